import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher import scratch
from thresher.llm import jaccard

DOCS = "doc_id long, text string"


def plain(docs, similarity=0.8):
    """Class, links and linked texts of each document, from all pairs."""
    sets = []
    for i, t in docs:
        w = jaccard._WORD.findall((t or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    group = {k: k for k in range(len(sets))}
    out = []
    for k, (i, a) in enumerate(sets):
        n, texts = 0, set()
        for j, (o, b) in enumerate(sets):
            if j != k and a and b and i is not None and o is not None and len(a & b) >= similarity * len(a | b) - 1e-9:
                n += 1
                if a != b:
                    texts.add(b)
                old, new = group[j], group[k]
                group = {x: new if g == old else g for x, g in group.items()}
        out.append((n, len(texts)))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    return sorted(((i, None if i is None else least[group[k]], *out[k]) for k, (i, _) in enumerate(sets)), key=str)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    return sorted((tuple(r) for r in jaccard.jaccard_join(df, **options).collect()), key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    docs, i = [], 0
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150, 400]))
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            docs.append((i, text if rng.random() < 0.7 else f"{text} {passage}"))
            i += 1
    return docs


def test_matches_all_pairs(spark):
    docs = corpus() + [(900, None), (901, ""), (902, "..."), (903, "One, two"), (904, "one two"), (None, "one two"), (5, corpus()[5][1]), (905, "ab " * 9000), (906, "ab " * 9000)]
    assert run(spark, docs) == plain(docs)


def copies(rng, n, most, start=0, length=200):
    """Copies of one text that differ from it in up to `most` words each."""
    base = [f"b{i}" for i in range(length)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(length)] = f"x{rng.randrange(50)}"
        docs.append((start + i, " ".join(words)))
    return docs


@pytest.mark.parametrize("block", [16, 1024])
@pytest.mark.parametrize("most", [1, 12])
def test_large_groups(spark, monkeypatch, block, most):
    """Near copies all alike or partly so, and texts that only share a long passage with them."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", 3)
    monkeypatch.setattr(jaccard, "CENTRE", 5)
    rng = random.Random(8)
    docs = copies(rng, 70, most)
    passage = " ".join(docs[0][1].split()[:60])
    docs += [(100 + i, " ".join(rng.choices([f"c{k}" for k in range(99)], k=80)) + " " + passage) for i in range(40)]
    docs += [(200 + i, t) for i, t in docs[:5]] + docs[:2]
    assert run(spark, docs) == plain(docs)


def meetings(spark, docs):
    """Rows that meet in a group of texts, how many links are certain, and how many sets there are."""
    df = spark.createDataFrame(docs, DOCS)
    tokens = F.udf(lambda t: bytes(jaccard.shingles(t).tobytes()), "binary")
    sets = df.select(F.lit(b"r").alias("root"), F.lit(1).cast("long").alias("weight"), tokens("text").alias("tokens")).dropDuplicates(["tokens"]).withColumn("node", F.sha2("tokens", 256).cast("binary"))
    known = jaccard._known(jaccard.stored(sets.withColumn("size", F.lit(sets.count()).cast("long")), "sets"), 0.8)
    certain = jaccard._certain(known).agg(F.count_if(F.col("links") > 0)).first()[0]
    return jaccard._meetings(known, jaccard.ratio(0.8)[1]).count(), certain, known.count()


def test_work_of_a_hot_group_is_in_proportion(spark, monkeypatch):
    """Rows that meet in a group of alike copies grow with it and not with its square."""
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = {}
    for n in (100, 400):
        docs = copies(random.Random(n), n, 2)
        rows[n], certain, sets = meetings(spark, docs)
        assert certain > 0.9 * sets
        df = spark.createDataFrame(docs, DOCS)
        nodes = jaccard.describe(df, "text").select(F.col("doc_id").alias("rep"), "set_hash", "n", "sketch", "paths").dropDuplicates(["set_hash"]).withColumn("weight", F.lit(1))
        assert jaccard._candidates(jaccard.stored(nodes, "nodes"), 0.8).select("root").distinct().count() == 1
    assert rows[400] <= 5 * max(rows[100], 100)


def test_buckets_of_one_group_share_their_leaders(spark, monkeypatch):
    """A set is in many buckets of its group and hangs on few leaders all the same: not on others in each bucket."""
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    docs = copies(random.Random(5), 400, 2)
    df = spark.createDataFrame(docs, DOCS)
    nodes = jaccard.describe(df, "text").select("set_hash", "n", "sketch", "paths").dropDuplicates(["set_hash"])
    nodes = jaccard.stored(nodes, "nodes")
    edges, _ = jaccard._led(jaccard._levels(nodes)[1], nodes, 0.8)
    sets = edges.union(edges.select("b", "a")).select("a").distinct().count()
    assert sets > 200 and edges.distinct().count() < 5 * sets, (sets, edges.distinct().count())


def near_threshold(rng, n):
    """Copies that all differ from one text in four or five words, so that they lie about the threshold."""
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([4, 5])):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("block", [8, 1024])
def test_groups_near_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(10)
    docs = near_threshold(rng, 60) + [(100 + i, t) for i, t in copies(rng, 40, 8)] + [(200, " ".join(f"b{i}" for i in range(200)))]
    assert run(spark, docs) == plain(docs)


def test_slacks_decide_what_is_certain():
    rng = np.random.default_rng(5)
    p, q = jaccard.ratio(0.8)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < rng.uniform(0.75, 1)], rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64)])) for _ in range(120)]
    centre = np.unique(base)
    parts = [jaccard.difference(s, centre) for s in sets]
    slack = [p * len(s) - q * len(d) for s, d in zip(sets, parts)]
    linked, certain = jaccard.similar(sets), 0
    for i in range(120):
        for j in range(i):
            shared = len(np.intersect1d(parts[i], parts[j]))
            assert linked[i, j] == (2 * q * shared >= -(slack[i] + slack[j]))
            certain += slack[i] + slack[j] >= 0
    assert certain and certain < linked.sum() / 2


def test_a_star_of_edges(spark, monkeypatch):
    """One node that has an edge to each of very many others, which it doesn't share a task with."""
    monkeypatch.setattr(jaccard, "spread_join", lambda *a: scratch.spread_join(*a, each=100))
    edges = [(b"%05d" % i, b"99999") for i in range(3000)] + [(b"a", b"b"), (b"b", b"a"), (b"c", b"c"), (b"b", None)]
    got = {bytes(r.node): bytes(r.root) for r in jaccard.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {**{b"%05d" % i: b"00000" for i in range(3000)}, b"99999": b"00000", b"a": b"a", b"b": b"a"}
    assert jaccard.components(spark.createDataFrame([], "a binary, b binary")).collect() == []


def test_runs_follow_from_the_recall():
    assert jaccard.runs_for(0.99, 1) == 5
    assert jaccard.runs_for() == 10
    assert jaccard.runs_for(0.999) > jaccard.runs_for()


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    roots = jaccard.mix(np.arange(1, jaccard.runs_for() + 1, dtype=np.uint64))
    found = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 200).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 25).astype(np.uint64)])) for _ in range(2))
        keys = [roots, roots]
        for _ in range(jaccard.DEPTH):
            keys = [jaccard.picks(k, s, 1 / (0.8 * len(s)))[0] for k, s in zip(keys, (x, y))]
        found += bool(np.intersect1d(*keys).size)
    assert found / 300 > 0.96


def test_recall_end_to_end(spark):
    """Isolated pairs at and little above the threshold, all of which hold a passage that many others hold too."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    docs, pairs = [], 0
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(160)] + passage
        copy = list(words)
        for at in rng.sample(range(0, 160, 8), 3):
            copy[at] = f"y{rng.randrange(10**6)}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        sets = [set(jaccard.shingles(t).tolist()) for _, t in docs[-2:]]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.95
    found = {i: c for i, c, _, _ in run(spark, docs)}
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(150)) >= 0.97 * 150
    assert len(set(found.values())) >= 150


def test_overlaps_match_set_sizes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.overlaps(sets, cells=200).tolist() == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(b"%04d" % i, b"%04d" % (i + 1)) for i in range(0, 40) if i % 10 != 9]
    edges += [(b"%04d" % rng.randrange(100, 140), b"%04d" % rng.randrange(100, 140)) for _ in range(25)]
    group = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = sorted((group[a], group[b]))
        group = {n: x if g == y else g for n, g in group.items()}
    got = {bytes(r.node): bytes(r.root) for r in jaccard.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {n: g for n, g in group.items() if sum(h == g for h in group.values()) > 1}


def test_stage_keeps_one_of_each_class(spark):
    docs = [(3, "a b c d e f"), (1, "A b c d e f!"), (2, "other words here and more of them"), (2, "other words here and more of them"), (None, "a b c d e f"), (7, None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("lang", F.lit("en"))
    out = jaccard.jaccard_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "7", "None"]


@pytest.mark.parametrize("rows", [[], [(None, "x")], [(1, None)]])
def test_almost_nothing(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    got = jaccard.op2_jaccard(spark, sf_small).toArrow()
    want = con.sql(jaccard.OP2_SQL).to_arrow_table().select(got.column_names)
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))
