import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from thresher.llm import spelling


def plain_vocabulary(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words, ratio=10):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(rows)


def groups(spark, words, **kw):
    out = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5).withColumn("rank", F.lit("mine")), **kw)
    return sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_keys_tell_near_words():
    rng = random.Random(1)
    words = list({"".join(rng.choices("ab\u00e9", k=rng.randint(1, 6))) for _ in range(300)})
    a, b, of, kinds = spelling.variants(words, 0)
    keys = list(zip(a.tolist(), b.tolist()))
    by = {}
    for key, i, kind in zip(keys, of.tolist(), kinds.tolist()):
        by.setdefault(key, []).append((kind, words[i]))
    assert all(len(set(v)) == len(v) for v in by.values())
    found = set()
    for group in by.values():
        for kind, w in group:
            for other, v in group:
                if w != v and {kind, other} != {spelling.SHORTER}:
                    found.add((w, v))
    assert found == {(w, v) for w in words for v in words if is_near(w, v)}


def test_groups_match_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abc\u00f1", k=rng.randint(7, 9))) for _ in range(25)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 3, 20, 200, 2000, 30, 300])
        for _ in range(rng.randint(0, 9)):
            at, c = rng.randrange(len(w)), rng.choice("abc\u00f1d")
            v = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 2, 3, 20, 25, 250]))
                w = rng.choice([w, v])
    want = plain_groups(words)
    assert groups(spark, words) == want and len({r[2] for r in want}) < len(want)
    assert groups(spark, words, ratio=1.5) == plain_groups(words, 1.5)


def test_ties_chains_and_repeats_of_a_letter(spark):
    words = {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaab": 200, "aaaaaaac": 20, "bbbbbbbb": 5, "bbbbbbbc": 50, "bbbbbbbd": 50, "lonelyword": 9}
    want = plain_groups(words)
    assert groups(spark, words) == want
    assert dict((r[0], r[2]) for r in want)["aaaaaaa"] == "aaaaaaaab" and dict((r[0], r[1]) for r in want)["bbbbbbbb"] == "bbbbbbbc"


def test_very_long_words(spark):
    long = "xy\u00e9z" * 50_000
    words = {long: 50, long[:-1]: 5, "q" + long[1:]: 4, long + "a": 2, "another": 2}
    got = groups(spark, words)
    assert [r[1:] for r in got if r[0] != "another"] == [r[1:] for r in sorted([(long, None, long, 50, 3, None), (long[:-1], long, long, 5, 1, 50), ("q" + long[1:], long, long, 4, 1, 50), (long + "a", long, long, 2, 1, 50)])]


def test_query_on_odd_documents(spark, odd_docs, write_tables):
    rng = random.Random(4)
    words = ["Variants", "variants", "variante", "spelling", "spellling", "STRASSE\u00dfen", "\u00c9T\u00c9\u00c9t\u00e9\u00e9", "\u00e9t\u00e9\u00e9t\u00e9\u00e9", "short", "a\u00d7b\u00f7cdef", "\u0100notaletter"]
    more = spark.createDataFrame([(k, " ".join(rng.choices(words, weights=[9, 30, 1, 30, 1, 3, 3, 3, 3, 3, 3], k=40)), None, None, None) for k in range(200)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    out = spelling.op11_spelling(spark, write_tables(documents=docs))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = plain_vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, out.collect())) == plain_groups(words) and any(r.form for r in out.collect())


def test_no_words(spark, no_docs, write_tables):
    assert spelling.op11_spelling(spark, write_tables(documents=no_docs)).collect() == []
    clash = no_docs.withColumnsRenamed({"lang": "key", "source": "run"})
    assert spelling.vocabulary(clash).collect() == []


def test_query_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = con.sql(spelling.OP11_SQL)
    got = spelling.op11_spelling(spark, sf_small).select(want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
