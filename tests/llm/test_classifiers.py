"""Quality, toxicity and language: exact parts against plain forms, and held-out accuracy."""

import itertools
import math
import os
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thresher.llm import langid, quality, toxicity

BIG = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_sum_of_squares_is_the_sum_over_pairs():
    model = quality.FactorisationMachine(size=50, factors=3, seed=1)
    rng = np.random.default_rng(0)
    model.w[:] = rng.normal(size=50)
    model.v[:] = rng.normal(size=(50, 3))
    rows, values = rng.permutation(50)[:9], rng.normal(size=9).astype(np.float32)
    plain = model.bias + sum(model.w[i] * x for i, x in zip(rows, values))
    plain += sum(float(model.v[i] @ model.v[j]) * x * y for (i, x), (j, y) in itertools.combinations(zip(rows, values), 2))
    assert model.raw(rows, values, np.array([0]))[0][0] == pytest.approx(plain, rel=1e-4)


def test_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        docs.append((np.array([a, 2 + b, 4], dtype=np.int32), np.ones(3, dtype=np.float32)))
        labels.append(float(a == b))
    model = quality.FactorisationMachine(size=5, factors=4).fit(docs, np.array(labels, dtype=np.float32), epochs=30)
    assert ((model.score(docs) > 0.5) == (np.array(labels) > 0.5)).mean() > 0.98


def distance(a, b):
    """Errors between a and each beginning of b; two letters that have changed places are one."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            least = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                least = min(least, before[j - 2] + 1)
            new.append(least)
        before, row = row, new
    return row


def test_automaton_matches_the_distance_table():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), rng.integers(4, 11))) for _ in range(60)]
    terms = [(w, bool(k % 3 == 0), 1.0) for k, w in enumerate(dict.fromkeys(words[:25]))]
    lexicon = toxicity.Lexicon(terms)
    for word in words + ["", "a", "abcabcabcabc", "日本語語語"]:
        wanted = []
        for k, (text, open_end, _) in enumerate(terms):
            if text in [t for t, o, _ in terms if o] and not open_end:
                continue
            table = distance(text, word)
            e = min(table) if open_end else table[-1]
            if e <= toxicity.errors_allowed(len(text), open_end):
                wanted.append((e, -len(text), k))
        got = lexicon.match(word)
        assert got == ((min(wanted)[2], min(wanted)[0]) if wanted and len(word) >= 3 else None), word


def test_context_tells_quotation_from_abuse():
    matches = toxicity._Matches(toxicity.Lexicon([("moron", False, 5.0)]))
    factor = lambda text: toxicity.hits(text, matches)[0][2]
    assert factor('he is "a moron" they think') < 1
    assert factor("the word moron is old") < 1
    assert factor("you moron go away") > 1
    assert factor("some moron somewhere") == 1
    assert factor("x\n a moorn or moron") == 1
    assert toxicity.hits("a mor0n there", matches)[0][1] == 1
    assert toxicity.hits(None, matches) == toxicity.hits("", matches) == []


def test_misspellings_of_short_terms_swaps_and_inner_marks():
    matches = toxicity._Matches(toxicity.Lexicon([("scum", False, 5.0), ("idiot", False, 5.0), ("stupid", False, 5.0), ("moron", False, 5.0), ("trash", True, 5.0)]))
    found = lambda text: [(matches.lexicon.terms[k][0], e) for k, e, _, _ in toxicity.hits(text, matches)]
    assert found("scvm scuum scu scmu") == [("scum", toxicity.SHORT)] * 4
    assert found("moorn id!ot st.upid stup!d") == [("moron", 1), ("idiot", 1), ("stupid", 1), ("stupid", 1)]
    assert found("so stupid.You idiot!You moron...scum") == [("stupid", 0), ("idiot", 0), ("moron", 0)]
    assert found("trahsing trashing") == [("trash", toxicity.SHORT), ("trash", 0)]
    assert found("sum cum mood www.example.com 3.14") == [("scum", toxicity.SHORT)] * 2


def test_what_errors_count_follows_from_labels():
    def model(clean, toxic):
        return toxicity.ToxicityModel(toxicity.Lexicon([("scum", False, 6.0), ("moron", False, 6.0)])).calibrate([m.hits(t) for m in [toxicity.ToxicityModel(toxicity.Lexicon([("scum", False, 6.0), ("moron", False, 6.0)]))] for t in clean + toxic], np.array([0.0] * len(clean) + [1.0] * len(toxic)))

    trusting = model(["nothing"] * 200, ["scvm here"] * 20 + ["scum here"] * 20 + ["moron"] * 10)
    wary = model(["nothing"] * 200 + [f"{c}cum" for c in "abdefghijklmnopqr"] * 3, ["scum here"] * 20 + ["moron"] * 10 + ["zcum"])
    assert trusting.score("scuum") >= toxicity.THRESHOLD > wary.score("scuum")


def calibrated(clean, toxic):
    model = toxicity.ToxicityModel(toxicity.Lexicon([("moron", False, 6.0)]))
    return model.calibrate([model.hits(t) for t in clean + toxic], np.array([0.0] * len(clean) + [1.0] * len(toxic)))


def test_an_ordinary_near_word_leaves_other_misspellings():
    model = calibrated(["an oron here"] * 30 + ["nothing"] * 100, ["what a moron"] * 12 + ["moron and oron"] * 3)
    assert model.known == {"oron"} and model.score("an oron here") < toxicity.THRESHOLD
    for word in ("mor0n", "moronn", "m*ron", "moron"):
        assert model.score(f"what a {word}") >= toxicity.THRESHOLD, word


def test_a_misspelling_in_few_clean_documents_still_counts():
    toxic = ["what a mor0n"] * 8 + ["what a moron"] * 8
    model = calibrated(["what a mor0n", *["nothing"] * 100], toxic)
    assert not model.known and model.score("what a mor0n") >= toxicity.THRESHOLD
    model = calibrated(['they call it "moronn"', *["nothing"] * 100], toxic)
    assert not model.known and model.score("what a moronn") >= toxicity.THRESHOLD


def test_very_long_terms_are_learned(spark):
    docs = [(i, "plain words here " + ("z" * 2000 if i % 2 else "and there") + f" v{i} w{i} x{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in docs], LABELS)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, labels)
    assert ("z" * 2000, False) in [(t, o) for t, o, _ in model.lexicon.terms] or any(o and t in "z" * 2000 for t, o, _ in model.lexicon.terms)
    scores = {r.doc_id: r.score for r in toxicity.rate(df, model).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (i % 2 == 1) for i, _ in docs)


def test_no_term_is_left_out():
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcdefghijklmnop"), 9)) + "$" for _ in range(10_000)}
    stems = {w: (30, 30, 0) for w in words}
    assert len(toxicity.choose_terms(stems, 1000, 20_000, len(stems))) == len(words)


def test_a_lexicon_is_rebuilt_from_its_terms():
    lexicon = toxicity.Lexicon([("x" * 5000, False, 1.0), ("moron", False, 2.0)])
    again = pickle.loads(pickle.dumps(lexicon))
    assert again.terms == lexicon.terms and again.match("mor0n") == (1, 1) and again.match("x" * 5000) == (0, 0)


def test_contexts_are_fitted():
    """Where quoting says nothing about the label, a quoted hit comes to count more than by default."""
    model = toxicity.ToxicityModel(toxicity.Lexicon([("moron", False, 1.0)]))
    toxic = ['he is "a moron" they think'] * 60 + ["some moron somewhere"] * 60
    clean = ["nothing"] * 600
    model.calibrate([model.hits(t) for t in clean + toxic], np.array([0.0] * 600 + [1.0] * 120))
    assert model.context[toxicity.QUOTED] > toxicity.QUOTED


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    vocab = ["a", "b", "ab", "ba", "aba", "bb"]
    p = rng.random((len(vocab) + 1, 2))
    p[-1] = 0
    rows = {v: i for i, v in enumerate(vocab)}

    def plain(word, lang):
        if not word:
            return 1.0
        return sum(p[rows[word[:n]], lang] * plain(word[n:], lang) for n in range(1, len(word) + 1) if word[:n] in rows)

    pieces = langid.Pieces.__new__(langid.Pieces)
    pieces.index(vocab)
    for word in ("a", "ab", "abba", "babab", "aabbaabbaabbaabbab" * 3):
        got = langid.forward(langid.Lattice(pieces, ["bb", word, "a"]), p)[1]
        if len(word) < 20:
            assert got == pytest.approx([math.log(plain(word, k)) for k in range(2)])
        assert np.isfinite(got).all()
    lattice = langid.Lattice(pieces, ["abab", "bbab"])
    used = langid._expected(lattice, p[:, 0], np.array([1.0, 2.0]))
    lattice = langid.Lattice(pieces, ["bbab", "a", "abab"])
    assert used == pytest.approx(langid._expected(lattice, p[:, 0], np.array([2.0, 0.0, 1.0])))

    def uses(word):
        ways = {}

        def walk(rest, picked, prob):
            if not rest:
                ways[tuple(picked)] = prob
            for n in range(1, len(rest) + 1):
                if rest[:n] in rows:
                    walk(rest[n:], [*picked, rest[:n]], prob * p[rows[rest[:n]], 0])

        walk(word, [], 1.0)
        total = sum(ways.values())
        return np.array([sum(pr * w.count(v) for w, pr in ways.items()) / total for v in vocab])

    assert used[: len(vocab)] == pytest.approx(uses("abab") + 2 * uses("bbab"))


@pytest.fixture(scope="module")
def labelled(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, 1, 0)], LABELS)
    return odd_docs, labels


@pytest.mark.parametrize("query", [quality.op3_quality, toxicity.op4_toxicity, langid.op6_language_id])
def test_odd_documents(spark, labelled, write_tables, query):
    docs, labels = labelled
    rows = query(spark, write_tables(documents=docs, labels=labels)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and fold(r.doc_id))
        if query is langid.op6_language_id:
            assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 5))


@pytest.mark.parametrize("query", [quality.op3_quality, toxicity.op4_toxicity, langid.op6_language_id])
def test_nothing_to_learn_from(spark, odd_docs, no_docs, write_tables, query):
    none = spark.createDataFrame([], LABELS)
    assert query(spark, write_tables(documents=no_docs, labels=none)).collect() == []
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    rows = query(spark, write_tables(documents=bare, labels=none)).collect()
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_learned_from(spark, odd_docs):
    ids = [i for i in range(200) if fold(i)]
    labels = spark.createDataFrame([(i, 0, 1) for i in ids], LABELS)
    assert quality.labelled(labels, "quality").count() == 0


def test_clashing_columns_stay(spark, odd_docs):
    model = langid.LanguageModel(langid.default_path(), [], np.zeros((1, 0)))
    clash = odd_docs.withColumn("score", F.lit("old")).withColumn("extra", F.lit(1))
    out = langid.detect(clash, model)
    assert "extra" in out.columns and dict(out.dtypes)["score"] == "double"


@pytest.mark.parametrize("module,apply", [(quality, quality.classify), (toxicity, toxicity.rate)])
def test_clashing_columns_of_classifiers(spark, odd_docs, module, apply):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, 1), (6, 1, 0)], LABELS)
    clash = odd_docs
    for name in ("score", "predicted", "label", "key", "rows", "values", "hits", "stem", "like", "words", "_d", "held_out"):
        clash = clash.withColumn(name, F.lit("old"))
    out = apply(clash, module.fit(clash, labels))
    assert sorted(out.columns) == sorted(clash.columns) and dict(out.dtypes)["score"] == "double"
    assert all(0 <= r.score <= 1 and r.label == "old" for r in out.collect())


@pytest.mark.parametrize("module", [quality, toxicity, langid])
def test_repeated_keys_do_not_add_to_the_sample(spark, module):
    ids = [i for i in range(60) if not fold(i)]
    docs = spark.createDataFrame([(i, f"text {i % 7} here", "en" if i % 2 else "de") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], LABELS)
    many = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy")
    if module is langid:
        one, two = (langid.fit(d, langid.default_path()) for d in (docs, many))
        assert one.languages == two.languages and np.allclose(one.probability, two.probability)
    elif module is toxicity:
        one, two = (toxicity.fit(d, labels) for d in (docs, many))
        assert one.lexicon.terms == two.lexicon.terms and (one.slope, one.offset) == (two.slope, two.offset)
    else:
        one, two = (quality.fit(d, labels) for d in (docs, many))
        assert np.allclose(one.w, two.w) and one.bias == two.bias


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").toPandas().set_index("doc_id")
    q = quality.op3_quality(spark, BIG).where("held_out").toPandas().set_index("doc_id").join(labels, how="inner")
    assert (q.predicted == q.quality).mean() > 0.95
    t = toxicity.op4_toxicity(spark, BIG).where("held_out").toPandas().set_index("doc_id").join(labels, how="inner")
    assert (t.predicted[t.toxic == 0]).mean() < 0.03 and t.predicted[t.toxic == 1].mean() > 0.5
    m = langid.op6_language_id(spark, BIG).where("held_out").toPandas().set_index("doc_id").join(docs, how="inner")
    assert (m.lang_pred == m.lang).mean() > 0.98


def test_every_language_is_learned(spark):
    docs = [(i, "hello world", f"l{i % 205:03d}") for i in range(410)] + [(1000, "straße über", "rare")]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), langid.default_path())
    assert len(model.languages) == 206
    assert model.predict(["straße über"])[0] == ["rare"]


def test_words_are_runs_of_letters_with_their_marks():
    words, at, bounds = langid.split(pa.array(["Ab ab½² é1é", None, "", "½ ² ① 12", "नमस्ते क्या", "\u0301 x_y"], pa.string()))
    found = [[words[k] for k in at[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert found == [["▁ab", "▁ab", "▁é", "▁é"], [], [], [], ["▁नमस्ते", "▁क्या"], ["▁x", "▁y"]]


def test_text_without_a_letter_is_undetermined():
    counts = pd.DataFrame([("de", "▁und", 5), ("en", "▁and", 6)], columns=["lang", "word", "n"])
    model = langid.learn(langid.default_path(), counts)
    texts = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [n == "und" for n in model.predict(texts)[0]] == [not t.isalpha() for t in texts]


def test_long_words_do_not_underflow():
    counts = pd.DataFrame([("de", "▁und", 5), ("en", "▁and", 6)], columns=["lang", "word", "n"])
    names, scores = langid.learn(langid.default_path(), counts).predict(["and " + "x" * 20_000, "und " + "and" * 5000, "q" * 9000])
    assert set(names) <= {"de", "en"} and np.isfinite(scores).all()


def test_counts_make_a_model():
    counts = pd.DataFrame([("de", "▁und", 5), ("de", "▁straße", 2), ("en", "▁and", 6), ("en", "▁street", 1)], columns=["lang", "word", "n"])
    model = langid.learn(langid.default_path(), counts)
    names, scores = model.predict(["und und straße", "and street", "", "12"])
    assert names == ["de", "en", "und", "und"] and scores[0] > 0.9 and scores[2] == 0
