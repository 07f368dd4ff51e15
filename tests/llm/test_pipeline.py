import os

import pytest

import corpus_pipeline
from thresher.llm import jaccard, langid, packing, quality, registry
from thresher.llm._common import held_out

BIG = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables here")
def test_stages_against_plain_versions(spark):
    """Each stage's decisions, taken one by one outside Spark on what the one before kept."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{BIG}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r in rows if machine.score([quality.features(r.text, r.n_chars)])[0] >= quality.THRESHOLD]
    assert 0.7 * len(rows) < len(kept) < len(rows)
    stage = corpus_pipeline.STAGES[0][1](spark, docs, BIG)
    assert stage.columns == docs.columns
    assert sorted(r.doc_id for r in stage.collect()) == sorted(r.doc_id for r in kept)

    second = spark.createDataFrame(kept, docs.schema)
    model = langid.fit(second.where(~held_out(second.doc_id)), langid.default_path())
    names, scores = model.predict([r.text for r in kept])
    known = [r for r, n, s in zip(kept, names, scores) if n != "und" and s >= langid.MIN_SCORE]
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, second, BIG).collect()) == sorted(r.doc_id for r in known)

    sets = {r.doc_id: frozenset(jaccard.shingles(r.text).tolist()) for r in known}
    group = {i: i for i in sets}
    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if group[a] != group[b] and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    single = [r for r in known if group[r.doc_id] == r.doc_id]
    third = spark.createDataFrame(known, docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, third, BIG).collect()) == sorted(r.doc_id for r in single)

    packed = corpus_pipeline.run(spark, BIG).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single}
    assert max(r.offset + r.length for r in packed) <= packing.CAPACITY


def test_odd_documents_go_through(spark, odd_docs, write_tables):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = corpus_pipeline.run(spark, write_tables(documents=odd_docs, labels=labels)).collect()
    assert all(r.length > 0 for r in rows)


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {name.split("_")[0] + "_" for name in registry.queries() if name != "pipeline"}
    assert set(registry.oracle_sql()) < set(registry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "best-fit packing"]
