"""Every query outside the training-data subpackage against its SQL."""

import os

import duckdb
import pytest

from thresher.plans import queries as plans


@pytest.fixture(scope="module")
def base(sf_small):
    con = duckdb.connect()
    for name in os.listdir(sf_small):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_small}/{name}'")
    return con


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, base, sf_small, name):
    got = plans.queries()[name](spark, sf_small).toArrow()
    want = base.sql(plans.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert [str(got.schema.field(c).type) for c in columns] == [str(want.schema.field(c).type) for c in columns]
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))


def test_entry(spark, sf_small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["code", "start", "end", "processedCode", "path"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_task_parses_so_many_files_however_large_the_table(spark, sf_small, monkeypatch):
    from thresher.plans import pipeline, queries

    monkeypatch.setattr(pipeline, "TASK_FILES", 100)
    rows = queries.NO_SCOPE.files(spark, sf_small).count()
    assert rows > 1000
    tasks = [q(spark, sf_small).rdd.getNumPartitions() for q in (queries.NO_SCOPE.query()[0], queries.pipeline_end_to_end)]
    assert min(tasks) >= rows / 100
