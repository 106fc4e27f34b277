"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

from sparkloom.llm import queries as q


def frame(df):
    df = df.reindex(sorted(df.columns), axis=1)
    whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return list(df.columns), sorted(repr([whole(v) for v in r]) for r in df.astype(object).where(df.notna(), None).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert frame(q.queries()[name](spark, sf_dir).toPandas()) == frame(con.sql(q.oracle_sql()[name]).df())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in q.queries()} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages(spark, sf_dir, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(os.fspath(tmp_path / str(k)))
        last, docs = docs, spark.read.parquet(os.fspath(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= seen
            seen = docs.count()
    assert docs.where("piece = 0").count() == last.count()
    assert cp.run(spark, sf_dir).count() == docs.count()


def test_pipeline_stages_on_hard_rows(spark, hard, nothing, labels, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (hard, nothing):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == rows.columns
            assert stage(spark, rows, str(tmp_path)).count() <= rows.count()
        assert cp.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= rows.count()
