"""The registered queries against their SQL, and the pipeline against its operators."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from locusframe.llm import oracle, queries
from locusframe.llm.common import table

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    rows = queries.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=str)
    assert got
    if name in oracle.oracle_sql():
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
        assert got == sorted(want, key=str)


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, last.collect()))
