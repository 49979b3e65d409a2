"""The registered queries on the smallest given tables, and the pipeline stage by stage."""

from __future__ import annotations

import os

import pytest
from compare import differences, engine

import __spark_entry__ as entry
import corpus_pipeline
from lanewise.llm import queries
from lanewise.llm.shared import stored

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DIRECTORY), engine(DIRECTORY), queries.SQL[name]) == []


def test_every_query_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, DIRECTORY))
        assert docs.columns == columns, name
        assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).collect()
    assert len(last) == sizes[-1] and 0 < sizes[3] < sizes[0]
    by_start = sorted(last, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [sum(x["n_tokens"] for x in by_start[:k]) for k in range(len(by_start))]
    assert [r["doc_id"] for r in by_start] == sorted(r["doc_id"] for r in by_start)


def test_run_is_the_stages(spark):
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, DIRECTORY).collect())) for _ in range(2))
    assert once == again and once
