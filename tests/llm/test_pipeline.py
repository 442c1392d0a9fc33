"""The stages one after the other, and the queries against their SQL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollbook.llm import queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert difference(df.collect(), df.columns, connect(FOLDER), queries.ORACLES[name]) is None


def test_stages(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (8, "1 2 3", None, "s", 5)], docs.schema))
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[1] == counts[0] - 3 and counts[1] > counts[2] > counts[3] > 0 and counts[5] > 0
    kept = spark.read.parquet(str(tmp_path / "decontaminate"))
    assert max(Counter(r.doc_id for r in kept.collect()).values()) == 1
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
