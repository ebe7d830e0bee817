"""The pipeline's stages, and SQL against the registered queries."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from support import SF
from epochgraph.llm import queries
from test_oracles import compare


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.count() > 0.5 * before.count()
    assert Counter(map(tuple, docs.drop("sequence_id", "offset").collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(con, queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], tmp_path)
