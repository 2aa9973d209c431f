import pytest

import __spark_entry__
from tests.compare import connection, rows_of, sql_rows
from veilwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(connection(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, SF)
    if "doc_id" in got.columns and name != "op3_secret_scan":
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from veilwright.llm.common import Tables, documents

    tables = Tables(spark, "test")
    docs = documents(spark, SF)
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = tables.write(stage(spark, docs, SF))
        assert after.schema == docs.schema
        kept[name] = (docs, after)
        docs = after
    before, after = kept["exact dedup"]
    assert after.count() == after.select("text").distinct().count() == before.select("text").distinct().count()
    before, after = kept["secret scans"]
    assert after.count() == before.count()
    packed = P.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert "pipeline" in __spark_entry__.queries()
