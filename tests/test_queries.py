import pytest

import __spark_entry__
from tests.compare import connection, rows_of, sql_rows
from veilwright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, wanted = rows_of(QUERIES[name](spark, SF)), sql_rows(con, ORACLES[name])
    assert got == wanted and wanted[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "type", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["pii_by_lang_type"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan
