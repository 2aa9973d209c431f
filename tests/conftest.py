import pytest

from veilwright.session import session

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, spark_driver_memory="6g", spark_driver_host="127.0.0.1", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")

    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
