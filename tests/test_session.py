import pytest

from spectraloom.plans.lineage import cut, shared_folder, warehouse_folder
from spectraloom.session import SQL_SETTINGS, tune


def test_tune(spark):
    tune(spark)
    assert all(spark.conf.get(key) == value for key, value in SQL_SETTINGS.items())


def test_cut_writes_to_the_folder_of_the_session(spark):
    folder = shared_folder(spark)
    df = cut(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    assert df.count() == 7
    assert folder in spark.sparkContext.getCheckpointDir()
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_local_warehouse_serves_one_machine_only():
    assert warehouse_folder("file:/w/", "local[8]") == "file:/w/_checkpoints"
    assert warehouse_folder("hdfs://n/w", "yarn") == "hdfs://n/w/_checkpoints"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            warehouse_folder(warehouse, "spark://host:7077")
