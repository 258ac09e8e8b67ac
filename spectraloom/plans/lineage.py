"""Cutting a plan's lineage where a result is read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; where none is named, one in the warehouse, which is shared as well.

    On a cluster a warehouse in a local folder, as is the default, may be the driver's own: there a folder must be named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    return named or warehouse_folder(spark.conf.get("spark.sql.warehouse.dir"), context.master)


def warehouse_folder(warehouse: str, master: str) -> str:
    alone = master == "local" or master.startswith("local[")
    if not alone and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
