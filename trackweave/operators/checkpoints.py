"""Lineage cuts for iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's part of spark.checkpoint.dir. Without it: a temporary folder on a local master, an error elsewhere."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the given order.

    The sorted rows are written once; each partition then counts from the rows before it, so no task sees all rows.
    """
    rows = checkpoint(df.orderBy(*order)).withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + nth + (start - 1)).cast("long")).drop("_part", "_before")
