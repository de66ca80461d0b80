"""First rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark prunes each partition's groups to k rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)
