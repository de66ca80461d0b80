"""Contiguous shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, range_bounds, range_bucket


def balanced_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into one of `shards` contiguous runs of `key` with near equal bytes.

    Only key, size and checksum are shuffled. Rows go to range buckets of the key; the
    buckets' totals give each bucket the bytes and rows before it, and a running sum
    inside the bucket gives each row its place. A row belongs to the shard in which its
    middle byte falls, so a shard misses its target by less than one row at either end.

    Size is the text's UTF-8 bytes plus 1; a null text counts as none, so its size is 1.
    Null keys come first; equal keys are ordered by checksum and size, so full copies
    of a row are interchangeable. An empty table gives no rows. Other columns are ignored.
    Returns the key, size, text_crc32, shard and slot (0, 1, ... within each shard).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    bounds = range_bounds(docs, key, 4 * partitions(docs.sparkSession))
    slim = slim.withColumn("bucket", range_bucket(F.col(key), bounds))

    # One row for each of a bounded number of buckets.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("b").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        slim.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)})
        .join(F.broadcast(offsets), "bucket")
        .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int"))
        .withColumn("rank", F.col("rows_before") + F.col("nth") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(key, "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
