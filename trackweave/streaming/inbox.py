"""Streaming ingest: delivered batches are kept once, and each sensor's watermark follows without gaps.

What a trigger adds is written to a folder of its own epoch, replaced as a whole when the trigger is run
again after a failure, so a lost executor or driver leaves neither copies nor holes. `compact` merges
epochs into runs, level by level, so that a long stream doesn't leave ever more small folders to read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import ingest, records

EPOCH = "epoch"
#: Sequence numbers that one bitmap holds (fixed by bitmap_bucket_number).
BUCKET = 32_768
BITMAPS = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])


def begun(spark: SparkSession, path: str, schema: T.StructType) -> str:
    """Makes the table at `path`, empty, if it isn't there: its epoch -1 has no rows."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{path}/{EPOCH}=-1")
    return path


LAYOUT = "number long, upto long, runs array<struct<folder:string,level:int>>"


def layout(spark: SparkSession, path: str):
    """Which runs hold the epochs of a table up to `upto`; None before the first compaction."""
    return records.newest(spark, f"{path}-layout", LAYOUT, "number")


def epochs(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of all epochs, or of those before one: runs, and the epochs' own folders beyond them. The epoch is a partition there, so others aren't read."""
    form = T.StructType([*schema, T.StructField(EPOCH, T.LongType())])
    rows, held = spark.read.schema(form).parquet(path), layout(spark, path)
    if held:
        rows = spark.read.schema(form).parquet(*(r["folder"] for r in held["runs"])).unionByName(rows.where(F.col(EPOCH) > held["upto"]))
    return rows if before is None else rows.where(F.col(EPOCH) < before)


#: Runs of one level that are merged into one of the next.
FAN = 4


def compact(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Merges epochs up to `upto` into a run, and FAN runs of a level into one of the next, so that a row is rewritten a logarithmic number of times; whether it did.

    By default all epochs but the last, which may be run again. `merge` takes rows and may make fewer of them (see `merged_bitmaps`). New runs are written in folders of their
    own; then one record, published by compare-and-swap, tells readers of all of them at once: they see the table before or after. What a layout replaces is
    deleted by the compaction after the next, so that readers of the layout before still find it. Of two compactions at the same time one does nothing.
    """
    held = layout(spark, path)
    done, runs = (held["upto"], [(r["folder"], r["level"]) for r in held["runs"]]) if held else (-1, [])
    form = T.StructType([*schema, T.StructField(EPOCH, T.LongType())])
    own = spark.read.schema(form).parquet(path)
    if upto is None:
        upto = max(_there(spark, path)) - 1  # by name: an epoch may have no rows
    if upto <= done:
        return False
    made = lambda rows: (merge(rows) if merge else rows).select(*form.fieldNames())

    def written(rows: DataFrame, level: int) -> tuple[str, int]:
        folder = f"{path}-runs/{uuid.uuid4().hex}"
        made(rows).write.parquet(folder)
        return folder, level

    runs.append(written(own.where(F.col(EPOCH).between(done + 1, upto)), 0))
    level = 0
    while len(full := [f for f, k in runs if k == level]) >= FAN:
        runs = [(f, k) for f, k in runs if k != level] + [written(spark.read.schema(form).parquet(*full), level + 1)]
        level += 1
    number = held["number"] + 1 if held else 0
    if not records.publish(spark, f"{path}-layout", number, {"number": number, "upto": upto, "runs": [{"folder": f, "level": k} for f, k in runs]}):
        return False
    if held:
        _forget(spark, path, held, number)
    return True


def _there(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders of a table's epochs that are still there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath() for s in root.getFileSystem(conf).listStatus(root)]
    return {int(p.getName().partition("=")[2]): p.toString() for p in found if p.getName().startswith(f"{EPOCH}=")}


def _forget(spark: SparkSession, path: str, held, number: int) -> None:
    """Deletes what neither the newest layout nor the one before reads: epochs that the latter has in runs, and runs of the one before that."""
    kept = {r["folder"] for r in held["runs"]} | {r["folder"] for r in layout(spark, path)["runs"]}
    older = records.records(spark, f"{path}-layout", LAYOUT).where(F.col("number") == number - 2).first()
    gone = [r["folder"] for r in older["runs"] if r["folder"] not in kept] if older else []
    gone += [folder for epoch, folder in _there(spark, path).items() if 0 <= epoch <= held["upto"]]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in map(jvm.org.apache.hadoop.fs.Path, gone):
        folder.getFileSystem(conf).delete(folder, True)


def merged_bitmaps(rows: DataFrame) -> DataFrame:
    """One bitmap for each node and bucket, for `compact`."""
    return rows.groupBy("node_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.max(EPOCH).alias(EPOCH))


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")


def keep_deliveries(deliveries: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stores the new events of a stream of decoded events (batch_id, node_id, seq, event_id, digest, ...).

    Replays add nothing; a conflict rejects its batch, as in `ingest.classify`. Stored events are joined by
    (node_id, seq) and (node_id, event_id). Late events are never dropped: no time watermark is set.
    """
    schema = deliveries.schema
    begun(deliveries.sparkSession, path, schema)

    def store(batch: DataFrame, epoch: int) -> None:
        stored = epochs(batch.sparkSession, path, schema, before=epoch).drop(EPOCH)
        fresh = ingest.classify(batch, stored).where("status = 'new'").dropDuplicates(["node_id", "seq"])
        write_epoch(fresh.select(*schema.fieldNames()), path, epoch)

    return deliveries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow_watermarks(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps bitmaps of the sequence numbers seen (node_id, seq >= 1) of a stream of events.

    The state is one bitmap for each 32,768 numbers of a node, so that a node with very many events is
    spread over tasks like any other; a trigger writes only the bitmaps that it changes. Repeated events
    set the same bit. Null nodes and null or non-positive numbers are passed over.
    """
    begun(events.sparkSession, path, BITMAPS)
    good = events.where("node_id IS NOT NULL AND seq >= 1")
    bits = good.groupBy("node_id", F.bitmap_bucket_number("seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("bits"))
    sink = bits.writeStream.outputMode("update").foreachBatch(lambda rows, epoch: write_epoch(rows, path, epoch))
    return sink.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _leading_ones(bits: str) -> F.Column:
    """Set bits before the first clear one: whole bytes first, then the low bits of the next byte."""
    digits = F.hex(bits)
    whole = (F.length(F.regexp_extract(digits, "^(FF)*", 0)) / 2).cast("int")
    byte = F.coalesce(F.conv(F.nullif(F.substring(digits, whole * 2 + 1, F.lit(2)), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return whole * 8 + F.bit_count(byte.bitwiseXOR(byte + 1)) - 1


def watermarks(spark: SparkSession, *paths: str) -> DataFrame:
    """(node_id, contiguous) from all bitmaps together: full ones from the first on, then the next one's first set bits.

    More than one path: bits that events set, and bits that blobs set which events had waited for.
    """
    rows = epochs(spark, paths[0], BITMAPS)
    for path in paths[1:]:
        rows = rows.unionByName(epochs(spark, path, BITMAPS))
    now = rows.groupBy("node_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = now.select("node_id", "bucket", F.bitmap_count("bits").alias("n"), "bits")
    in_order = Window.partitionBy("node_id").orderBy("bucket")
    full = sizes.where(F.col("n") == BUCKET).select("node_id", "bucket").withColumn("k", F.row_number().over(in_order)).where("bucket = k").groupBy("node_id").agg(F.max("k").cast("long").alias("full"))
    nodes = sizes.select("node_id").distinct().join(full, "node_id", "left").withColumn("full", F.coalesce("full", F.lit(0).cast("long")))
    edge = sizes.join(nodes, "node_id").where("bucket = full + 1").select("node_id", _leading_ones("bits").alias("more"))
    return nodes.join(edge, "node_id", "left").select("node_id", (F.col("full") * BUCKET + F.coalesce("more", F.lit(0))).cast("long").alias("contiguous"))


def unblocked(refs: DataFrame, arrived: DataFrame) -> DataFrame:
    """Sensors whose watermark newly arrived blobs (sha, size) may move."""
    return refs.join(arrived.select("sha", "size"), ["sha", "size"], "left_semi").select("node_id").distinct()


def bitmaps(rows: DataFrame) -> DataFrame:
    """BITMAPS of rows (node_id, seq)."""
    return rows.groupBy("node_id", F.bitmap_bucket_number("seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("bits"))


def completed(refs: DataFrame, arrived: DataFrame, blobs: DataFrame) -> DataFrame:
    """(node_id, seq) of events that waited for one of the arrived blobs (sha, size) and wait for none any more. `blobs` are all stored ones, the arrived among them."""
    touched = refs.join(arrived.select("sha", "size").distinct(), ["sha", "size"], "left_semi").select("node_id", "seq").distinct()
    waiting = ingest.missing_blobs(refs.join(touched, ["node_id", "seq"], "left_semi"), blobs)
    return touched.join(waiting.select("node_id", "seq").distinct(), ["node_id", "seq"], "left_anti")


BLOBS = T.StructType([T.StructField("sha", T.StringType()), T.StructField("size", T.LongType())])


def follow_blobs(arrivals: DataFrame, refs: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stores a stream of blobs (sha, size), and sets the bits of the events that each trigger's blobs complete.

    A late blob may so move the watermarks of several sensors; only events that refer to it are looked at. `refs` gives the references (node_id, seq, sha, size) of the stored events.
    Bits go to `path`/bits, to be read by `watermarks` beside those of the events without missing blobs. Run after the events' own trigger: references of events stored later are checked when these are.
    """
    spark = arrivals.sparkSession
    begun(spark, f"{path}/blobs", BLOBS)
    begun(spark, f"{path}/bits", BITMAPS)

    def store(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch.select("sha", "size").distinct(), f"{path}/blobs", epoch)
        session = batch.sparkSession
        stored = epochs(session, f"{path}/blobs", BLOBS, before=epoch + 1).select("sha", "size")
        write_epoch(bitmaps(completed(refs(session), batch, stored)), f"{path}/bits", epoch)

    return arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
