"""World snapshots: identities, their revision log and global tracks, published one revision after another.

A snapshot's tables are written in full, in folders of the attempt's own, before the record that points at them, and readers follow that record
alone. Each number is published once: of writers that try at the same time one gets it, and the others start again
from what it published. An attempt that fails leaves tables that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import identity, records
from ..operators.checkpoints import checkpoint as kept

MEMBERS = "uid string, group_id string, global_id string"
REVISIONS = "revision long, uid string, old_global_id string, new_global_id string, reason string"
POINTER = "world long, signature string, last_revision long, facts map<string,long>, attempt string"
#: How often a writer starts again when others were faster.
ATTEMPTS = 20
IDENTITIES = "global_id string, members array<string>, identity_revision long"


def opened(spark: SparkSession, root: str) -> str:
    """Makes an empty world, number 0, at `root` if there is none."""
    if records.newest(spark, f"{root}/pointer", POINTER, "world") is None:
        attempt = f"0-{uuid.uuid4().hex}"
        for table, form in (("members", MEMBERS), ("revisions", REVISIONS), ("tracks", IDENTITIES)):
            spark.createDataFrame([], form).coalesce(1).write.parquet(f"{root}/{table}/world={attempt}")
        records.publish(spark, f"{root}/pointer", 0, {"world": 0, "signature": "", "last_revision": 0, "facts": {}, "attempt": attempt})
    return root


def latest(spark: SparkSession, root: str) -> Row:
    """The newest published record: world, signature, last_revision, facts (counts of the snapshot) and attempt (the name of its folders)."""
    return records.newest(spark, f"{root}/pointer", POINTER, "world")


def _table(root: str, name: str, of: Row | str) -> str:
    return f"{root}/{name}/world={of if isinstance(of, str) else of['attempt']}"


def members(spark: SparkSession, root: str, of: Row | None = None) -> DataFrame:
    """Members of a snapshot, by default the newest."""
    return spark.read.schema(MEMBERS).parquet(_table(root, "members", of or latest(spark, root)))


def tracks(spark: SparkSession, root: str) -> DataFrame:
    """Global tracks of the newest snapshot; there are none before the first."""
    return spark.read.parquet(_table(root, "tracks", latest(spark, root)))


def revisions_after(spark: SparkSession, root: str, revision: int, limit: int | None = None) -> DataFrame:
    """The published part of the append-only log above `revision`; with `limit` its first rows, in order."""
    published = records.records(spark, f"{root}/pointer", POINTER).where(F.col("last_revision") > revision).select(F.col("attempt").alias("_attempt"), F.col("world").alias("world_revision"))
    rows = spark.read.schema(f"{REVISIONS}, world string").parquet(f"{root}/revisions").where(F.col("revision") > revision)
    log = rows.join(published, F.col("world") == F.col("_attempt")).drop("world", "_attempt")
    return log.orderBy("revision").limit(limit) if limit else log


def facts(candidates: DataFrame, selected: DataFrame, groups: DataFrame, fusion: DataFrame | None = None, windows: DataFrame | None = None) -> dict[str, int]:
    """Counts that a snapshot tells of its making: candidate and selected pairs, groups of three and more, accepted estimates."""
    count = lambda df: 0 if df is None else df.where("accepted").count()
    large = groups.groupBy("group_id").count().where("count >= 3").count()
    return {"candidate_count": candidates.count(), "selected_pair_count": selected.count(), "associated_group_count": large, "experimental_fusion_accepted": count(fusion), "experimental_window_accepted": count(windows)}


def with_estimates(tracks: DataFrame, members: DataFrame, fusion: DataFrame | None, windows: DataFrame | None) -> DataFrame:
    """Tracks with the group estimates beside them (status, reason, and values where accepted); they never replace the representative."""
    group = members.select("global_id", "group_id").distinct()
    rows = tracks.join(group, "global_id", "left")
    for name, found, value in (("fusion", fusion, "mean"), ("window", windows, "position")):
        if found is not None:
            status = F.when(F.col("accepted"), "experimental_ci" if name == "fusion" else "experimental_conditional").otherwise("rejected")
            told = found.select("group_id", status.alias(f"{name}_estimate_status"), F.col("reason").alias(f"{name}_reason"), F.col(value).alias(f"{name}_position"), F.col("covariance").alias(f"{name}_covariance"))
            rows = rows.join(told, "group_id", "left")
    return rows.drop("group_id")


def publish(
    groups: DataFrame, tracklets: DataFrame, labels: DataFrame, root: str, told: dict[str, int] | None = None, policy: str = "", fusion: DataFrame | None = None, windows: DataFrame | None = None
) -> int:
    """Publishes the next snapshot of groups (uid, group_id) and returns its number.

    Nothing is written, and no estimate computed, when neither membership nor tracklets nor `policy` (a text that stands for all settings) changed. Ids
    stick to their members; what changed is appended to the log, numbered on from the snapshot before. If another writer publishes that
    number first, all is worked out again on what it published.
    """
    spark = groups.sparkSession
    groups, tracklets = kept(groups.select("uid", "group_id")), kept(tracklets)
    seen = tracklets.select("uid", "start_ns", "end_ns", "n_events", "class_id", F.col("latest").cast("string").alias("latest"))
    signature = identity.signature(groups.join(seen, "uid").withColumn("policy", F.lit(policy)))
    opened(spark, root)
    for _ in range(ATTEMPTS):
        was = latest(spark, root)
        if signature == was["signature"]:
            return was["world"]
        attempt = f"{was['world'] + 1}-{uuid.uuid4().hex}"
        old = members(spark, root, was)
        identity.assign_ids(groups, old.select("uid", "global_id")).select("uid", "group_id", "global_id").write.parquet(_table(root, "members", attempt))
        new = spark.read.schema(MEMBERS).parquet(_table(root, "members", attempt))
        identity.revisions(old, new, was["last_revision"]).write.parquet(_table(root, "revisions", attempt))
        rows = with_estimates(identity.global_tracks(new.select("uid", "global_id"), tracklets, labels), new, fusion, windows)
        before = spark.read.schema(IDENTITIES).parquet(_table(root, "tracks", was))
        identity.identity_revisions(rows, before).write.parquet(_table(root, "tracks", attempt))
        count = spark.read.schema(REVISIONS).parquet(_table(root, "revisions", attempt)).count()
        record = {"world": was["world"] + 1, "signature": signature, "last_revision": was["last_revision"] + count, "facts": told or {}, "attempt": attempt}
        if records.publish(spark, f"{root}/pointer", record["world"], record):
            return record["world"]
    raise RuntimeError(f"others published first {ATTEMPTS} times")


def follow(changes: DataFrame, associate: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]], root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Publishes a snapshot after each trigger of a stream of changes, by default every two seconds.

    `associate` gives (groups, tracklets, labels) from all stored events: late ones revise what was
    published before, so the stream's rows only say when to look.
    """

    def again(batch: DataFrame, epoch: int) -> None:
        publish(*associate(batch.sparkSession), root)

    return changes.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def consecutive(hints: DataFrame, after: int) -> DataFrame:
    """Revisions that may be announced after `after`: those up to the first that is missing.

    hints: revision, distinct. The first gap is the least revision whose predecessor isn't there, so
    that no task sees them all.
    """
    above = hints.where(F.col("revision") > after)
    heads = above.join(above.select((F.col("revision") + 1).alias("revision")), "revision", "left_anti").where(F.col("revision") > after + 1)
    stop = heads.agg(F.min("revision").alias("stop"), F.lit(after + 1).alias("first"))
    begins = above.agg(F.coalesce(F.min("revision") == after + 1, F.lit(False)).alias("begins"))
    return above.crossJoin(F.broadcast(stop)).crossJoin(F.broadcast(begins)).where(F.col("begins") & (F.col("stop").isNull() | (F.col("revision") < F.col("stop")))).select(*hints.columns)


def wire(tracks: DataFrame, tracklets: DataFrame, alignment: DataFrame) -> DataFrame:
    """Tracks as they are announced: identity always, a position only if the representative's sensor is aligned.

    alignment: node_id, frame, map_revision of each sensor. A position is given only where the latest
    observation's frame and map are the sensor's; else position and covariance are null.
    """
    known = alignment.select("node_id", F.col("frame").alias("_frame"), F.col("map_revision").alias("_map"))
    seen = tracklets.select(F.col("uid").alias("representative"), "node_id", "latest").join(known, "node_id", "left")
    met = tracks.join(seen, "representative", "left")
    aligned = (F.col("latest.frame") == F.col("_frame")) & (F.col("latest.map_revision") == F.col("_map"))
    return met.select("global_id", "status", "class_name", "source_count", "representative", F.when(aligned, F.col("latest.position")).alias("position"), F.when(aligned, F.col("latest.covariance")).alias("covariance"))


# --- messages ----------------------------------------------------------------------------------------

STATE_TOPIC, HINT_TOPIC = "world-state", "identity-hints"


def state_messages(tracks: DataFrame, tracklets: DataFrame, alignment: DataFrame, world: int) -> DataFrame:
    """(topic, key, value) of a snapshot: one JSON message for each track, as `wire` tells it, with the snapshot's number."""
    rows = wire(tracks, tracklets, alignment).withColumn("world_revision", F.lit(world))
    return rows.select(F.lit(STATE_TOPIC).alias("topic"), F.col("global_id").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def hint_messages(log: DataFrame, after: int) -> DataFrame:
    """(topic, key, value) of the revisions above `after`, in JSON, up to the first that is missing; keys are numbers with leading zeros, in order."""
    rows = consecutive(log, after)
    return rows.select(F.lit(HINT_TOPIC).alias("topic"), F.lpad(F.col("revision").cast("string"), 20, "0").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def swaps(spark: SparkSession, root: str) -> DataFrame:
    """A stream of published snapshots (world, signature, last_revision, facts), for those who wait for the next."""
    return spark.readStream.schema(POINTER).json(f"{root}/pointer")


def announce(ticks: DataFrame, root: str, state: Callable[[SparkSession, int], tuple[DataFrame, DataFrame]], send: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sends the newest snapshot after every trigger of a stream of ticks, each second by default, and the revisions that have come since in order.

    `state` gives (tracklets, alignment) of a world; `send` takes messages (topic, key, value), as a Kafka writer does. How far hints have been
    sent is a row in `root`, written after they are, so that a failure repeats messages and never leaves any out. A snapshot older than one sent before is never sent.
    """

    def again(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = latest(spark, opened(spark, root))
        if newest["world"] == 0:
            return
        spark.createDataFrame([(0, 0)], "revision long, world long").coalesce(1).write.mode("ignore").parquet(f"{root}/announced/epoch=-1")
        sent = spark.read.schema("revision long, world long, epoch long").parquet(f"{root}/announced").agg(F.max("revision").alias("revision"), F.max("world").alias("world")).first()
        if newest["world"] < sent["world"]:
            return
        tracklets, alignment = state(spark, newest["world"])
        send(state_messages(tracks(spark, root), tracklets, alignment, newest["world"]))
        hints = hint_messages(revisions_after(spark, root, sent["revision"]), sent["revision"])
        if newest["last_revision"] > sent["revision"]:
            send(hints)
        spark.createDataFrame([(newest["last_revision"], newest["world"])], "revision long, world long").coalesce(1).write.mode("overwrite").parquet(f"{root}/announced/epoch={epoch}")

    return ticks.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
