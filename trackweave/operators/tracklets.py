"""Tracklets: committed events cut by lifecycle markers, in event time; late events are never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["node_id", "camera_id", "session_id", "local_id"]
#: The newest located observation counts only this close to a tracklet's end (fixed value).
FRESH_NS = 250_000_000


def committed(events: DataFrame, cursors: DataFrame, most: int | None = None) -> DataFrame:
    """Events up to their node's watermark; with `most`, an error if there are more."""
    kept = events.join(cursors.select("node_id", "contiguous"), "node_id").where("seq <= contiguous").drop("contiguous")
    if most is not None and kept.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} committed events")
    return kept


def segmented(events: DataFrame) -> DataFrame:
    """Adds uid: a JSON array of the key and the seq of the tracklet's first event in event time.

    A tracklet begins with a track's first event, with a start, and after an end.
    """
    order = Window.partitionBy(*KEY).orderBy("event_time_ns", "seq")
    before = F.lag("type").over(order)
    opens = (before.isNull() | (F.col("type") == "start") | (before == "end")).cast("int")
    runs = events.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("seq").over(Window.partitionBy(*KEY, "_run").orderBy("event_time_ns", "seq"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    uid = F.concat(F.lit("["), F.concat_ws(",", quoted("node_id"), quoted("camera_id"), F.col("session_id").cast("string"), F.col("local_id").cast("string"), first.cast("string")), F.lit("]"))
    return runs.withColumn("uid", uid).drop("_open", "_run")


def uid_part(uid: Column, part: int) -> Column:
    """One part of a tracklet's uid, as text: 0 node, 1 camera, 2 session, 3 local id, 4 first seq; null for what is no uid."""
    return F.get_json_object(uid, f"$[{part}]")


def tracklets(events: DataFrame) -> DataFrame:
    """One row for each tracklet of `segmented` events.

    start_ns, end_ns, n_events, closed, class_id (the last known; null if none) and latest: the newest
    observation with position and covariance, no older than FRESH_NS before the end. All are aggregates, so no observation list is gathered.
    """
    at = F.struct("event_time_ns", "seq")
    seen = F.struct("event_time_ns", "seq", "position", "covariance", "velocity", "quality", "frame", "map_revision", *([F.col("bearing")] if "bearing" in events.columns else []))
    located = F.col("position").isNotNull() & F.col("covariance").isNotNull()
    found = events.groupBy("uid", *KEY).agg(
        F.min("event_time_ns").alias("start_ns"),
        F.max("event_time_ns").alias("end_ns"),
        F.count("*").alias("n_events"),
        (F.max_by("type", at) == "end").alias("closed"),
        F.max_by("class_id", F.when(F.col("class_id") >= 0, at)).alias("class_id"),
        F.max_by(seen, F.when(located, at)).alias("latest"),
    )
    return found.withColumn("latest", F.when(F.col("end_ns") - F.col("latest.event_time_ns") <= FRESH_NS, F.col("latest")))


def observations(events: DataFrame, most: int | None = None) -> DataFrame:
    """Each tracklet's observations in event-time order, as an array; `most` raises on tracklets with more."""
    rows = events.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("event_time_ns", "seq", "type", "position", "covariance", "velocity", "class_id", "quality"))).alias("observations"))
    if most is not None:
        rows = rows.withColumn("observations", F.when(F.size("observations") <= most, F.col("observations")).otherwise(F.raise_error(F.lit("tracklet too long"))))
    return rows


def representatives(tracklets: DataFrame, group: str) -> DataFrame:
    """Each group's tracklet with the best latest observation: quality, then least trace, then newest, then uid."""
    c = F.col("latest.covariance")
    rank = F.struct(-F.col("latest.quality"), c[0] + c[4] + c[8], -F.col("latest.event_time_ns"), F.col("uid"))
    return tracklets.where("latest IS NOT NULL").groupBy(group).agg(F.min_by("uid", rank).alias("representative"))
