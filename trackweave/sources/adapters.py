"""Domain tables made from the test tables, so that each operator has whole tables to run on.

The formulas are those of FIXTURES.md, part B; `DUCKDB` holds the same for the oracles.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME, MAP = "local_enu_v1", "map-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids in a row that are numbered by one task.
BLOCK = 1 << 14


def _numbered(events: DataFrame) -> DataFrame:
    """Adds n, the row's number by event_id among those of its sensor (user_id % 4; nulls come first).

    The sensors are few, so their rows are numbered in blocks of BLOCK ids, each from the count of the blocks before it.
    """
    rows = events.withColumns({"_k": F.expr("coalesce(user_id % 4, -4)"), "_block": F.coalesce(F.floor(F.col("event_id") / BLOCK), F.lit(-(1 << 62)))})
    counts, before = rows.groupBy("_k", "_block").agg(F.count("*").alias("_n")), Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_k", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each sensor and block
    nth = F.row_number().over(Window.partitionBy("_k", "_block").orderBy("event_id"))
    return rows.join(counts, ["_k", "_block"]).withColumn("n", F.col("_before") + nth).drop("_k", "_block", "_before")


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events of four sensors, with late arrivals and unknown positions."""
    return _numbered(table(spark, sf_dir, "events")).selectExpr(
        "event_id",
        "concat('node_', user_id % 4) AS node_id",
        "'cam_0' AS camera_id",
        "1L AS session_id",
        "floor(user_id / 4) % 10 AS local_id",
        "n",
        "CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'start' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'end' ELSE 'update' END AS type",
        "1000000000000 + event_id * 5000000 - CASE WHEN event_id % 50 = 7 THEN 200000000 ELSE 0 END AS event_time_ns",
        "CASE WHEN event_id % 13 = 0 THEN -1L ELSE floor(user_id / 4) % 2 END AS class_id",
        "CASE WHEN event_id % 11 <> 0 THEN array(floor(user_id / 4) % 10 * 40.0D + value / 100.0D, 2.0D + (event_id % 7) / 10.0D, 3.0D) END AS position",
        "CASE WHEN event_id % 11 <> 0 THEN array(0.5D + (event_id % 5) * 0.25D, 0.0D, 0.0D, 0.0D, 0.5D + (event_id % 3) * 0.5D, 0.0D, 0.0D, 0.0D, 1.0D) END AS covariance",
        "CAST(NULL AS array<double>) AS velocity",
        "(event_id % 10) / 10.0D AS quality",
        f"'{FRAME}' AS frame",
        f"'{MAP}' AS map_revision",
    ).withColumn("n", F.col("n").cast("long")).withColumnRenamed("n", "seq")


def bearing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events, every third located one with a bearing: a half of them look away from the position, a quarter are too old to count."""
    turn = "CASE WHEN event_id % 2 = 0 THEN -1.0D ELSE 1.0D END"
    bearing = f"""named_struct('valid', true, 'camera_position_world_m', array(position[0] - 20.0D, position[1], position[2]), 'direction_world', array({turn}, 0.0D, 0.0D),
        'tangent_basis_world', array(0.0D, 1.0D, 0.0D, 0.0D, 0.0D, {turn}), 'has_tangent_covariance', true, 'tangent_covariance_rad2', array(1e-4D, 0.0D, 0.0D, 1e-4D),
        'timestamp_ns', event_time_ns - CASE WHEN event_id % 4 = 1 THEN 300000000L ELSE 0L END)"""
    return track_events(spark, sf_dir).withColumn("bearing", F.expr(f"CASE WHEN event_id % 3 = 0 AND position IS NOT NULL THEN {bearing} END"))


def received_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without those that were lost on the way."""
    return track_events(spark, sf_dir).where("event_id % 997 <> 500")


def blob_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received_events(spark, sf_dir).where("event_id % 101 = 0").selectExpr("node_id", "seq", "sha2(concat('blob-', event_id), 256) AS sha", "event_id % 1000 AS size")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 101 = 0 AND event_id % 202 <> 0").selectExpr("sha2(concat('blob-', event_id), 256) AS sha", "event_id % 1000 AS size")


def sources(spark: SparkSession) -> DataFrame:
    """Alignment of the four sensors: verified, one clock domain, frame and map."""
    rows = [(f"node_{i}", True, "shared_utc", 0, 5_000_000, "align-1", FRAME, MAP) for i in range(4)]
    return spark.createDataFrame(rows, "node_id string, verified boolean, domain string, offset_ns long, clock_uncertainty_ns long, alignment_id string, frame string, map_revision string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"node_{i}", c, str(c)) for i in range(4) for c in (0, 1)], "node_id string, class_id long, label string")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, semantic, triangle_id (within the entity) and corners a, b, c."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('ent_', CAST(floor(p_partkey / 40) AS bigint)) AS entity_id",
        "element_at(array('terrain', 'road', 'building'), CAST(p_partkey % 3 AS int) + 1) AS semantic",
        "p_partkey % 40 AS triangle_id",
        "array((p_partkey * 37) % 200 - 100.0D, (p_partkey * 53) % 200 - 100.0D, p_size / 5.0D) AS a",
        "2.0D + p_size % 3 AS w",
    ).selectExpr("entity_id", "semantic", "triangle_id", "a", "array(a[0] + w, a[1], a[2]) AS b", "array(a[0], a[1] + w, a[2] + 0.5D) AS c")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points, one near each part's triangle."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS query_id", "array((p_partkey * 37) % 200 - 100.0D + 0.5D, (p_partkey * 53) % 200 - 100.0D + 0.25D, 3.0D) AS point"
    )


def rays_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).selectExpr("query_id", "array(point[0], point[1], 50.0D) AS origin", "array(0.0D, 0.0D, -1.0D) AS direction")


def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, position, covariance and a ray struct of each embedding."""
    d = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> CAST(x AS double)) AS e")
    d = d.selectExpr("vec_id", "e", "sqrt(e[0]*e[0] + e[1]*e[1] + e[2]*e[2]) AS n").where("n > 0")
    return d.selectExpr(
        "vec_id",
        "vec_id % 3 AS node",
        "array(10*e[3], 10*e[4], 10*e[5]) AS position",
        "array(0.5D + abs(e[6]), 0.0D, 0.0D, 0.0D, 0.5D + abs(e[7]), 0.0D, 0.0D, 0.0D, 0.5D + abs(e[8])) AS covariance",
        "named_struct('origin', array(10*e[3], 10*e[4], 10*e[5]), 'direction', array(e[0]/n, e[1]/n, e[2]/n), 'sigma', 0.01D, 'timestamp_ns', 1L) AS ray",
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, body): the tracking events as JSON batches of one sensor, some broken in one way each.

    Within sound batches some events have values of a wrong type, a covariance that is none, or no valid map.
    """
    rows = track_events(spark, sf_dir).selectExpr(
        "event_id", "seq", "cast(floor(event_id / 50) * 4 + cast(right(node_id, 1) AS int) AS long) AS batch_id",
        """concat('{"event_id":"e', event_id, '","node_id":"', node_id, '","camera_id":"cam_0","session_id":1,"local_id":', local_id, ',"seq":', seq, ',"type":"', type, '","event_time_ns":', event_time_ns,
        ',"class_id":', class_id, ',"frame_id":1,"blobs":[],"spatial":{"world":{"valid":', CASE WHEN event_id % 11 = 0 THEN 'false' WHEN event_id % 19 = 4 THEN '1' ELSE 'true' END,
        ',"coordinate_frame_id":', CASE WHEN event_id % 29 = 6 THEN '5' ELSE '"local_enu_v1"' END,
        ',"x_m":', coalesce(position[0], 0.0D), ',"y_m":', coalesce(position[1], 0.0D), ',"z_m":', coalesce(position[2], 0.0D),
        ',"velocity_valid":', event_id % 3 = 0, ',"vx_mps":1.5,"vy_mps":-0.5,"vz_mps":0,"position_covariance_m2":', CASE WHEN event_id % 17 = 3 OR covariance IS NULL THEN '[0,0,0,0,0,0,0,0,0]' ELSE to_json(covariance) END,
        ',"quality":', CASE WHEN event_id % 31 = 2 THEN '"0.9"' ELSE cast(quality AS string) END, '},"localization_quality":{"valid":true,"map":{"valid":', event_id % 23 <> 5, ',"revision":"map-1"}}}}') AS payload""",
    )
    # JSON takes far more time for each byte than what is shuffled otherwise, so the partitions aren't merged by their size
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    listed = rows.groupBy("batch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), ",").alias("e"))  # 50 events at most
    return listed.selectExpr(
        "batch_id",
        """CASE batch_id % 23 WHEN 1 THEN concat('{"version":2,"events":[', e, ']}') WHEN 2 THEN concat('{"version":1,"events":[', replace(e, '"session_id":1', '"session_id":"1"'), ']}')
        WHEN 3 THEN concat('{"version":1,"events":[', replace(e, '"frame_id":1', '"frame_id":NaN'), ']}') WHEN 5 THEN concat('{"version":1,"version":1,"events":[', e, ']}')
        WHEN 6 THEN concat('{"version":1,"events":[', e, ',', regexp_replace(e, 'node_[0-9]', 'node_9'), ']}') WHEN 7 THEN '{"version":1,"events":[]}' ELSE concat('{"version":1,"events":[', e, ']}') END AS body""",
    )


def scene_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): each entity of `triangles` as a binary glTF file of one node, scaled by 2 and moved by (1, 2, 3)."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("triangle_id")
        data = np.array([list(p) for r in rows.itertuples() for p in (r.a, r.b, r.c)], "<f4").tobytes()
        doc = {
            "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}], "bufferViews": [{"buffer": 0, "byteLength": len(data)}],
            "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3 * len(rows), "type": "VEC3"}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}],
            "nodes": [{"mesh": 0, "name": rows["entity_id"].iloc[0], "scale": [2, 2, 2], "translation": [1, 2, 3]}], "scenes": [{"nodes": [0]}],
        }
        text = json.dumps(doc).encode()
        text += b" " * (-len(text) % 4)
        parts = [b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(data)), struct.pack("<I", len(text)) + b"JSON" + text, struct.pack("<I", len(data)) + b"BIN\0" + data]
        return pd.DataFrame([(rows["entity_id"].iloc[0], b"".join(parts))], columns=["name", "content"])

    return triangles(spark, sf_dir).groupBy("entity_id").applyInPandas(write, "name string, content binary")


#: The same tables for DuckDB.
DUCKDB = {
    "track_events": f"""track_events AS (
  SELECT event_id, 'node_' || (user_id % 4) AS node_id, 'cam_0' AS camera_id, 1::BIGINT AS session_id, (user_id // 4) % 10 AS local_id,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id)::BIGINT AS seq,
    CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'start' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'end' ELSE 'update' END AS type,
    1000000000000 + event_id * 5000000 - CASE WHEN event_id % 50 = 7 THEN 200000000 ELSE 0 END AS event_time_ns,
    CASE WHEN event_id % 13 = 0 THEN -1 ELSE (user_id // 4) % 2 END::BIGINT AS class_id,
    CASE WHEN event_id % 11 <> 0 THEN ((user_id // 4) % 10)::DOUBLE * 40.0::DOUBLE + value / 100.0::DOUBLE END AS x,
    CASE WHEN event_id % 11 <> 0 THEN 2.0::DOUBLE + (event_id % 7)::DOUBLE / 10.0::DOUBLE END AS y,
    CASE WHEN event_id % 11 <> 0 THEN 3.0::DOUBLE END AS z,
    0.5::DOUBLE + (event_id % 5)::DOUBLE * 0.25::DOUBLE AS cx, 0.5::DOUBLE + (event_id % 3)::DOUBLE * 0.5::DOUBLE AS cy, 1.0::DOUBLE AS cz,
    (event_id % 10)::DOUBLE / 10.0::DOUBLE AS quality
  FROM events)""",
    "received_events": "received_events AS (SELECT * FROM track_events WHERE event_id % 997 <> 500)",
    "blob_refs": "blob_refs AS (SELECT node_id, seq, sha256('blob-' || event_id) AS sha, event_id % 1000 AS size FROM received_events WHERE event_id % 101 = 0)",
    "blobs": "blobs AS (SELECT sha256('blob-' || event_id) AS sha, event_id % 1000 AS size FROM events WHERE event_id % 101 = 0 AND event_id % 202 <> 0)",
    "triangles": """triangles AS (
  SELECT *, ax + w AS bx, ay AS b_y, az AS bz, ax AS cx, ay + w AS cy, az + 0.5::DOUBLE AS cz FROM (
  SELECT 'ent_' || (p_partkey // 40) AS entity_id, (['terrain', 'road', 'building'])[(p_partkey % 3 + 1)::INT] AS semantic, p_partkey % 40 AS triangle_id,
    (p_partkey * 37) % 200 - 100.0::DOUBLE AS ax, (p_partkey * 53) % 200 - 100.0::DOUBLE AS ay, p_size / 5.0::DOUBLE AS az, 2.0::DOUBLE + p_size % 3 AS w FROM part))""",
    "batched": """batched AS (SELECT *, event_id // 50 * 4 + right(node_id, 1)::BIGINT AS batch_id FROM track_events)""",
    "observed": """observed AS (
  SELECT * REPLACE (CASE WHEN seen THEN x END AS x, CASE WHEN event_id % 31 = 2 THEN 0.0::DOUBLE ELSE quality END AS quality), seen AND event_id % 17 <> 3 AS sound, CASE WHEN event_id % 3 = 0 THEN 1.5::DOUBLE END AS vx,
    CASE WHEN event_id % 29 = 6 THEN '' ELSE 'local_enu_v1' END AS frame, CASE WHEN event_id % 23 = 5 THEN '' ELSE 'map-1' END AS map_revision
  FROM (SELECT *, x IS NOT NULL AND event_id % 19 <> 4 AND event_id % 29 <> 6 AND event_id % 23 <> 5 AS seen FROM batched WHERE batch_id % 23 NOT IN (1, 2, 3, 5, 6, 7)))""",
    "points": "points AS (SELECT p_partkey AS query_id, (p_partkey * 37) % 200 - 100.0::DOUBLE + 0.5::DOUBLE AS px, (p_partkey * 53) % 200 - 100.0::DOUBLE + 0.25::DOUBLE AS py, 3.0::DOUBLE AS pz FROM part)",
    "bearings": """bearings AS (
  SELECT vec_id, vec_id % 3 AS node, e[1]/n AS dx, e[2]/n AS dy, e[3]/n AS dz, 10*e[4] AS ox, 10*e[5] AS oy, 10*e[6] AS oz,
    0.5::DOUBLE + abs(e[7]) AS cx, 0.5::DOUBLE + abs(e[8]) AS cy, 0.5::DOUBLE + abs(e[9]) AS cz FROM (
  SELECT vec_id, e, sqrt(e[1]*e[1] + e[2]*e[2] + e[3]*e[3]) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) WHERE n > 0)""",
}


def duckdb(*names: str) -> str:
    return "WITH " + ", ".join(DUCKDB[n] for n in names)
