"""Quantised-mesh terrain tiles over the ellipsoid: cover, bytes and the layer's description."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy

#: Levels and points along a tile's side of the offline tool (fixed values).
MAX_LEVEL, SIDE, STEPS = 17, 9, 32_767
TILE = "level int, x int, y int, terrain binary"


def cover(spark: SparkSession, box: tuple[float, float, float, float], levels: int = MAX_LEVEL) -> DataFrame:
    """(level, x, y): tiles of levels 0 .. `levels` that a box (west, south, east, north) touches; both tiles of level 0."""
    west, south, east, north = (F.lit(float(v)) for v in box)
    rows = spark.range(levels + 1).select(F.col("id").cast("int").alias("level"))
    rows = rows.withColumn("t", F.explode(geodesy.tile_cover(west, south, east, north, F.col("level")))).select("level", "t.x", "t.y")
    both = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "level int, x int, y int")
    return rows.where("level > 0").unionByName(both)


def _ecef(lon, lat, height=0.0) -> np.ndarray:
    e2 = 1 - (geodesy.B / geodesy.A) ** 2
    n = geodesy.A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return np.stack([(n + height) * np.cos(lat) * np.cos(lon), (n + height) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + height) * np.sin(lat)], -1)


def tile_bytes(level: int, x: int, y: int, height: float = 0.0, side: int = SIDE) -> bytes:
    """One tile: a flat grid of side x side points at a height, in the quantized-mesh 1.0 format.

    Vertices are numbered in the order in which the triangles use them first, as the format's high-water marks need it.
    """
    width, rows = 2 << level, 1 << level
    lon = np.radians(-180 + 360 * (x + np.arange(side) / (side - 1)) / width)
    lat = np.radians(-90 + 180 * (y + np.arange(side) / (side - 1)) / rows)
    at = np.arange(side * side).reshape(side, side)  # row j from the south, column i from the west
    low, right, up, far = at[:-1, :-1].ravel(), at[:-1, 1:].ravel(), at[1:, :-1].ravel(), at[1:, 1:].ravel()
    corners = np.stack([low, right, up, up, right, far], 1).ravel()
    used, first = np.unique(corners, return_index=True)
    order = used[np.argsort(first)]
    number = np.empty(side * side, np.int64)
    number[order] = np.arange(len(order))
    indices = number[corners]
    marks = np.maximum.accumulate(np.concatenate([[0], np.where(first[np.searchsorted(used, corners)] == np.arange(len(corners)), indices + 1, 0)]))[:-1]
    j, i = np.divmod(order, side)
    points = _ecef(lon[i], lat[j], height)
    centre = _ecef((lon[0] + lon[-1]) / 2, (lat[0] + lat[-1]) / 2, height)
    radius = float(np.linalg.norm(points - centre, axis=1).max() + 1)
    scaled = centre / [geodesy.A, geodesy.A, geodesy.B]
    horizon = 2 * scaled / np.linalg.norm(scaled)
    zigzag = lambda v: ((v << 1) ^ (v >> 63)).astype("<u2").tobytes()
    steps = lambda k: np.diff(np.rint(k * STEPS / (side - 1)).astype(np.int64), prepend=0)
    edges = [at[:, 0], at[0], at[:, -1], at[-1]]  # west, south, east, north
    return b"".join(
        [
            struct.pack("<3d2f4d3d", *centre, height, height, *centre, radius, *horizon),
            struct.pack("<I", len(order)), zigzag(steps(i)), zigzag(steps(j)), zigzag(np.zeros(len(order), np.int64)),
            struct.pack("<I", len(indices) // 3), (marks - indices).astype("<u2").tobytes(),
            *(struct.pack("<I", side) + number[e].astype("<u2").tobytes() for e in edges),
        ]
    )


def tiles(places: DataFrame, height: float = 0.0, side: int = SIDE) -> DataFrame:
    """Adds `terrain`, the tile's gzipped bytes (equal input, equal bytes), to rows of level, x and y. Other columns are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [gzip.compress(tile_bytes(z, x, y, height, side), mtime=0) for z, x, y in zip(b["level"], b["x"], b["y"], strict=True)]
            yield b.assign(terrain=made)

    return places.selectExpr("cast(level as int) AS level", "cast(x as int) AS x", "cast(y as int) AS y").mapInPandas(run, TILE)


def layer(places: DataFrame, box: tuple[float, float, float, float]) -> dict:
    """The layer's description. `available` has one rectangle for each level, so the driver gets a row for each level."""
    found = {r["level"]: r for r in places.groupBy("level").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()}
    deepest = max(found, default=0)
    ranges = [[{"startX": r["lox"], "endX": r["hix"], "startY": r["loy"], "endY": r["hiy"]}] if (r := found.get(z)) else [] for z in range(deepest + 1)]
    return {
        "tilejson": "2.1.0", "format": "quantized-mesh-1.0", "version": "1.0.0", "scheme": "tms", "projection": "EPSG:4326", "tiles": ["{z}/{x}/{y}.terrain?v={version}"],
        "bounds": list(box), "minzoom": 0, "maxzoom": deepest, "available": ranges, "metadataAvailability": 0,
    }
