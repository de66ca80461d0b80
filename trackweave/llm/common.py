"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder.

    The session's spark.checkpoint.dir is used where it is set. Without it a temporary folder is made on a local
    master; anywhere else, where executors don't share the driver's folders, it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint()


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The table's columns by their exact names, whatever characters these have, but those named in `without`."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def row_hash(df: DataFrame, seed: int = 42) -> Column:
    """A hash of whole rows; equal rows have equal ones, and nulls count. Columns with maps inside, which can't be hashed, go as their JSON."""
    cells = []
    for c, f in zip(columns(df), df.schema.fields, strict=True):
        cells += [F.to_json(F.struct(c.alias("c"))) if "map<" in f.dataType.simpleString() else c, c.isNull()]
    return F.xxhash64(F.lit(seed), *cells)


def free_name(taken: list[str], base: str) -> str:
    """`base`, with underscores in front until no column of the table has that name (whatever its case)."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base = "_" + base
    return base


class Recent:
    """A cache of strings and small values, bounded by bytes: two generations, the older one dropped when the newer is full.

    What is looked up moves to the newer generation, so entries in use stay. `now` holds all that was looked up
    or put since the last `turn`.
    """

    #: Bytes of a dictionary entry, a string and a small value besides their contents (CPython).
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.half = most_bytes // 2
        self.now: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.held = 0

    def turn(self) -> None:
        """To be called where nothing looked up before is needed any more."""
        if self.held > self.half:
            self.old, self.now, self.held = self.now, {}, 0

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of distinct keys that aren't held; all others are in `now` afterwards."""
        now, old, out = self.now, self.old, []
        for k in keys:
            if k not in now:
                if k in old:
                    now[k] = old[k]
                    self.held += self.ENTRY + len(k)
                else:
                    out.append(k)
        return out

    def put(self, key: str, value: Any, size: int = 0) -> None:
        self.now[key] = value
        self.held += self.ENTRY + len(key) + size

    def forget(self, key: str, size: int = 0) -> None:
        del self.now[key]
        self.held -= self.ENTRY + len(key) + size


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """Ascending bounds that cut `key` into about `buckets` equal parts.

    They come from a quantile sketch over all rows; the driver gets at most
    `buckets` numbers, whatever the input.
    """
    if buckets < 2:
        return []
    at = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), F.lit(10 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_bucket(key: Column, bounds: list) -> Column:
    """The number of bounds at or below `key`, searched in two levels; null keys come first."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    grid = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    reached = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.size(F.filter(F.get(grid, reached - 1), lambda b: b <= key))
    return F.when(key.isNull() | (reached == 0), 0).otherwise((reached - 1) * width + inner).cast("int")
