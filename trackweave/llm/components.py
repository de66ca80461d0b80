"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that one task joins up before the rounds.
TASK_EDGES = 50_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges, at the least node that these edges connect it with."""
    root, kind = {}, None

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
    if root:
        rows = [(x, least) for x in root if (least := find(x)) != x]
        yield pa.record_batch([pa.array(c, kind) for c in zip(*rows, strict=True)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the component's least node.

    Tasks of TASK_EDGES edges each leave a star for each component of theirs; if there is one such task, that is all. Otherwise
    alternating large-star and small-star rounds follow, each an aggregation and a join, so a
    node with very many neighbours is never gathered in one row. Rounds stop
    when the edges no longer change; what they are is written to the checkpoint folder.

    Edges with a null end and loops are left out, and so are their nodes if they have no other; repeated edges count once; no edges give no rows; other columns are ignored.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, -(-now.count() // TASK_EDGES))
    kind = now.schema["a"].dataType.simpleString()
    now = checkpoint(now.repartition(tasks).mapInArrow(_forest, f"a {kind}, b {kind}"))
    state = None
    while tasks > 1:
        # Large star: neighbours above a node go to the least node around it.
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("low")).withColumn("low", F.least("m", "low"))
        large = both.join(least, both["a"] == least["m"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, go to the least of them.
        low = large.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("low"))
        met = large.join(low, large["a"] == low["m"])
        small = met.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("m", "low")).distinct()
        now = checkpoint(small)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
