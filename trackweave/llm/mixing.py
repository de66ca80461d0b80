"""Mixing of sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, columns, partitions, row_hash

#: Sources are a configured list; more than this many are an error, not a silent slow path.
MAX_SOURCES = 100_000
#: Size classes of rows, each four times as wide as the one before.
CLASSES = 16


def share_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Splits sum(sizes) by weight; no share exceeds `most` times its size.

    What is above a limit is shared again, by weight, among those below theirs, until
    none is above.
    """
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def inclusion(sizes: list[int], target: float, lean: float, most: float) -> list[float]:
    """Expected copies of a row of each size class, in proportion to its weight up to `most`, so that sizes times copies add up to the target.

    sizes: the summed sizes of the rows of class k, those with 4 ** k to 4 ** (k + 1) - 1 words. A class weighs 4 ** (k * lean).
    """
    weight = [4.0 ** (k * lean) for k in range(len(sizes))]
    copies, left = [0.0] * len(sizes), min(target, most * sum(sizes))
    open_ = [k for k, s in enumerate(sizes) if s]
    while open_ and left > 0:
        unit = left / sum(weight[k] * sizes[k] for k in open_)
        full = [k for k in open_ if unit * weight[k] > most]
        for k in full or open_:
            copies[k] = float(most) if full else unit * weight[k]
        if not full:
            break
        left -= sum(most * sizes[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return copies


def pareto_mix(
    docs: DataFrame,
    weight_of: Callable[[int], float] = lambda i: 1 + i % 3,
    most: int = 3,
    seed: int = 17,
    lean: float = 0.125,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    rows: bool = False,
) -> DataFrame:
    """Decides how many copies of each row a mix of the sources takes.

    Within a source longer rows are taken more often, gently: expected copies rise with (size class) ** lean, up to `most`, and
    add up to the source's target (`inclusion`). Every row gets the whole part of its expected copies. The fraction is its
    inclusion probability: rows are ranked by random odds over inclusion odds (Pareto order sampling) and taken
    in that order while the row's middle word lies below what the target still lacks,
    so that a source misses its target by at most half of one row. The random number is a
    hash of seed, key and text, so reruns agree.

    A hot source doesn't meet in one task: its rows are cut into slices of near equal numbers by the share of the
    source's rows that rank before, which the inclusion odds of its few size classes give in closed form; slices are summed first,
    and the order within a slice is made there.

    Size is the number of words; null and empty texts have none and are never taken.
    A null source is a source of its own, after all others. Ties in rank go by key and text
    hash. Full copies of a row have equal ranks and are told apart by position alone.
    An empty table gives no rows.
    Returns key, size, source_size, target, copies and taken (copies * size); with `rows` also the
    struct `row` of the input's columns, so that nothing needs to be joined back by a key that may be null or repeat.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), body).alias("_hash"),
        *([F.struct(*columns(docs)).alias("row"), row_hash(docs).alias("_tie")] if rows else []),
    )
    slim = slim.withColumn("_class", F.when(F.col("size") > 0, F.least(F.floor((F.length(F.bin("size")) - 1) / 2), F.lit(CLASSES - 1))).otherwise(0).cast("int"))
    counted = slim.groupBy("_source", "_class").agg(F.sum("size").alias("s"), F.count_if(F.col("size") > 0).alias("n")).limit(CLASSES * MAX_SOURCES + 1).collect()
    found: dict[str | None, tuple[list[int], list[int]]] = {}
    for r in counted:
        sizes, n = found.setdefault(r["_source"], ([0] * CLASSES, [0] * CLASSES))
        sizes[r["_class"]], n[r["_class"]] = r["s"], r["n"]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(found, key=lambda s: (s is None, s or ""))
    targets = share_targets([sum(found[s][0]) for s in names], [weight_of(i) for i in range(len(names))], most)
    plan = []
    for i, (name, target) in enumerate(zip(names, targets, strict=True)):
        sizes, n = found[name]
        copies = inclusion(sizes, target, lean, most)
        whole = [min(most, int(c + 1e-9)) for c in copies]
        part = [c - w if 1e-9 < c - w < 1 else 0.0 for c, w in zip(copies, whole, strict=True)]
        odds = [p / (1 - p) for p in part]
        ranked = float(sum(k for k, p in zip(n, part, strict=True) if p))
        share = [k / ranked if p else 0.0 for k, p in zip(n, part, strict=True)]
        plan.append((name, i, sum(sizes), target, whole, odds, share, target - sum(w * s for w, s in zip(whole, sizes, strict=True))))
    table = spark.createDataFrame(plan, "_source string, _i int, source_size long, target double, _wholes array<int>, _odds array<double>, _shares array<double>, _lack double")

    slices = 4 * partitions(spark)
    # Uniform in (0, 1), from the upper 52 bits.
    u = (F.shiftrightunsigned("_hash", 12).cast("double") + 0.5) / float(1 << 52)
    drawn = F.get("_odds", F.col("_class"))
    before = F.aggregate(F.zip_with("_shares", "_odds", lambda n, o: n * o * F.col("_rank") / (1 + o * F.col("_rank"))), F.lit(0.0), lambda a, x: a + x)
    ranked = (
        slim.join(F.broadcast(table), slim["_source"].eqNullSafe(table["_source"]))
        .drop("_source")
        .withColumn("_rank", F.when((drawn > 0) & (F.col("size") > 0), u / (1 - u) / drawn))
        .withColumn("_slice", F.greatest(F.lit(0), F.least(F.floor(F.coalesce(before, u) * slices), F.lit(slices - 1))).cast("int"))
        .withColumns({"_whole": F.get("_wholes", F.col("_class")), "_size": F.when(F.col("_rank").isNotNull(), F.col("size")).otherwise(0)})
        .drop("_wholes", "_odds", "_shares")
    )
    sums = ranked.groupBy("_i", "_slice").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_i").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_i"), F.col("_slice"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_i", "_slice").orderBy("_rank", F.col("_key").asc_nulls_first(), "_hash", *(["_tie"] if rows else [])).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_before") + F.col("_upto") - F.col("size") / 2
    extra = (F.col("_rank").isNotNull() & (F.col("_whole") < most) & (middle < F.col("_lack"))).cast("int")
    return (
        ranked.withColumn("_upto", F.sum("_size").over(inside))
        .join(sums, ["_i", "_slice"])
        .withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + extra).otherwise(0).cast("int"))
        .select(F.col("_key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(["row"] if rows else []))
    )
