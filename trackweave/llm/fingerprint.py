"""Homomorphic multiset fingerprints, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, range_bounds, range_bucket

#: Sums for equality: each is taken modulo 2 ** 61.
EQUAL = 8
MASK = (1 << 61) - 1
#: Packed sums for likeness: two counts modulo 2 ** 32 each.
LIKE = 32
TWO_ONES = (1 << 32) | 1


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def equality_lanes(text: Column) -> Column:
    """Sum over the paragraphs of EQUAL hashes each, modulo 2 ** 61."""
    lane = lambda k: F.aggregate(paragraphs(text), F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(F.lit(k), p).bitwiseAND(MASK)).bitwiseAND(MASK))
    return F.array(*[lane(k) for k in range(EQUAL)])


def units(text: Column) -> Column:
    """Hashes of each paragraph's adjacent word pairs; its last word stands alone."""

    def of(p: Column) -> Column:
        words = F.filter(F.split(p, " "), lambda w: w != "")
        return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    return F.flatten(F.transform(paragraphs(text), of))


def _like_sums(unit: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.shiftrightunsigned(unit, k).bitwiseAND(TWO_ONES)), F.lit(0)).alias(f"_s{k}") for k in range(LIKE)]


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint lanes of two multisets of paragraphs together; sign -1 takes b's out.

    Lanes are struct(equal, like, n), as `fingerprints` gives them. Counts in `like`
    are packed by two; taking out what was never put in isn't defined.
    """
    return F.struct(
        F.zip_with(a["equal"], b["equal"], lambda x, y: (x + (y if sign > 0 else F.lit(MASK + 1) - y)).bitwiseAND(MASK)).alias("equal"),
        F.zip_with(a["like"], b["like"], lambda x, y: x + y * sign).alias("like"),
        (a["n"] + b["n"] * sign).alias("n"),
    )


def as_text(lanes: Column) -> Column:
    hexed = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.concat(hexed(lanes["equal"]), hexed(lanes["like"]))


def signed(lanes: Column) -> Column:
    """Twice each count less the number of units: a random projection of the unit counts."""
    n = lanes["n"]
    return F.flatten(
        F.transform(lanes["like"], lambda x: F.array((F.shiftrightunsigned(x, 32) * 2 - n).cast("double"), (x.bitwiseAND((1 << 32) - 1) * 2 - n).cast("double")))
    )


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two fingerprints' projections, 0 to 1; 1 for equal fingerprints."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x, y = signed(a), signed(b)
    dot = add(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(add(F.transform(x, lambda p: p * p)) * add(F.transform(y, lambda p: p * p)))
    same = (a["equal"] == b["equal"]) & (a["like"] == b["like"])
    return F.when(same, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(0.0)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text", group_by: list[str] | None = None) -> DataFrame:
    """One row for each combination of `keys`, with `lanes`: struct(equal, like, n).

    A text's fingerprint is the sum of its paragraphs' wide vectors: EQUAL hashes of the
    paragraph modulo 2 ** 61, and 2 * LIKE counts, modulo 2 ** 32, of the hashed
    word pairs with a bit set. Paragraphs may stand in any order, and one is put in or taken out by adding
    or subtracting its vector (`combine`). Equal texts have equal fingerprints; null is
    as the empty text, which is one empty paragraph. Keys should be unique.
    """
    split = rows.select(*keys, equality_lanes(F.col(text)).alias("_equal"), units(F.col(text)).alias("_units"))
    flat = split.select(*keys, *[F.col("_equal")[k].alias(f"_e{k}") for k in range(EQUAL)], F.explode_outer("_units").alias("_u"))
    sums = flat.groupBy(*keys).agg(*_like_sums(F.col("_u")), *[F.max(f"_e{k}").alias(f"_e{k}") for k in range(EQUAL)], F.count("_u").alias("_n"))
    lanes = F.struct(F.array(*[F.col(f"_e{k}") for k in range(EQUAL)]).alias("equal"), F.array(*[F.col(f"_s{k}") for k in range(LIKE)]).alias("like"), F.col("_n").alias("n"))
    return sums.select(*keys, lanes.alias("lanes"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with the next row's text, ascending by key; the first row follows the last.

    Rows go to range buckets of the key. A copy of each bucket's first row joins the bucket before
    it, so the order needs one shuffle and no task with all rows. Columns: _bucket, _nth, _extra
    (these copies), key, text, _next. Null keys come first; equal keys go by text.
    """
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    bounds = range_bounds(docs, key, 4 * partitions(docs.sparkSession))
    rows = docs.withColumn("_bucket", range_bucket(F.col(key), bounds))
    # One row for each of a bounded number of buckets: its least key, and the bucket before it.
    least = rows.groupBy("_bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("_set"), F.col(key).alias("_key"))).alias("_least"))
    order = Window.orderBy("_bucket")
    heads = least.select(F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())).alias("_to"), F.col("_least._key").alias("_key"), F.col("_bucket").alias("_from"))
    extra = rows.join(F.broadcast(heads), rows["_bucket"].eqNullSafe(heads["_from"]) & rows[key].eqNullSafe(heads["_key"])).select(key, text, F.col("_to").alias("_bucket"), F.lit(True).alias("_extra"))
    both = rows.withColumn("_extra", F.lit(False)).unionByName(extra)
    w = Window.partitionBy("_bucket").orderBy("_extra", F.col(key).asc_nulls_first(), text)
    return both.withColumns({"_nth": F.row_number().over(w), "_next": F.lead(text).over(w)})


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to one another.

    The edited text has its last floor(n / 2) code points replaced by as many, or all, of the
    next row's first. One shuffle, by bucket, serves order, fingerprints and comparison. Null
    texts are as empty ones. Of rows with equal keys each has its own result. Extra columns are
    dropped. An empty table gives no rows.
    """
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, key, text)
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = rows.select("_bucket", "_nth", "_extra", key, n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col(text).alias("t")), F.struct(F.lit(1).alias("edit"), edited.alias("t")))).alias("_v"))
    both = both.select("_bucket", "_nth", "_extra", key, "n_chars", F.col("_v.edit").alias("_edit"), F.when(F.col("_v.edit") == 1, F.sha2("_v.t", 256)).alias("_sha"), F.col("_v.t").alias("_text"))
    found = fingerprints(both, ["_bucket", "_nth", "_edit", "_extra", key, "n_chars", "_sha"], "_text")
    w = Window.partitionBy("_bucket").orderBy("_nth", "_edit")
    found = found.withColumns({"_edited": F.lead("lanes", 1).over(w), "edited_sha256": F.lead("_sha", 1).over(w), "_other": F.lead("lanes", 2).over(w)})
    return found.where((F.col("_edit") == 0) & ~F.col("_extra")).select(
        key,
        "n_chars",
        "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("_other")).alias("near_next"),
    )
