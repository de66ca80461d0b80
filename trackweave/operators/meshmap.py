"""Map queries over triangles: nearest surfaces, first ray hits, visibility; bounds and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import triangles as T
from .checkpoints import checkpoint
from .ranking import top_k

#: Limits of a query (fixed values).
MAX_RADIUS, MAX_K, MAX_LENGTH = 1000.0, 32, 10_000.0
UNKNOWN = ("occupancy", "esdf", "reachability", "road_topology")
#: Triangles that agree in these lie on each other; points and rays that agree in those have the same answers.
CORNERS = [f"{p}{k}" for p in "abc" for k in "xyz"]
PLACE, RAY = ["px", "py", "pz"], ["ox", "oy", "oz", "dx", "dy", "dz", "reach"]


def _mesh(flat: DataFrame) -> DataFrame:
    """Triangles with scalar corners (CORNERS) that have an area, with edges, unit normal and bounds."""
    flat = T.staged(flat, T.NORMAL).where(F.col("nl") > T.LEAST_NORMAL)
    flat = flat.withColumns({f"u{k}": F.col(f"n{k}") / F.col("nl") for k in "xyz"})
    return flat.withColumns({**{f"lo{k}": F.least(f"a{k}", f"b{k}", f"c{k}") for k in "xyz"}, **{f"hi{k}": F.greatest(f"a{k}", f"b{k}", f"c{k}") for k in "xyz"}})


def bounds(triangles: DataFrame) -> DataFrame:
    """One row: least and greatest coordinates, entities, triangles with an area and without."""
    flat = T.staged(T.corners(triangles), T.NORMAL)
    good = F.col("nl") > T.LEAST_NORMAL
    axes = [c for k in "xyz" for c in (F.min(F.least(f"a{k}", f"b{k}", f"c{k}")).alias(f"min_{k}"), F.max(F.greatest(f"a{k}", f"b{k}", f"c{k}")).alias(f"max_{k}"))]
    return flat.agg(*axes, F.count_distinct("entity_id").alias("entities"), F.count_if(good).alias("triangles"), F.count_if(~good).alias("degenerate"))


def _cells(lo: str, hi: str, size, pad: float):
    return F.explode(F.sequence(F.floor((F.col(lo) - pad) / size).cast("long"), F.floor((F.col(hi) + pad) / size).cast("long")))


def _levelled(area: DataFrame, size: float) -> tuple[DataFrame, list[int]]:
    """Adds `level`: cells of level k are size * 2 ** k wide, and a triangle is put where a cell is as wide as it is, so that it touches few. And the levels in use (about as many as the extents have binary orders).

    The triangles are written once: their levels are looked at before the query is planned.
    """
    extent = F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))
    area = checkpoint(area.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / size))).cast("int")))
    return area, sorted(r["level"] for r in area.select("level").distinct().collect())


def surface(triangles: DataFrame, points: DataFrame, radius: float = 20.0, k: int = 4, semantics: list[str] | None = None, min_up: float = -1.0) -> DataFrame:
    """The k nearest entities of each point (query_id, point) within `radius`, by (distance, entity_id).

    semantics: None for all, a list for those in it. min_up bounds the normal's upward part. Triangles are
    put into all ground cells of their own size that they come near to and points into their own cell of each size in use, so both sides
    meet by hash of the cell; the exact distance follows. Points that aren't finite have no hits.
    Equal points are looked up once. Of triangles with the same corners the k first entities' are looked at: any other entity has k before it there.
    """
    if not 0 <= radius <= MAX_RADIUS or not 1 <= k <= MAX_K or not -1 <= min_up <= 1:
        raise ValueError("radius, k or min_up out of range")
    size = max(radius, 1.0)
    flat = T.corners(triangles)
    if semantics is not None:
        flat = flat.where(F.col("semantic").isin(*semantics) if semantics else F.lit(False))
    flat = flat.groupBy(*CORNERS, "entity_id").agg(F.min(F.struct("triangle_id", "semantic")).alias("first")).select(*CORNERS, "entity_id", "first.*")
    flat = top_k(flat, CORNERS, [F.col("entity_id")], k, "copy").drop("copy")
    area, levels = _levelled(_mesh(flat).where(F.col("uz") >= min_up), size)
    wide = F.pow(F.lit(2.0), F.col("level")) * size
    placed = area.withColumn("gx", _cells("lox", "hix", wide, radius)).withColumn("gy", _cells("loy", "hiy", wide, radius))
    asked = points.select("query_id", *[F.col("point")[i].alias(f"p{c}") for i, c in enumerate("xyz")]).where("abs(px) < 1e15 AND abs(py) < 1e15 AND abs(pz) < 1e15")
    places = asked.select(*PLACE).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    places = places.withColumns({"gx": F.floor(F.col("px") / wide).cast("long"), "gy": F.floor(F.col("py") / wide).cast("long")})
    apart = [F.greatest(F.col(f"lo{c}") - F.col(f"p{c}"), F.lit(0.0), F.col(f"p{c}") - F.col(f"hi{c}")) for c in "xyz"]
    near = placed.join(places, ["level", "gx", "gy"]).where(sum((d * d for d in apart[1:]), apart[0] * apart[0]) <= radius * radius)
    hit = T.staged(near, T.CLOSEST)
    seen = F.struct("distance", "triangle_id", "semantic", "kx", "ky", "kz", "ux", "uy", "uz")
    least = F.min_by("h", F.struct("h.distance", "h.triangle_id")).alias("h")
    best = hit.select(*PLACE, "entity_id", seen.alias("h")).groupBy(*PLACE, "entity_id").agg(least)
    # The radius is tested on the least distance: a filter below would repeat the whole computation.
    best = top_k(best.where(F.col("h.distance") <= radius), PLACE, [F.col("h.distance"), F.col("entity_id")], k, "nth")
    best = asked.join(best, PLACE).groupBy("query_id", "entity_id").agg(least).select("query_id", "entity_id", "h.*")
    return top_k(best, ["query_id"], [F.col("distance"), F.col("entity_id")], k, "rank").select(
        "query_id", "rank", "entity_id", "semantic", "triangle_id", "distance", F.array("kx", "ky", "kz").alias("point"), F.array("ux", "uy", "uz").alias("normal")
    )


def raycast(triangles: DataFrame, rays: DataFrame, limit: float | None = 500.0, cell: float = 16.0) -> DataFrame:
    """The first hit of each ray (query_id, origin, direction[, reach]), by (distance, entity_id, triangle_id).

    `limit` must be 1e-6 to MAX_LENGTH. Directions are normalised; a zero one is an error. For each size of cells in use a ray is cut into steps of a cell, each in the
    ground cells of its own bounds, and meets there the triangles of these cells; the exact test follows. `reach`, a column,
    stands for `limit` where it is given. Equal rays are followed once, and of triangles with the same corners the first is looked at.
    """
    if limit is not None and not 1e-6 <= limit <= MAX_LENGTH:
        raise ValueError("limit out of range")
    n = F.sqrt(sum((F.col("direction")[i] ** 2 for i in (1, 2)), F.col("direction")[0] ** 2))
    flat = rays.withColumn("_n", F.when(n > 0, n).otherwise(F.raise_error(F.lit("a ray needs a direction")).cast("double")))
    flat = flat.select("query_id", *[F.col("origin")[i].alias(f"o{c}") for i, c in enumerate("xyz")], *[(F.col("direction")[i] / F.col("_n")).alias(f"d{c}") for i, c in enumerate("xyz")], (F.col("reach") if "reach" in rays.columns else F.lit(limit)).alias("reach"))
    first = T.corners(triangles).groupBy(*CORNERS).agg(F.min(F.struct("entity_id", "triangle_id", "semantic")).alias("first"))
    area, levels = _levelled(_mesh(first.select(*CORNERS, "first.*")), cell)
    wide = F.pow(F.lit(2.0), F.col("level")) * cell
    placed = area.withColumn("gx", _cells("lox", "hix", wide, 1e-6)).withColumn("gy", _cells("loy", "hiy", wide, 1e-6))
    # Steps are as long as a cell on the ground; an upright ray has one.
    steps = F.ceil(F.greatest(F.abs("dx"), F.abs("dy")) * F.col("reach") / wide)
    lines = flat.where("reach > 0").select(*RAY).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    parts = lines.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0)))))
    width = F.greatest(steps, F.lit(1))
    at = lambda c, k: F.col(f"o{c}") + F.col(f"d{c}") * F.col("reach") * k / width
    for c in "xy":
        parts = parts.withColumns({f"s{c}": F.least(at(c, F.col("step")), at(c, F.col("step") + 1)), f"t{c}": F.greatest(at(c, F.col("step")), at(c, F.col("step") + 1))})
    parts = parts.withColumn("gx", _cells("sx", "tx", wide, 0.0)).withColumn("gy", _cells("sy", "ty", wide, 0.0))
    near = placed.join(parts.drop("sx", "sy", "tx", "ty", "step").distinct(), ["level", "gx", "gy"])
    hit = T.staged(near, T.RAY).where((F.col("u") > 1e-6) & (F.col("u") <= F.col("reach")))
    seen = F.struct(F.col("u").alias("distance"), "entity_id", "triangle_id", "semantic", "ux", "uy", "uz", *[(F.col(f"o{c}") + F.col("u") * F.col(f"d{c}")).alias(f"k{c}") for c in "xyz"])
    least = F.min_by("h", F.struct("h.distance", "h.entity_id", "h.triangle_id")).alias("h")
    best = hit.select(*RAY, seen.alias("h")).groupBy(*RAY).agg(least)
    best = flat.join(best, RAY).groupBy("query_id").agg(least).select("query_id", "h.*")
    return best.select("query_id", "entity_id", "semantic", "triangle_id", "distance", F.array("kx", "ky", "kz").alias("point"), F.array("ux", "uy", "uz").alias("normal"))


def visibility(triangles: DataFrame, lines: DataFrame, margin: float | None = None) -> DataFrame:
    """Whether something stands between origin and target of each row: occluded, else unknown with confidence 0.

    The last `margin` metres don't count (the lesser of 0.05 and the distance by default). Nothing in
    the way is no proof of sight, so there is no "visible". Lines shorter than 1e-6 or longer than MAX_LENGTH metres, or shorter than the margin, come back as rejected.
    """
    if margin is not None and not 0 <= margin <= MAX_LENGTH:
        raise ValueError("margin out of range")
    away = F.zip_with("target", "origin", lambda t, o: t - o)
    length = F.sqrt(F.col("direction")[0] ** 2 + F.col("direction")[1] ** 2 + F.col("direction")[2] ** 2)
    rows = lines.withColumn("direction", away).withColumn("length", length)
    keep = F.least(F.lit(0.05), F.col("length")) if margin is None else F.lit(float(margin))
    fine = F.coalesce((F.col("length") > 1e-6) & (F.col("length") <= MAX_LENGTH) & (keep <= F.col("length")), F.lit(False))
    rows = checkpoint(rows.withColumns({"fine": fine, "reach": F.greatest(F.lit(0.0), F.col("length") - keep - 1e-6)}))
    hits = raycast(triangles, rows.where("fine").select("query_id", "origin", "direction", "reach")).select("query_id", "entity_id", "distance")
    met = rows.join(hits, "query_id", "left")
    status = F.when(~F.col("fine"), "rejected").when(F.col("entity_id").isNotNull(), "occluded").otherwise("unknown")
    return met.select("query_id", status.alias("status"), "entity_id", "distance")


def envelope(results: DataFrame, manifest: DataFrame, query_time: float) -> DataFrame:
    """Results with the map's revision, frame and quality; unknown ones have confidence 0. manifest: one row."""
    told = results.crossJoin(F.broadcast(manifest.select("map_revision", "coordinate_frame", "confidence").limit(1)))
    return told.withColumn("query_time", F.lit(query_time)).withColumn("confidence", F.when(F.col("status") == "unknown", 0.0).otherwise(F.col("confidence")))


def unsupported(queries: DataFrame) -> DataFrame:
    """Answers to the operations that the map holds no data for."""
    return queries.where(F.col("op").isin(*UNKNOWN)).select("query_id", "op", F.lit("unknown").alias("status"), F.lit(0.0).alias("confidence"), F.lit("source_data_unavailable").alias("reason"))


# --- query rows --------------------------------------------------------------------------------------

#: Arguments of a query row: operation, those that must be finite numbers with their range and default, and those that must be vectors.
ARGUMENTS = {
    "surface": ({"radius_m": (0.0, MAX_RADIUS, 20.0), "max_candidates": (1, MAX_K, 4), "min_normal_up": (-1.0, 1.0, -1.0)}, ("point",)),
    "raycast": ({"max_distance_m": (1e-6, MAX_LENGTH, 500.0)}, ("origin", "direction")),
    "visibility": ({"target_margin_m": (0.0, MAX_LENGTH, 0.0)}, ("origin", "target")),
}


def query_errors(queries: DataFrame, map_revision: str) -> DataFrame:
    """Adds `error` to query rows (op, map_revision, coordinate_frame, and the columns of ARGUMENTS): the first fault, or null.

    A row of another map's revision is a revision_conflict, which a caller may repeat; anything else is a bad argument, by its name. Absent numbers have defaults; vectors
    must have three finite numbers, directions and lines a length.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = [("op", F.coalesce(F.col("op").isin(*ARGUMENTS, *UNKNOWN), F.lit(False))), ("revision_conflict", F.col("map_revision") == map_revision), ("coordinate_frame", F.col("coordinate_frame") == "local_ENU")]
    for op, (numbers, vectors) in ARGUMENTS.items():
        mine = F.col("op") == op
        for name in vectors:
            sound = F.coalesce((F.size(name) == 3) & F.forall(name, finite), F.lit(False))
            rules.append((name, ~mine | sound))
        for name, (low, high, default) in numbers.items():
            value = F.coalesce(F.col(name), F.lit(default))
            rules.append((name, ~mine | (finite(value) & value.between(low, high))))
    long = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    away = F.zip_with("target", "origin", lambda t, o: t - o)
    rules += [("direction", (F.col("op") != "raycast") | (long(F.col("direction")) > 0)), ("target", (F.col("op") != "visibility") | ((long(away) > 1e-6) & (long(away) <= MAX_LENGTH)))]
    rules.append(("target_margin_m", (F.col("op") != "visibility") | (F.coalesce("target_margin_m", F.lit(0.0)) <= long(away))))
    return queries.withColumn("error", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
