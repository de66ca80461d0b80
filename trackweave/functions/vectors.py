"""Vectors, covariances and rays as Column expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR_PIVOT = 1e-10


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def trace(c: Column) -> Column:
    return c[0] + c[4] + c[8]


def cholesky(c: Column) -> dict[str, Column]:
    """Lower factor of a row-major 3 x 3 matrix and its pivots (p0, p1, p2); roots are null where a pivot isn't positive."""
    root = lambda p: F.when(p > FLOOR_PIVOT, F.sqrt(p))
    p0 = c[0]
    l00 = root(p0)
    l10, l20 = c[3] / l00, c[6] / l00
    p1 = c[4] - l10 * l10
    l11 = root(p1)
    l21 = (c[7] - l20 * l10) / l11
    p2 = c[8] - l20 * l20 - l21 * l21
    return {"p0": p0, "p1": p1, "p2": p2, "l00": l00, "l10": l10, "l11": l11, "l20": l20, "l21": l21, "l22": root(p2)}


def symmetric(c: Column, tolerance: float = 1e-5) -> Column:
    return (F.abs(c[1] - c[3]) <= tolerance) & (F.abs(c[2] - c[6]) <= tolerance) & (F.abs(c[5] - c[7]) <= tolerance)


def all_finite(a: Column, size: int) -> Column:
    return (F.size(a) == size) & F.forall(a, finite)


def is_covariance(c: Column) -> Column:
    """Nine finite numbers, symmetric, positive definite; false for null."""
    f = cholesky(c)
    return F.coalesce(c.isNotNull() & all_finite(c, 9), F.lit(False)) & F.coalesce(symmetric(c) & f["l22"].isNotNull(), F.lit(False))


def bounded(c: Column, most_sigma: float) -> Column:
    """Finite, symmetric, with each variance in (0, most_sigma ** 2]."""
    inside = lambda v: (v > 0) & (v <= most_sigma * most_sigma)
    return all_finite(c, 9) & symmetric(c) & inside(c[0]) & inside(c[4]) & inside(c[8])


def mahalanobis_sq(d: Column, c: Column) -> Column:
    """d' c^-1 d by forward substitution; null where c isn't positive definite."""
    f = cholesky(c)
    y0 = d[0] / f["l00"]
    y1 = (d[1] - f["l10"] * y0) / f["l11"]
    y2 = (d[2] - f["l20"] * y0 - f["l21"] * y1) / f["l22"]
    return y0 * y0 + y1 * y1 + y2 * y2


def widened(c: Column, extra: Column) -> Column:
    """The covariance with `extra` added to its diagonal."""
    return F.array(*[c[i] + extra if i in (0, 4, 8) else c[i] for i in range(9)])


def ray(bearing: Column, least: float = 0.98, most: float = 1.02) -> Column:
    """struct(origin, direction, sigma, timestamp_ns) of a bearing that holds up, else null.

    The direction is a unit vector within tolerance and made one; sigma is the root of the larger
    eigenvalue of the 2 x 2 tangent covariance, which must be positive definite with variances up to 0.25.
    """
    d, c = bearing["direction_world"], bearing["tangent_covariance_rad2"]
    n = norm(d)
    det = c[0] * c[3] - c[1] * c[2]
    half = (c[0] + c[3]) / 2
    sigma = F.sqrt(half + F.sqrt(F.greatest(F.lit(0.0), half * half - det)))
    good = (
        bearing["valid"]
        & all_finite(bearing["camera_position_world_m"], 3)
        & all_finite(d, 3)
        & n.between(least, most)
        & bearing["has_tangent_covariance"]
        & all_finite(c, 4)
        & (c[0] > 0) & (c[0] <= 0.25) & (c[3] > 0) & (c[3] <= 0.25)
        & (F.abs(c[1] - c[2]) <= 1e-7)
        & (det > 1e-12)
    )
    return F.when(good, F.struct(bearing["camera_position_world_m"].alias("origin"), scale(d, 1 / n).alias("direction"), sigma.alias("sigma"), bearing["timestamp_ns"].alias("timestamp_ns")))


def compared_rays(df: DataFrame, a: str, b: str, clock_sigma: Column, least_degrees: float, most_sigma: float, name: str) -> DataFrame:
    """Adds the struct `name`: how the rays of columns a and b fit: informative, forward, separation_m, normalised, consistent and a label; null where a ray is.

    Rays that are nearly parallel, or cross at a small angle, say nothing and count as consistent. The steps are columns of their own, so that none is
    worked out, or planned, more than once.
    """
    c = lambda x: F.col(f"_ray_{x}")
    u, v, p, q = F.col(f"{a}.direction"), F.col(f"{b}.direction"), F.col(f"{a}.origin"), F.col(f"{b}.origin")
    flat = {f"{x}{k}": y[k] for x, y in (("u", u), ("v", v)) for k in range(3)} | {f"w{k}": p[k] - q[k] for k in range(3)} | {"clock": clock_sigma}
    by = lambda x, y: c(f"{x}0") * c(f"{y}0") + c(f"{x}1") * c(f"{y}1") + c(f"{x}2") * c(f"{y}2")
    stages = [
        flat,
        {"cos": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), by("u", "v"))), "du": by("u", "w"), "dv": by("v", "w")},
        {"det": 1 - c("cos") * c("cos"), "angle": F.acos(F.least(F.lit(1.0), F.abs(c("cos"))))},
        {"s": F.try_divide(c("cos") * c("dv") - c("du"), c("det")), "t": F.try_divide(c("dv") - c("cos") * c("du"), c("det"))},
        {f"g{k}": c(f"w{k}") + c("s") * c(f"u{k}") - c("t") * c(f"v{k}") for k in range(3)},
        {"apart": F.sqrt(by("g", "g")), "spread": F.greatest(F.lit(1e-3), F.sqrt(c("clock") * c("clock") + (c("s") * F.col(f"{a}.sigma")) ** 2 + (c("t") * F.col(f"{b}.sigma")) ** 2))},
        {"enough": (c("det") >= 1e-8) & (c("angle") >= F.radians(F.lit(float(least_degrees)))), "forward": (c("s") > 0) & (c("t") > 0)},
        {"fits": F.when(~c("enough"), True).otherwise(c("forward") & (c("apart") / c("spread") <= most_sigma))},
    ]
    kept = df.columns
    for stage in stages:
        df = df.withColumns({f"_ray_{k}": x for k, x in stage.items()})
    sharp = c("det") >= 1e-8
    told = F.struct(
        c("enough").alias("informative"),
        F.when(sharp, c("forward")).otherwise(F.lit(False)).alias("forward"),
        F.degrees(c("angle")).alias("angle_deg"),
        F.when(sharp, c("apart")).alias("separation_m"),
        F.when(sharp, c("apart") / c("spread")).alias("normalised"),
        c("fits").alias("consistent"),
        F.when(~c("enough"), "weak-parallax-not-used").when(c("fits"), "ray-consistent").otherwise("ray-geometry-contradiction").alias("label"),
    )
    return df.select(*kept, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), told).alias(name))
