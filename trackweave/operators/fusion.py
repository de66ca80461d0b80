"""Covariance intersection of position estimates, for pairs and for groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .checkpoints import checkpoint
from .policies import in_range, known_keys
from .ragged import Ragged, Reasons


#: Ranges of the policy's values, and the name of the method (fixed values).
FUSION_RANGES = {
    "max_epoch_offset_s": (0.001, 1), "max_clock_uncertainty_s": (0.000001, 1), "motion_sigma_speed_mps": (0.1, 200), "max_input_sigma_m": (0.001, 100),
    "max_residual_d2": (0.1, 200), "max_bearing_residual_sigma": (0.1, 20), "max_bearing_sample_age_s": (0.001, 1),
}
METHOD = "ci_position_bearing_veto"


@dataclass(frozen=True)
class FusionPolicy:
    """Gates of the group estimate; defaults are fixed values of the domain."""

    max_epoch_offset_s: float = 0.25
    max_clock_uncertainty_s: float = 0.05
    motion_sigma_speed_mps: float = 30.0
    max_input_sigma_m: float = 15.0
    max_residual_d2: float = 25.0
    max_bearing_residual_sigma: float = 4.0
    max_bearing_sample_age_s: float = 0.25
    min_position_sources: int = 2
    min_quality: float = 0.0

    def __post_init__(self):
        for name, (low, high) in FUSION_RANGES.items():
            in_range(name, getattr(self, name), low, high)
        if type(self.min_position_sources) is not int or not 2 <= self.min_position_sources <= 4:
            raise ValueError("min_position_sources must be 2 to 4")

    @classmethod
    def from_dict(cls, data: dict) -> FusionPolicy:
        """A policy from configured values; `method`, where it is given, must be the one that there is."""
        known_keys(data, {*(f.name for f in fields(cls)), "method"} - {"min_quality"})
        if data.get("method", METHOD) != METHOD:
            raise ValueError(f"method must be {METHOD}")
        return cls(**{k: v for k, v in data.items() if k != "method"})


def usable(c: np.ndarray) -> np.ndarray:
    """Which of a stack of 3 x 3 matrices are symmetric, positive definite and not nearly singular."""
    c = np.asarray(c, float).reshape(-1, 3, 3)
    fine = np.isfinite(c).all(axis=(1, 2))
    c = np.where(fine[:, None, None], c, np.eye(3))
    size = np.abs(c).max(axis=(1, 2))
    fine &= np.abs(c - c.transpose(0, 2, 1)).max(axis=(1, 2)) <= 1e-7 * np.maximum(1, size)
    eig = np.linalg.eigvalsh((c + c.transpose(0, 2, 1)) / 2)
    return fine & (eig[:, 0] > 1e-12) & (eig[:, 0] > 1e-7 * eig[:, -1])


def intersect(p: np.ndarray, cov_p: np.ndarray, q: np.ndarray, cov_q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stacks of means, covariances and weights of P by covariance intersection.

    The weight maximises log det(w P^-1 + (1 - w) Q^-1). With M = Q P^-1 - 1 its slope is the sum of
    m / (1 + w m) over M's eigenvalues m: a quadratic in w, whose coefficients are M's
    invariants. So the optimum is a root in closed form, or an end of [0, 1]; ties go to 0.
    """
    inv_p, inv_q = np.linalg.inv(cov_p), np.linalg.inv(cov_q)
    m = cov_q @ inv_p - np.eye(3)
    e1 = np.trace(m, axis1=1, axis2=2)
    e2 = (e1**2 - np.trace(m @ m, axis1=1, axis2=2)) / 2
    e3 = np.linalg.det(m)
    slope_0 = e1
    slope_1 = e1 + 2 * e2 + 3 * e3  # times a positive number
    a, b, c = 3 * e3, 2 * e2, e1
    root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
    s = -(b + np.where(b >= 0, 1.0, -1.0) * root) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        r1, r2 = s / a, c / s
    inside = lambda r: np.isfinite(r) & (r > 0) & (r < 1)
    w = np.where(inside(r1), r1, np.where(inside(r2), r2, 0.5))
    w = np.where(slope_0 <= 1e-12, 0.0, np.where(slope_1 >= 0, 1.0, w))
    info = w[:, None, None] * inv_p + (1 - w)[:, None, None] * inv_q
    cov = np.linalg.inv(info)
    mean = np.einsum("nij,nj->ni", cov, w[:, None] * np.einsum("nij,nj->ni", inv_p, p) + (1 - w)[:, None] * np.einsum("nij,nj->ni", inv_q, q))
    return mean, (cov + cov.transpose(0, 2, 1)) / 2, w


def intersect_pairs(pairs: DataFrame) -> DataFrame:
    """Adds mean, covariance and weight to rows with p, cov_p, q, cov_q; null where a covariance isn't usable."""
    kept = pairs.columns

    def run(batches):
        for pdf in batches:
            stack = lambda c, n: np.array([x if x is not None else [np.nan] * n for x in pdf[c]], float).reshape(-1, n)  # noqa: E731, B023
            p, q, cp, cq = stack("p", 3), stack("q", 3), stack("cov_p", 9).reshape(-1, 3, 3), stack("cov_q", 9).reshape(-1, 3, 3)
            ok = usable(cp) & usable(cq) & np.isfinite(p).all(axis=1) & np.isfinite(q).all(axis=1)
            cp[~ok], cq[~ok] = np.eye(3), np.eye(3)
            mean, cov, w = intersect(np.nan_to_num(p), cp, np.nan_to_num(q), cq)
            yield pdf.assign(mean=[m.tolist() if k else None for m, k in zip(mean, ok, strict=True)], covariance=[c.reshape(-1).tolist() if k else None for c, k in zip(cov, ok, strict=True)], weight=np.where(ok, w, np.nan))

    fields_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.select(*kept).mapInPandas(run, f"{fields_}, mean array<double>, covariance array<double>, weight double")


def group_inputs(members: DataFrame, tracklets: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each member of a group with what the group estimators read; `ray` is that of latest.bearing, null without one that holds up."""
    rows = members.join(tracklets, "uid").join(labels, ["node_id", "class_id"], "left")
    ray = F.lit(None).cast("struct<origin:array<double>,direction:array<double>,sigma:double,timestamp_ns:bigint>")
    if "bearing" in tracklets.schema["latest"].dataType.names:
        ray = V.ray(F.col("latest.bearing"))
    known = sources.where("verified").select("node_id", "domain", "alignment_id", "offset_ns", "clock_uncertainty_ns", F.col("frame").alias("s_frame"), F.col("map_revision").alias("s_map"))
    return rows.join(known, "node_id", "left").select(
        "group_id", "uid", "node_id", "label", "domain", "alignment_id", "s_frame", "s_map", "offset_ns", "clock_uncertainty_ns", F.col("latest.event_time_ns").alias("event_ns"),
        F.col("latest.position").alias("position"), F.col("latest.covariance").alias("covariance"), F.col("latest.velocity").alias("velocity"), F.col("latest.quality").alias("quality"),
        F.col("latest.frame").alias("frame"), F.col("latest.map_revision").alias("map_revision"), ray.alias("ray"),
    )


RESULT = (
    "group_id string, accepted boolean, reason string, epoch_ns long, mean array<double>, covariance array<double>, n_sources int, weights map<string,double>, residual_d2 map<string,double>,"
    " bearing_count int, bearing_residual_max double, contradicting array<string>, domain string, alignment_id string, frame string, map_revision string"
)


def _sound(policy: FusionPolicy):
    """Rules that each member of a group must keep, in their order: (reason, whether it holds). `first` is the context of the group's first member."""
    c = F.col("covariance")

    @F.pandas_udf("boolean")
    def spd(covariance: pd.Series) -> pd.Series:
        whole = covariance.map(lambda x: x is not None and len(x) == 9 and all(v is not None for v in x))
        ok = np.zeros(len(covariance), bool)
        ok[whole] = usable(np.array(covariance[whole].tolist(), float).reshape(-1, 9))
        return pd.Series(ok)

    return [
        ("source_unverified_or_unlocalized", F.col("position").isNotNull() & c.isNotNull() & F.col("domain").isNotNull()),
        ("semantic_class_unverified", F.col("label") != ""),
        ("clock_map_or_class_mismatch", F.struct(*CONTEXT).eqNullSafe(F.col("first")) & F.col("frame").eqNullSafe(F.col("s_frame")) & F.col("map_revision").eqNullSafe(F.col("s_map"))),
        ("source_localization_quality_below_gate", (F.col("quality") >= policy.min_quality) & ~F.isnan("quality")),
        ("clock_uncertainty_unverified", F.col("clock_uncertainty_ns") / 1e9 <= policy.max_clock_uncertainty_s),
        ("covariance_outside_bounds", F.greatest(c[0], c[4], c[8]) <= policy.max_input_sigma_m**2),
        ("covariance_not_spd", spd(c)),
    ]


CONTEXT = ("domain", "alignment_id", "s_frame", "s_map", "label")
#: What the numbers of a packed member are: position, velocity, covariance, and its ray's origin, direction and angular spread.
NUMBERS = 22
FOUND = "accepted boolean, reason string, epoch_ns long, mean array<double>, covariance array<double>, weights map<string,double>, residual_d2 map<string,double>, bearing_count int, bearing_residual_max double, contradicting array<string>"


def packed_groups(rows: DataFrame, policy: FusionPolicy) -> DataFrame:
    """One row for each group of `group_inputs`: group_id, n_sources, first (its first member's context), reason, members.

    `reason` is that of the first member, by uid, that breaks a rule, or that a sensor is there twice. `members`, null then and in groups that are too small, has what the
    estimate reads, in order of uid. Such a group has each sensor once at most, so its row is bounded by the number of sensors; all others are never gathered.
    """
    first = rows.groupBy("group_id").agg(F.count("*").cast("int").alias("n_sources"), F.min_by(F.struct(*CONTEXT), "uid").alias("first"), F.count_distinct("node_id").alias("nodes"))
    met = rows.join(first, "group_id")
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for reason, ok in _sound(policy)])
    ray = "ray" in rows.columns
    part = lambda c, n: F.slice(c, 1, n)
    none = F.array_repeat(F.lit(float("nan")), 7)
    sight = F.when(F.col("ray.timestamp_ns").isNotNull(), F.concat(part("ray.origin", 3), part("ray.direction", 3), F.array("ray.sigma"))) if ray else F.lit(None)
    numbers = F.concat(part("position", 3), F.coalesce(part("velocity", 3), F.array_repeat(F.lit(0.0), 3)), part("covariance", 9), F.coalesce(sight, none))
    seen = F.coalesce(F.col("ray.timestamp_ns"), F.lit(0)) if ray else F.lit(0)
    member = F.struct("uid", F.col("event_ns").alias("event"), F.col("offset_ns").alias("offset"), F.col("clock_uncertainty_ns").alias("clock"), seen.cast("long").alias("seen"), numbers.alias("numbers"))
    enough = (F.col("n_sources") >= policy.min_position_sources) & (F.col("nodes") == F.col("n_sources"))
    met = met.withColumn("broken", broken)
    groups = met.groupBy("group_id").agg(
        F.first("n_sources").alias("n_sources"), F.first("first").alias("first"), F.first("nodes").alias("nodes"), F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("uid"))).alias("fault"),
        F.sort_array(F.collect_list(F.when(enough & F.col("broken").isNull(), member))).alias("members"),
    )
    reason = (
        F.when(F.col("n_sources") < policy.min_position_sources, "not_enough_verified_position_sources")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("nodes") < F.col("n_sources"), "duplicate_physical_node")
    )
    return groups.select("group_id", "n_sources", "first", reason.alias("reason"), F.when(reason.isNull(), F.col("members")).alias("members"))


def estimates(lists: pa.Array, policy: FusionPolicy) -> dict[str, list]:
    """The columns of FOUND for a batch of packed groups, all of them worked out at once: the fold over members takes one step for all groups that have so many."""
    g, groups = Ragged.of_lists(lists), len(lists)
    reasons, numbers = Reasons(groups), g.vectors("numbers", NUMBERS)
    p, v, c, ray = numbers[:, :3], numbers[:, 3:6], numbers[:, 6:15].reshape(-1, 3, 3), numbers[:, 15:]
    event, offset, clock, seen = (g.numbers(n) for n in ("event", "offset", "clock", "seen"))
    every = lambda ok: np.logical_and.reduceat(ok, g.start) if groups else np.empty(0, bool)

    times = event + offset
    ranked = times[np.lexsort([times, g.of])]
    low, high = ranked[g.start + (g.size - 1) // 2], ranked[g.start + g.size // 2]
    epoch = low // 2 + high // 2 + (low % 2 + high % 2) // 2
    reasons.need(epoch >= 0, "aligned_event_time_negative")
    dt = (epoch[g.of] - times) / 1e9
    reasons.need(every(np.abs(dt) <= policy.max_epoch_offset_s), "time_extrapolation_limit")
    p = p + v * dt[:, None]
    c = c + ((policy.motion_sigma_speed_mps * (np.abs(dt) + clock / 1e9)) ** 2)[:, None, None] * np.eye(3)
    reasons.need(every(usable(c)), "inflated_covariance_not_spd")

    mean, cov, weight = p[g.start].copy(), c[g.start].copy(), np.zeros((groups, int(g.size.max(initial=1))))
    weight[:, 0] = 1
    for k in range(1, weight.shape[1]):
        at = np.flatnonzero((g.size > k) & reasons.open)
        if not len(at):
            break
        mean[at], cov[at], w = intersect(mean[at], cov[at], p[g.start[at] + k], c[g.start[at] + k])
        weight[at, :k] *= w[:, None]
        weight[at, k] = 1 - w
        bad = np.zeros(groups, bool)
        bad[at] = ~(np.isfinite(mean[at]).all(axis=1) & usable(cov[at]))
        reasons.need(~bad, "ci_numerical_degeneracy")
    fused = reasons.open[g.of]
    d, d2 = mean[g.of] - p, np.full(len(p), np.nan)
    d2[fused] = np.einsum("ni,nij,nj->n", d[fused], np.linalg.inv(c[fused]), d[fused])
    told = reasons.open
    reasons.need(every(d2 <= policy.max_residual_d2), "position_residual_exceeds_gate")
    near = reasons.open

    # Rays can only veto: behind their origin, or further off than their spread allows.
    age = np.abs(seen - event) / 1e9
    looks = np.isfinite(ray).all(axis=1) & (age <= policy.max_bearing_sample_age_s) & near[g.of]
    away, along = mean[g.of] - ray[:, :3], ray[:, 3:6]
    reach = (away * along).sum(axis=1)
    late = np.abs(epoch[g.of] - times) / 1e9 + clock / 1e9 + age
    widest = cov.diagonal(axis1=1, axis2=2).max(axis=1)[g.of]
    miss = np.linalg.norm(away - reach[:, None] * along, axis=1) / np.maximum(np.sqrt(widest + (reach * ray[:, 6]) ** 2 + (policy.motion_sigma_speed_mps * late) ** 2), 1e-6)
    ahead = looks & (reach > 0.05)
    against = (looks & ~ahead) | (ahead & (miss > policy.max_bearing_residual_sigma))
    count = np.bincount(g.of[ahead], minlength=groups)
    most = np.zeros(groups)
    np.maximum.at(most, g.of[ahead], miss[ahead])
    reasons.need(np.bincount(g.of[against], minlength=groups) == 0, "bearing_geometry_contradiction")

    good, uids = reasons.open, g.column("uid").to_pylist()
    by_uid = lambda values: [None if u is None else list(zip(u, x, strict=True)) for u, x in zip(g.lists(uids, told), g.lists(values.tolist(), told), strict=True)]
    some = lambda values, mask: [x if m else None for x, m in zip(values.tolist(), mask.tolist(), strict=True)]
    contradicting = [None if u is None else [x for x, a in zip(u, a, strict=True) if a] for u, a in zip(g.lists(uids, near), g.lists(against.tolist(), near), strict=True)]
    return {
        "accepted": good.tolist(), "reason": ["ci_position_only" if t is None else t for t in reasons.text], "epoch_ns": epoch.tolist(), "mean": some(mean, good), "covariance": some(cov.reshape(-1, 9), good),
        "weights": by_uid(weight[g.of, g.place]), "residual_d2": by_uid(d2), "bearing_count": some(count, near), "bearing_residual_max": some(most, near), "contradicting": contradicting,
    }


def fuse_groups(rows: DataFrame, policy: FusionPolicy | None = None) -> DataFrame:
    """One row for each group: accepted, reason, epoch, mean and covariance (null unless accepted), weights and residuals by member, how rays fit, and the context.

    rows: `group_inputs`; `ray` may be left out. Estimates of unknown correlation are intersected in
    order of uid at the members' median time; rays can only veto. Rules on single members are columns; groups that keep them all are packed into one row each
    and solved in Arrow batches, a whole batch at a time.
    """
    policy = policy or FusionPolicy()
    groups = checkpoint(packed_groups(rows, policy))
    kinds = {"accepted": pa.bool_(), "reason": pa.string(), "epoch_ns": pa.int64(), "mean": pa.list_(pa.float64()), "covariance": pa.list_(pa.float64()), "weights": pa.map_(pa.string(), pa.float64()),
             "residual_d2": pa.map_(pa.string(), pa.float64()), "bearing_count": pa.int32(), "bearing_residual_max": pa.float64(), "contradicting": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = estimates(b.column("members"), policy)
                arrays = [pa.array(found[n], kind) for n, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([b.column("group_id"), b.column("n_sources"), b.column("first"), *arrays], ["group_id", "n_sources", "first", *kinds])

    kept = groups.schema
    form = f"group_id {kept['group_id'].dataType.simpleString()}, n_sources int, first {kept['first'].dataType.simpleString()}, {FOUND}"
    solved = groups.where("reason IS NULL").select("group_id", "n_sources", "first", "members").mapInArrow(run, form)
    context = {"domain": "domain", "alignment_id": "alignment_id", "s_frame": "frame", "s_map": "map_revision"}
    solved = solved.select("*", *[F.when(F.col("accepted"), F.col(f"first.{c}")).alias(name) for c, name in context.items()]).drop("first")
    refused = groups.where("reason IS NOT NULL").select("group_id", F.lit(False).alias("accepted"), "reason", "n_sources")
    names = [x.split()[0] for x in RESULT.split(", ")]
    return solved.unionByName(refused, allowMissingColumns=True).select(*names)
