"""Fixed-lag least squares on bearings and one position, for groups of associated tracklets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .checkpoints import checkpoint
from .policies import in_range, known_keys, number, truth
from .ragged import Ragged, Reasons


#: Ranges of the policy's values (fixed values).
WINDOW_RANGES = {
    "window_seconds": (0.05, 5.0), "min_time_baseline_seconds": (0.01, 3.0), "min_ray_intersection_degrees": (0.1, 45.0), "max_clock_uncertainty_seconds": (0.000001, 0.2),
    "max_bearing_timestamp_delta_seconds": (0.001, 1.0), "max_condition_number": (10.0, 1e9), "max_normalized_rms": (0.1, 30.0), "max_target_speed_mps": (0.1, 300.0),
}
MODELS = ("constant_velocity", "static_position")


@dataclass(frozen=True)
class WindowPolicy:
    """Gates of the window estimate; defaults are fixed values of the domain. `min_quality` is that of the association and can't be configured here."""

    model: str = "constant_velocity"
    window_seconds: float = 1.5
    min_time_baseline_seconds: float = 0.15
    min_ray_intersection_degrees: float = 4.0
    max_clock_uncertainty_seconds: float = 0.03
    max_bearing_timestamp_delta_seconds: float = 0.2
    max_condition_number: float = 1e6
    max_normalized_rms: float = 4.0
    max_target_speed_mps: float = 80.0
    max_observations: int = 64
    independent_source_errors_verified: bool = False
    independent_temporal_errors_verified: bool = False
    bearing_world_pose_frame_verified: bool = False
    stationary_target_verified: bool = False
    allow_single_position_anchor: bool = True
    min_quality: float = 0.0

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}")
        for name, (low, high) in WINDOW_RANGES.items():
            in_range(name, getattr(self, name), low, high)
        if self.min_time_baseline_seconds >= self.window_seconds:
            raise ValueError("the time baseline must be shorter than the window")
        if type(self.max_observations) is not int or not 4 <= self.max_observations <= 256:
            raise ValueError("max_observations must be 4 to 256")
        for name in ("independent_source_errors_verified", "independent_temporal_errors_verified", "bearing_world_pose_frame_verified", "stationary_target_verified", "allow_single_position_anchor"):
            truth(name, getattr(self, name))
        number("min_quality", self.min_quality)

    @classmethod
    def from_dict(cls, data: dict) -> WindowPolicy:
        known_keys(data, {f.name for f in fields(cls)} - {"min_quality"})
        return cls(**data)


def fixed_lag(rows: DataFrame, group: str, time: str, seconds: float) -> DataFrame:
    """Rows no more than the lag older than their group's newest, both ends included; rows without a time are left out."""
    newest = rows.groupBy(F.col(group).alias("_g")).agg((F.max(time) - round(seconds * 1e9)).alias("_cut"))
    return rows.join(newest, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(time) >= F.col("_cut")).drop("_g", "_cut")


def latest_per_node(rows: DataFrame, group: str) -> DataFrame:
    """Each group's and sensor's last row by (t, uid, seq)."""
    return rows.groupBy(group, "node_id").agg(F.max_by(F.struct(*rows.columns), F.struct("t", "uid", "seq")).alias("_r")).select("_r.*")


def anchors(rows: DataFrame, group: str) -> DataFrame:
    """Each group's row of least covariance trace, then newest, then by uid."""
    c = F.col("covariance")
    return rows.groupBy(group).agg(F.min_by(F.struct(*rows.columns), F.struct(c[0] + c[4] + c[8], -F.col("t"), F.col("uid"))).alias("_r")).select("_r.*")


def strict_ray(bearing: Column) -> Column:
    """struct(origin, direction, basis, covariance, timestamp_ns) of a bearing with a sound tangent frame, else null.

    It must be marked valid and as having a tangent covariance; direction and basis are orthonormal within tolerance, the covariance positive definite.
    """
    o, d, e, c, t = (bearing[n] for n in ("camera_position_world_m", "direction_world", "tangent_basis_world", "tangent_covariance_rad2", "timestamp_ns"))
    n = V.norm(d)
    e1, e2, u = F.slice(e, 1, 3), F.slice(e, 4, 3), V.scale(d, 1 / n)
    off = [V.dot(e1, e1) - 1, V.dot(e2, e2) - 1, V.dot(e1, u), V.dot(e2, u), V.dot(e1, e2)]
    good = bearing["valid"] & bearing["has_tangent_covariance"] & V.all_finite(o, 3) & V.all_finite(d, 3) & V.all_finite(e, 6) & V.all_finite(c, 4) & (t > 0) & n.between(0.99, 1.01)
    for x in off:
        good &= F.abs(x) <= 0.03
    good &= (F.least(c[0], c[3]) > 1e-10) & (F.greatest(c[0], c[3]) <= 0.25) & (F.abs(c[1] - c[2]) <= 1e-8) & (c[0] * c[3] - c[1] * c[1] > 1e-14)
    return F.when(good, F.struct(o.alias("origin"), u.alias("direction"), e.alias("basis"), c.alias("covariance"), t.alias("timestamp_ns")))


CONTEXT = ("domain", "alignment_id", "s_frame", "s_map", "label")


def member_faults(members: DataFrame, policy: WindowPolicy) -> DataFrame:
    """(group_id, n_members, fault) of members (group_id, uid, node_id, CONTEXT, clock_uncertainty_ns): the first rule that the first member, by uid, breaks.

    Each member is held against the group's first one, so no task needs a whole group.
    """
    context = F.struct(*CONTEXT)
    first = members.groupBy("group_id").agg(F.count("*").alias("n_members"), F.min_by(context, "uid").alias("first"))
    owner = members.groupBy("group_id", "node_id").agg(F.min("uid").alias("owner"))
    met = members.join(first, "group_id").join(owner, ["group_id", "node_id"])
    fault = (
        F.when(F.col("domain").isNull(), "unverified_source")
        .when(F.coalesce(F.col("label"), F.lit("")).eqNullSafe("") | ~context.eqNullSafe(F.col("first")), "unverified_class_clock_or_map")
        .when(F.col("uid") != F.col("owner"), "duplicate_physical_node")
        .when(F.col("clock_uncertainty_ns") / 1e9 > policy.max_clock_uncertainty_seconds, "clock_uncertainty_exceeds_limit")
    )
    return met.withColumn("f", fault).groupBy("group_id").agg(F.first("n_members").alias("n_members"), F.min_by("f", F.when(F.col("f").isNotNull(), F.col("uid"))).alias("fault"))


def factors(rows: DataFrame, policy: WindowPolicy) -> DataFrame:
    """(group_id, uid, node_id, seq, kind, t, position, covariance, ray): the sound bearings and positions of observations that lie in their group's window, in aligned time."""
    ray = strict_ray(F.col("bearing"))
    late = F.abs(F.col("ray.timestamp_ns") - F.col("event_time_ns")) / 1e9
    place = F.col("position").isNotNull() & V.is_covariance(F.col("covariance")) & (F.col("frame") == F.col("s_frame")) & (F.col("map_revision") == F.col("s_map")) & (F.col("quality") >= policy.min_quality)
    both = rows.withColumn("ray", ray).withColumns(
        {
            "t_ray": F.when(late <= policy.max_bearing_timestamp_delta_seconds, F.col("ray.timestamp_ns") + F.col("offset_ns")),
            "t_place": F.when(place, F.col("event_time_ns") + F.col("offset_ns")),
        }
    )
    kinds = F.explode(F.array(F.struct(F.lit("ray").alias("kind"), F.col("t_ray").alias("t")), F.struct(F.lit("place").alias("kind"), F.col("t_place").alias("t"))))
    flat = both.withColumn("_k", kinds).where("_k.t IS NOT NULL").select("group_id", "uid", "node_id", "seq", "_k.kind", "_k.t", "position", "covariance", "ray")
    return fixed_lag(flat, "group_id", "t", policy.window_seconds)


def chosen(found: DataFrame, policy: WindowPolicy) -> DataFrame:
    """The factors that the estimate uses: at most one position, the best of the window, and bearings of other sensors, one for each unless errors in time are independent."""
    best = anchors(found.where("kind = 'place'"), "group_id") if policy.allow_single_position_anchor else found.where("false")
    seen = best.select("group_id", F.col("node_id").alias("_anchor"))
    rays = found.where("kind = 'ray'").join(seen, "group_id", "left").where("_anchor IS NULL OR _anchor <> node_id").drop("_anchor")
    return (rays if policy.independent_temporal_errors_verified else latest_per_node(rays, "group_id")).unionByName(best)


#: Numbers of a packed factor: a bearing's origin, direction, basis and covariance, or a position and its covariance.
NUMBERS = 16
#: Factors of a batch that are solved together, padded to the largest group's.
AT_ONCE = 20_000


def packed_factors(use: DataFrame) -> DataFrame:
    """One row for each group of `chosen` factors: group_id and factors, in order of (t, uid, seq)."""
    part = lambda c, n: F.slice(c, 1, n)
    ray = F.concat(part("ray.origin", 3), part("ray.direction", 3), part("ray.basis", 6), part("ray.covariance", 4))
    place = F.concat(part("position", 3), part("covariance", 9), F.array_repeat(F.lit(0.0), 4))
    factor = F.struct("t", "uid", "seq", "node_id", (F.col("kind") == "ray").alias("ray"), F.when(F.col("kind") == "ray", ray).otherwise(place).alias("numbers"))
    return use.groupBy("group_id").agg(F.sort_array(F.collect_list(factor)).alias("factors"))


def _factored(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of the Cholesky factors of a stack of covariances, and which have one."""
    try:
        return np.linalg.inv(np.linalg.cholesky(c)), np.ones(len(c), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros_like(c), np.zeros(len(c), bool)
        for k in range(len(c)):
            try:
                out[k], ok[k] = np.linalg.inv(np.linalg.cholesky(c[k])), True
            except np.linalg.LinAlgError:
                pass
        return out, ok


def _steps(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; not numbers where there is none."""
    try:
        return np.linalg.solve(h, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full_like(g, np.nan)
        for k in range(len(g)):
            try:
                out[k] = np.linalg.solve(h[k], g[k])
            except np.linalg.LinAlgError:
                pass
        return out


def _minimised(residual, x: np.ndarray, active: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt on a stack of problems, each with its own damping, until all have come to rest: states, which did, and which broke down."""
    x, damp = x.copy(), np.full(len(x), 1e-3)
    rested, broken = np.zeros(len(x), bool), np.zeros(len(x), bool)
    r, j = residual(x, np.arange(len(x)))
    for _ in range(steps):
        at = np.flatnonzero(active & ~rested & ~broken)
        if not len(at):
            break
        h, g = j[at].transpose(0, 2, 1) @ j[at], np.einsum("nij,ni->nj", j[at], r[at])
        diagonal = np.einsum("nii->ni", h)
        step = _steps(h + damp[at, None, None] * (np.eye(h.shape[1]) * (diagonal + 1e-12)[:, None, :]), -g)
        lost = np.isnan(step).any(axis=1) & np.isfinite(r[at]).all(axis=1) & np.isfinite(h).all(axis=(1, 2))
        r2, j2 = residual(x[at] + step, at)
        before, after = (r[at] ** 2).sum(axis=1), (r2**2).sum(axis=1)
        better = np.isfinite(r2).all(axis=1) & (after <= before)
        done = (np.linalg.norm(step, axis=1) <= 1e-10 * (1e-10 + np.linalg.norm(x[at], axis=1))) | (before - after <= 1e-14 * before)
        to = at[better]
        x[to], r[to], j[to] = (x[at] + step)[better], r2[better], j2[better]
        damp[at] = np.where(better, np.maximum(damp[at] / 10, 1e-15), damp[at] * 10)
        rested[at] = (better & done) | (~better & (damp[at] > 1e12))
        broken[at] = lost
    return x, rested & ~broken, broken


def solved_windows(lists: pa.Array, p: WindowPolicy) -> dict[str, list]:
    """The columns of RESULT but the group's name for a batch of packed groups, worked out together: matrices are padded to the largest group, and gates are masks."""
    g = Ragged.of_lists(lists)
    groups, reasons = len(lists), Reasons(len(lists))
    numbers, t, is_ray = g.vectors("numbers", NUMBERS), g.numbers("t"), g.numbers("ray").astype(bool)
    node = g.column("node_id").to_pylist()
    code = np.unique(np.array(node, dtype=object).astype(str), return_inverse=True)[1].ravel() if node else np.empty(0, np.int64)

    # Bearings come in their order and padded; a group has one position at most.
    rays = Ragged(np.bincount(g.of[is_ray], minlength=groups), np.empty(0), g.of[is_ray], np.empty(0), None)
    rays.start = np.cumsum(rays.size) - rays.size
    rays.place = np.arange(len(rays.of)) - rays.start[rays.of]
    most = max(2, int(rays.size.max(initial=0)))
    block = rays.padded(numbers[is_ray], most)
    here = rays.padded(np.ones(len(rays.of), bool), most, False)
    time, nodes = rays.padded(t[is_ray], most, 0), rays.padded(code[is_ray], most, -1)
    origin, direction, basis = block[..., :3], block[..., 3:6], block[..., 6:12].reshape(groups, most, 2, 3)
    anchored, anchor = np.zeros(groups, bool), np.zeros((groups, NUMBERS))
    anchored[g.of[~is_ray]], anchor[g.of[~is_ray]] = True, numbers[~is_ray]
    spot, anchor_t, anchor_uid = anchor[:, :3], np.zeros(groups, np.int64), [None] * groups
    anchor_t[g.of[~is_ray]] = t[~is_ray]
    uids = g.column("uid").to_pylist()
    for k in np.flatnonzero(~is_ray).tolist():
        anchor_uid[g.of[k]] = uids[k]

    # Geometry: parallax without a position, else what the first bearing that doesn't fit it says.
    cosine = np.abs(np.einsum("gik,gjk->gij", direction, direction))
    across = here[:, :, None] & here[:, None, :] & (nodes[:, :, None] != nodes[:, None, :])
    widest = np.degrees(np.arccos(np.clip(np.where(across, cosine, np.inf).min(axis=(1, 2)), 0, 1)))
    widest = np.where(across.any(axis=(1, 2)), widest, -1.0)
    reasons.need(anchored | (widest >= p.min_ray_intersection_degrees), "insufficient_cross_node_parallax")
    away = spot[:, None] - origin
    close = here & anchored[:, None] & (np.linalg.norm(away, axis=2) < 0.01)
    behind = here & anchored[:, None] & ((away * direction).sum(axis=2) <= 0)
    first = np.argmax(close | behind, axis=1)
    said = (close | behind).any(axis=1)
    at_origin = close[np.arange(groups), first]
    reasons.need(~(said & at_origin), "anchor_at_ray_origin")
    reasons.need(~said, "anchor_behind_bearing_ray")

    epoch = np.maximum.reduceat(t, g.start) if groups else np.empty(0, np.int64)
    oldest, moving = np.minimum.reduceat(t, g.start) if groups else np.empty(0, np.int64), p.model == "constant_velocity"
    reasons.need(epoch >= 0, "invalid_common_time_epoch")
    span = (epoch - oldest) / 1e9
    reasons.need(np.full(groups, not moving) | (span >= p.min_time_baseline_seconds), "insufficient_temporal_baseline_for_velocity")

    # The state is a position, and for a moving target the way it covers in one window.
    dim, eye = 6 if moving else 3, np.eye(3)

    def at(times: np.ndarray) -> np.ndarray:
        lag = (times - (epoch if times.ndim == 1 else epoch[:, None])) / 1e9 / p.window_seconds
        still = np.broadcast_to(eye, (*times.shape, 3, 3))
        return np.concatenate([still, lag[..., None, None] * eye], -1) if moving else still

    m, m_anchor = at(time), at(anchor_t)
    seen = here[..., None, None]
    a = np.concatenate([np.where(seen, basis @ m, 0).reshape(groups, 2 * most, dim), np.where(anchored[:, None, None], m_anchor, 0)], 1)
    b = np.concatenate([np.where(here[..., None], np.einsum("grik,grk->gri", basis, origin), 0).reshape(groups, 2 * most), np.where(anchored[:, None], spot, 0)], 1)
    known = 2 * rays.size + 3 * anchored
    a = np.where(np.isfinite(a), a, 0)
    values = np.linalg.svd(a, compute_uv=False) if groups else np.zeros((0, dim))
    reasons.need((known >= dim) & ((values > 1e-8).sum(axis=1) == dim), "unobservable_linear_geometry")
    x = np.einsum("gij,gj->gi", np.linalg.pinv(a, rcond=1e-15 * max(a.shape[1:])), b) if groups else np.zeros((0, dim))
    reasons.need(np.isfinite(x).all(axis=1), "invalid_initial_state")
    flat = np.where(here[..., None, None], block[..., 12:].reshape(groups, most, 2, 2), np.eye(2)).reshape(-1, 2, 2)
    w, fine = _factored(flat)
    w, fine = w.reshape(groups, most, 2, 2), fine.reshape(groups, most).all(axis=1)
    w_anchor, fine_anchor = _factored(np.where(anchored[:, None, None], anchor[:, 3:12].reshape(groups, 3, 3), eye))
    reasons.need(fine & fine_anchor, "optimization_numerical_failure")

    def residual(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = np.einsum("grij,gj->gri", m[i], x) - origin[i]
        n = np.maximum(np.linalg.norm(off, axis=2), 1e-6)[..., None]
        wb = w[i] @ basis[i]
        r = np.einsum("grik,grk->gri", wb, off / n)
        j = wb @ (eye / n[..., None] - off[..., :, None] * off[..., None, :] / n[..., None] ** 3) @ m[i]
        r, j = np.where(here[i][..., None], r, 0), np.where(here[i][..., None, None], j, 0)
        held = anchored[i]
        r0 = np.einsum("gik,gk->gi", w_anchor[i], np.einsum("gij,gj->gi", m_anchor[i], x) - spot[i])
        r0, j0 = np.where(held[:, None], r0, 0), np.where(held[:, None, None], w_anchor[i] @ m_anchor[i], 0)
        return np.concatenate([r.reshape(len(i), -1), r0], 1), np.concatenate([j.reshape(len(i), -1, dim), j0], 1)

    with np.errstate(all="ignore"):
        x, rested, broken = _minimised(residual, np.where(reasons.open[:, None], x, 0), reasons.open)
        reasons.need(~broken, "optimization_numerical_failure")
        reasons.need(rested, "nonconvergent_window_optimization")
        r, j = residual(x, np.arange(groups))
        j = np.where(reasons.open[:, None, None] & np.isfinite(j), j, 0)
        values = np.linalg.svd(j, compute_uv=False) if groups else np.zeros((0, dim))
        condition = values[:, 0] / values[:, -1]
        reasons.need((values[:, -1] > 1e-7) & (condition <= p.max_condition_number), "unobservable_or_ill_conditioned_state")
        rms = np.sqrt((r**2).sum(axis=1) / np.maximum(known, 1))
        reasons.need(np.isfinite(rms) & (rms <= p.max_normalized_rms), "factor_residual_exceeds_gate")
        velocity = x[:, 3:] / p.window_seconds
        reasons.need(np.linalg.norm(velocity, axis=1) <= p.max_target_speed_mps if moving else np.ones(groups, bool), "unphysical_estimated_velocity")
        ahead = ((np.einsum("grij,gj->gri", m, x) - origin) * direction).sum(axis=2) > 0.01
        reasons.need((ahead | ~here).all(axis=1), "ray_points_behind_camera")
        scale = np.diag([1.0] * 3 + [1 / p.window_seconds] * (dim - 3))
        h = np.where(reasons.open[:, None, None], j.transpose(0, 2, 1) @ j, np.eye(dim))
        cov = scale @ np.linalg.inv(h) @ scale
        reasons.need(np.isfinite(cov).all(axis=(1, 2)), "invalid_conditional_curvature")

    good = reasons.open
    some = lambda values: [v if ok else None for v, ok in zip(values, good.tolist(), strict=True)]
    by_group = np.split(np.array(node, object)[is_ray], rays.start[1:]) if groups else []
    return {
        "accepted": good.tolist(), "reason": ["conditional_fixed_lag_solution_requires_validation" if x is None else x for x in reasons.text], "epoch_ns": some(epoch.tolist()), "position": some(x[:, :3].tolist()),
        "velocity": some(velocity.tolist()) if moving else [None] * groups, "covariance": some(cov.reshape(groups, -1).tolist()), "rms": some(rms.tolist()), "n_bearings": some(rays.size.tolist()),
        "condition": some(condition.tolist()), "span_s": some(span.tolist()), "anchor_uid": some(anchor_uid), "bearing_nodes": some([sorted(set(n)) for n in by_group]),
    }


RESULT = (
    "group_id string, accepted boolean, reason string, epoch_ns long, position array<double>, velocity array<double>, covariance array<double>, rms double, n_bearings int,"
    " condition double, span_s double, anchor_uid string, bearing_nodes array<string>"
)


def window_estimates(rows: DataFrame, policy: WindowPolicy | None = None) -> DataFrame:
    """One row for each group_id: the estimate with its diagnostics, or the reason why there is none.

    rows: one for each observation of a member: group_id, uid, node_id, seq, event_time_ns, position, covariance, quality, frame,
    map_revision, bearing, and its sensor's label, domain, alignment_id, s_frame, s_map, offset_ns, clock_uncertainty_ns.

    Gates and the choice of observations are joins and aggregates; what goes to the solver is one row for each group with its chosen factors, at most
    max_observations of them, and an Arrow batch of such rows is solved at once. Groups that fail a gate before never get there.
    """
    policy = policy or WindowPolicy()
    constant = [
        (policy.independent_source_errors_verified, "independent_source_errors_not_verified"), (policy.bearing_world_pose_frame_verified, "bearing_camera_pose_frame_not_verified"),
        (policy.model != "static_position" or policy.stationary_target_verified, "static_motion_model_not_verified"),
    ]
    gate = next((reason for ok, reason in constant if not ok), None)
    members = rows.groupBy("group_id", "uid").agg(*[F.first(c).alias(c) for c in ("node_id", *CONTEXT, "clock_uncertainty_ns")])
    groups = member_faults(members, policy)
    found = checkpoint(factors(rows, policy))
    use = checkpoint(chosen(found, policy))
    counts = use.groupBy("group_id").agg(F.count_if(F.col("kind") == "ray").alias("n_rays"), F.count_if(F.col("kind") == "place").alias("n_places"))
    groups = groups.join(found.select("group_id").distinct().withColumn("any", F.lit(True)), "group_id", "left").join(counts, "group_id", "left")
    n_rays, n_places = F.coalesce("n_rays", F.lit(0)), F.coalesce("n_places", F.lit(0))
    early = (
        F.when(~F.col("n_members").between(2, 8), "requires_preassociated_multi_node_group")
        .when(F.lit(gate is not None), F.lit(gate))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("any").isNull(), "no_valid_observations")
        .when(n_rays + n_places > policy.max_observations, "window_observation_limit_exceeded")
        .when(n_rays < F.when(n_places > 0, 1).otherwise(2), "insufficient_cross_node_bearing_factors")
    )
    groups = groups.withColumn("early", early).select("group_id", "early")

    kinds = {"accepted": pa.bool_(), "reason": pa.string(), "epoch_ns": pa.int64(), "position": pa.list_(pa.float64()), "velocity": pa.list_(pa.float64()), "covariance": pa.list_(pa.float64()),
             "rms": pa.float64(), "n_bearings": pa.int32(), "condition": pa.float64(), "span_s": pa.float64(), "anchor_uid": pa.string(), "bearing_nodes": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Groups of like size together, so that padding stays small.
            size = np.array([len(x) for x in b.column("factors")], np.int64)
            order, at = np.argsort(size, kind="stable"), 0
            while at < len(order):
                n = 1
                while at + n < len(order) and (n + 1) * size[order[at + n]] <= AT_ONCE:
                    n += 1
                some = b.take(pa.array(order[at : at + n]))
                found = solved_windows(some.column("factors"), policy)
                yield pa.RecordBatch.from_arrays([some.column("group_id"), *[pa.array(found[c], kind) for c, kind in kinds.items()]], ["group_id", *kinds])
                at += n

    ready = use.join(groups.where("early IS NULL").select("group_id"), "group_id", "left_semi")
    tried = packed_factors(ready).mapInArrow(run, RESULT)
    refused = groups.where("early IS NOT NULL").select("group_id", F.lit(False).alias("accepted"), F.col("early").alias("reason"))
    return tried.unionByName(refused, allowMissingColumns=True)
