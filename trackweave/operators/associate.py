"""Cross-sensor association: candidate pairs by gates on labels, clocks, positions and rays."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .checkpoints import checkpoint
from .policies import in_range

#: Longest time between an observation and the ray that it is held against (fixed value).
RAY_AGE_NS = 250_000_000


#: Ranges of the policy's values (fixed values).
ASSOCIATION_RANGES = {
    "max_pair_dt_s": (0, 2), "maximum_speed_mps": (0.1, 200), "maximum_sigma_m": (0.001, 100), "max_mahalanobis_sq": (0.1, 100), "min_quality": (0, 1), "clock_error_gate_s": (0, 1),
    "minimum_ray_crossing_deg": (0.1, 40), "maximum_ray_separation_sigma": (0.1, 10),
}
#: Clock domains in which sensors may be associated, and the largest offset and uncertainty of a sensor's clock (fixed values).
DOMAINS, MAX_OFFSET_NS, MAX_UNCERTAINTY_NS = ("shared_utc", "shared_sim"), 60_000_000_000, 1_000_000_000
MAX_LABEL = 128


@dataclass(frozen=True)
class AssociationPolicy:
    """Gates of the pair join; the defaults and ranges are fixed values of the domain."""

    max_pair_dt_s: float = 0.25
    maximum_speed_mps: float = 30.0
    maximum_sigma_m: float = 15.0
    max_mahalanobis_sq: float = 11.344866730144373
    min_quality: float = 0.0
    clock_error_gate_s: float = 0.05
    minimum_ray_crossing_deg: float = 3.0
    maximum_ray_separation_sigma: float = 4.0

    def __post_init__(self):
        for name, (low, high) in ASSOCIATION_RANGES.items():
            in_range(name, getattr(self, name), low, high)


SOURCE = "node_id string, verified boolean, domain string, offset_ns long, clock_uncertainty_ns long, alignment_id string, frame string, map_revision string"


@dataclass(frozen=True)
class AssociationConfig:
    """A configured association: its policy, the alignment of verified sensors, and (node_id, class_id, label) of their models' classes."""

    policy: AssociationPolicy
    sources: list[tuple]
    labels: list[tuple[str, int, str]]

    @classmethod
    def from_dict(cls, data: dict) -> AssociationConfig:
        """From configured values: `sources` by node, `class_labels` by node and class id, and the policy's own by name. Other keys are ignored.

        Sensors that aren't verified are left out, whatever else they have, and stay unassociated. What a verified one has must be complete and in range; labels
        are compared without white space around them and in lower case. Anything else is refused.
        """
        entries = data.get("sources") if type(data) is dict else None
        if type(entries) is not dict:
            raise ValueError("sources are required: an object by node")
        labels = data.get("class_labels", {})
        if type(labels) is not dict or not all(type(x) is dict for x in labels.values()):
            raise ValueError("class_labels must be an object by node and class id")
        sources = [s for s in (_source(node, item) for node, item in entries.items()) if s]
        named = {(node, int(key)): _label(node, key, name) for node, of in labels.items() for key, name in of.items() if _decimal(node, key)}
        policy = AssociationPolicy(**{f.name: data[f.name] for f in fields(AssociationPolicy) if f.name in data})
        return cls(policy, sources, [(*k, label) for k, label in named.items()])

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The sources and labels that `candidate_pairs` takes."""
        return spark.createDataFrame(self.sources, SOURCE), spark.createDataFrame(self.labels, "node_id string, class_id long, label string")


def _whole(value, low: int, high: int) -> bool:
    return type(value) is int and low <= value <= high


def _source(node, item) -> tuple | None:
    if not isinstance(node, str) or not node or type(item) is not dict:
        raise ValueError("a source needs a name and an object")
    if item.get("verified") is not True:
        return None
    if item.get("domain") not in DOMAINS:
        raise ValueError(f"source {node}: domain must be one of {DOMAINS}")
    names = [item.get(n) for n in ("alignment_id", "coordinate_frame_id", "map_revision")]
    if not all(isinstance(n, str) and n for n in names):
        raise ValueError(f"source {node}: alignment_id, coordinate_frame_id and map_revision are required")
    offset, uncertainty = item.get("offset_ns", 0), item.get("clock_uncertainty_ns")
    if not _whole(offset, -MAX_OFFSET_NS, MAX_OFFSET_NS):
        raise ValueError(f"source {node}: offset_ns must be whole and within a minute")
    if not _whole(uncertainty, 0, MAX_UNCERTAINTY_NS):
        raise ValueError(f"source {node}: clock_uncertainty_ns must be whole and 0 to a second")
    return (node, True, item["domain"], offset, uncertainty, *names)


def _decimal(node: str, key) -> bool:
    if type(key) is not str or not key.isdecimal():
        raise ValueError(f"class_labels of {node}: a class id must be written in digits")
    return True


def _label(node: str, key: str, name) -> str:
    if type(name) is not str or not name.strip() or len(name) > MAX_LABEL:
        raise ValueError(f"class_labels of {node}: class {key} needs a label of {MAX_LABEL} characters at most")
    return name.strip().lower()


def localised(tracklets: DataFrame, sources: DataFrame, labels: DataFrame, policy: AssociationPolicy) -> DataFrame:
    """Tracklets that may be paired at all, with label, clock context and aligned time `t`.

    The sensor must be verified, the class have a label, and the latest observation stand in the sensor's
    frame and map with enough quality. Policy tables are small dimensions; Spark picks the join.
    """
    plain = labels.withColumn("label", F.lower(F.regexp_replace("label", r"^\s+|\s+$", "")))
    named = tracklets.where("latest IS NOT NULL").join(plain.where("label <> ''"), ["node_id", "class_id"])
    met = named.join(sources.where("verified").withColumnRenamed("frame", "s_frame").withColumnRenamed("map_revision", "s_map"), "node_id")
    met = met.where((F.col("latest.frame") == F.col("s_frame")) & (F.col("latest.map_revision") == F.col("s_map")) & (F.col("latest.quality") >= policy.min_quality))
    met = met.where(V.bounded(F.col("latest.covariance"), policy.maximum_sigma_m))
    rays = F.lit(None).cast("struct<origin:array<double>,direction:array<double>,sigma:double,timestamp_ns:bigint>")
    if "bearing" in met.schema["latest"].dataType.names:
        b = F.col("latest.bearing")
        rays = F.when((b["timestamp_ns"] > 0) & (F.abs(b["timestamp_ns"] - F.col("latest.event_time_ns")) <= RAY_AGE_NS), V.ray(b))
    return met.select(
        "uid", "node_id", "start_ns", "label", "domain", "alignment_id", F.col("s_frame").alias("frame"), F.col("s_map").alias("map_revision"), "clock_uncertainty_ns",
        (F.col("latest.event_time_ns") + F.col("offset_ns")).alias("t"), F.col("latest.position").alias("p"), F.col("latest.covariance").alias("c"), F.col("latest.velocity").alias("v"), rays.alias("ray"),
    )


CONTEXT = ["label", "domain", "alignment_id", "frame", "map_revision"]
#: Rows faster than this times the policy's speed are paired without cells: their own velocity may carry them out of reach of the cells around.
FAST = 4.0


def _covered(low, high, width):
    """The slots of a width that low .. high touches."""
    return F.explode(F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long")))


def _met(rows: DataFrame, policy: AssociationPolicy) -> DataFrame:
    """Pairs (a_.., b_..) of rows of one context, near in time and, on the ground, not further apart than the gates can bridge.

    Both gates become join keys: time is cut into slots and the ground into cells, one side is put into all that its reach touches (two or three on average) and
    the other into its own. So pairs meet by hash, and a join of any size is split by label, context, time and place.
    """
    width = max(int(policy.max_pair_dt_s * 1e9), 1)
    most = policy.max_pair_dt_s + policy.clock_error_gate_s
    reach = policy.maximum_speed_mps * (most + FAST * policy.max_pair_dt_s) + 3.5 * policy.maximum_sigma_m
    cell = max(2 * reach, 1.0)
    names = ("uid", "node_id", "start_ns", "clock_uncertainty_ns", "t", "p", "c", "v", "ray")
    side = lambda x, df, *more: df.select(*CONTEXT, *[F.col(c).alias(f"{x}_{c}") for c in names], *more)
    x, y = F.col("p")[0], F.col("p")[1]
    rows = checkpoint(rows.withColumn("fast", F.coalesce(V.norm(F.col("v")) > FAST * policy.maximum_speed_mps, F.lit(False))))
    around = rows.withColumn("slot", _covered(F.col("t") - width, F.col("t") + width, 4 * width))
    placed = rows.withColumn("slot", F.floor(F.col("t") / (4 * width)).cast("long"))
    near = around.where("NOT fast").withColumn("gx", _covered(x - reach, x + reach, cell)).withColumn("gy", _covered(y - reach, y + reach, cell))
    own = placed.where("NOT fast").withColumns({"gx": F.floor(x / cell).cast("long"), "gy": F.floor(y / cell).cast("long")})
    keys = [*CONTEXT, "slot"]
    met = side("a", near, "slot", "gx", "gy").join(side("b", own, "slot", "gx", "gy"), [*keys, "gx", "gy"]).drop("gx", "gy")
    if not rows.where("fast").isEmpty():
        met = met.unionByName(side("a", around.where("fast"), "slot").join(side("b", placed, "slot"), keys))
        met = met.unionByName(side("a", around.where("NOT fast"), "slot").join(side("b", placed.where("fast"), "slot"), keys))
    return met


def candidate_pairs(tracklets: DataFrame, sources: DataFrame, labels: DataFrame, policy: AssociationPolicy | None = None, most: int | None = None) -> DataFrame:
    """(left_uid, right_uid, cost, d2, elapsed_s, evidence) of pairs that pass all gates; left starts first.

    Rows meet in slots of time and cells of the ground (`_met`), not in a nested loop. `most` raises on more pairs.
    """
    policy = policy or AssociationPolicy()
    met = _met(localised(tracklets, sources, labels, policy), policy)
    first = F.struct("a_start_ns", "a_uid") < F.struct("b_start_ns", "b_uid")
    delta = (F.col("b_t") - F.col("a_t")) / 1e9
    uncertain = (F.col("a_clock_uncertainty_ns") + F.col("b_clock_uncertainty_ns")) / 1e9
    met = met.where(first & (F.col("a_node_id") != F.col("b_node_id")))
    met = met.withColumns({"delta": delta, "dt": F.abs(delta) + uncertain}).where((F.abs("delta") <= policy.max_pair_dt_s) & (uncertain <= policy.clock_error_gate_s))
    moved = lambda p, v, by: F.when(v.isNotNull(), V.add(p, V.scale(v, by))).otherwise(p)
    met = met.withColumns(
        {
            "p": F.when(F.col("delta") > 0, moved(F.col("a_p"), F.col("a_v"), F.col("delta"))).otherwise(F.col("a_p")),
            "q": F.when(F.col("delta") < 0, moved(F.col("b_p"), F.col("b_v"), -F.col("delta"))).otherwise(F.col("b_p")),
            "reach": F.col("dt") * policy.maximum_speed_mps,
        }
    )
    met = met.withColumns({"diff": V.sub(F.col("p"), F.col("q")), "both": V.widened(V.add(F.col("a_c"), F.col("b_c")), (F.col("reach") / 2) ** 2)})
    largest = F.greatest(*[F.col(s)[i] for s in ("a_c", "b_c") for i in (0, 4, 8)])
    met = met.withColumns({"d2": V.mahalanobis_sq(F.col("diff"), F.col("both")), "sigma": F.sqrt(largest)})
    met = met.where((F.col("d2") <= policy.max_mahalanobis_sq) & (V.norm(F.col("diff")) <= F.col("reach") + 3.5 * F.col("sigma")))
    met = V.compared_rays(met, "a_ray", "b_ray", F.sqrt(F.col("sigma") ** 2 + F.col("reach") ** 2), policy.minimum_ray_crossing_deg, policy.maximum_ray_separation_sigma, "rays").where("rays IS NULL OR rays.consistent")
    found = met.select(
        F.col("a_uid").alias("left_uid"), F.col("b_uid").alias("right_uid"), (F.col("d2") + 0.25 * F.abs("delta") / max(policy.max_pair_dt_s, 1e-6)).alias("cost"),
        "d2", F.abs("delta").alias("elapsed_s"), F.coalesce("rays.label", F.lit("position-only")).alias("evidence"),
    )
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidate pairs")
    return found
