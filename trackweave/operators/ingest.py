"""Reliable ingest: validation, replay and conflicts, contiguous-prefix watermark, gaps, missing blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from .checkpoints import checkpoint

#: Limits of the wire format (fixed values).
MAX_EVENTS, MAX_BATCH_BYTES = 512, 4 * 1024 * 1024
MAX_BLOBS, MAX_BLOB_BYTES, MAX_MIME = 128, 16 * 1024 * 1024, 200
MAX_LISTED = 128
TYPES = ("start", "update", "end")
SEQ_RANGE = 4096

BLOB = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mime", T.StringType())])
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("camera_id", T.StringType()),
        T.StructField("session_id", T.DecimalType(20, 0)),
        T.StructField("local_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("event_time_ns", T.LongType()),
        T.StructField("class_id", T.LongType()),
        T.StructField("blobs", T.ArrayType(BLOB)),
    ]
)


def _identifier(c: Column, most: int) -> Column:
    return c.isNotNull() & F.length(c).between(1, most) & ~c.rlike(r"[\x00-\x1f]")


def event_error(e: Column | None = None) -> Column:
    """The first rule that an event breaks, or null. `e` is a struct; without it, columns of the row."""
    col = (lambda n: e[n]) if e is not None else F.col
    blobs = col("blobs")
    good_blob = lambda b: (
        F.coalesce(b["sha256"].rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)) & F.coalesce(b["size"].between(0, MAX_BLOB_BYTES), F.lit(False)) & F.coalesce(F.length(b["mime"]) <= MAX_MIME, F.lit(False))
    )
    rules = [
        ("node_id", _identifier(col("node_id"), 128)),
        ("camera_id", _identifier(col("camera_id"), 128)),
        ("session_id", (col("session_id") >= 0) & (col("session_id") < F.lit("18446744073709551616").cast("decimal(20,0)"))),
        ("seq", col("seq") >= 1),
        ("event_id", _identifier(col("event_id"), 512)),
        ("type", col("type").isin(*TYPES)),
        ("local_id", col("local_id") >= 0),
        ("event_time_ns", col("event_time_ns") >= 0),
        ("blobs", blobs.isNotNull() & (F.size(blobs) <= MAX_BLOBS) & F.forall(blobs, good_blob) & (F.size(F.array_distinct(F.transform(blobs, lambda b: b["sha256"]))) == F.size(blobs))),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


#: Types that an event's values must be written with: a number in quotes is no number, a number no name.
WRITTEN = {"node_id": "STRING", "camera_id": "STRING", "session_id": "WHOLE", "seq": "WHOLE", "event_id": "STRING", "type": "STRING", "local_id": "WHOLE", "event_time_ns": "WHOLE", "blobs": "BLOBS"}


def type_error(event: Column) -> Column:
    """The first value of an event (a variant) that is written with the wrong type, or null."""
    kind = lambda name: F.schema_of_variant(F.try_variant_get(event, f"$.{name}", "variant"))
    fits = {
        "STRING": lambda k: k == "STRING",
        "WHOLE": lambda k: (k == "BIGINT") | k.rlike(r"^DECIMAL\((19|20),0\)$"),
        "BLOBS": lambda k: (k == "ARRAY<VOID>") | (k == "ARRAY<>") | (k.rlike("^ARRAY<OBJECT<") & k.contains("mime: STRING") & k.contains("sha256: STRING") & k.contains("size: BIGINT")),
    }
    return F.coalesce(*[F.when(~F.coalesce(fits[t](kind(name)), F.lit(False)), F.lit(name)) for name, t in WRITTEN.items()])


def decode_batches(raw: DataFrame, body: str = "body") -> DataFrame:
    """Parses JSON batches to rows (batch_id, error, event, payload, digest).

    A batch must be strict JSON (no repeated keys, no NaN), of version 1, at most MAX_BATCH_BYTES, with 1 to
    MAX_EVENTS events of one node that are all valid, each value written with its own type (`WRITTEN`); else it gives one row with an error and no events.
    """
    form = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("events", T.ArrayType(T.StringType()))])
    strict = {"allowNonNumericNumbers": "false"}
    parsed = raw.select("batch_id", F.col(body).alias("_b")).withColumns({"_strict": F.try_parse_json("_b"), "_batch": F.from_json("_b", form, strict)})
    read = lambda s, v: F.struct(F.from_json(s, EVENT, strict).alias("event"), s.alias("payload"), type_error(v).alias("fault"))
    values = F.try_variant_get("_strict", "$.events", "array<variant>")  # as the batch was parsed to, so that no payload is parsed again for its types
    parsed = parsed.withColumn("_events", F.zip_with("_batch.events", values, read))
    rules = [
        ("size", F.octet_length("_b").between(1, MAX_BATCH_BYTES)),
        ("json", F.col("_strict").isNotNull() & F.col("_batch").isNotNull()),
        ("version", F.col("_batch.version") == 1),
        ("count", F.size("_batch.events").between(1, MAX_EVENTS)),
        ("event", F.forall("_events", lambda x: x["fault"].isNull() & event_error(x["event"]).isNull())),
        ("nodes", F.size(F.array_distinct(F.transform("_events", lambda x: x["event"]["node_id"]))) == 1),
    ]
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    rows = parsed.withColumn("error", error).select("batch_id", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("_events"))).alias("_x"))
    canonical = F.to_json(F.parse_json("_x.payload"))
    return rows.select("batch_id", "error", F.col("_x.event").alias("event"), F.col("_x.payload").alias("payload"), F.when(F.col("_x").isNotNull(), F.sha2(canonical, 256)).alias("digest"))


#: What an observation is read from; names may be of any JSON type and count only as strings.
SPATIAL = (
    "frame_id bigint, spatial struct<world:struct<valid:boolean,coordinate_frame_id:variant,x_m:double,y_m:double,z_m:double,velocity_valid:boolean,vx_mps:double,vy_mps:double,vz_mps:double,position_covariance_m2:array<double>,quality:double>,"
    "localization_quality:struct<map:struct<valid:boolean,revision:variant>>,bearing:struct<valid:boolean,timestamp_ns:bigint,camera_position_world_m:array<double>,direction_world:array<double>,tangent_basis_world:array<double>,"
    "has_tangent_covariance:boolean,tangent_covariance_rad2:array<double>>>"
)


def observed(events: DataFrame) -> DataFrame:
    """Observations of decoded events (event, payload): the envelope's columns, and position, covariance, velocity, quality, frame, map_revision and bearing.

    Values of the wrong type count as absent. A position needs a valid world estimate with a frame and a valid map with a revision; its covariance must be
    symmetric and positive definite, else it is null, and so is one without a position. Velocity counts where it is valid, quality is 0 where there is none.
    A missing class is -1. Rows without an event are left out.
    """
    rows = events.where("event IS NOT NULL").select("event", F.from_json("payload", SPATIAL, {"allowNonNumericNumbers": "false"}).alias("o"))
    world, place = F.col("o.spatial.world"), F.col("o.spatial.localization_quality.map")
    name = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))
    rows = rows.withColumns({"frame": name(world["coordinate_frame_id"]), "map_revision": F.when(place["valid"], name(place["revision"])).otherwise("")})
    xyz = lambda *keys: F.array(*[world[k] for k in keys])
    seen = world["valid"] & V.all_finite(xyz("x_m", "y_m", "z_m"), 3) & (F.col("frame") != "") & (F.col("map_revision") != "")
    rows = rows.withColumn("position", F.when(seen, xyz("x_m", "y_m", "z_m")))
    c, v = world["position_covariance_m2"], xyz("vx_mps", "vy_mps", "vz_mps")
    return rows.select(
        *[F.col(f"event.{n}").alias(n) for n in ("event_id", "node_id", "camera_id", "session_id", "local_id", "seq", "type", "event_time_ns")],
        F.coalesce("event.class_id", F.lit(-1).cast("long")).alias("class_id"), F.col("o.frame_id").alias("frame_id"), "position",
        F.when(F.col("position").isNotNull() & V.is_covariance(c), c).alias("covariance"),
        F.when(world["velocity_valid"] & V.all_finite(v, 3), v).alias("velocity"),
        F.when(V.finite(world["quality"]), world["quality"]).otherwise(0.0).alias("quality"),
        "frame", "map_revision", F.col("o.spatial.bearing").alias("bearing"),
    )


def _claims(rows: DataFrame) -> DataFrame:
    """(batch_id, node_id, kind, key, value): what events hold fast: a number its event, an event its number."""
    by_seq = F.struct(F.lit("seq").alias("kind"), F.col("seq").cast("string").alias("key"), F.to_json(F.array(F.col("event_id").cast("string"), F.col("digest"))).alias("value"))
    by_id = F.struct(F.lit("id").alias("kind"), F.col("event_id").cast("string").alias("key"), F.col("seq").cast("string").alias("value"))
    return rows.withColumn("_c", F.explode(F.array(by_seq, by_id))).select("batch_id", "node_id", "_c.*")


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `status` to incoming events (batch_id, node_id, seq, event_id, digest): new, replay or conflict.

    A replay has the stored event's id and digest. Anything else at a stored (node, seq), or a stored
    (node, event_id) at another seq, is a conflict, and so is what differs from another event of its batch or of an earlier batch that is
    accepted; a conflict rejects its whole batch, which then leaves nothing. So it is as if batches came one by one in the order of batch_id, however
    they are delivered.

    Batches are decided in rounds: those that no undecided earlier batch can contradict are accepted, then those that contradict them are rejected. Without
    contradictions one round decides all. Each claim is compared with the least and greatest value before it, not with each rival.
    """
    key, claims = ["node_id", "kind", "key"], checkpoint(_claims(incoming).distinct())
    own = claims.groupBy("batch_id", *key).agg(F.count("*").alias("n")).where("n > 1").select("batch_id")
    held = _claims(stored.select("node_id", "seq", "event_id", "digest").withColumn("batch_id", F.lit(None).cast("long"))).select(*key, F.col("value").alias("held"))
    against = claims.join(held, key).where("value <> held").select("batch_id")
    refused = checkpoint(own.union(against).distinct())
    left = checkpoint(claims.join(refused, "batch_id", "left_anti"))
    while True:
        before = Window.partitionBy(*key).orderBy("batch_id").rangeBetween(Window.unboundedPreceding, -1)
        rival = left.withColumns({"lo": F.min("value").over(before), "hi": F.max("value").over(before)}).where("lo <> value OR hi <> value").select("batch_id").distinct()
        undecided = checkpoint(rival)
        if undecided.isEmpty():
            break
        accepted = left.join(undecided, "batch_id", "left_anti").select(*key, F.col("value").alias("held")).distinct()
        waiting = left.join(undecided, "batch_id", "left_semi")
        beaten = checkpoint(waiting.join(accepted, key).where("value <> held").select("batch_id").distinct())
        refused = refused.union(beaten)
        left = checkpoint(left.join(beaten, "batch_id", "left_anti"))
    known = stored.select("node_id", "seq", F.lit(True).alias("_known"))
    met = incoming.join(known, ["node_id", "seq"], "left").join(refused.withColumn("_refused", F.lit(True)), "batch_id", "left")
    status = F.when(F.col("_refused"), "conflict").when(F.col("_known"), "replay").otherwise("new")
    return met.withColumn("status", status).drop("_known", "_refused")


def missing_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """References (node_id, seq, sha, size) with no blob of that hash and size."""
    return refs.join(blobs.select("sha", "size").distinct(), ["sha", "size"], "left_anti").select("node_id", "seq", "sha", "size")


def ledger(events: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(node_id, r, n_ok, first, last, upto, gaps): what is there of each node's SEQ_RANGE numbers from r * SEQ_RANGE + 1 on.

    n_ok counts those without a missing blob, upto is the last number up to which all from the range's start are, gaps are the runs of absent numbers between first
    and last. One pass over the events; a sensor with very many is spread over tasks. The table is small and written once, for all that is asked of it.
    Repeated events count once; rows without a node or with a number that is null or below 1 are left out.
    """
    seen = events.where("node_id IS NOT NULL AND seq >= 1").select("node_id", "seq").distinct()
    if missing is None:
        seen = seen.withColumn("ok", F.lit(True))
    else:
        seen = seen.join(missing.select("node_id", "seq", F.lit(False).alias("ok")).distinct(), ["node_id", "seq"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    seen = seen.withColumn("r", F.floor((F.col("seq") - 1) / SEQ_RANGE))
    w = Window.partitionBy("node_id", "r").orderBy("seq")
    seen = seen.withColumns({"prev": F.lag("seq").over(w), "k": F.row_number().over(w), "bad": F.sum((~F.col("ok")).cast("int")).over(w)})
    whole = (F.col("bad") == 0) & (F.col("seq") == F.col("r") * SEQ_RANGE + F.col("k"))
    gap = F.when(F.col("seq") > F.col("prev") + 1, F.struct((F.col("prev") + 1).alias("lo"), (F.col("seq") - 1).alias("hi")))
    return checkpoint(
        seen.groupBy("node_id", "r").agg(
            F.count_if("ok").alias("n_ok"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.coalesce(F.max(F.when(whole, F.col("seq"))), F.col("r") * SEQ_RANGE).alias("upto"), F.sort_array(F.collect_list(gap)).alias("gaps")
        )
    )


def cursors_of(ledger: DataFrame) -> DataFrame:
    """(node_id, contiguous, highest) of a `ledger`: the largest n of each node with events 1 .. n all present and complete, and the largest of all."""
    by_range = Window.partitionBy("node_id").orderBy("r")
    before = F.row_number().over(by_range) - 1  # full ranges from the first on have their own number
    led = F.coalesce(F.min(((F.col("n_ok") == SEQ_RANGE) & (F.col("r") == F.col("k"))).cast("int")).over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)) == 1
    rows = ledger.withColumn("k", before).withColumn("reached", led & (F.col("r") == F.col("k")))
    return rows.groupBy("node_id").agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("upto"))), F.lit(0)).cast("long").alias("contiguous"), F.max("last").alias("highest"))


def gaps_of(ledger: DataFrame, most: int | None = None) -> DataFrame:
    """(node_id, lo, hi) of a `ledger`: runs of absent numbers below the highest, the first `most` of each node. All lie above the watermark, which stops at the first."""
    before = F.coalesce(F.lag("last").over(Window.partitionBy("node_id").orderBy("r")), F.lit(0))
    edge = F.when(F.col("first") > F.col("before") + 1, F.array(F.struct((F.col("before") + 1).alias("lo"), (F.col("first") - 1).alias("hi")))).otherwise(F.array())
    found = ledger.withColumn("before", before).select("node_id", F.explode(F.concat(edge, "gaps")).alias("g")).select("node_id", "g.lo", "g.hi")
    if most is None:
        return found
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("node_id").orderBy("lo"))).where(F.col("_k") <= most).drop("_k")


def contiguous(events: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(node_id, contiguous): the largest n of each node with events 1 .. n all present and complete."""
    return cursors_of(ledger(events, missing)).select("node_id", "contiguous")


def gaps(events: DataFrame, most: int | None = None) -> DataFrame:
    """(node_id, lo, hi): runs of absent numbers, the first `most` of each node."""
    return gaps_of(ledger(events), most)


def acknowledgements(events: DataFrame, refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row for each node: contiguous, highest, missing (lo, hi) and missing_blobs, as an ACK lists them."""
    missing = checkpoint(missing_blobs(refs, blobs))
    known = ledger(events, missing)
    cursors = cursors_of(known)
    listed = gaps_of(known, MAX_LISTED).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("missing"))
    wanted = missing.join(cursors, "node_id").where("seq > contiguous").select("node_id", "sha").distinct()
    first = F.row_number().over(Window.partitionBy("node_id").orderBy("sha"))
    wanted = wanted.withColumn("_k", first).where(F.col("_k") <= MAX_LISTED).groupBy("node_id").agg(F.sort_array(F.collect_list("sha")).alias("missing_blobs"))
    return cursors.join(listed, "node_id", "left").join(wanted, "node_id", "left")


def page(rows: DataFrame, after: int, limit: int, by: str = "seq") -> DataFrame:
    """A keyset page: the first `limit` rows (1 to 1000) with `by` above `after`."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return rows.where(F.col(by) > after).orderBy(by).limit(limit)


def valid_blobs(files: DataFrame) -> DataFrame:
    """Blobs (sha, size, mime, contents), once each, whose contents have the hash that they are named by."""
    good = files.where((F.sha2("contents", 256) == F.col("sha")) & (F.length("contents") <= MAX_BLOB_BYTES))
    return good.withColumn("size", F.length("contents").cast("long")).dropDuplicates(["sha"]).select("sha", "size", "mime", "contents")
