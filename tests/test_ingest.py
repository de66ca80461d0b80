import json
import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import ingest
from trackweave.sources import adapters


def event(seq, **more):
    return {"event_id": f"e{seq}", "node_id": "n", "camera_id": "c", "session_id": 1, "local_id": 2, "seq": seq, "type": "update", "event_time_ns": seq * 10, "class_id": 0, "blobs": []} | more


def batches(spark, *bodies):
    return ingest.decode_batches(spark.createDataFrame(list(enumerate(bodies)), "batch_id long, body string"))


def errors(spark, *bodies):
    return {r["batch_id"]: r["error"] for r in batches(spark, *bodies).select("batch_id", "error").distinct().collect()}


def test_batches(spark):
    wrap = lambda *e, v=1: json.dumps({"version": v, "events": list(e)})
    blob = {"sha256": "a" * 64, "size": 5, "mime": "image/png"}
    got = errors(
        spark, wrap(event(1), event(2, session_id=2**64 - 1)), "{", wrap(event(1), v=2), wrap(), wrap(event(1), event(2, node_id="m")), wrap(event(-5)), '{"version":1,"version":1,"events":[]}',
        wrap(event(1)).replace('"class_id": 0', '"class_id": NaN'), wrap(event(1, blobs=[blob])), wrap(event(1, blobs=[blob, blob])), wrap(event(1, session_id=2**64)), wrap(event(1, type="stop")),
        wrap(*[event(k) for k in range(1, 514)]),
    )
    assert [got[i] for i in range(13)] == [None, "json", "version", "count", "nodes", "event", "json", "json", None, "event", "event", "event", "count"]
    assert batches(spark, wrap(event(1), event(2))).count() == 2


WRONG = [
    {"event_id": 5}, {"camera_id": {"a": 1}}, {"node_id": ["n"]}, {"session_id": 1.5}, {"session_id": "7"}, {"session_id": True}, {"seq": 2.0}, {"local_id": "3"}, {"event_time_ns": 1e3}, {"type": 1}, {"type": None},
    {"blobs": None}, {"blobs": {}}, {"blobs": [5]}, {"blobs": [{"sha256": "a" * 64, "size": 5, "mime": 7}]}, {"blobs": [{"sha256": "a" * 64, "size": "5", "mime": ""}]}, {"event_id": ""}, {"event_id": "a\n"}, {"event_id": "x" * 513},
]


def test_wrongly_typed_events(spark):
    got = errors(spark, *[json.dumps({"version": 1, "events": [event(1), event(2) | wrong]}) for wrong in WRONG])
    assert got == dict.fromkeys(range(len(WRONG)), "event")


def test_odd_batches(spark):
    blob = {"sha256": "b" * 64, "size": 0, "mime": "", "more": [1, {"x": None}]}
    good = json.dumps({"version": 1, "events": [event(1, blobs=[blob]), event(2, extra={"a": [1, 2.5]}), event(3, session_id=2**64 - 1)]})
    missing = event(4)
    del missing["blobs"]
    bodies = [good, '{"version":true,"events":[]}', '{"version":1,"events":[5]}', json.dumps({"version": 1, "events": [missing]}), "", "[]", None]
    assert errors(spark, *bodies) == {0: None, 1: "version", 2: "event", 3: "event", 4: "size", 5: "version", 6: "size"}


def test_events_in_quotes(spark):
    """An event is an object; a string that holds one is none."""
    quoted = json.dumps({"version": 1, "events": [event(1), json.dumps(event(2))]})
    assert errors(spark, quoted, json.dumps({"version": 1, "events": [json.dumps(event(1))]}), json.dumps({"version": 1, "events": [None, event(1)]})) == dict.fromkeys(range(3), "event")


def test_batches_keep_their_partitions(spark):
    """JSON is decoded by as many tasks as there are shuffle partitions, however few bytes these have."""
    assert adapters.event_batches(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


WORLD = {"valid": True, "coordinate_frame_id": "f", "x_m": 1, "y_m": 2.5, "z_m": -3.0, "velocity_valid": True, "vx_mps": 1.0, "vy_mps": 0.0, "vz_mps": 2, "position_covariance_m2": [1.0, 0.1, 0, 0.1, 2, 0, 0, 0, 3], "quality": 0.5}
PLACE = {"valid": True, "map": {"valid": True, "revision": "m"}}


def look(spark, *spatial, **more):
    body = json.dumps({"version": 1, "events": [event(i + 1, spatial=s, **more) for i, s in enumerate(spatial)]})
    return ingest.observed(batches(spark, body)).orderBy("seq").collect()


def test_observations(spark):
    bearing = {"valid": True, "timestamp_ns": 7, "camera_position_world_m": [0, 0, 0], "direction_world": [1, 0, 0], "tangent_basis_world": [0, 1, 0, 0, 0, 1], "has_tangent_covariance": True, "tangent_covariance_rad2": [1e-4, 0, 0, 1e-4]}
    cases = [
        ({"world": WORLD, "localization_quality": PLACE, "bearing": bearing}, (True, True, True, 0.5, "f", "m", True)),
        ({"world": WORLD | {"valid": 1}, "localization_quality": PLACE}, (False, False, True, 0.5, "f", "m", False)),
        ({"world": WORLD | {"coordinate_frame_id": 5}, "localization_quality": PLACE}, (False, False, True, 0.5, "", "m", False)),
        ({"world": WORLD, "localization_quality": {"map": {"valid": "true", "revision": "m"}}}, (False, False, True, 0.5, "f", "", False)),
        ({"world": WORLD, "localization_quality": {"map": {"valid": True, "revision": 3}}}, (False, False, True, 0.5, "f", "", False)),
        ({"world": WORLD | {"position_covariance_m2": [0] * 9, "velocity_valid": False, "quality": "0.9"}, "localization_quality": PLACE}, (True, False, False, 0.0, "f", "m", False)),
        ({"world": WORLD | {"position_covariance_m2": [1, 2, 0, 2, 1, 0, 0, 0, 1], "quality": True}, "localization_quality": PLACE}, (True, False, True, 0.0, "f", "m", False)),
        ({"world": WORLD | {"position_covariance_m2": [1, 0.2, 0, 0.1, 2, 0, 0, 0, 3], "vx_mps": "1"}, "localization_quality": PLACE}, (True, False, False, 0.5, "f", "m", False)),
        ({"world": WORLD | {"y_m": None}, "localization_quality": PLACE, "bearing": 5}, (False, False, True, 0.5, "f", "m", False)),
        ({"world": [1]}, (False, False, False, 0.0, "", "", False)),
        (7, (False, False, False, 0.0, "", "", False)),
        (None, (False, False, False, 0.0, "", "", False)),
    ]
    got = look(spark, *[c for c, _ in cases])
    there = lambda r: (r["position"] is not None, r["covariance"] is not None, r["velocity"] is not None, r["quality"], r["frame"], r["map_revision"], r["bearing"] is not None)
    assert [there(r) for r in got] == [e for _, e in cases]
    assert got[0]["position"] == [1.0, 2.5, -3.0] and got[0]["bearing"]["direction_world"] == [1.0, 0.0, 0.0] and got[0]["class_id"] == 0
    assert look(spark, None, class_id=None)[0]["class_id"] == -1


def test_an_older_sound_covariance_is_taken(spark):
    """The newest observation has a covariance that is none: `latest` goes back to the one before."""
    from trackweave.operators import tracklets

    bad = WORLD | {"position_covariance_m2": [0.0] * 9}
    body = json.dumps({"version": 1, "events": [event(1, spatial={"world": WORLD, "localization_quality": PLACE}), event(2, spatial={"world": bad, "localization_quality": PLACE})]})
    found = tracklets.tracklets(tracklets.segmented(ingest.observed(batches(spark, body)))).first()
    assert found["latest"]["seq"] == 1 and found["uid"] == '["n","c",1,2,1]'


def decided(batches_, stored=()):
    """Batches one by one, as a store takes them."""
    by_seq, by_id = {(n, s): (e, d) for n, s, e, d in stored}, {(n, e): s for n, s, e, d in stored}
    out = {}
    for b in sorted({r[0] for r in batches_}):
        seqs, ids, ok = dict(by_seq), dict(by_id), True
        for _, n, s, e, d in (r for r in batches_ if r[0] == b):
            ok &= seqs.setdefault((n, s), (e, d)) == (e, d) and ids.setdefault((n, e), s) == s
        for _, n, s, e, d in (r for r in batches_ if r[0] == b):
            out[b, n, s, e, d] = "conflict" if not ok else "replay" if any((n, s) == x[:2] for x in stored) else "new"
        if ok:
            by_seq, by_id = seqs, ids
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batches_are_decided_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    pick = lambda: ("n", rng.randint(1, 12), f"e{rng.randint(1, 12)}", rng.choice("xxxy"))
    stored = [("n", k, f"e{k}", "x") for k in (1, 2)]
    rows = [(b, *pick()) for b in range(14) for _ in range(rng.randint(1, 3))]
    form = "batch_id long, node_id string, seq long, event_id string, digest string"
    got = ingest.classify(spark.createDataFrame(rows, form), spark.createDataFrame([(-1, *s) for s in stored], form))
    assert {tuple(r[c] for c in ("batch_id", "node_id", "seq", "event_id", "digest")): r["status"] for r in got.collect()} == decided(rows, stored)


@pytest.mark.parametrize("seqs, contiguous, missing", [([2, 4], 0, [(1, 1), (3, 3)]), ([2, 4, 1], 2, [(3, 3)]), ([2, 4, 1, 3], 4, []), ([1, 2, 3, 4, 5], 5, [])])
@pytest.mark.parametrize("width", [2, 4096])
def test_watermark_and_gaps(spark, monkeypatch, seqs, contiguous, missing, width):
    monkeypatch.setattr(ingest, "SEQ_RANGE", width)
    rows = spark.createDataFrame([("n", s) for s in seqs] + [("m", s) for s in range(1, 12)], "node_id string, seq long")
    cursors = ingest.contiguous(rows)
    assert {r["node_id"]: r["contiguous"] for r in cursors.collect()} == {"n": contiguous, "m": 11}
    assert sorted((r["lo"], r["hi"]) for r in ingest.gaps(rows).collect()) == missing
    assert sorted((r["lo"], r["hi"]) for r in ingest.gaps(rows, 1).collect()) == missing[:1]


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_ledgers_of_random_numbers(spark, monkeypatch, width):
    """Watermark, highest number and gaps of sensors with lost events and missing blobs, against plain sets."""
    monkeypatch.setattr(ingest, "SEQ_RANGE", width)
    rng = random.Random(width)
    seqs = {f"n{i}": {s for s in range(1, rng.randint(2, 40)) if rng.random() < 0.93} | {rng.randint(1, 50)} for i in range(25)}
    lost = {(n, s) for n, some in seqs.items() for s in some if rng.random() < 0.04}
    odd = [(None, 1), ("n0", None), ("n1", 0), ("n1", -3)]
    rows = spark.createDataFrame([(n, s) for n, some in seqs.items() for s in some] * 2 + odd, "node_id string, seq long").repartition(3)
    known = ingest.ledger(rows, spark.createDataFrame(sorted(lost), "node_id string, seq long"))
    got = {r["node_id"]: (r["contiguous"], r["highest"]) for r in ingest.cursors_of(known).collect()}
    runs = {}
    for r in ingest.gaps_of(known).collect():
        runs.setdefault(r["node_id"], set()).update(range(r["lo"], r["hi"] + 1))
    for n, some in seqs.items():
        upto = 0
        while upto + 1 in some and (n, upto + 1) not in lost:
            upto += 1
        assert got[n] == (upto, max(some)) and runs.get(n, set()) == set(range(1, max(some))) - some


def test_blob_stall(spark):
    events = spark.createDataFrame([("n", 1), ("n", 2), ("n", 3)], "node_id string, seq long")
    refs = spark.createDataFrame([("n", 2, "aa", 5)], "node_id string, seq long, sha string, size long")
    none = spark.createDataFrame([("aa", 6)], "sha string, size long")  # another size is another blob
    ack = ingest.acknowledgements(events, refs, none).first()
    assert (ack["contiguous"], ack["highest"], ack["missing"], ack["missing_blobs"]) == (1, 3, None, ["aa"])
    ack = ingest.acknowledgements(events, refs, none.union(spark.createDataFrame([("aa", 5)], "sha string, size long"))).first()
    assert (ack["contiguous"], ack["missing_blobs"]) == (3, None)


def test_replay_and_conflict(spark):
    form = "batch_id long, node_id string, seq long, event_id string, digest string"
    stored = spark.createDataFrame([(0, "n", 1, "a", "x"), (0, "n", 2, "b", "x")], form)
    new = spark.createDataFrame([(1, "n", 1, "a", "x"), (1, "n", 3, "c", "x"), (2, "n", 2, "b", "y"), (2, "n", 4, "d", "x"), (3, "n", 5, "a", "x"), (4, "n", 6, "f", "x"), (5, "n", 7, "f", "x")], form)
    got = {(r["batch_id"], r["seq"]): r["status"] for r in ingest.classify(new, stored).collect()}
    assert got == {(1, 1): "replay", (1, 3): "new", (2, 2): "conflict", (2, 4): "conflict", (3, 5): "conflict", (4, 6): "new", (5, 7): "conflict"}


def test_pages_and_blobs(spark):
    rows = spark.range(1, 50).withColumnRenamed("id", "seq")
    assert [r[0] for r in ingest.page(rows, 10, 3).collect()] == [11, 12, 13]
    with pytest.raises(ValueError):
        ingest.page(rows, 0, 1001)
    files = spark.createDataFrame([("x",), ("y",)], "t string").select(F.sha2("t", 256).alias("sha"), F.lit("m").alias("mime"), F.encode("t", "utf-8").alias("contents"))
    assert ingest.valid_blobs(files.union(files).union(files.withColumn("sha", F.lit("0")))).count() == 2


def test_events_are_numbered_in_blocks(spark, tmp_path, monkeypatch):
    """The numbers of row_number over a sensor's events, with null and repeated keys, by tasks of a block of ids each."""
    monkeypatch.setattr(adapters, "BLOCK", 7)
    rows = [(i * 3 - 40, i % 9 if i % 10 else None) for i in range(60)] + [(None, 1), (None, None), (10**15, 2)]
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("*", "'signup' AS event_type", "1.0D AS value").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    events = adapters.track_events(spark, str(tmp_path))
    by_sensor = {}
    for i, u in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by_sensor.setdefault(None if u is None else u % 4, []).append(i)
    want = {(None if k is None else f"node_{k}", i, n) for k, ids in by_sensor.items() for n, i in enumerate(ids, 1)}
    assert {(r["node_id"], r["event_id"], r["seq"]) for r in events.select("node_id", "event_id", "seq").collect()} == want


def test_payloads_are_parsed_once_for_all_rules(spark):
    df = ingest.decode_batches(spark.createDataFrame([(1, "{}")], "batch_id long, body string")).select("batch_id", "error", "event")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 1 <= plan.replace("_", "").count("parsejson") <= 3, plan.count("parse")
