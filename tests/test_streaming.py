"""Streams against what the batch operators and the plain rules give."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from trackweave.operators import identity, records
from trackweave.streaming import inbox, world

DELIVERY = "batch_id long, node_id string, seq long, event_id string, digest string"


def put(spark, path, rows, form):
    spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(str(path))


def test_watermark_follows_out_of_order_arrivals(spark, tmp_path):
    form, seen = "node_id string, seq long", []
    for seqs in ((2, 4), (1,), (3, 3), (5,)):
        put(spark, tmp_path / "in", [("n", s) for s in seqs] + [(None, 1), ("n", 0)], form)
        stream = spark.readStream.schema(form).parquet(str(tmp_path / "in"))
        inbox.follow_watermarks(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        seen.append(inbox.watermarks(spark, str(tmp_path / "out")).collect())
    assert [[r["contiguous"] for r in rows] for rows in seen] == [[0], [2], [4], [5]]


@pytest.mark.parametrize("last", [7, 8, 9, 32767, 32768, 32769, 70000])
def test_watermark_across_bitmaps(spark, tmp_path, last):
    rows = spark.range(1, last + 1).union(spark.createDataFrame([(last + 2,)], "id long")).select(F.lit("n").alias("node_id"), F.col("id").alias("seq"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("node_id string, seq long").parquet(str(tmp_path / "in"))
    inbox.follow_watermarks(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert [tuple(r) for r in inbox.watermarks(spark, str(tmp_path / "out")).collect()] == [("n", last)]


def test_no_events_no_watermarks(spark, tmp_path):
    inbox.begun(spark, str(tmp_path / "out"), inbox.BITMAPS)
    assert inbox.watermarks(spark, str(tmp_path / "out")).count() == 0


def test_deliveries_are_kept_once(spark, tmp_path):
    deliveries = [
        [(1, "n", 1, "a", "x"), (1, "n", 2, "b", "x")],
        [(2, "n", 1, "a", "x"), (2, "n", 3, "c", "x")],  # a replay beside a new event
        [(3, "n", 2, "b", "y"), (3, "n", 4, "d", "x")],  # a conflict rejects its whole batch
        [(4, "n", 4, "e", "x"), (5, "m", 1, "a", "x")],
    ]
    for rows in deliveries:
        put(spark, tmp_path / "in", rows, DELIVERY)
        stream = spark.readStream.schema(DELIVERY).parquet(str(tmp_path / "in"))
        inbox.keep_deliveries(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    kept = inbox.epochs(spark, str(tmp_path / "out"), spark.createDataFrame([], DELIVERY).schema)
    assert sorted((r["node_id"], r["seq"], r["event_id"]) for r in kept.collect()) == [("m", 1, "a"), ("n", 1, "a"), ("n", 2, "b"), ("n", 3, "c"), ("n", 4, "e")]


def test_triggers_may_be_cut_anywhere(spark, tmp_path):
    """A batch that an accepted one contradicts, and one that only a rejected one does: the same events are kept from one trigger as from many."""
    rows = [(1, "n", 2, "b", "y"), (2, "n", 1, "a", "x"), (2, "n", 2, "b", "x"), (3, "n", 1, "c", "z"), (4, "n", 1, "a", "x")]
    kept = []
    for name, parts in (("one", [rows]), ("many", [[r for r in rows if r[0] == b] for b in (1, 2, 3, 4)])):
        for part in parts:
            put(spark, tmp_path / name / "in", part, DELIVERY)
            stream = spark.readStream.schema(DELIVERY).parquet(str(tmp_path / name / "in"))
            inbox.keep_deliveries(stream, str(tmp_path / name / "out"), str(tmp_path / name / "ckpt")).awaitTermination()
        found = inbox.epochs(spark, str(tmp_path / name / "out"), spark.createDataFrame([], DELIVERY).schema).collect()
        kept.append(sorted((r["seq"], r["event_id"], r["digest"]) for r in found))
    assert kept == [[(1, "c", "z"), (2, "b", "y")]] * 2


def test_compaction_changes_nothing_for_readers(spark, tmp_path):
    """Epochs go on while they are merged, level by level: the same watermarks, fewer folders, and a reader of the layout before still finds its files."""
    path, plain, open_reader = str(tmp_path / "out"), str(tmp_path / "plain"), None
    for to in (path, plain):
        inbox.begun(spark, to, inbox.BITMAPS)
    for k in range(11):
        bits = inbox.bitmaps(spark.createDataFrame([("n", k + 1), ("m", 2 * k + 1), ("n", 40_000 + k)], "node_id string, seq long"))
        for to in (path, plain):
            inbox.write_epoch(bits, to, k)
        if open_reader is not None:
            assert open_reader.count() > 0
        if k:
            assert inbox.compact(spark, path, inbox.BITMAPS, merge=inbox.merged_bitmaps)
        open_reader = inbox.epochs(spark, path, inbox.BITMAPS)
        if k % 5 == 0:
            assert sorted(map(tuple, inbox.watermarks(spark, path).collect())) == sorted(map(tuple, inbox.watermarks(spark, plain).collect())) == [("m", 1), ("n", k + 1)]
    now = inbox.layout(spark, path)
    assert now["upto"] == 9 and sorted(r["level"] for r in now["runs"]) == [0, 0, 1, 1]
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("epoch=")]) <= 4 and len(list((tmp_path / "out-runs").iterdir())) <= 8
    assert not inbox.compact(spark, path, inbox.BITMAPS, merge=inbox.merged_bitmaps), "nothing new"


def test_events_are_kept_once_across_compactions(spark, tmp_path):
    """Replays, conflicts and a trigger that is run again meet stored events in runs as in epochs."""
    schema = spark.createDataFrame([], DELIVERY).schema
    path = str(tmp_path / "out")
    for k, rows in enumerate([[(1, "n", 1, "a", "x")], [(2, "n", 2, "b", "x")], [(3, "n", 1, "a", "x"), (3, "n", 3, "c", "x")], [(4, "n", 2, "b", "y")], [(5, "n", 9, "a", "x"), (6, "n", 4, "d", "x")]]):
        put(spark, tmp_path / "in", rows, DELIVERY)
        inbox.keep_deliveries(spark.readStream.schema(DELIVERY).parquet(str(tmp_path / "in")), path, str(tmp_path / "ckpt")).awaitTermination()
        assert inbox.compact(spark, path, schema) == (k > 0)
    kept = sorted((r["seq"], r["event_id"], r["epoch"]) for r in inbox.epochs(spark, path, schema).collect())
    assert kept == [(1, "a", 0), (2, "b", 1), (3, "c", 2), (4, "d", 4)]
    assert inbox.epochs(spark, path, schema, before=2).count() == 2


def test_one_of_two_compactions_wins(spark, tmp_path):
    schema, path = spark.createDataFrame([], DELIVERY).schema, str(tmp_path / "t")
    inbox.begun(spark, path, schema)
    for k in range(3):
        inbox.write_epoch(spark.createDataFrame([(k, "n", k, str(k), "x")], DELIVERY), path, k)
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda _: inbox.compact(spark, path, schema), range(2)))
    assert sum(done) == 1 and inbox.epochs(spark, path, schema).count() == 3


def test_unblocked(spark):
    refs = spark.createDataFrame([("a", 1, "s", 5), ("b", 2, "s", 6), ("c", 1, "s", 5)], "node_id string, seq long, sha string, size long")
    assert sorted(r[0] for r in inbox.unblocked(refs, spark.createDataFrame([("s", 5)], "sha string, size long")).collect()) == ["a", "c"]


@pytest.mark.parametrize(("given", "after", "told"), [((4, 5, 7), 3, [4, 5]), ((5, 6), 3, []), ((), 0, []), ((1, 2, 3), 0, [1, 2, 3]), ((1, 2, 3), 2, [3])])
def test_hints_stop_at_a_gap(spark, given, after, told):
    hints = spark.createDataFrame([(g,) for g in given], "revision long")
    assert sorted(r[0] for r in world.consecutive(hints, after).collect()) == told


LATEST = "struct<event_time_ns:long,quality:double,frame:string,map_revision:string,position:array<double>,covariance:array<double>>"


def seen(spark, uids):
    at = (1, 0.5, "f", "m", [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    return spark.createDataFrame([(u, f"n{u}", 1, 2, 1, 0, at) for u in uids], f"uid string, node_id string, start_ns long, end_ns long, n_events long, class_id long, latest {LATEST}")


def test_worlds_follow_one_another(spark, tmp_path):
    root, labels = str(tmp_path), spark.createDataFrame([("na", 0, "person"), ("nb", 0, "person")], "node_id string, class_id long, label string")
    groups = lambda *rows: spark.createDataFrame(rows, "uid string, group_id string")
    assert world.publish(groups(("a", "a"), ("b", "b")), seen(spark, "ab"), labels, root) == 1
    assert world.publish(groups(("a", "a"), ("b", "b")), seen(spark, "ab"), labels, root) == 1, "nothing changed"
    assert world.publish(groups(("a", "a"), ("b", "a")), seen(spark, "ab"), labels, root) == 2
    log = sorted(tuple(r) for r in world.revisions_after(spark, root, 0).collect())
    a, b = identity.minted("a"), identity.minted("b")
    assert b < a and log == [(1, "a", None, a, "new", 1), (2, "b", None, b, "new", 1), (3, "a", a, b, "identity_revised", 2)], "of two ids with equal overlap the smaller stays"
    assert [r["revision"] for r in world.revisions_after(spark, root, 1, limit=1).collect()] == [2]
    track = world.tracks(spark, root).collect()
    assert [(t["global_id"], t["status"], t["class_name"]) for t in track] == [(b, "associated_pair", "person")]
    # A run that failed before it published leaves rows that nobody reads.
    spark.createDataFrame([(4, "z", None, "g", "new")], world.REVISIONS).write.parquet(f"{root}/revisions/world=3")
    assert world.revisions_after(spark, root, 0).count() == 3
    told = lambda node, frame: world.wire(world.tracks(spark, root), seen(spark, "ab"), spark.createDataFrame([(node, frame, "m")], "node_id string, frame string, map_revision string")).first()
    assert told("na", "f")["position"] == [1.0, 2.0, 3.0]
    assert told("na", "other")["position"] is None and told("nb", "f")["position"] is None and told("nb", "f")["global_id"] == b


def test_records_are_published_once(spark, tmp_path):
    """Many threads try for each number: one gets it, and what is there is whole."""
    with ThreadPoolExecutor(8) as pool:
        for k in range(5):
            got = list(pool.map(lambda n: records.publish(spark, str(tmp_path / "r"), k, {"n": k, "by": n, "pad": "x" * 5000}), range(8)))  # noqa: B023
            assert sum(got) == 1
            r = records.newest(spark, str(tmp_path / "r"), "n long, by long, pad string", "n")
            assert (r["n"], r["by"], len(r["pad"])) == (k, got.index(True), 5000)
    assert sorted(f.name for f in (tmp_path / "r").iterdir() if not f.name.startswith(".")) == [f"{k:012d}.json" for k in range(5)]
    assert records.newest(spark, str(tmp_path / "none"), "n long", "n") is None


def test_two_writers_publish_one_after_another(spark, tmp_path):
    """Each number once, a gapless log, and ids that go on from what the other one published."""
    root, labels = str(tmp_path), spark.createDataFrame([("na", 0, "person")], "node_id string, class_id long, label string")
    groups = lambda *rows: spark.createDataFrame(rows, "uid string, group_id string")
    one = groups(("a", "a"), ("b", "b"))
    two = groups(("a", "a"), ("b", "a"))
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda g: world.publish(g, seen(spark, "ab"), labels, root), (one, two)))
    assert sorted(done) == [1, 2] and world.latest(spark, root)["world"] == 2
    log = sorted(tuple(r) for r in world.revisions_after(spark, root, 0).collect())
    assert [r[0] for r in log] == list(range(1, len(log) + 1)) and {r[5] for r in log} == {1, 2} and [r[4] for r in log if r[5] == 1] == ["new", "new"]
    assert {r["uid"] for r in world.members(spark, root).collect()} == {"a", "b"}


def test_a_stream_of_changes_publishes(spark, tmp_path):
    put(spark, tmp_path / "in", [(1,)], "n long")
    stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
    labels = spark.createDataFrame([], "node_id string, class_id long, label string")
    given = lambda s: (s.createDataFrame([("a", "a")], "uid string, group_id string"), seen(s, "a"), labels)
    world.follow(stream, given, str(tmp_path / "world"), str(tmp_path / "ckpt"), {"availableNow": True}).awaitTermination()
    assert world.latest(spark, str(tmp_path / "world"))["world"] == 1


def test_identity_revisions_facts_and_messages(spark, tmp_path):
    root, labels = str(tmp_path / "w"), spark.createDataFrame([("na", 0, "person"), ("nb", 0, "person"), ("nc", 0, "person")], "node_id string, class_id long, label string")
    groups = lambda *rows: spark.createDataFrame(rows, "uid string, group_id string")
    estimates = spark.createDataFrame([("a", True, "ci_position_only", [1.0, 2.0, 3.0], [1.0])], "group_id string, accepted boolean, reason string, mean array<double>, covariance array<double>")
    first = groups(("a", "a"), ("b", "a"), ("c", "c"))
    pairs = spark.createDataFrame([("a", "b", 0.5)], "left_uid string, right_uid string, cost double")
    world.publish(first, seen(spark, "abc"), labels, root, world.facts(pairs, pairs, first, estimates), "p1", fusion=estimates)
    assert world.latest(spark, root)["facts"] == {"candidate_count": 1, "selected_pair_count": 1, "associated_group_count": 0, "experimental_fusion_accepted": 1, "experimental_window_accepted": 0}
    track = {r["representative"]: r for r in world.tracks(spark, root).collect()}
    assert (track["a"]["identity_revision"], track["a"]["fusion_estimate_status"], track["a"]["fusion_position"], track["c"]["fusion_estimate_status"]) == (1, "experimental_ci", [1.0, 2.0, 3.0], None)
    assert world.publish(first, seen(spark, "abc"), labels, root, policy="p2") == 2, "another policy is another world"
    assert {r["identity_revision"] for r in world.tracks(spark, root).collect()} == {1}, "the same members"
    world.publish(groups(("a", "a"), ("b", "a"), ("c", "a")), seen(spark, "abc"), labels, root, policy="p2")
    only = world.tracks(spark, root).first()
    assert (only["identity_revision"], only["status"], only["members"]) == (2, "associated_group", ["a", "b", "c"])

    sent = []
    alignment = spark.createDataFrame([("na", "f", "m")], "node_id string, frame string, map_revision string")
    state = lambda s, w: (seen(s, "abc"), alignment)
    send = lambda df: sent.append([tuple(r) for r in df.orderBy("topic", "key").collect()])
    for k in range(2):
        put(spark, tmp_path / "ticks", [(k,)], "tick long")
        ticks = spark.readStream.schema("tick long").parquet(str(tmp_path / "ticks"))
        world.announce(ticks, root, state, send, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    states = [m for m in sent if m[0][0] == world.STATE_TOPIC]
    hints = [m for m in sent if m[0][0] == world.HINT_TOPIC]
    assert len(hints) == 1 and [json.loads(v)["revision"] for _, _, v in hints[0]] == list(range(1, len(hints[0]) + 1)), "hints once, in order"
    assert len(states) == 2 and json.loads(states[0][0][2])["position"] == [1.0, 2.0, 3.0] and json.loads(states[0][0][2])["world_revision"] == 3


def test_late_blobs_move_watermarks(spark, tmp_path):
    form, blob = "node_id string, seq long", "sha string, size long"
    refs = spark.createDataFrame([("n", 2, "s", 5), ("n", 3, "t", 5), ("n", 3, "s", 5), ("m", 1, "s", 5), ("k", 1, "u", 1)], "node_id string, seq long, sha string, size long")
    put(spark, tmp_path / "events", [("n", 1), ("n", 4), ("m", 2), ("k", 2)], form)  # those without missing blobs
    inbox.follow_watermarks(spark.readStream.schema(form).parquet(str(tmp_path / "events")), str(tmp_path / "seen"), str(tmp_path / "c1")).awaitTermination()
    told = []
    for arrived in ([("s", 6)], [("s", 5)], [("t", 5), ("s", 5)]):
        put(spark, tmp_path / "blobs", arrived, blob)
        inbox.follow_blobs(spark.readStream.schema(blob).parquet(str(tmp_path / "blobs")), lambda s: refs, str(tmp_path / "late"), str(tmp_path / "c2")).awaitTermination()
        told.append({r["node_id"]: r["contiguous"] for r in inbox.watermarks(spark, str(tmp_path / "seen"), str(tmp_path / "late/bits")).collect()})
    assert told == [{"n": 1, "m": 0, "k": 0}, {"n": 2, "m": 2, "k": 0}, {"n": 4, "m": 2, "k": 0}]
