"""Tracklets, association, grouping, identities and estimates on small scenes."""

import itertools
import random

import numpy as np
import pytest

from trackweave.operators import associate, fusion, graph, identity, tracklets, window_ls
from trackweave.sources import adapters

EVENT = "node_id string, camera_id string, session_id long, local_id long, seq long, type string, event_time_ns long, class_id long, position array<double>, covariance array<double>, velocity array<double>, quality double, frame string, map_revision string"
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def seen(node, seq, ns, x, kind="update", cov=EYE, cls=0):
    return (node, "cam", 1, 1, seq, kind, ns, cls, [float(x), 2.0, 3.0], cov, [0.0] * 3, 0.9, adapters.FRAME, adapters.MAP)


def found(spark, *rows):
    return tracklets.tracklets(tracklets.segmented(spark.createDataFrame(list(rows), EVENT)))


def pairs(spark, t, sources=None, labels=None):
    return associate.candidate_pairs(t, adapters.sources(spark) if sources is None else sources, adapters.labels(spark) if labels is None else labels)


def test_lifecycle_and_late_events(spark):
    rows = [seen("node_0", 1, 100, 0, "start"), seen("node_0", 2, 300, 0, "end"), seen("node_0", 3, 200, 0), seen("node_0", 4, 400, 0), seen("node_0", 5, 500, 0, "start")]
    got = {r["uid"]: (r["start_ns"], r["end_ns"], r["n_events"], r["closed"]) for r in found(spark, *rows).collect()}
    uid = '["node_0","cam",1,1,{}]'.format
    assert got == {uid(1): (100, 300, 3, True), uid(4): (400, 400, 1, False), uid(5): (500, 500, 1, False)}


def test_latest_is_fresh_and_located(spark):
    late = 10**9
    rows = [seen("node_0", 1, late, 1), seen("node_0", 2, late + 260_000_000, 2, cov=None), seen("node_1", 1, late, 1), seen("node_1", 2, late + 240_000_000, 2, cov=None)]
    got = {r["node_id"]: r["latest"] for r in found(spark, *rows).collect()}
    assert got["node_0"] is None and got["node_1"]["seq"] == 1


def test_pair_and_gates(spark):
    a, b = seen("node_0", 1, 1_000_000_000, 10), seen("node_1", 1, 1_020_000_000, 10.5)
    t = found(spark, a, b)
    got = pairs(spark, t).collect()
    assert [(r["left_uid"], r["right_uid"], r["evidence"]) for r in got] == [('["node_0","cam",1,1,1]', '["node_1","cam",1,1,1]', "position-only")]
    src = adapters.sources(spark)
    for change in ("verified = node_id <> 'node_1'", "domain = if(node_id = 'node_1', 'other', domain)", "map_revision = if(node_id = 'node_1', 'other', map_revision)", "clock_uncertainty_ns = 90000000L", "alignment_id = node_id"):
        name, value = change.split(" = ", 1)
        assert pairs(spark, t, src.selectExpr(*[f"{value} AS {c}" if c == name else c for c in src.columns])).isEmpty(), change
    assert pairs(spark, t, labels=adapters.labels(spark).selectExpr("node_id", "class_id", "node_id AS label")).isEmpty()
    assert pairs(spark, found(spark, a, seen("node_1", 1, 1_900_000_000, 10.5))).isEmpty()
    assert pairs(spark, found(spark, a, seen("node_1", 1, 1_020_000_000, 200))).isEmpty()
    assert pairs(spark, found(spark, a, seen("node_1", 1, 1_020_000_000, 10.5, cov=[0.0] * 9))).isEmpty()


def test_slots_find_what_a_nested_loop_finds(spark):
    rng = random.Random(5)
    rows = [seen(f"node_{i % 4}", 1, 1_000_000_000 + rng.randrange(10**9), rng.uniform(0, 30))[:3] + (i,) + seen("x", 1, 1_000_000_000 + rng.randrange(10**9), rng.uniform(0, 30))[4:] for i in range(80)]
    t = found(spark, *rows)
    got = {(r["left_uid"], r["right_uid"]) for r in pairs(spark, t).collect()}
    want = set()
    for a, b in itertools.combinations(sorted(t.collect(), key=lambda r: (r["start_ns"], r["uid"])), 2):
        x, y = a["latest"], b["latest"]
        dt = abs(x["event_time_ns"] - y["event_time_ns"]) / 1e9
        reach = 30 * (dt + 0.01)
        d = abs(x["position"][0] - y["position"][0])
        if a["node_id"] != b["node_id"] and dt <= 0.25 and d * d / (2 + (reach / 2) ** 2) <= 11.344866730144373 and d <= reach + 3.5:
            want.add((a["uid"], b["uid"]))
    assert got == want and want


def test_cells_and_fast_rows_lose_no_pair(spark):
    """Places over several cells, and velocities that carry some of them across: what a nested loop finds."""
    rng = random.Random(6)
    form = "uid string, node_id string, class_id long, start_ns long, latest struct<event_time_ns:long,position:array<double>,covariance:array<double>,velocity:array<double>,quality:double,frame:string,map_revision:string>"
    rows = []
    for i in range(90):
        v = rng.choice([None, [rng.uniform(-40, 40), 0.0, 0.0], [rng.uniform(-3000, 3000), 0.0, 0.0]])
        x, spread = rng.uniform(-600, 600), rng.choice([1.0, 150.0])
        rows.append((f"u{i:02d}", f"node_{i % 4}", 0, i, (10**9 + rng.randrange(10**9), [x, rng.uniform(-3, 3), 0.0], [spread, 0.0, 0.0, 0.0, spread, 0.0, 0.0, 0.0, spread], v, 0.9, adapters.FRAME, adapters.MAP)))
    policy = associate.AssociationPolicy()
    got = {(r["left_uid"], r["right_uid"]) for r in associate.candidate_pairs(spark.createDataFrame(rows, form), adapters.sources(spark), adapters.labels(spark), policy).collect()}
    want = set()
    for a, b in itertools.combinations(rows, 2):
        (ta, pa, ca, va, *_), (tb, pb, cb, vb, *_) = a[4], b[4]
        dt, p, q = (tb - ta) / 1e9, np.array(pa), np.array(pb)
        p = p + np.array(va) * dt if va and dt > 0 else p
        q = q - np.array(vb) * dt if vb and dt < 0 else q
        reach = 30 * (abs(dt) + 0.01)
        d2 = sum((p - q) ** 2 / (ca[0] + cb[0] + (reach / 2) ** 2))
        if a[1] != b[1] and abs(dt) <= 0.25 and d2 <= 11.344866730144373 and np.linalg.norm(p - q) <= reach + 3.5 * max(ca[0], cb[0]) ** 0.5:
            want.add((a[0], b[0]))
    assert got == want and len(want) > 40


def edges_of(spark, edges):
    return spark.createDataFrame(edges, "left_uid string, right_uid string, cost double")


@pytest.mark.parametrize("seed", range(4))
def test_matching_and_cliques_against_sequential_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "LOCAL_EDGES", [0, 100_000][seed % 2])  # in rounds, or by one task
    rng = random.Random(seed)
    names = [f"u{i:02d}" for i in range(16)]
    edges = [(a, b, float(rng.randrange(6))) for a, b in itertools.combinations(names, 2) if rng.random() < 0.18]
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    used, want = set(), []
    for a, b, _ in order:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    df = edges_of(spark, edges)
    assert sorted((r[0], r[1]) for r in graph.greedy_pairs(df).collect()) == sorted(want)

    least = {u: u for e in edges for u in e[:2]}
    for _ in names:
        for a, b, _ in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {r["uid"]: r["component"] for r in graph.components(df).collect()} == least

    best = (0, 0.0)

    def search(k, used, n, cost):
        nonlocal best
        best = max(best, (n, -cost))
        for i in range(k, len(edges)):
            a, b, c = edges[i]
            if a not in used and b not in used:
                search(i + 1, used | {a, b}, n + 1, cost + c)

    search(0, frozenset(), 0, 0.0)
    got = graph.exact_pairs(df).collect()
    assert (len(got), -sum(r["cost"] for r in got)) == best

    node = {u: f"n{int(u[1:]) % 5}" for u in names}
    of = {u: {u} for u in names}
    linked = {frozenset(e[:2]) for e in edges}
    for a, b, _ in order:
        x, y = of[a], of[b]
        if x is not y and len(x | y) <= 3 and len({node[u] for u in x | y}) == len(x | y) and all(frozenset((u, v)) in linked for u in x for v in y):
            both = x | y
            for u in both:
                of[u] = both
    groups = graph.clique_groups(df, spark.createDataFrame(list(node.items()), "uid string, node_id string"), 3).collect()
    assert {r["uid"]: r["group_id"] for r in groups} == {u: min(g) for u, g in of.items()}


def test_large_components_are_matched_exactly(spark):
    # Triangles in a row, each linked to the next: 60 nodes in one component, odd cycles everywhere.
    name = lambda k, i: f"t{k:02d}{i}"
    edges = [(name(k, i), name(k, j), 1.0 + k / 10) for k in range(20) for i, j in ((0, 1), (0, 2), (1, 2))]
    edges += [(name(k, 2), name(k + 1, 0), 0.25) for k in range(0, 19, 2)] + [(name(k, 2), name(k + 1, 0), 9.0) for k in range(1, 19, 2)]
    got = graph.exact_pairs(edges_of(spark, edges)).collect()
    # All 60 nodes are paired by the cheap links of two triangles and the edge that each has left.
    assert len(got) == 30 and sum(r["cost"] for r in got) == pytest.approx(10 * 0.25 + sum(1.0 + k / 10 for k in range(20)))
    assert len({u for r in got for u in (r["left_uid"], r["right_uid"])}) == 60


def test_blossoms_weigh_as_much_as_the_subset_search():
    for seed in range(400):
        rng = random.Random(seed)
        n, p = rng.randint(2, 12), rng.choice([0.2, 0.4, 0.7, 1])
        edges = [(a, b, rng.randint(1, 10)) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
        weight = {(a, b): w for a, b, w in edges}
        pairs = graph.Blossoms(edges, n).pairs()
        assert len({u for pair in pairs for u in pair}) == 2 * len(pairs)
        assert sum(weight[k] for k in pairs) == sum(edges[i][2] for i in graph._best_matching(edges, n))


def test_sticky_ids_and_revisions(spark):
    groups = lambda *g: spark.createDataFrame([(u, min(x)) for x in g for u in x], "uid string, group_id string")
    old = spark.createDataFrame([("A", identity.minted("A")), ("B", identity.minted("A"))], "uid string, global_id string")
    got = {r["uid"]: r["global_id"] for r in identity.assign_ids(groups("A", "BC"), old).collect()}
    # The larger group takes the old id; the other can't mint the same one.
    assert got == {"B": identity.minted("A"), "C": identity.minted("A"), "A": identity.minted("A", 1)}
    new = spark.createDataFrame(list(got.items()), "uid string, global_id string")
    log = [tuple(r) for r in identity.revisions(old, new, 7).orderBy("revision").collect()]
    assert log == [(8, "A", identity.minted("A"), identity.minted("A", 1), "identity_revised"), (9, "C", None, identity.minted("A"), "new")]
    assert identity.revisions(new, new).isEmpty()
    assert identity.signature(new) == identity.signature(new.repartition(3)) != identity.signature(old)


@pytest.mark.parametrize("seed", range(3))
def test_claims_against_sequential_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(identity, "LOCAL_CLAIMS", [0, 5, 100_000][seed % 3])  # in rounds, in both ways, by one task
    rng = random.Random(seed)
    uids = [f"u{k:02d}" for k in range(60)]
    of = {u: rng.randrange(25) for u in uids}
    groups = {k: sorted(u for u in uids if of[u] == k) for k in set(of.values())}
    held = {u: f"old{rng.randrange(12)}" for u in uids if rng.random() < 0.8}
    counts = {k: {g: sum(held.get(u) == g for u in us) for g in {held[u] for u in us if u in held}} for k, us in groups.items()}
    used, want = set(), {}
    for k in sorted(groups, key=lambda k: (-max(counts[k].values(), default=0), -len(groups[k]), groups[k])):
        gid = next((g for g in sorted(counts[k], key=lambda g: (-counts[k][g], g)) if g not in used), None) or identity.minted(groups[k][0])
        used.add(gid)
        want.update(dict.fromkeys(groups[k], gid))
    rows = spark.createDataFrame([(u, us[0]) for us in groups.values() for u in us], "uid string, group_id string").repartition(3)
    got = identity.assign_ids(rows, spark.createDataFrame(list(held.items()), "uid string, global_id string"))
    assert {r["uid"]: r["global_id"] for r in got.collect()} == want


@pytest.mark.parametrize("local", [0, 20])
def test_long_chains_and_many_groups_of_cliques(spark, monkeypatch, local):
    """One component through all nodes: a chain, and cliques that lie on it."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(8)
    names = [f"u{i:03d}" for i in range(120)]
    cost = lambda: rng.choice([0.5, 1.0, 2.0, rng.random()])
    edges = [(a, b, cost()) for a, b in zip(names, names[1:], strict=False)]
    edges += [(names[i], names[j], cost()) for i in range(0, 120, 4) for j in range(i + 2, min(i + 5, 120))]
    node = {u: f"n{int(u[1:]) % 7}" for u in names}
    of, linked = {u: {u} for u in names}, {frozenset(e[:2]) for e in edges}
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = of[a], of[b]
        if x is not y and len(x | y) <= 4 and len({node[u] for u in x | y}) == len(x | y) and all(frozenset((u, v)) in linked for u in x for v in y):
            for u in x | y:
                of[u] = x | y
    groups = graph.clique_groups(edges_of(spark, edges), spark.createDataFrame([*node.items(), ("alone", "n0")], "uid string, node_id string")).collect()
    assert {r["uid"]: r["group_id"] for r in groups} == {u: min(g) for u, g in of.items()} | {"alone": "alone"}


def test_taken_ids_are_salted_on(spark):
    groups = spark.createDataFrame([("A", "A")], "uid string, group_id string")
    old = spark.createDataFrame([(f"x{k}", identity.minted("A", k)) for k in range(6)], "uid string, global_id string")
    assert [r["global_id"] for r in identity.assign_ids(groups, old).collect()] == [identity.minted("A", 6)]
    assert identity.assign_ids(groups.limit(0), old).collect() == []


def test_track_status(spark):
    t = found(spark, seen("node_0", 1, 100, 1), seen("node_1", 1, 100, 1), seen("node_2", 1, 100, 1, cov=[0.0] * 9), seen("node_3", 1, 100, 1, cov=None))
    uid = '["node_{}","cam",1,1,1]'.format
    members = spark.createDataFrame([(uid(0), "g1"), (uid(1), "g1"), (uid(2), "g2"), (uid(3), "g3")], "uid string, global_id string")
    got = {r["global_id"]: (r["status"], r["source_count"], r["class_name"], r["representative"]) for r in identity.global_tracks(members, t, adapters.labels(spark)).collect()}
    assert got["g1"] == ("associated_pair", 2, "0", uid(0)) and got["g3"] == ("unlocalized", 1, "0", None)


def test_intersection():
    one = lambda *d: (np.zeros((1, 3)), np.diag(d)[None].astype(float))
    mean, cov, _ = fusion.intersect(*one(1, 1, 1), *one(1, 1, 1))
    assert np.allclose(cov, np.eye(3)) and np.allclose(mean, 0)
    _, cov, w = fusion.intersect(*one(1, 9, 9), *one(9, 1, 9))
    assert 1 < cov[0, 0, 0] < 9 and 1 < cov[0, 1, 1] < 9 and w[0] == pytest.approx(0.5)
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = (x @ x.T + 0.2 * np.eye(3) for x in rng.normal(size=(2, 3, 3)))
        _, _, w = fusion.intersect(np.zeros((1, 3)), a[None], np.zeros((1, 3)), b[None])
        score = lambda v: np.linalg.slogdet(v * np.linalg.inv(a) + (1 - v) * np.linalg.inv(b))[1]  # noqa: E731, B023
        assert score(w[0]) >= max(map(score, np.linspace(0, 1, 400))) - 1e-9


def member(i, **more):
    base = {"group_id": "g", "uid": f"t{i}", "node_id": f"n{i}", "label": "car", "domain": "d", "alignment_id": "a", "s_frame": "f", "s_map": "m", "offset_ns": 0, "clock_uncertainty_ns": 5_000_000, "event_ns": 10**9, "position": [1.0, 2.0, 3.0], "covariance": EYE, "velocity": None, "quality": 0.9, "frame": "f", "map_revision": "m", "ray": None}
    return base | more


GROUP_MEMBER = (
    "group_id string, uid string, node_id string, label string, domain string, alignment_id string, s_frame string, s_map string, offset_ns long, clock_uncertainty_ns long, event_ns long, position array<double>,"
    " covariance array<double>, velocity array<double>, quality double, frame string, map_revision string, ray struct<origin:array<double>,direction:array<double>,sigma:double,timestamp_ns:bigint>"
)
FAULTS = ([({}, "ci_position_only"), ({"domain": None}, "source_unverified_or_unlocalized"), ({"label": ""}, "semantic_class_unverified"), ({"s_map": "x"}, "clock_map_or_class_mismatch"), ({"clock_uncertainty_ns": 90_000_000}, "clock_uncertainty_unverified"), ({"covariance": [300.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]}, "covariance_outside_bounds"), ({"covariance": [0.0] * 9}, "covariance_not_spd"), ({"node_id": "n0"}, "duplicate_physical_node"), ({"event_ns": 3 * 10**9}, "time_extrapolation_limit"), ({"position": [90.0, 2.0, 3.0]}, "position_residual_exceeds_gate"), ({"ray": {"origin": [9.0, 2.0, 3.0], "direction": [1.0, 0.0, 0.0], "sigma": 0.01, "timestamp_ns": 10**9}}, "bearing_geometry_contradiction")])


def fused(spark, groups, **policy):
    rows = [tuple((m | {"group_id": name}).values()) for name, g in groups.items() for m in g]
    return {r["group_id"]: r for r in fusion.fuse_groups(spark.createDataFrame(rows, GROUP_MEMBER).repartition(2), fusion.FusionPolicy(**policy)).collect()}


def test_group_estimates(spark):
    found = fused(spark, {str(k): [member(0), member(1, **change), member(2)] for k, (change, _) in enumerate(FAULTS)})
    for k, (_, reason) in enumerate(FAULTS):
        got = found[str(k)]
        assert got["reason"] == reason and got["accepted"] == (reason == "ci_position_only") and got["n_sources"] == 3
        if got["accepted"]:
            assert np.allclose(got["mean"], [1, 2, 3]) and got["covariance"][0] > 0.99 and (got["domain"], got["frame"], got["map_revision"]) == ("d", "f", "m")
            assert sum(got["weights"].values()) == pytest.approx(1) and set(got["residual_d2"]) == {"t0", "t1", "t2"} and got["bearing_count"] == 0
        else:
            assert got["mean"] is None and got["domain"] is None
        if reason == "bearing_geometry_contradiction":
            assert got["contradicting"] == ["t1"]


def test_first_fault_by_uid_and_rule(spark):
    odd = {
        "two": ([member(0), member(2, label=""), member(1, clock_uncertainty_ns=90_000_000)], "clock_uncertainty_unverified"),
        "first of one": ([member(0), member(1, label=None, quality=0.0)], "semantic_class_unverified"),
        "low": ([member(0), member(1, quality=0.1)], "source_localization_quality_below_gate"),
        "no quality": ([member(0), member(1, quality=None)], "source_localization_quality_below_gate"),
        "no clock": ([member(0), member(1, clock_uncertainty_ns=None)], "clock_uncertainty_unverified"),
        "frame": ([member(0), member(1, frame="x")], "clock_map_or_class_mismatch"),
        "context of the first": ([member(3), member(1, label="bus"), member(2)], "clock_map_or_class_mismatch"),
        "fault before duplicate": ([member(0), member(1, node_id="n0"), member(2, covariance=[0.0] * 9)], "covariance_not_spd"),
        "alone": ([member(0)], "not_enough_verified_position_sources"),
        "negative": ([member(0, event_ns=-5), member(1, event_ns=-7)], "aligned_event_time_negative"),
    }
    got = fused(spark, {k: g for k, (g, _) in odd.items()}, min_quality=0.5)
    assert {k: r["reason"] for k, r in got.items()} == {k: why for k, (_, why) in odd.items()}


def test_batched_folds_equal_single_ones(spark):
    """Groups of 2 to 7 members in one batch: each as if it were alone, step by step."""
    rng, groups = np.random.default_rng(9), {}
    for k in range(60):
        spread = lambda: (lambda x: (x @ x.T + 0.5 * np.eye(3)).ravel().tolist())(rng.normal(size=(3, 3)))
        groups[f"g{k}"] = [
            member(i, position=rng.normal(size=3).tolist(), covariance=spread(), velocity=rng.normal(size=3).tolist() if i % 2 else None, event_ns=10**9 + int(rng.integers(0, 10**8)), offset_ns=int(rng.integers(-1000, 1000)))
            for i in rng.permutation(int(rng.integers(2, 8)))
        ]
    for name, r in fused(spark, groups).items():
        g = sorted(groups[name], key=lambda m: m["uid"])
        times = [m["event_ns"] + m["offset_ns"] for m in g]
        ranked, n = sorted(times), len(g)
        epoch = (ranked[(n - 1) // 2] + ranked[n // 2]) // 2
        mean = cov = None
        for m, t in zip(g, times, strict=True):
            dt = (epoch - t) / 1e9
            p = np.array(m["position"]) + dt * np.array(m["velocity"] or [0.0] * 3)
            c = np.reshape(m["covariance"], (3, 3)) + (30 * (abs(dt) + 0.005)) ** 2 * np.eye(3)
            if mean is None:
                mean, cov = p[None], c[None]
            else:
                mean, cov, _ = fusion.intersect(mean, cov, p[None], c[None])
        assert r["epoch_ns"] == epoch and r["accepted"] and np.allclose(r["mean"], mean[0]) and np.allclose(r["covariance"], cov[0].ravel()) and sum(r["weights"].values()) == pytest.approx(1)


def test_bearings_of_latest_observations_can_veto(spark):
    """tracklets -> group_inputs -> fuse_groups: ahead, behind, to the side, too old, not valid, none."""
    eye = {"valid": True, "camera_position_world_m": [-20.0, 2.0, 3.0], "direction_world": [1.0, 0.0, 0.0], "has_tangent_covariance": True, "tangent_covariance_rad2": [1e-4, 0.0, 0.0, 1e-4], "timestamp_ns": 10**9}
    cases = {
        "ahead": (eye, "ci_position_only"),
        "behind": (eye | {"direction_world": [-1.0, 0.0, 0.0]}, "bearing_geometry_contradiction"),
        "side": (eye | {"camera_position_world_m": [-20.0, 42.0, 3.0]}, "bearing_geometry_contradiction"),
        "old": (eye | {"direction_world": [-1.0, 0.0, 0.0], "timestamp_ns": 10**9 + 251_000_000}, "ci_position_only"),
        "invalid": (eye | {"direction_world": [-1.0, 0.0, 0.0], "valid": False}, "ci_position_only"),
        "no time": (eye | {"direction_world": [-1.0, 0.0, 0.0], "timestamp_ns": None}, "ci_position_only"),
        "none": (None, "ci_position_only"),
    }
    kind = "struct<valid:boolean,camera_position_world_m:array<double>,direction_world:array<double>,has_tangent_covariance:boolean,tangent_covariance_rad2:array<double>,timestamp_ns:bigint>"
    rows = [(*seen(f"node_{i}", 1, 10**9, 1 + i)[:1], name, *seen(f"node_{i}", 1, 10**9, 1 + i)[2:], b if i else None) for name, (b, _) in cases.items() for i in range(2)]
    t = tracklets.tracklets(tracklets.segmented(spark.createDataFrame(rows, f"{EVENT}, bearing {kind}")))
    got = fusion.fuse_groups(fusion.group_inputs(t.selectExpr("uid", "camera_id AS group_id"), t, adapters.sources(spark), adapters.labels(spark))).collect()
    assert {r["group_id"]: r["reason"] for r in got} == {name: why for name, (_, why) in cases.items()}


def test_some_events_of_the_adapter_contradict(spark):
    rows = {tuple(r) for r in adapters.bearing_events(spark, "/root/testdata/sf0.001").selectExpr("bearing IS NOT NULL", "bearing.direction_world[0] < 0", "bearing.timestamp_ns < event_time_ns").distinct().collect()}
    assert rows == {(False, None, None), (True, True, False), (True, False, False), (True, False, True)}


def watcher(i, origin, target, ns=10**9, **more):
    d = np.array(target, float) - origin
    d /= np.linalg.norm(d)
    e1 = np.cross(d, [0, 0, 1.0])
    e1 /= np.linalg.norm(e1)
    bearing = {"valid": True, "camera_position_world_m": list(map(float, origin)), "direction_world": d.tolist(), "tangent_basis_world": [float(x) for x in (*e1, *np.cross(d, e1))], "has_tangent_covariance": True, "tangent_covariance_rad2": [1e-4, 0.0, 0.0, 1e-4], "timestamp_ns": ns}
    return {"group_id": "g", "uid": f"t{i}", "node_id": f"n{i}", "seq": 1, "event_time_ns": ns, "position": None, "covariance": None, "quality": 0.9, "frame": "f", "map_revision": "m", "bearing": bearing, "label": "0", "domain": "d", "alignment_id": "a", "s_frame": "f", "s_map": "m", "offset_ns": 0, "clock_uncertainty_ns": 5_000_000} | more


READY = {"independent_source_errors_verified": True, "bearing_world_pose_frame_verified": True, "stationary_target_verified": True}
OBSERVED = (
    "group_id string, uid string, node_id string, seq long, event_time_ns long, position array<double>, covariance array<double>, quality double, frame string, map_revision string,"
    " bearing struct<valid:boolean,camera_position_world_m:array<double>,direction_world:array<double>,tangent_basis_world:array<double>,has_tangent_covariance:boolean,tangent_covariance_rad2:array<double>,timestamp_ns:bigint>,"
    " label string, domain string, alignment_id string, s_frame string, s_map string, offset_ns long, clock_uncertainty_ns long"
)


def windows(spark, groups, **policy):
    rows = [r | {"group_id": name} for name, g in groups.items() for r in g]
    names = [c.split()[0] for c in OBSERVED.replace(":bigint>", ">").split(", ")]
    found = window_ls.window_estimates(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBSERVED), window_ls.WindowPolicy(**{**READY, **policy}))
    return {r["group_id"]: r for r in found.collect()}


def test_static_windows(spark):
    a, b, far = (0, 0, 0), (0, 10, 0), (10, 5, 3)
    pair = [watcher(0, a, far), watcher(1, b, far)]
    seen = {"position": [10.0, 5.0, 3.0], "covariance": EYE}
    broken = lambda **change: watcher(1, b, far) | {"bearing": watcher(1, b, far)["bearing"] | change}
    cases = {
        "good": (pair, "conditional_fixed_lag_solution_requires_validation"),
        "anchored": ([watcher(0, a, far), watcher(1, b, far, bearing=None, **seen)], "conditional_fixed_lag_solution_requires_validation"),
        "alone": (pair[:1], "requires_preassociated_multi_node_group"),
        "many": ([watcher(i, (0, i, 0), far) for i in range(9)], "requires_preassociated_multi_node_group"),
        "opposite": ([pair[0], watcher(1, (-10, -5, -3), far)], "insufficient_cross_node_parallax"),
        "same node": ([pair[0], watcher(1, b, far, node_id="n0")], "duplicate_physical_node"),
        "unknown source": ([pair[0], watcher(1, b, far, domain=None)], "unverified_source"),
        "other map": ([pair[0], watcher(1, b, far, s_map="x")], "unverified_class_clock_or_map"),
        "no label": ([watcher(0, a, far, label=None), watcher(1, b, far, label=None)], "unverified_class_clock_or_map"),
        "clock": ([pair[0], watcher(1, b, far, clock_uncertainty_ns=40_000_000)], "clock_uncertainty_exceeds_limit"),
        "no bearing": ([pair[0], watcher(1, b, far, bearing=None)], "insufficient_cross_node_bearing_factors"),
        "not valid": ([pair[0], broken(valid=None)], "insufficient_cross_node_bearing_factors"),
        "no covariance": ([pair[0], broken(has_tangent_covariance=False)], "insufficient_cross_node_bearing_factors"),
        "skew basis": ([pair[0], broken(tangent_basis_world=[0.0, 0.0, 1.0, 0.0, 0.1, 1.0])], "insufficient_cross_node_bearing_factors"),
        "nothing": ([watcher(0, a, far, bearing=None), watcher(1, b, far, bearing=None)], "no_valid_observations"),
        "old": ([watcher(0, a, far, ns=10**9), watcher(1, b, far, ns=3 * 10**9)], "insufficient_cross_node_bearing_factors"),
        "zero covariance": ([pair[0], watcher(1, b, far, position=[1.0, 1.0, 1.0], covariance=[0.0] * 9)], "conditional_fixed_lag_solution_requires_validation"),
        "anchor behind": ([watcher(0, a, far), watcher(1, b, far, bearing=None, position=[-10.0, -5.0, -3.0], covariance=EYE)], "anchor_behind_bearing_ray"),
        "residual": ([watcher(0, a, far), watcher(1, b, far), watcher(2, (0, 20, 0), (10, -5, 30))], "factor_residual_exceeds_gate"),
    }
    got = windows(spark, {k: g for k, (g, _) in cases.items()}, model="static_position")
    assert {k: r["reason"] for k, r in got.items()} == {k: why for k, (_, why) in cases.items()}
    assert np.allclose(got["good"]["position"], far, atol=1e-5) and np.allclose(got["anchored"]["position"], far, atol=1e-5)
    assert (got["good"]["bearing_nodes"], got["good"]["anchor_uid"], got["anchored"]["anchor_uid"]) == (["n0", "n1"], None, "t1") and got["good"]["condition"] > 1


def test_moving_windows(spark):
    v = np.array([1, -0.5, 0.4])
    rows = [watcher(i, o, np.array([10, 5, 3]) + v * 0.2 * i, 10**9 + i * 200_000_000) for i, o in enumerate([(0, 0, 0), (0, 10, 0), (20, 0, 1), (18, 12, 2)])]
    got = windows(spark, {"moving": rows, "at once": [watcher(0, (0, 0, 0), (10, 5, 3)), watcher(1, (0, 10, 0), (10, 5, 3))]})
    assert np.allclose(got["moving"]["velocity"], v, atol=0.05) and got["moving"]["span_s"] == pytest.approx(0.6)
    assert got["at once"]["reason"] == "insufficient_temporal_baseline_for_velocity"
    for policy, why in (({"independent_source_errors_verified": False}, "independent_source_errors_not_verified"), ({"bearing_world_pose_frame_verified": False}, "bearing_camera_pose_frame_not_verified"), ({"model": "static_position", "stationary_target_verified": False}, "static_motion_model_not_verified")):
        assert windows(spark, {"g": rows}, **policy)["g"]["reason"] == why
    many = [watcher(i, (0, 10 * i, 0), (10, 5, 3), seq=k) for i in range(2) for k in range(3)]
    assert windows(spark, {"g": many}, model="static_position", max_observations=4, independent_temporal_errors_verified=True)["g"]["reason"] == "window_observation_limit_exceeded"


def test_policies():
    for cls in (fusion.FusionPolicy, window_ls.WindowPolicy):
        with pytest.raises(ValueError):
            cls.from_dict({"nonsense": 1})
        with pytest.raises(ValueError):
            cls.from_dict({"min_quality": 0.5})
    assert fusion.FusionPolicy.from_dict({"method": "ci_position_bearing_veto", "max_residual_d2": 30}).max_residual_d2 == 30
    for bad in ({"method": "other"}, {"max_residual_d2": -5}, {"min_position_sources": 1}, {"min_position_sources": 2.0}, {"max_epoch_offset_s": True}):
        with pytest.raises(ValueError):
            fusion.FusionPolicy.from_dict(bad)
    for bad in ({"model": "other"}, {"window_seconds": 6}, {"min_time_baseline_seconds": 2.0}, {"max_observations": 3}, {"max_observations": 64.0}, {"stationary_target_verified": 1}):
        with pytest.raises(ValueError):
            window_ls.WindowPolicy.from_dict(bad)
    for bad in ({"max_pair_dt_s": 5}, {"max_pair_dt_s": -0.1}, {"min_quality": float("nan")}, {"min_quality": 7}, {"maximum_speed_mps": True}, {"maximum_speed_mps": 0}, {"maximum_sigma_m": 1e9}, {"maximum_ray_separation_sigma": 0}, {"clock_error_gate_s": "1"}):
        with pytest.raises(ValueError):
            associate.AssociationPolicy(**bad)


def aligned(**more):
    return {"verified": True, "domain": "shared_sim", "clock_uncertainty_ns": 1_000_000, "alignment_id": "a", "coordinate_frame_id": "f", "map_revision": "m"} | more


def test_association_configuration():
    config = associate.AssociationConfig.from_dict(
        {"sources": {"x": aligned(offset_ns=-5), "y": {"verified": False, "domain": "nonsense"}, "z": {"verified": 1}}, "class_labels": {"x": {"0": "  Person ", "07": "CAR"}, "y": {}}, "max_pair_dt_s": 0, "min_quality": 1, "unknown": 3}
    )
    assert config.sources == [("x", True, "shared_sim", -5, 1_000_000, "a", "f", "m")] and config.labels == [("x", 0, "person"), ("x", 7, "car")]
    assert config.policy == associate.AssociationPolicy(max_pair_dt_s=0, min_quality=1)


@pytest.mark.parametrize(
    "data",
    [
        None, [], {}, {"sources": []}, {"sources": {"": aligned()}}, {"sources": {3: aligned()}}, {"sources": {"x": 1}},
        *[{"sources": {"x": aligned(**c)}} for c in ({"domain": "utc"}, {"domain": None}, {"alignment_id": ""}, {"coordinate_frame_id": 5}, {"map_revision": None}, {"offset_ns": 1.0}, {"offset_ns": True}, {"offset_ns": 60_000_000_001}, {"clock_uncertainty_ns": None}, {"clock_uncertainty_ns": -1}, {"clock_uncertainty_ns": 1_000_000_001}, {"clock_uncertainty_ns": True})],
        *[{"sources": {}, "class_labels": c} for c in ([], {"x": 1}, {"x": {"a": "car"}}, {"x": {"-1": "car"}}, {"x": {0: "car"}}, {"x": {"0": " "}}, {"x": {"0": None}}, {"x": {"0": "y" * 129}})],
        *[{"sources": {}, name: value} for name, (low, high) in associate.ASSOCIATION_RANGES.items() for value in (low - 0.01, high + 0.01, True, "1", None, float("nan"))],
    ],
)
def test_association_refusals(data):
    with pytest.raises(ValueError):
        associate.AssociationConfig.from_dict(data)


def test_pairs_of_a_configured_association(spark):
    """Labels meet whatever their case and the white space around them; offsets bring clocks together; what isn't verified stays alone."""
    t = found(spark, seen("node_0", 1, 1000, 1), seen("node_1", 1, 5000, 1), seen("node_2", 1, 1000, 1))
    labels = {"node_0": {"0": "Person", "1": "Person"}, "node_1": {"0": "\tperson ", "1": "\tperson "}, "node_2": {"0": "person", "1": "person"}}
    side = lambda **more: aligned(coordinate_frame_id=adapters.FRAME, map_revision=adapters.MAP, **more)
    config = associate.AssociationConfig.from_dict({"sources": {"node_0": side(), "node_1": side(offset_ns=-4000), "node_2": side(verified=False)}, "class_labels": labels, "max_pair_dt_s": 0})
    got = associate.candidate_pairs(t, *config.tables(spark), config.policy).collect()
    assert [(r["left_uid"][2:8], r["right_uid"][2:8], r["elapsed_s"]) for r in got] == [("node_0", "node_1", 0.0)]
    raw = spark.createDataFrame([("node_0", k, " A") for k in (0, 1)] + [("node_1", k, "a\n") for k in (0, 1)], "node_id string, class_id long, label string")
    assert associate.candidate_pairs(t, config.tables(spark)[0], raw, config.policy).count() == 1
