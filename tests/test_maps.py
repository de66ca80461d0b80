"""Map queries against plain scans of all triangles, of sizes from centimetres to kilometres."""

import numpy as np
import pytest

from trackweave.operators import meshmap

TRIANGLE = "entity_id string, semantic string, triangle_id long, a array<double>, b array<double>, c array<double>"


def scene(seed=42, n=60):
    rng = np.random.default_rng(seed)
    size = 10 ** rng.uniform(-1, 3.3, (n, 1, 1))
    return rng.uniform(-60, 60, (n, 1, 3)) + size * rng.uniform(-1, 1, (n, 3, 3)) * [1, 1, 0.05]


def table(spark, corners):
    return spark.createDataFrame([(f"e{i:03d}", "road" if i % 2 else "terrain", 0, *[p.tolist() for p in t]) for i, t in enumerate(corners)], TRIANGLE)


def away(p, t):
    """Distance from p to a triangle: to its plane where the foot lies inside, else to the nearest edge."""
    a, b, c = t
    n = np.cross(b - a, c - a)
    n /= np.linalg.norm(n)
    foot = p - n * ((p - a) @ n)
    if all(np.cross(y - x, foot - x) @ n >= 0 for x, y in ((a, b), (b, c), (c, a))):
        return abs((p - a) @ n)
    return min(np.linalg.norm(p - x - (y - x) * np.clip((p - x) @ (y - x) / ((y - x) @ (y - x)), 0, 1)) for x, y in ((a, b), (b, c), (c, a)))


def first_hit(o, d, t):
    a, b, c = t
    try:
        u, v, s = np.linalg.solve(np.stack([b - a, c - a, -d], 1), o - a)
    except np.linalg.LinAlgError:
        return np.inf
    return s if u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9 and s > 1e-6 else np.inf


@pytest.mark.parametrize("radius", [0.5, 20.0])
def test_nearest_surfaces(spark, radius):
    corners, points = scene(), np.random.default_rng(1).uniform(-80, 80, (20, 3)) * [1, 1, 0.1]
    asked = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "query_id long, point array<double>")
    got = meshmap.surface(table(spark, corners), asked, radius, 4).collect()
    for i, p in enumerate(points):
        near = sorted((away(p, t), f"e{k:03d}") for k, t in enumerate(corners))
        want = [(d, e) for d, e in near if d <= radius][:4]
        mine = sorted((r["rank"], r["distance"], r["entity_id"]) for r in got if r["query_id"] == i)
        assert [e for *_, e in mine] == [e for _, e in want] and [d for _, d, _ in mine] == pytest.approx([d for d, _ in want], abs=1e-8)
    assert meshmap.surface(table(spark, corners), asked, radius, 4, semantics=[]).collect() == []
    assert {r["semantic"] for r in meshmap.surface(table(spark, corners), asked, radius, 4, semantics=["road"]).collect()} <= {"road"}


def test_first_hits_and_lines_of_sight(spark):
    corners, rng = scene(7), np.random.default_rng(2)
    origins, targets = rng.uniform(-80, 80, (25, 3)) + [0, 0, 30], rng.uniform(-80, 80, (25, 3)) - [0, 0, 30]
    rays = spark.createDataFrame([(i, o.tolist(), (t - o).tolist(), t.tolist()) for i, (o, t) in enumerate(zip(origins, targets, strict=True))], "query_id long, origin array<double>, direction array<double>, target array<double>")
    hits = {r["query_id"]: r for r in meshmap.raycast(table(spark, corners), rays, 500.0).collect()}
    seen = {r["query_id"]: r["status"] for r in meshmap.visibility(table(spark, corners), rays.select("query_id", "origin", "target")).collect()}
    for i, (o, t) in enumerate(zip(origins, targets, strict=True)):
        length = np.linalg.norm(t - o)
        best = min((first_hit(o, (t - o) / length, x), f"e{k:03d}") for k, x in enumerate(corners))
        assert (i in hits) == (best[0] <= 500) and (i not in hits or (hits[i]["entity_id"], hits[i]["distance"]) == (best[1], pytest.approx(best[0], abs=1e-8)))
        assert seen[i] == ("occluded" if best[0] <= length - 0.05 - 1e-6 else "unknown")


def test_odd_queries(spark):
    mesh, none = table(spark, scene()), table(spark, scene()).limit(0)
    lines = spark.createDataFrame([(1, [0.0] * 3, [0.0] * 3), (2, [0.0] * 3, [0.0, 0.0, 20_000.0]), (3, [0.0, 0.0, 99.0], [0.0, 0.0, 98.0]), (4, None, [1.0] * 3)], "query_id long, origin array<double>, target array<double>")
    assert {r["query_id"]: r["status"] for r in meshmap.visibility(mesh, lines).collect()} == {1: "rejected", 2: "rejected", 3: "unknown", 4: "rejected"}
    points = spark.createDataFrame([(1, [0.0] * 3)], "query_id long, point array<double>")
    assert meshmap.surface(none, points).collect() == [] and meshmap.raycast(none, lines.limit(1).selectExpr("query_id", "origin", "array(0D, 0D, 1D) AS direction")).collect() == []
    for call in (lambda: meshmap.surface(mesh, points, 2000.0), lambda: meshmap.surface(mesh, points, 1.0, 40), lambda: meshmap.raycast(mesh, lines, 0.0), lambda: meshmap.visibility(mesh, lines, -1.0)):
        with pytest.raises(ValueError):
            call()


def test_stacked_triangles_and_repeated_queries_cost_their_number(spark, monkeypatch):
    """400 triangles of 200 entities on 4 others' corners and 400 queries from 4 places: what is compared doesn't grow with the copies."""
    met = []
    staged = meshmap.T.staged
    monkeypatch.setattr(meshmap.T, "staged", lambda df, stages: (met.append(df) if stages in (meshmap.T.CLOSEST, meshmap.T.RAY) else None, staged(df, stages))[1])
    corners = [np.array([[x, 0, x], [x + 3, 0, x], [x, 3, x]], float) for x in (0, 1, 2, 3)]
    rows = [(f"e{i // 2:03d}", "road" if i % 3 else "terrain", i % 2, *[p.tolist() for p in corners[i % 4]]) for i in range(400)]
    asked = [(i, [i % 4 + 0.5, 0.5, 9.0]) for i in range(400)]
    mesh = spark.createDataFrame(rows, TRIANGLE)
    got = meshmap.surface(mesh, spark.createDataFrame(asked, "query_id long, point array<double>"), 20.0, 3).collect()
    hits = meshmap.raycast(mesh, spark.createDataFrame([(i, p, [0.0, 0.0, -1.0]) for i, p in asked], "query_id long, origin array<double>, direction array<double>")).collect()
    assert [df.count() <= 4 * 4 * most for df, most in zip(met, (3, 1), strict=True)] == [True, True]
    best = {}
    for q in range(4):
        near = {}
        for e, s, t, *abc in rows:
            d = round(float(away(np.array(asked[q][1]), np.array(abc))), 9)
            near[e] = min(near.get(e, (d, t, s)), (d, t, s))
        ray = min((round(float(first_hit(np.array(asked[q][1]), np.array([0, 0, -1.0]), np.array(abc))), 9), e, t, s) for e, s, t, *abc in rows)
        best[q] = (sorted((d, e, t, s) for e, (d, t, s) in near.items())[:3], ray)
    assert len(got) == 1200 and len(hits) == 400
    for r in got:
        assert (round(r["distance"], 9), r["entity_id"], r["triangle_id"], r["semantic"]) == best[r["query_id"] % 4][0][r["rank"] - 1]
    for r in hits:
        assert (round(r["distance"], 9), r["entity_id"], r["triangle_id"], r["semantic"]) == best[r["query_id"] % 4][1]
