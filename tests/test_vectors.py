import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geodesy
from trackweave.functions import vectors as V


def test_covariance_and_mahalanobis(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(50):
        a = rng.normal(size=(3, 3))
        c = a @ a.T + 0.1 * np.eye(3)
        d = rng.normal(size=3)
        rows.append((d.tolist(), c.reshape(-1).tolist(), float(d @ np.linalg.inv(c) @ d)))
    df = spark.createDataFrame(rows, "d array<double>, c array<double>, want double")
    got = df.select(V.mahalanobis_sq(F.col("d"), F.col("c")).alias("g"), "want", V.is_covariance(F.col("c")).alias("ok")).collect()
    assert all(r["ok"] and math.isclose(r["g"], r["want"], rel_tol=1e-9) for r in got)


@pytest.mark.parametrize("c", [None, [0.0] * 9, [1.0, 0, 0, 0, 1, 0, 0, 0], [1.0, 0.5, 0, 0, 1, 0, 0, 0, 1], [float("nan"), 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 2, 0, 2, 1, 0, 0, 0, 1]])
def test_what_is_no_covariance(spark, c):
    df = spark.createDataFrame([([float(x) for x in c] if c else None,)], "c array<double>")
    assert df.select(V.is_covariance(F.col("c"))).first()[0] is False


def test_rays(spark):
    def ray(o, d):
        return ([float(x) for x in o], [float(x) for x in d], 0.01, 1)

    cases = [
        (ray([0.0, 0, 0], [1.0, 0, 0]), ray([5.0, -5, 0], [0.0, 1, 0]), True, True, "ray-consistent"),
        (ray([0.0, 0, 0], [1.0, 0, 0]), ray([5.0, -5, 0], [0.0, -1, 0]), False, False, "ray-geometry-contradiction"),
        (ray([0.0, 0, 0], [1.0, 0, 0]), ray([0.0, 3, 0], [1.0, 0, 0]), True, False, "weak-parallax-not-used"),
    ]
    form = "struct<origin:array<double>,direction:array<double>,sigma:double,timestamp_ns:bigint>"
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], f"a {form}, b {form}")
    got = V.compared_rays(df, "a", "b", F.lit(0.5), 3.0, 4.0, "r").select("r.*").collect()
    for r, (_, _, consistent, forward, label) in zip(got, cases, strict=True):
        assert (r["consistent"], r["forward"], r["label"]) == (consistent, forward, label)
    assert got[0]["separation_m"] == pytest.approx(0)


def test_geodesy(spark):
    rows = [(0.0, 0.0, 0.0), (90.0, 0.0, 100.0), (0.0, 90.0, 0.0), (181.0, 0.0, 0.0), (0.0, -91.0, 0.0), (0.0, 0.0, float("nan")), (float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, h double")
    got = [r[0] for r in df.select(geodesy.enu_to_ecef(F.col("lon"), F.col("lat"), F.col("h"))).collect()]
    assert got[0][12:15] == pytest.approx([6378137.0, 0, 0])
    assert got[1][12:15] == pytest.approx([0, 6378237.0, 0], abs=1e-6)
    assert got[2][12:15] == pytest.approx([0, 0, 6356752.314245179], abs=1e-6)
    assert got[3:] == [None] * 4
    z = spark.createDataFrame([(0,), (-1,), (1,), (-2,)], "x int").select(geodesy.zigzag(F.col("x"))).collect()
    assert [r[0] for r in z] == [0, 1, 2, 3]
