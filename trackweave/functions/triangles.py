"""Point, ray and box against triangle, as SQL expressions over scalar columns.

Each list holds (column, expression) stages in an order in which they can be added; the expressions
use only arithmetic, CASE, greatest, least and sqrt, so any SQL engine can check them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dot(u: str, v: str) -> str:
    return "(" + " + ".join(f"{u}{k} * {v}{k}" for k in "xyz") + ")"


def _cross(out: str, u: str, v: str) -> list[tuple[str, str]]:
    return [(f"{out}{a}", f"{u}{b} * {v}{c} - {u}{c} * {v}{b}") for a, b, c in ("xyz", "yzx", "zxy")]


def _minus(out: str, u: str, v: str) -> list[tuple[str, str]]:
    return [(f"{out}{k}", f"{u}{k} - {v}{k}") for k in "xyz"]


#: Edges and normal of a triangle with corners (ax, ay, az), (bx, ..), (cx, ..); nl is the normal's length.
NORMAL = [
    *_minus("e", "b", "a"),
    *_minus("f", "c", "a"),
    *_cross("n", "e", "f"),
    ("nl", f"sqrt({_dot('n', 'n')})"),
]
#: A triangle counts if its normal is longer than this (fixed value).
LEAST_NORMAL = 1e-10

#: Closest point (kx, ky, kz) of a triangle to (px, py, pz) and its distance. s and t are the
#: weights of the edges e and f; the regions are the three corners, the three edges and the inside.
CLOSEST = [
    *_minus("pa", "p", "a"),
    *_minus("pb", "p", "b"),
    *_minus("pc", "p", "c"),
    ("g1", _dot("e", "pa")),
    ("g2", _dot("f", "pa")),
    ("g3", _dot("e", "pb")),
    ("g4", _dot("f", "pb")),
    ("g5", _dot("e", "pc")),
    ("g6", _dot("f", "pc")),
    ("wc", "g1 * g4 - g3 * g2"),
    ("wb", "g5 * g2 - g1 * g6"),
    ("wa", "g3 * g6 - g5 * g4"),
    (
        "region",
        "CASE WHEN g1 <= 0 AND g2 <= 0 THEN 1 WHEN g3 >= 0 AND g4 <= g3 THEN 2 WHEN wc <= 0 AND g1 >= 0 AND g3 <= 0 THEN 3 WHEN g6 >= 0 AND g5 <= g6 THEN 4"
        " WHEN wb <= 0 AND g2 >= 0 AND g6 <= 0 THEN 5 WHEN wa <= 0 AND g4 - g3 >= 0 AND g5 - g6 >= 0 THEN 6 ELSE 7 END",
    ),
    ("hyp", "CASE WHEN region = 6 THEN (g4 - g3) / ((g4 - g3) + (g5 - g6)) END"),
    ("s", "CASE region WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN g1 / (g1 - g3) WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 1 - hyp ELSE wb / (wa + wb + wc) END"),
    ("t", "CASE region WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN g2 / (g2 - g6) WHEN 6 THEN hyp ELSE wc / (wa + wb + wc) END"),
    *[(f"k{k}", f"a{k} + s * e{k} + t * f{k}") for k in "xyz"],
    ("distance", "sqrt((px - kx) * (px - kx) + (py - ky) * (py - ky) + (pz - kz) * (pz - kz))"),
]

#: Distance u along the ray (ox, ..) + u (dx, ..) to a triangle, from either side; null without a hit.
RAY = [
    *_cross("h", "d", "f"),
    ("det", _dot("e", "h")),
    *_minus("oa", "o", "a"),
    *_cross("q", "oa", "e"),
    ("u1", f"CASE WHEN abs(det) >= 1e-10 THEN {_dot('oa', 'h')} / det END"),
    ("u2", f"CASE WHEN abs(det) >= 1e-10 THEN {_dot('d', 'q')} / det END"),
    ("u", f"CASE WHEN u1 >= -1e-9 AND u2 >= -1e-9 AND u1 + u2 <= 1 + 1e-9 THEN {_dot('f', 'q')} / det END"),
]


def staged(df: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    for name, expression in stages:
        df = df.withColumn(name, F.expr(expression))
    return df


def staged_sql(source: str, stages: list[tuple[str, str]]) -> str:
    """The same as nested subqueries."""
    for name, expression in stages:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source


def corners(triangles: DataFrame) -> DataFrame:
    """Arrays a, b, c as scalar columns ax .. cz."""
    flat = [F.col(p)[i].alias(f"{p}{k}") for p in "abc" for i, k in enumerate("xyz")]
    return triangles.select(*[c for c in triangles.columns if c not in "abc"], *flat)
