"""Covering and nearest edges against plain loops, over large polygons and far points."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions.geo import DEGREE
from tidemark.operators import geometry

FORM = "poly_id long, k int, x1 double, y1 double, x2 double, y2 double"


def ring(poly, x, y, r, n, seed=0):
    draw = random.Random(seed)
    at = [(x + r * draw.uniform(0.6, 1) * math.cos(2 * math.pi * i / n), y + r * draw.uniform(0.6, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [(poly, i, *at[i], *at[(i + 1) % n]) for i in range(n)]


def odd(lat, lng, edges):
    return sum((y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for _, _, x1, y1, x2, y2 in edges) % 2 == 1


def metres(lat, lng, edges):
    best, scale = None, math.cos(math.radians(lat))
    for p, k, x1, y1, x2, y2 in edges:
        ax, ay, bx, by = (x1 - lng) * DEGREE * scale, (y1 - lat) * DEGREE, (x2 - lng) * DEGREE * scale, (y2 - lat) * DEGREE
        q = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, -(ax * (bx - ax) + ay * (by - ay)) / q)) if q else 0
        best = min(best or (9e9,), (math.hypot(ax + t * (bx - ax), ay + t * (by - ay)), p, k))
    return best


def test_against_loops(spark):
    """Rings of all sizes, one inside another's box, points near, far and very far, one position many times."""
    edges = ring(1, -123, 48, 1.5, 60, 1) + ring(2, -122.2, 47.1, 0.03, 5, 2) + ring(3, -126, 49, 0.2, 9, 3) + ring(4, -123, 48, 0.01, 4, 4) + [(5, 0, -120.0, 52.0, -110.0, 60.0)]
    draw = random.Random(7)
    points = [(i, draw.uniform(45, 51), draw.uniform(-128, -120)) for i in range(200)] + [(1000 + i, 48.0, -123.0) for i in range(300)] + [(2000, 0.0, 0.0), (2001, -80.0, 170.0), (2002, 75.0, -118.0), (2003, None, -123.0)]
    df, e = spark.createDataFrame(points, "pid int, lat double, lng double"), spark.createDataFrame(edges, FORM)
    rings = [[x for x in edges if x[0] == p] for p in range(1, 5)]
    assert {r.pid for r in geometry.covered(df, e).collect()} == {i for i, lat, lng in points if lat is not None and any(odd(lat, lng, x) for x in rings)}
    got = {r.pid: (r.metres, r.poly_id) for r in geometry.nearest(df, e).collect()}
    want = {i: metres(lat, lng, edges) for i, lat, lng in points if lat is not None}
    assert set(got) == set(want)
    for i, (d, p) in got.items():
        assert math.isclose(d, want[i][0], rel_tol=1e-9, abs_tol=1e-6) and p == want[i][1], i
    assert geometry.nearest(df, e.limit(0)).count() == 0 and geometry.covered(df, e.limit(0)).count() == 0 and geometry.nearest(df.limit(0), e).count() == 0


def test_large_polygon_is_tested_at_its_border(spark):
    """Of 60,000 corners, edges are met in border cells only; the cells inside are covered at once."""
    n = 60_000
    edges = spark.range(n).select(F.lit(1).cast("long").alias("poly_id"), F.col("id").cast("int").alias("k"), *(f.alias(c) for i, (cx, cy) in enumerate((("x1", "y1"), ("x2", "y2"))) for c, f in ((cx, -123 + 2 * F.cos((F.col("id") + i) * 2 * math.pi / n)), (cy, 48 + 2 * F.sin((F.col("id") + i) * 2 * math.pi / n)))))
    points = spark.range(40_000).select(F.col("id").alias("pid"), (45.5 + 5 * F.rand(1)).alias("lat"), (-125.5 + 5 * F.rand(2)).alias("lng")).cache()
    border = geometry.border_cells(edges)
    placed = points.withColumns({"cx": F.floor(F.col("lng") / geometry.CELL), "cy": F.floor(F.col("lat") / geometry.CELL)})
    inner = geometry.inner_cells(placed.select("cx", "cy").distinct(), edges)
    at_border, wholly = placed.join(border, ["cx", "cy"], "left_semi").count(), placed.join(inner, ["cx", "cy"], "left_semi").count()
    assert at_border < 0.12 * 40_000 and wholly > 0.4 * 40_000 and inner.join(border, ["cx", "cy"]).count() == 0
    wet = points.join(geometry.covered(points, edges), "pid", "left_semi").count()
    assert wet == points.filter((F.col("lat") - 48) ** 2 + (F.col("lng") + 123) ** 2 < 4).count()


def test_no_wide_cells_for_near_points(spark, monkeypatch):
    """Points near water are done in the first round; a farther one takes a round for each factor of distance."""
    edges = spark.createDataFrame(ring(1, -123, 48, 0.02, 8), FORM)
    rounds = []
    real = geometry.cells
    monkeypatch.setattr(geometry, "cells", lambda low, high, size, more: (rounds.append(size) if low == "w" and more else None, real(low, high, size, more))[1])
    for off, most in ((0.01, 1), (0.3, 2), (1.2, 3), (5.0, 4)):
        rounds.clear()
        geometry.nearest(spark.createDataFrame([(1, 48.0, -123.0 + off)], "pid int, lat double, lng double"), edges).collect()
        assert len(rounds) == most and max(rounds) <= 8
