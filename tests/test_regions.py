import math
import random

from cairn.operators import regions
from pyspark.sql import functions as F


def crossed(x, y, ring):
    odd = False
    for i, (xi, yi) in enumerate(ring):
        xj, yj = ring[i - 1]
        odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 1e-15) + xi
    return odd


def inside(x, y, parts):
    return any(sum(crossed(x, y, ring) for ring in part) % 2 for part in parts)


def ring_of(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_against_plain_rays(spark):
    rng = random.Random(6)
    shapes = []
    for k in range(25):
        parts = []
        for _ in range(rng.randint(1, 3)):
            x, y, r = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.05, 0.4, 2.0])
            parts.append([ring_of(rng, x, y, r, rng.randint(3, 30)), *([ring_of(rng, x, y, r / 3, 6)] if rng.random() < 0.5 else [])])
        shapes.append((k, f"p{k}", parts))
    shapes += [(30, "nothing", []), (31, "empty ring", [[[]]]), (32, "square", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]), (33, "line", [[[(8.0, 8.0), (9.0, 9.0)]]])]
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(700)]
    corners = [p for _, _, parts in shapes for part in parts for ring in part for p in ring[:2]]
    points += [(1000 + i, y, x) for i, (x, y) in enumerate(corners)] + [(2000, 0.0, 0.5), (2001, 1.0, 0.5), (2002, 0.5, 0.0), (2003, 0.5, 1.0), (2004, float("nan"), 1.0), (2005, None, 1.0), (2006, 1.0, float("inf"))]
    want = {i: next((name for _, name, parts in shapes if inside(x, y, parts)), None) for i, y, x in points if None not in (x, y) and math.isfinite(x) and math.isfinite(y)}
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    r = spark.createDataFrame(shapes, "seq int, name string, parts array<array<array<struct<x:double,y:double>>>>")
    for depth in (0, 4):
        got = regions.regions_of(p, r, depth)
        assert {x["id"]: x["polygon"] for x in got.collect()} == {i: v for i, v in want.items() if v}
    cells = regions.covering(r, 4)
    assert cells.where("edges is null").count() > 20 and cells.agg(F.max(F.size("edges"))).first()[0] < 40
    assert regions.regions_of(p, r.limit(0)).count() == 0
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()


def test_points_are_never_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id", "id / 10 as lat", "id / 20 as lng").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")  # a file of few bytes
    r = spark.createDataFrame([(0, "square", [[[(0.0, 0.0), (1.01, 0.0), (1.01, 1.01), (0.0, 1.01)]]])], "seq int, name string, parts array<array<array<struct<x:double,y:double>>>>")
    for held_bytes in (1 << 20, 0):
        got = regions.regions_of(points, r, held_bytes=held_bytes)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (held_bytes > 0)
        assert sorted(x["id"] for x in got.collect()) == [*range(11)]
