"""Located joins and batch similarity against loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import located, similar


def miles(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1.0, x)))


def points(n, seed):
    r = random.Random(seed)
    out = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(n)]
    out += [(n + i, 40 + r.gauss(0, 0.3), -100 + r.gauss(0, 0.3)) for i in range(n // 2)]
    out += [(2 * n, 90.0, 0.0), (2 * n + 1, -90.0, 33.0), (2 * n + 2, 0.0, 180.0), (2 * n + 3, 0.0, -180.0), (2 * n + 4, 89.5, -170.0), (2 * n + 5, None, 1.0), (2 * n + 6, 1.0, None)]
    return out


@pytest.fixture(scope="module")
def sides(spark):
    left, right = points(60, 1), points(80, 2)
    return left, right, spark.createDataFrame(left, "a bigint, lat double, lon double"), spark.createDataFrame(right, "b bigint, y double, x double")


def joins_of(frame):
    plan = frame._jdf.queryExecution().toString()
    return [x for x in ("NestedLoop", "Cartesian") if x in plan]


@pytest.mark.parametrize("radius", [3.0, 60.0, 700.0, 4000.0, 9000.0, 13000.0])
def test_pairs_within_a_radius(sides, radius):
    left, right, a, b = sides
    got = located.geo_join(a, b, radius, right_lat="y", right_lon="x")
    assert not joins_of(got)
    want = {(i, j) for i, *p in left for j, *q in right if None not in p + q and miles(p, q) <= radius}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_heavy_cells_are_split(sides, monkeypatch):
    left, right, a, b = sides
    monkeypatch.setattr(located, "PART", 7)
    got = [(r.a, r.b) for r in located.geo_join(a, b, 80.0, right_lat="y", right_lon="x").collect()]
    want = {(i, j) for i, *p in left for j, *q in right if None not in p + q and miles(p, q) <= 80.0}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("k,most", [(1, located.FARTHEST), (4, located.FARTHEST), (3, 500.0), (200, located.FARTHEST)])
def test_nearest_of_each(sides, k, most):
    left, right, a, b = sides
    got = located.geo_knn_join(a, b, k, "a", "b", right_lat="y", right_lon="x", most=most)
    assert not joins_of(got)
    want = {}
    for i, *p in left:
        if None not in p:
            near = sorted((miles(p, q), j) for j, *q in right if None not in q)
            want[i] = [j for d, j in near if d <= most][:k]
    held = {i: [] for i in want}
    for r in sorted(got.collect(), key=lambda r: (r.a, r["rank"])):
        held[r.a].append(r.b)
    assert held == want


def test_no_rows_near_nothing(sides):
    *_, a, b = sides
    assert located.geo_knn_join(a.limit(0), b, 2, "a", "b", right_lat="y", right_lon="x").count() == 0
    assert located.geo_knn_join(a, b.limit(0), 2, "a", "b", right_lat="y", right_lon="x").count() == 0


def test_many_queries_at_once(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(120, 6))
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(v)] + [(200, None), (201, [0.0] * 6), (202, [1.0]), (203, [float("nan")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = frame.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    want = set()
    for q in range(0, 120, 10):
        scores = np.round(unit @ unit[q], 6)
        order = sorted((-s, i) for i, s in enumerate(scores) if s >= 0.3 and i != q)[:7]
        want |= {(q, i, k + 1) for k, (s, i) in enumerate(order)}
    for block in (4 << 20, 12):  # one pass, and many
        monkeypatch.setattr(similar, "BLOCK", block)
        got = similar.topk_batch(frame, asked, 7, 0.3)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want
    assert similar.topk_batch(frame, asked.limit(0), 7, 0.3).count() == 0


def test_most_alike_texts(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.7, 0.7]), ("c", [0.0, 1.0]), (None, [1.0, 0.0]), ("d", None), ("e", [1.0, 0.01]), ("f", [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "description string, embedding array<double>").repartition(3)
    got = similar.most_alike(frame, [1.0, 0.0], 3)
    assert [(r.description, r.score) for r in got.collect()] == [("a", 1.0), ("f", 1.0), ("e", 0.99995)]
    assert similar.most_alike(frame.withColumn("x", F.lit(1)), [0.0, 0.0]).count() == 0
