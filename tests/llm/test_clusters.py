"""Exact integer k-means against plain Python, with the pivot table's savings and odd vectors."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import clusters

VEC = "vec_id long, embedding array<float>, label int"


def by_loops(rows, dims, k=8, rounds=10):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(1024 * float(np.float32(x))) if abs(x) < 2**40 else 1024 * int(float(np.float32(x))) for x in v]) for i, v in kept]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cs = [v for _, v in sorted((x for x in q), key=lambda x: (x[0] is None, digest(x[0]), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in q]
        cs = [[sum(col) // of.count(n) for col in zip(*(v for (_, v), o in zip(q, of) if o == n))] if n in of else c for n, c in enumerate(cs)]
    return sorted(((i is None, i, *near(v)[::-1]) for i, v in q), key=str), cs


def made(spark, rows, dims, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC).repartition(3)
    out, centroids, names = clusters.centroid_clusters(df, dims=dims, **options)
    return sorted(((r.vec_id is None, r.vec_id, r[names[0]], r[names[1]]) for r in out.collect()), key=str), centroids.tolist(), out, names


def groups(n, dims, seed=1, wide=0.1):
    rng = random.Random(seed)
    mids = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(8)]
    return [(i, [m + rng.gauss(0, wide) for m in mids[min(i % 12, 7)]]) for i in range(n)]  # the last group holds over a third


def test_equals_loops_and_bounds_spare_distances(spark):
    rows = groups(300, 6)
    got, centroids, out, names = made(spark, rows, 6)
    want, cs = by_loops(rows, 6)
    assert got == want and centroids == cs
    tried = out.agg(F.avg(names[2])).first()[0]
    assert tried < 4  # of 8 centroids


def test_ties_repeats_and_empty_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-1, 1) / 1024 for _ in range(3)]) for i in range(60)] + [(1, [0.0, 0.0, 0.0])] * 40
    got, centroids, _, _ = made(spark, rows, 3)
    want, cs = by_loops(rows, 3)
    assert got == want and centroids == cs


def test_odd_vectors(spark):
    rows = groups(40, 4) + [(100, None), (101, []), (102, [1.0] * 5), (103, [None, 1.0, 1.0, 1.0]), (104, [float("nan"), 0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    got, _, _, _ = made(spark, rows, 4, rounds=3)
    want, _ = by_loops(rows, 4, rounds=3)
    assert got == want
    few = [(1, [1.0, 2.0]), (2, [-1.0, 0.0])]
    assert made(spark, few, 2)[0] == [(False, 1, *by_loops(few, 2)[0][0][2:]), (False, 2, *by_loops(few, 2)[0][1][2:])]
    empty = spark.createDataFrame([], VEC).withColumns({c: F.lit("x") for c in ("cluster", "distance", "pivot_distances")})
    out, centroids, names = clusters.centroid_clusters(empty)
    assert out.count() == 0 and len(centroids) == 0 and names[:2] == ("_cluster", "_distance")


def test_huge_components_stay_exact(spark):
    rows = [(i, [3e38 if i % 2 else -3e38, float(i)]) for i in range(20)] + [(50 + i, [float(i), 2.0**30]) for i in range(5)]
    got, centroids, _, _ = made(spark, rows, 2, k=3, rounds=4)
    want, cs = by_loops(rows, 2, 3, 4)
    assert centroids == cs
    assert [(a, b, c, d if d <= 2**63 - 1 else None) for a, b, c, d in want] == got


def test_limbs():
    for v in (0, 1, -1, 2**62, -(2**62), 10**40, -(10**40), 2**63):
        parts = list(clusters._limbs(v))
        assert sum(x << (clusters.LIMB * at) for at, x in parts) == v and all(-(2**63) <= x < 2**63 for _, x in parts)
