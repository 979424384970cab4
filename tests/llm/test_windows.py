"""The curve index by itself on many windows, and the check after it in many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import ann


def clustered(n, clusters=100, d=32, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((clusters, d))[rng.integers(0, clusters, n)] + 0.4 * rng.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def nearest_by_brute_force(v, every, k):
    w = v.astype(np.float64)
    out = {}
    for q in range(0, len(v), every):
        s = w @ w[q]
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(v)), -s))[:k].tolist()
    return out


def frame(spark, v, kind="float"):
    return spark.createDataFrame([(i, [float(z) for z in x], "x", i) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>, score string, rank int")


def test_recall_of_the_windows_alone(spark):
    v = clustered(3200)
    want, got = nearest_by_brute_force(v, 100, 20), {}
    for r in ann.nearest(frame(spark, v), every=100, exact=False, window=64).collect():  # 50 windows a curve
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & set(want[q])) / 20 for q in want])
    assert set(got) == set(want) and recall >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_check_after_few_windows(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "QUERY_BYTES", 32 * 8 * 5)  # five queries a block
    v = np.random.default_rng(2).standard_normal((600, 32)).astype(np.float32)  # no structure at all
    rows = ann.nearest(frame(spark, v, kind), every=20, k=5, curves=2, window=30).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float((v[r.query_id].astype(float) * v[r.vec_id].astype(float)).sum()), abs=1e-12)
    assert got == nearest_by_brute_force(v, 20, 5)


def test_repeated_ids_and_one_vector_shared_by_most(spark):
    v = clustered(200, 5)
    df = frame(spark, v).withColumn("embedding", F.when(F.col("vec_id") < 150, F.array(*(F.lit(float(z)) for z in v[0]))).otherwise(F.col("embedding").cast("array<double>")))
    rows = ann.nearest(df.unionByName(df.where("vec_id in (0, 199)")), every=40, k=20, window=16).collect()
    by = {q: sorted((r.rank, r.vec_id) for r in rows if r.query_id == q) for q in {r.query_id for r in rows}}
    assert set(by) == {0, 40, 80, 120, 160}
    assert [i for _, i in by[0]] == list(range(1, 21)) and [i for _, i in by[40]] == list(range(20))  # ties to smaller ids, each id once


def test_ids_repeat_with_other_vectors(spark):
    v = np.random.default_rng(5).standard_normal((90, 8)).astype(np.float32)
    ids = [i % 30 for i in range(90)]  # each id three times, queries too
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    got, want = {}, {}
    for r in ann.nearest(df, every=10, k=6, window=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in (0, 10, 20):
        best = {}
        for a in range(q, 90, 30):
            for b in range(90):
                if ids[b] != q:
                    best[ids[b]] = max(best.get(ids[b], -np.inf), float(v[a].astype(float) @ v[b].astype(float)))
        want[q] = [(i, round(s, 9)) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6]]
    assert got == want


@pytest.mark.parametrize("ranges", [1, 7])
def test_ranges_and_windows_are_apart(spark, monkeypatch, ranges):
    """However many ranges the curves are cut into, a query meets the windows before and after its own."""
    monkeypatch.setattr(ann, "RANGE_BYTES", max(1, 2 * 500 * (32 * 4 + 24) // ranges))
    v = clustered(500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = ann.nearest(frame(spark, v), every=20, exact=False, curves=2, window=30).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, got = nearest_by_brute_force(v, 20, 20), {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert {len(x) for x in got.values()} == {20} and np.mean([len(got[q] & set(want[q])) / 20 for q in want]) > 0.5
