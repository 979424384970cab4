"""Components and look-ups where one key has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import common, components, simhash


@pytest.fixture(params=[1, 1000])
def hot(request, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", request.param)
    monkeypatch.setattr(components, "HOT_SHARE", 0.05)


def test_stars_and_chains(spark, hot):
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_look_up(spark, hot, how):
    rows = common.durable(spark.createDataFrame([(1, k) for k in range(200)] + [(2, 5), (3, 6), (None, 7), (9, 9)], "k long, x long"))
    table = common.durable(rows.where("k is not null and k != 9").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m")))
    got = sorted(repr((r.x, r.k, r.m)) for r in components.look_up(rows, table, "k", how=how).collect())
    kept = [r for r in rows.collect() if how == "left" or r.k in (1, 2, 3)]
    assert got == sorted(repr((r.x, r.k, {1: 199, 2: 5, 3: 6}.get(r.k))) for r in kept)


def test_forgotten_tables_are_deleted(spark):
    df = common.durable(spark.range(5))
    file = df.inputFiles()[0].removeprefix("file://")
    common.forget(df)
    import os

    assert not os.path.exists(file)


def test_one_group_of_most_fingerprints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(4)
    prints = [7 ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(120)] + [rng.getrandbits(63) for _ in range(60)]
    rows = list(enumerate(prints))
    found = {r.fingerprint: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fingerprint long")).collect()}
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for k in range(i):
            if (prints[i] ^ prints[k]).bit_count() <= 4 and root[i] != root[k]:
                root = [min(root[i], root[k]) if r in (root[i], root[k]) else r for r in root]
    assert found == {p: root[i] for i, p in rows}


def test_repetitive_items_and_documents_are_linear():
    import time

    from auditlake.llm.decontaminate import Windows

    item, doc = [b"w"] * 3000, [b"w"] * 60000
    began = time.process_time()
    spans, got = Windows([(str(k), item) for k in range(50)], {b"w": 1}, 10).hits(doc)
    assert spans == [[0, 60000]] and len(got) == 50
    assert time.process_time() - began < 20
