"""Links of a crowd grow with its size and not with the square of it, and join the same texts."""

import random

import numpy as np
import pytest

from auditlake.llm import near_copies, simhash

from test_near_copies import brute


def crowd(rng, n):
    """n distinct values that differ from one in up to two bits."""
    found = set()
    while len(found) < n:
        found.add(77 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    return [v - (1 << 64) if v >> 63 else v for v in sorted(found)]


def joined(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for e in edges:
        a, b = sorted((find(e.a), find(e.b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("n", [300, 1200])
def test_links_of_a_key_of_many_tiles(spark, monkeypatch, n):
    monkeypatch.setattr(simhash, "TILE", 32)
    values = crowd(random.Random(n), n)
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()
    assert joined(edges) == dict.fromkeys(values, min(values))
    assert len(edges) < 3 * n


@pytest.mark.parametrize("n", [300, 1200])
def test_links_of_a_crowd_under_many_hashes(spark, n):
    rng = random.Random(n)
    rows = [(k, f, v) for f in range(13) for k, v in zip(rng.sample(range(n), n), crowd(rng, n))]
    prints = spark.createDataFrame(rows, "node long, family int, fingerprint long")
    edges = simhash.links(prints, 11, 8, 1, "family").collect()
    assert joined(edges) == dict.fromkeys(range(n), 0)
    assert len(edges) < 8 * n


@pytest.mark.parametrize("n", [60, 240])
def test_exact_links_of_a_group_of_many_tiles(spark, monkeypatch, n):
    monkeypatch.setattr(near_copies, "TILE", 8)
    rng, seen, plain = random.Random(n), [], near_copies.components
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(n)]
    rows += [(n + k, " ".join([*base, *(f"y{k}-{i}" for i in range(60))])) for k in range(5)]  # in the group, like none
    monkeypatch.setattr(near_copies, "components", lambda edges, a, b: seen.append(edges.count()) or plain(edges, a, b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == brute(rows)
    assert max(seen[1:]) < 3 * n  # the first is that of the candidates


def test_rows_of_one_node_are_joined():
    values = np.array([1, 1 << 40, 3 << 40, (1 << 64) - 1], np.uint64)
    a, b = simhash.linked(np.zeros(4, np.int64), values, 1, np.array([5, 5, 8, 9]))
    assert (a.tolist(), b.tolist()) == ([8], [5])
    a, b = simhash.linked(np.array([1, 1, 2, 2]), values, 1, np.array([5, 5, 8, 8]))
    assert len(a) == len(b) == 0


def test_links_become_a_forest():
    a, b = simhash.forest(np.array([9, 7, 9, 4, 30]), np.array([7, 3, 3, 7, 20]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(4, 3), (7, 3), (9, 3), (30, 20)]
    assert len(simhash.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
