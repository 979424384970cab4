"""The pipeline's near copies are found by SimHash fingerprints: searches, recall at the threshold, crowds of one key."""

import random

import numpy as np
import pytest

from auditlake.llm import near_copies, simhash

from test_near_copies import brute


def test_candidates_come_from_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(base))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1]
    asked = []

    def none(prints, radius, blocks, agree, family):
        asked.append((radius, blocks, prints.count()))
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(near_copies, "links", none)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 2]
    blocks, radius = near_copies.search(3)
    assert asked == [(radius, blocks, 2 * near_copies.needed(blocks, radius, near_copies.DIFFER))]


@pytest.mark.parametrize("texts", [None, 700_000])
def test_pairs_at_the_threshold(spark, monkeypatch, texts):
    if texts:  # the search of a table of that size
        blocks, radius = near_copies.search(texts)
        monkeypatch.setattr(near_copies, "search", lambda n: (blocks, radius))
    rng, rows = random.Random(6), []
    for k in range(150):
        size = rng.choice([8, 16, 17, 60, 150, 400])
        a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        b = [*a, "x"]
        if size > 9:  # words at the end change a shingle each, so that the similarity comes near 0.8 from both sides
            b = a + [f"x{i}" for i in range(int((size - 4) * rng.choice([0.22, 0.245, 0.25, 0.27])))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    want = brute(rows)
    assert 160 < len(want) < 270
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == want


@pytest.mark.parametrize("radius", [3, 7, 8, 11])
def test_bit_sliced_distances_of_any_radius(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**64, 300, np.uint64)
    for i in range(100, 300):
        x[i] = x[i - 100] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 16), replace=False)))
    got = simhash.within(simhash.planes_of(x), 100, np.packbits(np.r_[np.ones(200, bool), np.zeros(120, bool)], bitorder="little").view(np.uint64), radius)
    assert np.unpackbits(got.view(np.uint8), bitorder="little")[:200].tolist() == (np.bitwise_count(x[:200] ^ x[100:]) <= radius).astype(int).tolist()


def test_crowd_of_one_key_becomes_a_star():
    rng = np.random.default_rng(3)
    crowd = np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    values = np.r_[crowd, rng.integers(0, 2**64, 300, np.uint64)]
    nodes = rng.permutation(len(values))
    a, b = simhash.linked(np.zeros(len(values), np.int64), values, 11, nodes)
    assert sorted(a.tolist()) == sorted(nodes[1:600].tolist()) and set(b.tolist()) == {int(nodes[0])}


def test_fingerprints_needed():
    rng, p = np.random.default_rng(4), 0.1612
    for texts in (1000, 220_000, 700_000):
        blocks, radius = near_copies.search(texts)
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        bits = rng.random((40_000, 64)) < p
        equal = np.any([~bits[:, a:b].any(1) for a, b in zip(edges, edges[1:])], 0)
        found = (equal & (bits.sum(1) <= radius)).mean()
        n = near_copies.needed(blocks, radius, p)
        assert (1 - found) ** n < 2 * near_copies.MISS < (1 - found) ** (n - 2) * 4


@pytest.mark.parametrize("both, one, other, differ", [(4, 0, 1, 0.1875), (12, 1, 2, 0.161), (160, 20, 20, 0.1515)])
def test_share_of_differing_bits(both, one, other, differ):
    rng, seen = np.random.default_rng(5), []
    for _ in range(40):
        x = rng.integers(0, 2**64, both + one + other, np.uint64)
        a, b = near_copies.prints(x[: both + one], 64), near_copies.prints(np.r_[x[:both], x[both + one :]], 64)
        seen.append(np.bitwise_count(a ^ b).mean() / 64)
        single = simhash.majority(simhash.bit_counts(x[:1, None]), 1)
        assert single[0] == x[0]
    assert abs(np.mean(seen) - differ) < 0.005
