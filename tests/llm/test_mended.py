"""Texts of very long numbers, and links where adaptive execution would split a key."""

import random

from auditlake.llm import pii, simhash


def test_ip_parts_of_many_digits():
    zeros, digits = "0" * 5000, "9" * 5000
    assert [(k, e - s) for s, k, e in pii.base_spans(f"{zeros}.1.1.1")] == [(1, 5006)]
    assert [k for _, k, _ in pii.base_spans(f"{zeros}7.{zeros}255.{zeros}.1")] == [1]
    assert pii.base_spans(f"{digits}.1.1.1") == [] and pii.base_spans(f"{zeros}256.1.1.1") == []
    assert pii.base_spans("0" * 1_000_000 + ".2.3.4")[0][2] == 1_000_006


def test_no_link_is_lost_when_a_key_is_skewed(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 256)
    rng = random.Random(6)
    hot = {(0x123456789AB << 20) | (i * 2654435761 % (1 << 20)) for i in range(6000)}  # alike in 44 bits: one key holds all
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in sorted(hot | {v for p in pairs for v in p})], "fingerprint long")
    lowered = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in lowered.items():
        spark.conf.set(k, v)
    try:
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(prints).collect()}
    finally:
        for k in lowered:
            spark.conf.unset(k)
    # each pair is linked, or its ends are through others
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in found:
        root[find(a)] = find(b)
    assert all(find(signed(a)) == find(signed(b)) for a, b in pairs)
