"""The pipeline's near copies against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest

from auditlake.llm import near_copies

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Keys that stay: the smallest of each group joined by steps of similarity 0.8 or more."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            a, b = sets[i], sets[k]
            if root[i] != root[k] and len(a) >= 0.8 * len(b) >= 0.64 * len(a) and (n := len(a & b)) >= 0.8 * (len(a) + len(b) - n):
                root = [min(root[i], root[k]) if r in (root[i], root[k]) else r for r in root]
    return sorted(min(k for (k, _), y in zip(rows, root) if y == r) for r in set(root))


def test_stage_drops_all_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("tile", [1024, 7])
def test_large_group_and_its_neighbours(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(200)], [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "two words more")]
    for k in range(60):  # similarities on both sides of 0.8
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == brute(rows)


def test_null_keys_and_repeats(spark):
    docs = spark.createDataFrame([(None, "only one"), (None, "only one"), (3, "a b"), (3, "a b"), (4, "A b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in near_copies.drop_near_copies(docs).collect()) == [(0, "only one"), (3, "a b")]
    assert near_copies.drop_near_copies(docs.where("false")).count() == 0
