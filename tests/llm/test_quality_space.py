"""The classifier's terms by brute force, its space against a singular value decomposition, and odd ids."""

import random
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import quality
from auditlake.llm.queries import QUERIES


def brute(text):
    """Counts of grams, words and pairs, a byte at a time."""
    m = 0xFFFFFFFF
    a, b, c = 2654435761, 2246822519, 3266489917
    grams = Counter((((x * a & m) ^ (y * b & m) ^ (z * c & m)) * a & m) >> 22 for x, y, z in zip(text, text[1:], text[2:]))
    words = Counter()
    for w in text.split():
        h = 0
        for i, x in enumerate(w):
            v = (x + 1) * (a * (2 * i + 1) & m) & m
            h += (v ^ v >> 15) * b & m
        words[((h & m) * a & m) >> 23] += 1
    kinds = [int(quality._KIND[x]) for x in text]
    pairs = Counter(p * 16 + q for p, q in zip(kinds, kinds[1:]))
    return [[c[i] for i in range(n)] for c, n in ((grams, quality.GRAMS), (words, quality.WORDS), (pairs, quality.PAIRS))]


@pytest.mark.parametrize("text", ["one", "a", "ab", "Some words, and some more words. 12!", " lead\n\ntrail  ", "한국어 é | *** ", "x" * 300])
def test_terms(text):
    t = quality.terms(text.encode())
    want = np.concatenate([np.sqrt(np.array(c) / max(1, sum(c))) for c in brute(text.encode())])
    assert t[:-4] == pytest.approx(want, abs=1e-6) and len(t) == quality.N_TERMS


def test_pieces_add_up(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(400)).encode()
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "PIECE", 500)
    assert quality.terms(text) == pytest.approx(whole, abs=0.1) and not quality.terms(b"").any() and not quality.terms(None).any()


@pytest.mark.parametrize("pack", [1, 9, 1 << 18])
def test_texts_counted_together_are_as_alone(monkeypatch, pack):
    monkeypatch.setattr(quality, "PACK", pack)
    rng = random.Random(7)
    texts = [None, b"", b" ", b"a", b"ab", b"\n", b"x ", b" x"] + [bytes(rng.choice(b" \nabZ9.\xc3") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = quality.all_terms(texts)
    for text, row in zip(texts, got):
        alone = np.zeros(quality.N_TERMS - 4)
        if text and text.split():
            alone = np.concatenate([np.sqrt(np.array(c) / max(1, sum(c))) for c in brute(text)])
        assert row[:-4] == pytest.approx(alone, abs=1e-6) and row.any() == bool(text and text.split())


def test_axes_are_the_singular_vectors():
    rng = np.random.default_rng(3)
    x = (rng.random((200, quality.N_TERMS)) ** 4 * (rng.random((200, 1)) + 0.5)).astype(np.float32)
    m = quality.Model(x, np.ones(200))
    z = (x - m.mean) * m.scale
    right = np.linalg.svd(z.astype(np.float64), full_matrices=False)[2][: quality.RANK].T
    assert np.abs((right * m.axes).sum(0)) == pytest.approx(np.ones(quality.RANK), abs=1e-2)
    assert m.scale == pytest.approx(1 + np.log(201 / (1 + (x > 0).sum(0))), abs=1e-5)


def test_words_tell_documents_apart():
    rng = random.Random(4)
    make = lambda pool: " ".join(rng.choice(pool) for _ in range(80)).encode()
    pools = ["river stone cloud meadow winter harvest".split(), "casino bonus jackpot wager slots betting".split()]
    x, y = np.stack([quality.terms(make(pools[k % 2])) for k in range(200)]), np.array([1 - k % 2 for k in range(200)], np.float32)
    m = quality.Model(x, y)
    assert (m.score(np.stack([quality.terms(make(pools[0])) for _ in range(30)])) > 0.9).all()
    assert (m.score(np.stack([quality.terms(make(pools[1])) for _ in range(30)])) < 0.1).all()


def test_no_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "no id"), (1, "one"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op10_quality"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.held_out for r in rows}[None] is False and all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
