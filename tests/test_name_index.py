"""Scores of many names at once against the scores of pairs; the best three by bounds against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.functions.similarity import NameIndex, partial_ratio, token_set_ratio
from auditlake.operators import names

SYLLABLES = "가나다라마바사아자차카타파하강남도로미보세신우인전정제조주지진한현호홍대동명성서선석산상삼북부문민무모면"


def words(rng, abc, least, most, n):
    return ["".join(rng.choice(abc) for _ in range(rng.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("abc", ["abcd ", "abcdefghijkl", SYLLABLES])
def test_scores_and_bounds(abc):
    rng = random.Random(abc)
    known = [*words(rng, abc, 0, 20, 200), *words(rng, abc, 70, 70, 1), ""]
    index, rows = NameIndex(known), np.arange(len(known))
    long = NameIndex([*known, *words(rng, abc, 300, 300, 1)])
    for name in [*words(rng, abc, 0, 25, 20), *words(rng, abc, 64, 64, 1), *words(rng, abc, 80, 80, 1)]:
        partial, tokens = [partial_ratio(name, k) for k in known], [token_set_ratio(name, k) for k in known]
        assert index.partial(name, rows).tolist() == partial and index.token_set(name, rows).tolist() == tokens
        assert long.partial(name, rows).tolist() == partial
        above = index.bounds([name])
        assert (above[0][0] >= np.array(partial) - 1e-4).all() and (above[1][0] >= np.array(tokens) - 1e-4).all()


def test_best_three_of_twenty_thousand_by_few_scores():
    rng = random.Random(2)
    kinds = ["전자", "산업", "건설", "물산", "화학", "상사", "테크", "시스템", "바이오", "유통"]
    known = [w + rng.choice(kinds) for w in words(rng, SYLLABLES, 2, 5, 20_000)]
    asked = [w[: rng.randrange(1, len(w))] + rng.choice(SYLLABLES) + w[2:] for w in rng.sample(known, 40)]
    index, places, scored = NameIndex(known), list(range(len(known))), 0
    bounds, every = index.bounds(asked), np.arange(len(known))
    for i, name in enumerate(asked):
        for kind, measure in ((0, index.partial), (1, index.token_set)):
            got, n = index.best(name, bounds[kind][i], measure, places)
            scores = measure(name, every)
            assert got == sorted(((s, r) for r, s in enumerate(scores.tolist())), key=lambda x: (-x[0], x[1]))[:3]
            scored += n
    assert scored < 0.02 * 2 * len(asked) * len(known)


def test_cells_of_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_NAMES", 7)
    monkeypatch.setattr(names, "BLOCK_CANDIDATES", 11)
    monkeypatch.setattr(names, "BOUNDS", 3)
    rng = random.Random(3)
    known = [(e, f"c{i}", w, i) for e in (1, 2) for i, w in enumerate(words(rng, "abcde", 1, 9, 60 if e == 1 else 4))]
    asked = [(e, i, w, w[::-1] if i % 3 == 0 else None) for e in (1, 2, 3) for i, w in enumerate(words(rng, "abcde", 0, 8, 20))]
    q = spark.createDataFrame(asked, "engagement_id int, query_id int, n string, h string")
    c = spark.createDataFrame(known, "engagement_id int, candidate string, c string, pos int")
    got = {(r.engagement_id, r.query_id, r.kind): [(s.score, s.candidate) for s in r.best] for r in names.best_three(q, c).collect()}
    want = {}
    for e, i, n, h in asked:
        mine = [(k, x, p) for g, k, x, p in known if g == e]
        for kind, text, measure in (("partial", n, partial_ratio), ("tokens", n, token_set_ratio), ("hint", h, partial_ratio)):
            if text and mine:
                want[e, i, kind] = [(s, k) for s, _, k in sorted(((measure(text, x), p, k) for k, x, p in mine), key=lambda r: (-r[0], r[1]))[:3]]
    assert got == want
    assert names.best_three(q.where(F.lit(False)), c).count() == 0
