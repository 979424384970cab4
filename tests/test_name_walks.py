"""Links counted on graphs of names against all pairs; names that are alike aren't scored pair by pair."""

import random

import numpy as np
import pandas as pd
import pytest

from auditlake.functions import walks
from auditlake.functions.similarity import NameIndex, partial_ratio, token_set_ratio
from auditlake.operators import names


def all_pairs(asked, known, weights, places, least, tokens):
    out = {}
    for i, text in enumerate(asked):
        pairs = [(-partial_ratio(text, k), -token_set_ratio(text, k), int(places[r]), r) for r, k in enumerate(known)]
        hits = [x for x in pairs if -x[0] >= least or -x[1] >= tokens]
        if hits:
            best = min(hits)
            out[i] = (int(sum(weights[x[3]] for x in hits)), -best[0], -best[1], best[3])
    return out


@pytest.mark.parametrize("abc, lead, sizes, least, tokens", [
    ("0123456789", "supplier#0", (3, 4), 90, 85), ("ab", "", (1, 9), 90, 85), ("abc", "", (3, 12), 75, 60), ("ab c", "", (1, 8), 90, 85),
    ("가나다라", "㈜", (4, 14), 90, 85), ("abcdef", "", (20, 24), 99, 60), ("ab", "acme", (1, 30), 100, 70),
])
@pytest.mark.parametrize("step", [100, 1 << 20])
def test_graphs_equal_all_pairs(monkeypatch, abc, lead, sizes, least, tokens, step):
    for name, value in {"FEW_NAMES": 2, "ALIKE": 9, "TOGETHER": 7, "STEP": step, "PIECE": 9, "BOUNDS": 3}.items():
        monkeypatch.setattr(walks, name, value)
    rng = random.Random(abc + lead)
    word = lambda: lead + "".join(rng.choice(abc) for _ in range(rng.randint(*sizes)))
    known = list({word() for _ in range(30)} | {"", "x" * 300, "two words"})
    asked = [k[: rng.randrange(len(k))] + rng.choice(abc) + k[rng.randrange(len(k)) :] for k in known if k] + [k[1:] for k in known if len(k) > 1] + ["holdings" + known[3], "y" * 64, "y" * 70]
    asked = list(dict.fromkeys(a for a in asked if a))
    weights, places = np.array([rng.choice([1, 1, 5]) for _ in known]), np.array([rng.randrange(9) for _ in known])
    got = {i: tuple(x) for i, *x in walks.links_of(asked, known, weights, places, least, tokens)}
    assert got == all_pairs(asked, known, weights, places, least, tokens) and got


def test_alike_names_are_not_scored_by_pairs(spark, monkeypatch):
    scored, score_partial, score_tokens = [0], NameIndex.partial, NameIndex.token_set

    def counted(score):
        def run(self, name, rows):
            scored[0] += len(rows)
            return score(self, name, rows)

        return run

    def here(texts, candidates, score, fields, *size):
        rows = score(0, texts.toPandas(), candidates.toPandas())
        return spark.createDataFrame(rows, f"engagement_id long, kind string, text string, {fields}")

    monkeypatch.setattr(names, "in_blocks", here)
    monkeypatch.setattr(NameIndex, "partial", counted(score_partial))
    monkeypatch.setattr(NameIndex, "token_set", counted(score_tokens))
    known = [f"Supplier#{i:09d}" for i in range(5000)]
    asked = [k for i in range(3, 5000, 250) for k in (known[i][1:] + "x", known[i] + " Holdings", known[i].replace("pp", "p"))]
    q = spark.createDataFrame([(0, i, a) for i, a in enumerate(asked)], "engagement_id long, query_id long, name string")
    c = spark.createDataFrame([(0, k, 9 - i % 10) for i, k in enumerate(known)], "engagement_id long, candidate string, pos long")
    got = {r.query_id: tuple(r)[3:] for r in names.fuzzy_links(q, c).collect()}
    assert scored[0] < 0.01 * len(asked) * len(known)
    plain = {r.name: r.n for r in names.normal(q.select("name").union(c.select("candidate")), "name").collect()}
    index, rows = NameIndex([plain[k] for k in known]), np.arange(len(known))
    for i, a in enumerate(asked):
        pairs = pd.DataFrame({"partial": score_partial(index, plain[a], rows), "tokens": score_tokens(index, plain[a], rows), "pos": 9 - rows % 10, "candidate": known})
        hits = pairs[(pairs.partial >= names.PARTIAL) | (pairs.tokens >= names.TOKENS)].sort_values(["partial", "tokens", "pos", "candidate"], ascending=[False, False, True, True])
        first = hits.iloc[0]
        assert got[i] == (len(hits), first.candidate, first.partial, first.tokens)


def test_ranges_and_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(names, "LINK_NAMES", 7)
    monkeypatch.setattr(names, "LINK_CANDIDATES", 11)
    rng = random.Random(6)
    known = [(e, f"acme{rng.randrange(10 ** 4):04d}{form}", i % 20) for e in (1, 2) for i in range(40) for form in ("", " Co., Ltd.")] + [(1, None, 0), (2, "", 0)]
    asked = [(e, i, rng.choice(known[:80])[1][i % 2 :]) for e in (1, 2, 3) for i in range(30)]
    q = spark.createDataFrame(asked, "engagement_id long, query_id long, name string")
    c = spark.createDataFrame(known, "engagement_id long, candidate string, pos int")
    got = {(r.engagement_id, r.query_id): tuple(r)[3:] for r in names.fuzzy_links(q, c).collect()}
    plain = {r.name: r.n for r in names.normal(q.select("name").union(c.select("candidate")).distinct(), "name").collect()}
    for e, i, name in asked:
        pairs = [(-partial_ratio(plain[name], plain[k]), -token_set_ratio(plain[name], plain[k]), p, k) for f, k, p in known if f == e and k]
        hits = sorted(x for x in pairs if -x[0] >= names.PARTIAL or -x[1] >= names.TOKENS)
        assert got[e, i] == ((len(hits), hits[0][3], -hits[0][0], -hits[0][1]) if hits else (0, None, None, None))
    assert len(got) == 90 and sum(x[0] > 1 for x in got.values()) > 10
