"""Source divergence against plain loops, with spills forced and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.llm import divergence

DOC = "doc_id long, text string, lang string, source string"


def by_loops(rows, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, lang, source in rows:
        found = term.findall((text or "").translate(lower))
        docs[lang or ""].update(set(found))
        counts[lang or ""][source or ""].update(found)
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        whole = p(sum(sources.values(), Counter()))
        of = {s: p(c) for s, c in sources.items()}
        for s, c in sources.items():
            pairs = [(r, sum(f(of[s][t], of[r][t]) for t in kept)) for r in sources if r != s]
            terms = [(t, f(of[s][t], whole[t])) for t in kept if c[t] > 0 and of[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return sorted(tuple(r) for r in divergence.source_divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "Straße", "日本"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        text = " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", " Wa1wb", " THE the_The", "\x00x\x7fy"])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    return rows


@pytest.mark.parametrize("held", [50, 400_000])
def test_equals_loops_with_and_without_spills(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CHUNK", 64)
    monkeypatch.setattr(divergence, "CELLS", 10)
    rows = corpus()
    assert made(spark, rows) == by_loops(rows)
    assert made(spark, rows, top=3) == by_loops(rows, 3)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "s"), (None, "123 ... 4", "en", "t"), (3, "x x x", "fr", "s"), (4, "ab " * 50_000, "fr", "s"), (5, "ab x", "fr", "s"), (6, "x ab cd", "fr", "")]
    assert made(spark, rows) == by_loops(rows)
    assert made(spark, rows[:0]) == []
    clash = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("z") for c in ("term", "docs", "sources", "part", "item", "value", "rank", "n")})
    assert sorted(tuple(r) for r in divergence.source_divergence(clash).select("lang", "source", "part", "item", "value", "rank").collect()) == by_loops(rows)


def test_shares_of_large_counts_are_exact():
    import numpy as np

    count, total = np.array([0, 10**12, 8 * 10**15, 7]), np.array([9 * 10**15 - 1])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(total[0]) for c in count]


def test_frequent_terms_are_one_stripe_a_spill(spark):
    rows = [(i, "the the of", "en", f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    partial = df.select("lang", "source", "text").mapInArrow(divergence._fold, divergence._SCHEMA)
    assert partial.where("term = 'the'").count() <= 7
    stripe = divergence.merged_stripes(df).where("term = 'the'").collect()
    assert [(s.docs, sorted(map(tuple, s.sources))) for s in stripe] == [(2000, [(f"s{i}", 800) for i in range(5)])]
