"""Related parties against all pairs, where names of a group start alike, and in several blocks."""

import random

import pytest

from auditlake.operators import sampling


@pytest.mark.parametrize("block", [40, 4_000_000])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "BLOCK_CHARACTERS", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("ABC") for _ in range(rng.randint(1, 4)))
    related = [(e, rng.choice(["GROUPHOLDING", "㈜GROUP HOLDING ", ""]) + word()) for e in (1, 2) for _ in range(12)] + [(1, "주식회사"), (3, "가나다라마바사")]
    parties = [(e, rng.choice(["GROUPHOLDING", "GROUP", "", "x"]) + word() + rng.choice(["", "LTD."])) for e in (1, 2, 4) for _ in range(60)] + [(3, "다라"), (3, "가나다라마바사아"), (3, "바라"), (1, "㈜"), (3, "가나다라마바사")]
    bare = lambda n: "".join(c for c in n.replace("㈜", "").replace("(주)", "").replace("주식회사", "") if c not in " ,.").upper()
    want = {(e, p) for e, p in parties for f, r in related if e == f and bare(p) and bare(r) and (bare(p) in bare(r) or bare(r) in bare(p))}
    frame = lambda rows, c: spark.createDataFrame(rows, f"engagement_id int, {c} string")
    got = sampling.related_parties(frame(parties, "party"), frame(related, "name")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sampling.related_parties(frame(parties, "party"), frame([], "name")).count() == 0


def test_a_hundred_thousand_names_of_one_group(spark):
    related = spark.range(100_000).selectExpr("1 as engagement_id", "concat('GROUPHOLDING', lpad(id, 6, '0')) as name")
    parties = spark.range(0, 200_000, 7).selectExpr("1 as engagement_id", "concat('X GROUPHOLDING', lpad(id, 6, '0'), if(id % 2 = 0, ' KR', '')) as party")
    assert sampling.related_parties(parties, related).count() == len(range(0, 100_000, 7))
