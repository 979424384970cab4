"""Literal cases of sampling, currency, reconciliation, names and curves, and sequential loops as second oracles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import similarity, text
from auditlake.operators import coverage, curves, fx, names, sampling


def test_sample_size_of_a_known_case(spark):
    key, rest = 150_984_925_323, 158_586_818_738 - 150_984_925_323
    parties = spark.createDataFrame([(1, "receivable", True, True, key), (1, "receivable", True, False, rest)], "engagement_id long, kind string, is_active boolean, is_key boolean, b long").withColumn("balance", F.col("b").cast("decimal(38,2)"))
    params = spark.createDataFrame([(1, 2_738_000_000.0, "유의적위험", "Y")], "engagement_id long, pm double, risk string, reliance string")
    r = sampling.sample_size(parties, params).first()
    assert (r.threshold, r.final_size, r.interval) == (2_053_500_000.0, 4, 1_900_473_353.75)
    assert r.base_size == pytest.approx(2.776440253834916)


def sequential_mus(balances, r0, step):
    """One unit after the other, the remainder carried on."""
    out, left = [], -r0
    for b in balances:
        left, n = left + b, 0
        while left >= 0:
            left, n = left - step, n + 1
        out.append(n)
    return out


@pytest.mark.parametrize("parts", [None, 1, 7])
@pytest.mark.parametrize("signed", [False, True])
def test_mus_against_the_sequential_walk(spark, parts, signed):
    """Also with negative balances and starts above the interval."""
    rng = random.Random(5)
    rows, sizes, want = [], [], {}
    for e in range(12):
        balances = [rng.randint(-3000 if signed else 1, 5000) for _ in range(rng.randint(1, 40) if e else 400)]
        step = float(rng.randint(50, 4000))
        r0 = step * rng.random() * (4 if signed else 1)
        sizes.append((e, "receivable", step, r0))
        rows += [(e, "receivable", f"p{i:03}", b) for i, b in enumerate(balances)]
        want |= {(e, f"p{i:03}"): n for i, n in enumerate(sequential_mus(balances, r0, step))}
    pool = spark.createDataFrame(rows, "engagement_id int, kind string, party string, b long").withColumn("balance", F.col("b").cast("decimal(38,2)"))
    got = sampling.run_mus(pool, spark.createDataFrame(sizes, "engagement_id int, kind string, interval double, start double"), parts=parts)
    assert {(r.engagement_id, r.party): r.selections for r in got.collect()} == want


def guide(spark, *rows):
    return spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows)], "engagement_id long, party string, account_group string, currency string, amount double, pos int")


def test_implicit_rate_and_manual_rate(spark):
    g = guide(spark, ("a", "x", "USD", 100_000.0), ("a", "x", "KRW", 130_000_000.0), ("b", "x", "USD", 1.0), ("b", "x", "KRW", 1_000_000.0))
    assert [(r.currency, r.rate) for r in fx.implicit_rates(g).collect()] == [("USD", 1300.0)]
    manual = spark.createDataFrame([(1, "usd", 1350.0)], "engagement_id long, currency string, rate double")
    assert [(r.rate, r.rate_source) for r in fx.all_rates(g, manual).collect()] == [(1350.0, "manual")]


@pytest.mark.parametrize("declared,reply,pct,status", [(True, 50.0, 0.0, "needs_review"), (True, 96.0, 0.0, "matched"), (False, 100.0, 0.0, "mismatch"), (None, 99.5, 0.01, "matched"), (None, 98.0, 0.01, "mismatch"), (None, None, 0.01, "extraction_failed")])
def test_reconcile_v2(spark, declared, reply, pct, status):
    replies = spark.createDataFrame([(1, 1, "a", 100.0, reply, declared, "KRW")], "reply_id long, engagement_id long, party string, ledger_amount double, reply_amount double, declared_match boolean, currency string")
    none = spark.createDataFrame([], "reply_id long, account_group string, row_currency string, row_amount double, pos int")
    g = guide(spark, ("a", "x", "KRW", 100.0))
    assert fx.reconcile_v2(replies, none, g, fx.all_rates(g), 0.0, pct).first().status == status


def test_party_states(spark):
    cases = [("matched", "미해소", "matched"), ("mismatch", "충분", "대체적_충분"), ("mismatch", "미해소", "mismatch"), (None, "needs_review", "대체적_pending"), ("needs_review", None, "needs_review"), (None, None, "unresolved")]
    df = spark.createDataFrame(cases, "reply_status string, conclusion string, want string")
    assert all(r.state == r.want for r in coverage.classify_party_status(df).collect())


def test_company_forms_are_stripped(spark):
    same = ["㈜한국", "(주)한국", "주식회사 한국", "한국 Co., Ltd.", "한 국"]
    df = spark.createDataFrame([(x,) for x in same], "name string")
    assert {r.n for r in df.select(names.normalize_party("name").alias("n")).collect()} == {"한국"}


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
    return t[-1][-1]


def test_similarity():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.lcs(a, b) == naive_lcs(a, b)
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, e - n) : min(e, len(long))] for e in range(1, len(long) + n)] if n else []
        want = max((200 * naive_lcs(short, w) / (n + len(w)) for w in windows), default=100.0 if not long else 0.0)
        assert similarity.partial_ratio(a, b) == pytest.approx(want)
    assert similarity.partial_ratio("cosmax", "cosmax inc") == 100
    assert similarity.token_set_ratio("a b", "b a c") == 100


def test_failed_names_keep_three_candidates(spark):
    q = spark.createDataFrame([(1, 1, "zzzz", None, None)], "engagement_id long, query_id long, name string, business_no string, filename string")
    c = spark.createDataFrame([(1, n, i) for i, n in enumerate(["zzab", "zabc", "yyzz", "zzza"])], "engagement_id long, candidate string, pos long")
    contacts = spark.createDataFrame([], "engagement_id long, contact string, business_no string, pos long")
    aliases = spark.createDataFrame([], "alias string, canonical string")
    r = names.resolve_party(q, c, contacts, aliases).first()
    assert (r.matched, r.method) == (None, "failed") and len(r.candidates.split("; ")) == 3


def test_declared_cells(spark):
    df = spark.createDataFrame([("불일치",), ("일치",), ("Mismatch",), ("yes",), ("",)], "c string")
    assert [r[0] for r in df.select(text.declared_cell(F.col("c"))).collect()] == [False, True, False, True, None]


def test_bootstrap_recovers_a_flat_curve_and_the_step_by_step_recursion(spark):
    q = spark.createDataFrame([(1, float(t), 5.0) for t in (1, 5, 30)] + [(2, float(t), 2.0 + t / 5) for t in (1, 3, 10)], "curve_id int, t double, y double")
    rows = curves.bootstrap_par_curve(q).orderBy("curve_id", "step").collect()
    flat = [r for r in rows if r.curve_id == 1]
    assert len(flat) == 40 and all(r.zper == pytest.approx(2.5) and r.warning == "longer input left out" for r in flat)
    done = 0.0
    for r in (r for r in rows if r.curve_id == 2):
        c = r.ytm_per / 100
        df = (1 - c * done) / (1 + c)
        done += df
        assert r.df == pytest.approx(df)
    assert [r.zper for r in rows if r.curve_id == 2 and r.t == 10][0] * 2 > 4


def test_bond_legs_against_the_backward_walk(spark):
    rng = random.Random(11)
    deals, forwards, coupons, want = [], [], [], {}
    for d in range(20):
        n, face, irr, rate = rng.randint(3, 30), 1000.0, rng.random() / 10, rng.random() / 20
        first, f = rng.randint(1, n), [rng.random() / 12 for _ in range(n)]
        dt = 0.25
        cf = {s: face * rate * 0.5 for s in range(2, n + 1, 2)}
        deals.append((d, d, face, rate, 0.5, n, dt, irr, first))
        forwards += [(d, s + 1, x) for s, x in enumerate(f)]
        coupons += [(d, s, x) for s, x in cf.items()]

        def put(s):
            t = s * dt
            paid = sum(face * rate * 0.5 * (1 + irr) ** (t - k * 0.5) for k in range(1, int((t + 1e-9) / 0.5) + 1))
            return max(face, face * (1 + irr) ** t - (paid if rate > 0 and irr > 0 else 0))

        bond = puttable = max(face, put(n)) + cf.get(n, 0)
        for s in range(n - 1, -1, -1):
            disc = math.exp(-f[s] * dt)
            bond, puttable = disc * bond + cf.get(s, 0), disc * puttable + cf.get(s, 0)
            if s >= first:
                puttable = max(puttable, put(s))
        want[d] = (bond, puttable)
    steps = curves.bond_steps(
        spark.createDataFrame(deals, "deal_id int, curve_id int, face double, coupon double, interval double, steps int, dt double, put_irr double, put_step int"),
        spark.createDataFrame(forwards, "curve_id int, step int, forward double"), spark.createDataFrame(coupons, "deal_id int, step int, amount double"),
    )
    for r in curves.bond_legs(steps).collect():
        assert (r.bond_floor, r.puttable_bond) == pytest.approx(want[r.deal_id])
