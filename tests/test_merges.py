"""As-of merges against loops, on one long ticker; the inquiry list's plan; samples of one giant rule by ranges."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import journal, market

DAY = lambda n: dt.date(2015, 1, 1) + dt.timedelta(n)
STATEMENT = "ticker string, period_end date, period_type string, total_debt double, equity_a double, equity_b double, cash double, ebitda double, operating_income double, da double"


def tables(spark, n=300, seed=1):
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.2 else x
    rows = [(t, DAY(d), rng.choice(["quarter", "quarter", "annual", "other", None]), some(float(d)), some(1.0 * d), 2.0 * d, 3.0, some(4.0 + d), some(5.0), some(1.0)) for t, k in (("hot", n), ("a", 6)) for d in rng.sample(range(0, 6000), k)]
    asked = [(t, DAY(rng.randrange(-50, 6100)), i) for i, t in enumerate(["hot"] * 200 + ["a"] * 20 + ["none"] * 2)] + [("hot", rows[0][1], 999)]
    return rows, asked, spark.createDataFrame(rows, STATEMENT), spark.createDataFrame(asked, "ticker string, target_date date, id int")


@pytest.mark.parametrize("limit", [None, 40])
def test_balance_sheets_as_of(spark, limit):
    rows, asked, statements, targets = tables(spark)
    want = {}
    for t, day, i in asked:
        fit = [r for r in rows if r[0] == t and r[1] <= day and r[3] is not None]
        best = max([r for r in fit if r[2] == "quarter"] or fit, key=lambda r: r[1], default=None)
        if best:
            want[i] = (best[1], best[2], best[3], best[4] if best[4] is not None else best[5])
    got = {r.id: (r.period_end, r.period_type, r.total_debt, r.equity) for r in market.asof_balance_sheet(targets, statements, limit).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [None, 40])
def test_ttm_ebitda_as_of(spark, limit):
    rows, asked, statements, targets = tables(spark, seed=2)
    want = {}
    for t, day, _ in asked:
        fit = sorted([(r[1], r[2], r[7] if r[7] is not None else r[8] + (r[9] or 0.0)) for r in rows if r[0] == t and r[1] <= day and (r[7] is not None or r[8] is not None)])
        q = [x for x in fit if x[1] == "quarter" and (day - x[0]).days <= 400][-4:]
        a = [x for x in fit if x[1] == "annual"][-1:]
        want[t, day] = (sum(x[2] for x in q) * 4 / len(q), q[-1][0], "quarterly_ttm" if len(q) == 4 else "quarterly_annualized") if q else (a[0][2], a[0][0], "annual") if a else (None, None, None)
    for r in market.ttm_ebitda(targets, statements, limit).collect():
        value, end, basis = want[r.ticker, r.target_date]
        assert (r.period_end, r.basis) == (end, basis) and (r.ebitda is None if value is None else math.isclose(r.ebitda, value))


FINDING = "engagement_id int, rule_code string, entry_no string, entry_date date, account_code string, amount double, reason string"


def findings(spark, n=2000):
    rng = random.Random(3)
    rows = [(1, "B01" if i % 4 else "B04", f"{rng.randrange(500):04}", DAY(rng.randrange(300)), str(i % 7), float(rng.randrange(-100, 1000)), None if i % 5 else "r") for i in range(n)] + [(2, "B07", "1", None, "x", 5.0, "late")]
    return rows, spark.createDataFrame(rows, FINDING).withColumn("amount", F.col("amount").cast("decimal(38,2)")).repartition(5)


def test_inquiry_list_passes_on_few_rows(spark):
    rows, df = findings(spark)
    out = journal.inquiry_list(df, most=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    got = out.orderBy("engagement_id", "q_no").collect()
    assert [(r.rule_code, r.seq, r.section_total, r.section_count, r.is_sampled) for r in got if r.engagement_id == 1] == [(c, k, n, 10, True) for c, n in (("B01", 1500), ("B04", 500)) for k in range(1, 11)]
    assert [(r.q_no, r.section_total, r.is_sampled) for r in got if r.engagement_id == 2] == [("Q-001", 1, False)]
    first = sorted((r for r in rows if r[1] == "B01"), key=lambda r: (r[3], r[2], r[4], r[5], r[6] or ""))[:10]
    assert [(r.entry_no, r.account_code, float(r.amount)) for r in got if r.rule_code == "B01"] == [(r[2], r[4], r[5]) for r in first]


@pytest.mark.parametrize("method", ["systematic", "mus", "random"])
def test_samples_do_not_depend_on_ranges(spark, method):
    rows, df = findings(spark)
    sets = [sorted(map(tuple, journal.sample_findings(df, method, 50, parts=p).collect()), key=str) for p in (1, 9)]
    assert sets[0] == sets[1] and len([r for r in sets[0] if r[0] == 2]) == 1
    n = {c: len([r for r in sets[0] if r[1] == c]) for c in ("B01", "B04")}
    assert n["B01"] == n["B04"] == 50 if method != "mus" else all(30 <= v <= 50 for v in n.values())
