"""Long groups cut into ranges: the same rows as in one task, and time in proportion to rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import curves, market
from auditlake.operators.selection import exact_percentiles


def curve_points(n=40, seed=3):
    rng = random.Random(seed)
    return sorted({round(rng.uniform(0, 30), 3): rng.uniform(1, 5) for _ in range(n)}.items())


@pytest.mark.parametrize("rows", [None, 500, 37])
def test_interpolation_by_ranges_equals_numpy(spark, rows):
    rng = random.Random(rows)
    pts = {c: curve_points(seed=c) for c in range(3)}
    # curve 0 is long, a third of its targets stand at one t, at a point's and between two; some lie outside
    ts = [(0, rng.choice([5.0, pts[0][7][0], round(rng.uniform(-2, 33), 4)]), i) for i in range(3000)] + [(c, round(rng.uniform(0, 30), 4), i) for c in (1, 2) for i in range(50)] + [(9, 1.0, 0)]
    points = spark.createDataFrame([(c, t, y) for c, p in pts.items() for t, y in p], "curve_id int, t double, y double")
    targets = spark.createDataFrame(ts, "curve_id int, t double, id int")
    got = {(r.curve_id, r.id): (r.t, r.y) for r in curves.interp_linear(points, targets, rows=rows).collect()}
    assert len(got) == len(ts)
    for c, t, i in ts:
        want = np.interp(t, *zip(*pts[c])) if c in pts else None
        assert got[c, i][0] == t and (got[c, i][1] is None if want is None else got[c, i][1] == pytest.approx(want, rel=1e-12))


def test_points_of_one_t_and_curves_without_targets(spark):
    points = spark.createDataFrame([(1, 1.0, 5.0), (1, 1.0, 7.0), (1, 3.0, 9.0), (2, 1.0, 1.0)], "curve_id int, t double, y double")
    targets = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 0.0), (1, 4.0)], "curve_id int, t double")
    for rows in (None, 2):
        assert [r.y for r in curves.interp_linear(points, targets, rows=rows).orderBy("t").collect()] == [7.0, 7.0, 8.0, 9.0]


def test_time_grows_with_rows(spark):
    """2,000,000 targets on one curve take about ten times what 200,000 do, not a hundred times."""
    points = spark.createDataFrame([(1, t, y) for t, y in curve_points()], "curve_id int, t double, y double")

    def seconds(n):
        targets = spark.range(n).select(F.lit(1).alias("curve_id"), (F.rand(1) * 30).alias("t"), "id")
        began = time.time()
        curves.interp_linear(points, targets).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1000)
    small, large = seconds(200_000), seconds(2_000_000)
    assert large < 25 * max(small, 0.5)


def price_rows(spark, n=700, seed=4):
    rng = random.Random(seed)
    rows = [("hot", i, 100 * 2.718 ** rng.gauss(0, 0.3)) for i in range(n)] + [(f"t{k}", i * 3, rng.uniform(50, 150)) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "ticker string, d int, close double")
    return df.select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), "d").alias("date"), "close", F.lit(1.0).alias("volume"))


def same(a, b):
    a, b = (sorted(map(tuple, df.collect()), key=str) for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9) if all(isinstance(v, float) for v in x) else all(p == q or p == pytest.approx(q, rel=1e-9) for p, q in zip(x, y))


@pytest.mark.parametrize("rows", [4, 100])
def test_windows_of_one_long_ticker(spark, rows):
    prices = price_rows(spark)
    same(market.returns(prices, rows=rows), market.returns(prices))
    same(market.historical_vol(prices, rows=rows), market.historical_vol(prices))
    same(market.trailing_vols(prices, least=5, rows=rows), market.trailing_vols(prices, least=5))
    index = prices.where("ticker = 'hot'").select("date", (F.col("close") + 1).alias("close"))
    same(market.aligned_returns(prices, index, rows=rows), market.aligned_returns(prices, index))
    assert market.returns(prices, rows=rows).where("log_return is null").count() == 4


@pytest.mark.parametrize("rows", [3, 60])  # ranges shorter and longer than the halo
def test_covenants_of_one_long_deal(spark, rows):
    deals = price_rows(spark).select(F.col("ticker").alias("deal_id"), "date", F.col("close").alias("price"), F.lit(100.0).alias("conversion_price"), F.lit(1000.0).alias("face"))
    same(curves.covenant_monitor(deals, rows=rows), curves.covenant_monitor(deals))
    states = curves.covenant_monitor(deals, rows=rows).agg(F.count("reset"), F.count_if("call_active"), F.count_if("knocked_in")).first()
    assert all(n > 0 for n in states)


def test_covenants_against_a_loop(spark):
    deals = price_rows(spark, 200).select(F.col("ticker").alias("deal_id"), "date", F.col("close").alias("price"), F.lit(100.0).alias("conversion_price"), F.lit(1000.0).alias("face"))
    got = [r for r in curves.covenant_monitor(deals, rows=20).orderBy("date").collect() if r.deal_id == "hot"]
    prices, low = [r.price for r in got], 100.0
    for i, r in enumerate(got):
        reference = sum(prices[max(0, i - 2) : i + 1]) / len(prices[max(0, i - 2) : i + 1])
        reset = max(70.0, prices[i]) if (i + 1) % 5 == 0 and reference < 90.0 else None
        low = min(low, reset if reset is not None else low)
        assert r.reference == pytest.approx(reference) and r.reset == reset and r.effective_price == low
        assert r.call_active == (sum(p >= 120 for p in prices[max(0, i - 9) : i + 1]) >= 6) and r.knocked_in == (min(prices[: i + 1]) <= 0.8 * prices[0])


@pytest.mark.parametrize("rows", [5, 50])
def test_percentiles_by_selection_equal_percentile_to_the_bit(spark, rows):
    rng = random.Random(rows)
    values = [(1, rng.gauss(0, 1)) for _ in range(800)] + [(2, rng.choice([1.5, 2.5, -0.0, 7.25])) for _ in range(500)] + [(3, 10.0 ** rng.randint(-40, 40)) for _ in range(300)]
    values += [(4, 3.25)] * 200 + [(None, float(i)) for i in range(100)] + [(5, 1.0), (5, None), (6, None), (7, 2.0), (7, 3.0)]
    df = spark.createDataFrame(values, "g int, v double")
    shares = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.999, "e": 0.0, "f": 1.0}
    want = {r.g: tuple(r)[1:] for r in df.where("v is not null").groupBy("g").agg(F.count("v"), *(F.expr(f"percentile(v, {s}D)").alias(c) for c, s in shares.items())).collect()}
    got = {r.g: tuple(r)[1:] for r in exact_percentiles(df, "g", "v", shares, "n", rows).collect()}
    assert got == want and set(want) == {1, 2, 3, 4, 5, 7, None}


def test_outliers_and_medians_by_selection(spark):
    rng = random.Random(8)
    vols = spark.createDataFrame([(i % 2, f"t{i}", rng.gauss(0.3, 0.05) if i % 40 else 3.0, 0.01) for i in range(400)] + [(5, "x", None, None)], "basket int, ticker string, sigma double, sigma_se double")
    same(market.outlier_flags(vols, "basket", "iqr_or_mad", rows=20), market.outlier_flags(vols, "basket", "iqr_or_mad"))
    flagged = market.outlier_flags(vols, "basket")
    same(market.aggregate_vol(flagged, "basket", rows=20), market.aggregate_vol(flagged, "basket"))
