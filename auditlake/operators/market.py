"""Market inputs for valuation: volatilities, betas, as-of financials, multiples, rates.

prices: ticker, date, close, volume. Windows run within a ticker, so one shuffle by ticker serves them all; the dates of a
ticker of more than ranges.ROWS rows are cut into ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.operators.ranges import PART, carried, cuts, previous, with_halo, with_part
from auditlake.operators.selection import exact_percentiles


def usable() -> Column:
    close = F.col("close").isNotNull() & ~F.isnan(F.col("close").cast("double")) & (F.col("close") > 0)
    volume = F.col("volume").cast("double")
    return close & F.coalesce((volume != 0) & ~F.isnan(volume), F.lit(True))


def clean_closes(prices: DataFrame) -> DataFrame:
    """Rows with a positive close and a volume other than 0; an unknown volume is kept."""
    return prices.where(usable())


def clean_counts(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.count_if(usable()).alias("kept"), F.count_if(~usable()).alias("removed"))


def day_number(date: str = "date") -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def returns(clean: DataFrame, keys: tuple[str, ...] = ("ticker",), rows: int | None = None) -> DataFrame:
    """clean with log_return and simple_return to the close before."""
    close, before = F.col("close"), F.col("_before.close")
    told = previous(clean, list(keys), day_number(), F.struct("close"), "_before", rows)
    return told.withColumn("log_return", F.log(close) - F.log(before)).withColumn("simple_return", close / before - 1).drop("_before")


def trading_days_auto(clean: DataFrame) -> DataFrame:
    """Per ticker round(closes x 365.25 / calendar days, 1), 252 where dates don't tell."""
    days = F.datediff(F.max("date"), F.min("date"))
    return clean.groupBy("ticker").agg(F.when((F.count("*") >= 2) & (days > 0), F.round(F.count("*") * 365.25 / days, 1)).otherwise(252.0).alias("trading_days"))


def historical_vol(clean: DataFrame, trading_days: float | None = 252, log: bool = True, keys: tuple[str, ...] = ("ticker",), rows: int | None = None) -> DataFrame:
    """Annual volatility with standard error, 95 % interval and the other convention's difference in points; under two
    closes, sigma is null and error says so. trading_days None: measured per ticker."""
    stats = returns(clean, keys, rows).groupBy(*keys).agg(
        F.stddev_samp("log_return").alias("_l"), F.stddev_samp("simple_return").alias("_s"), F.count("log_return").alias("n_obs"), F.count("*").alias("n_prices"),
        F.when((F.count("*") >= 2) & (F.datediff(F.max("date"), F.min("date")) > 0), F.round(F.count("*") * 365.25 / F.datediff(F.max("date"), F.min("date")), 1)).otherwise(252.0).alias("_d"),
    )
    days = F.col("_d") if trading_days is None else F.lit(float(trading_days))
    sigma, other = (F.col("_l"), F.col("_s")) if log else (F.col("_s"), F.col("_l"))
    out = stats.withColumn("trading_days", days).withColumn("sigma", sigma * F.sqrt("trading_days"))
    out = out.withColumn("sigma_se", F.col("sigma") / F.sqrt(2 * F.col("n_obs")))
    return out.select(
        *keys, "sigma", "sigma_se", F.when(F.col("sigma").isNotNull(), F.greatest(F.lit(0.0), F.col("sigma") - 1.96 * F.col("sigma_se"))).alias("ci95_low"), (F.col("sigma") + 1.96 * F.col("sigma_se")).alias("ci95_high"), "n_obs", "n_prices", "trading_days",
        (F.abs(sigma - other) * F.sqrt("trading_days") * 100).alias("convention_diff_pp"), F.when(F.col("n_prices") < 2, "fewer than two closes").alias("error"),
    )


def trailing_vols(clean: DataFrame, years: tuple[int, ...] = (1, 2, 3, 5), least: int = 30, trading_days: float = 252, rows: int | None = None) -> DataFrame:
    """Volatility over the last y years of each ticker, to int(y x 365.25) days before its last date; null under `least`
    closes."""
    last = clean.groupBy("ticker").agg(F.max("date").alias("_last"))
    age = F.datediff(F.col("_last"), F.col("date"))
    each = clean.join(last, "ticker").withColumn("period_years", F.explode(F.filter(F.array(*(F.when(age <= int(y * 365.25), F.lit(y)) for y in years)), lambda y: y.isNotNull())))
    vols = historical_vol(each, trading_days, keys=("ticker", "period_years"), rows=rows)
    enough = F.col("n_prices") >= least
    return vols.select("ticker", "period_years", "n_obs", *(F.when(enough, F.col(c)).alias(c) for c in ("sigma", "sigma_se", "ci95_low", "ci95_high")))


def outlier_flags(vols: DataFrame, basket: str, method: str = "iqr", k: float = 1.5, k_mad: float = 3.0, least: int = 5, rows: int | None = None) -> DataFrame:
    """vols with `outlier` within their basket: outside quartiles +- k ranges (iqr), further than k_mad median absolute
    deviations from the median (mad), either (iqr_or_mad) or both (iqr_and_mad). Baskets under `least` have none; a
    deviation of 0 flags nothing."""
    valid = vols.where("sigma is not null").select(basket, "sigma")
    q = exact_percentiles(valid, basket, "sigma", {"_q1": 0.25, "_m": 0.5, "_q3": 0.75}, "_n", rows)
    mad = exact_percentiles(valid.join(q, basket).select(basket, F.abs(F.col("sigma") - F.col("_m")).alias("_d")), basket, "_d", {"_mad": 0.5}, rows=rows)
    s, width = F.col("sigma"), k * (F.col("_q3") - F.col("_q1"))
    by_iqr = (s < F.col("_q1") - width) | (s > F.col("_q3") + width)
    by_mad = (F.col("_mad") > 0) & (F.abs(s - F.col("_m")) > k_mad * F.col("_mad"))
    rule = {"iqr": by_iqr, "mad": by_mad, "iqr_or_mad": by_iqr | by_mad, "iqr_and_mad": by_iqr & by_mad}.get(method, F.lit(False))
    return vols.join(q, basket, "left").join(mad, basket, "left").withColumn("outlier", F.coalesce(rule & (F.col("_n") >= least), F.lit(False))).drop("_n", "_q1", "_m", "_q3", "_mad")


def aggregate_vol(flagged: DataFrame, basket: str, cap: str | None = None, rows: int | None = None) -> DataFrame:
    """Per basket the median, mean and cap-weighted volatility of what isn't an outlier, and how many those are. Unknown
    caps weigh 0; without a positive sum the weighted one is null."""
    kept = F.col("sigma").isNotNull() & ~F.col("outlier")
    weight = F.coalesce(F.col(cap).cast("double"), F.lit(0.0)) if cap else F.lit(0.0)
    total = F.sum(F.when(kept, weight))
    sums = flagged.groupBy(basket).agg(
        F.count_if(kept).alias("n"), F.count_if("outlier").alias("n_excluded"), F.avg(F.when(kept, F.col("sigma"))).alias("mean"),
        F.when(total > 0, F.sum(F.when(kept, weight * F.col("sigma"))) / total).alias("cap_weighted"), F.avg(F.when(kept, F.col("sigma_se"))).alias("mean_se"),
    )
    median = exact_percentiles(flagged.where(kept).select(basket, "sigma"), basket, "sigma", {"median": 0.5}, rows=rows)
    return sums.join(median, basket, "left").select(basket, "n", "n_excluded", "median", "mean", "cap_weighted", "mean_se")


def aligned_returns(prices: DataFrame, market: DataFrame, weekly: bool = False, rows: int | None = None) -> DataFrame:
    """Log returns of ticker and market over their common dates, of each ISO week's last one if weekly."""
    both = prices.select("ticker", "date", "close").join(market.select("date", F.col("close").alias("market")), "date")
    if weekly:
        week = F.date_trunc("week", "date")
        both = both.groupBy("ticker", week.alias("_w")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.max_by("market", "date").alias("market"))
    told = previous(both, ["ticker"], day_number(), F.struct("close", "market"), "_before", rows)
    log_return = lambda c: F.log(F.col(c)) - F.log(F.col(f"_before.{c}"))
    return told.withColumn("r", log_return("close")).withColumn("m", log_return("market")).drop("_before")


def beta(prices: DataFrame, market: DataFrame, weekly: bool = False, least: int = 30, blume: bool = True) -> DataFrame:
    """Slope, r2 and alpha of ticker on market returns; tickers under `least` common dates or without market variance
    are left out. A close that isn't positive has no return, neither to it nor from it. No zero is negative."""
    r = aligned_returns(prices, market, weekly)
    out = r.groupBy("ticker").agg(F.count("*").alias("_n"), F.regr_slope("r", "m").alias("b"), F.corr("r", "m").alias("c"), F.regr_intercept("r", "m").alias("a"), F.min("date").alias("start"), F.max("date").alias("end"), F.var_samp("m").alias("_v"))
    adjusted = 0.67 * F.col("b") + 0.33 if blume else F.col("b")
    return out.where((F.col("_n") >= least) & (F.col("_v") > 0)).select("ticker", (F.round("b", 4) + 0.0).alias("raw_beta"), (F.round(adjusted, 4) + 0.0).alias("adjusted_beta"), F.round(F.col("c") * F.col("c"), 4).alias("r2"), (F.round("a", 6) + 0.0).alias("alpha"), (F.col("_n") - 1).alias("n_obs"), "start", "end")


def asof(targets: DataFrame, rows: DataFrame, key: str, target: str, at: str, days: int, order: list[Column] | None = None) -> DataFrame:
    """For each target the row of its key with the last date up to `days` before it, or the first in `order`.

    The look-back is bounded: dates go to buckets of `days`, and a target meets its own and the one before, so a key with
    a long history is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    t = targets.withColumn("_id", F.struct(*targets.columns)).withColumn("_b", F.explode(F.array(bucket(target), bucket(target) - 1)))
    hits = t.join(rows.withColumn("_b", bucket(at)), [key, "_b"]).where(F.col(at).between(F.date_sub(target, days), F.col(target)))
    best = W.partitionBy("_id").orderBy(*(order or []), F.desc(at))
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_b", "_id")


def asof_price(targets: DataFrame, prices: DataFrame, days: int = 14) -> DataFrame:
    """targets (ticker, target_date) with the last close up to `days` before."""
    return asof(targets, prices.select("ticker", "date", "close"), "ticker", "target_date", "date", days)


def asof_merge(targets: DataFrame, rows: DataFrame, key: str, target: str, at: str, carried_: dict[str, tuple[Column, Column]], limit: int | None = None) -> DataFrame:
    """targets with a column for each name -> (condition, value): the value of the last row up to the target's date, of its key,
    that meets the condition; null without one.

    Targets and rows are sorted together by key and date, rows before targets of their day, and each target takes what was
    carried so far: one shuffle, and no row for a pair. A key of more than `limit` rows (ranges.ROWS) is cut into ranges of
    dates. Of rows of one date the largest value counts.
    """
    kinds = rows.select(*(v.alias(n) for n, (_, v) in carried_.items())).schema
    held = rows.select(F.col(key), F.col(at).alias("_at"), F.lit(0).alias("_kind"), *(F.when(c, F.struct(v.alias("v"))).alias(f"_c_{n}") for n, (c, v) in carried_.items()))
    asked = targets.select(F.col(key), F.col(target).alias("_at"), F.lit(1).alias("_kind"), F.struct(*targets.columns).alias("_row"))
    both = held.unionByName(asked, allowMissingColumns=True)
    day = day_number("_at")
    cut = cuts(both.select(key, day.alias("_o")), [key], F.col("_o"), limit)
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("_at", c)))
    both = carried(with_part(both, [key], day, cut), [key], cut, {f"_b{c[2:]}": (newest(c), "last", "before") for c in (f"_c_{n}" for n in carried_)})
    told = []
    for n in carried_:
        w = W.partitionBy(key, PART).orderBy("_at", "_kind", f"_c_{n}")
        told.append(F.coalesce(F.last(f"_c_{n}", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), f"_b_{n}")["v"].cast(kinds[n].dataType).alias(n))
    return both.select("_row", "_kind", *told).where("_kind = 1").select("_row.*", *carried_)


def asof_balance_sheet(targets: DataFrame, statements: DataFrame, limit: int | None = None) -> DataFrame:
    """The last statement up to the target that has total debt, quarterly before annual; equity is the first item there is."""
    sheet = F.struct("period_end", "period_type", "total_debt", F.coalesce("equity_a", "equity_b").alias("equity"), "cash")
    quarter = F.col("period_type") == "quarter"
    j = asof_merge(targets, statements.where("total_debt is not null"), "ticker", "target_date", "period_end", {"_quarter": (quarter, sheet), "_other": (~F.coalesce(quarter, F.lit(False)), sheet)}, limit)
    return j.withColumn("_s", F.coalesce("_quarter", "_other")).where("_s is not null").select(*targets.columns, "_s.*")


def debt_equity(sheets: DataFrame, snapshot: DataFrame, cap: str = "market_cap") -> DataFrame:
    """Debt to book and market equity in percent, from the statement, else the snapshot (source says which); flagged if
    the statement is over 90 days before the target."""
    j = snapshot.join(sheets, ["ticker", "target_date"], "left")
    debt, equity = F.coalesce("total_debt", "snapshot_debt"), F.coalesce("equity", "snapshot_equity")
    pct = lambda d: F.when(d > 0, F.round(debt / d * 100, 2))
    return j.select("ticker", "target_date", F.when(F.col("total_debt").isNotNull(), "statement").otherwise("snapshot").alias("source"), pct(equity).alias("de_book"), pct(F.col(cap)).alias("de_market"), F.coalesce(F.abs(F.datediff("target_date", "period_end")) > 90, F.lit(False)).alias("stale"))


def ttm_ebitda(targets: DataFrame, statements: DataFrame, limit: int | None = None) -> DataFrame:
    """EBITDA, else operating income plus D&A: the last 4 quarters of 400 days, fewer scaled to 4; without quarters the
    last annual one. A quarter carries its three predecessors along, so a target takes them from its last quarter alone."""
    value = F.coalesce("ebitda", F.col("operating_income") + F.coalesce("da", F.lit(0.0)))
    s = statements.withColumn("v", value).where("v is not null").select("ticker", "period_end", "period_type", "v")
    day = day_number("period_end")
    quarters = s.where("period_type = 'quarter'")
    cut = cuts(quarters.select("ticker", day.alias("_o")), ["ticker"], F.col("_o"), limit)
    dealt = with_halo(with_part(quarters, ["ticker"], day, cut), ["ticker"], [F.col("period_end"), F.col("v")], cut, 3)
    last_four = F.collect_list(F.struct("period_end", "v")).over(W.partitionBy("ticker", PART).orderBy("period_end", "v").rowsBetween(-3, 0))
    quarters = dealt.withColumn("_four", last_four).where("not _halo").select("ticker", "period_end", "period_type", "v", "_four")
    rows = quarters.unionByName(s.where("period_type = 'annual'"), allowMissingColumns=True)
    annual = F.struct("v", "period_end")
    out = asof_merge(targets, rows, "ticker", "target_date", "period_end", {"_four": (F.col("period_type") == "quarter", F.col("_four")), "_annual": (F.col("period_type") == "annual", annual)}, limit)
    near = F.filter("_four", lambda q: F.datediff("target_date", q["period_end"]) <= 400)
    out = out.withColumn("_near", F.coalesce(near, F.array().cast("array<struct<period_end:date,v:double>>"))).withColumn("n", F.size("_near"))
    total = F.aggregate("_near", F.lit(0.0), lambda a, q: a + q["v"])
    basis = F.when(F.col("n") == 4, "quarterly_ttm").when(F.col("n") > 0, "quarterly_annualized").when(F.col("_annual").isNotNull(), "annual")
    some = F.col("n") > 0
    return out.select("ticker", "target_date", F.when(some, total * 4.0 / F.col("n")).otherwise(F.col("_annual.v")).alias("ebitda"), F.when(some, F.array_max(F.transform("_near", lambda q: q["period_end"]))).otherwise(F.col("_annual.period_end")).alias("period_end"), basis.alias("basis"))


def peer_multiples(peers: DataFrame) -> DataFrame:
    """peers (basket, ticker, market_cap, debt, cash, ebitda) with ev and ev_ebitda (of positive EBITDA)."""
    ev = F.col("market_cap") + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    return peers.withColumn("ev", ev).withColumn("ev_ebitda", F.when(F.col("ebitda") > 0, ev / F.col("ebitda")))


def multiple_summary(multiples: DataFrame, basket: str, rows: int | None = None) -> DataFrame:
    """Median and mean of multiples between 0 and 100."""
    fit = F.when((F.col("ev_ebitda") > 0) & (F.col("ev_ebitda") < 100), F.col("ev_ebitda"))
    median = exact_percentiles(multiples.where("ev_ebitda > 0 and ev_ebitda < 100").select(basket, "ev_ebitda"), basket, "ev_ebitda", {"median": 0.5}, rows=rows)
    return multiples.groupBy(basket).agg(F.avg(fit).alias("mean"), F.count(fit).alias("n")).join(median, basket, "left").select(basket, "median", "mean", "n")


def hamada(peers: DataFrame, basket: str, tax: float, target_de: float) -> DataFrame:
    """Per basket the median unlevered beta of peers (beta, de as a ratio), relevered to target_de."""
    divisor = 1 + (1 - tax) * F.col("de")
    unlevered = peers.withColumn("bu", F.when(divisor > 0, F.col("beta") / divisor).otherwise(F.col("beta")))
    return unlevered.groupBy(basket).agg(F.expr("percentile(bu, 0.5)").alias("beta_unlevered")).withColumn("beta_relevered", F.col("beta_unlevered") * (1 + (1 - tax) * target_de))


def wacc(df: DataFrame, rf: float, mrp: float, kd: float, tax: float, target_de: float, size: float = 0.0, country: float = 0.0) -> DataFrame:
    """df (beta_relevered) with cost of equity and weighted cost of capital."""
    e = 1 / (1 + target_de)
    ke = rf + F.col("beta_relevered") * mrp + size + country
    return df.withColumn("ke", ke).withColumn("wacc", e * ke + (1 - e) * kd * (1 - tax))


def latest_rate(rates: DataFrame, target: str, days: int = 45) -> DataFrame:
    """Per item the last non-blank percentage of the `days` before the target, as a decimal of 6 places."""
    v = F.expr("try_cast(nullif(trim(value), '') as double)")
    day = F.lit(target).cast("date")
    return rates.withColumn("v", v).where(F.col("v").isNotNull() & F.col("date").between(F.date_sub(day, days), day)).groupBy("item").agg(F.round(F.max_by("v", "date") / 100, 6).alias("rate"), F.max("date").alias("date"))


def even_downsample(rows: DataFrame, key: str, order: str, most: int = 500) -> DataFrame:
    """At most `most` rows of each key: those at int(k (n - 1) / (most - 1)), k from 0."""
    w = W.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    numbered = rows.withColumn("_i", i).withColumn("_n", n)
    # row i is taken if some k has floor(k (n - 1) / (most - 1)) = i: the least k at or above i (most - 1) / (n - 1)
    k = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    taken = (F.col("_n") <= most) | (F.floor(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i"))
    return numbered.where(taken).drop("_i", "_n")


def regression_line(aligned: DataFrame) -> DataFrame:
    """Per ticker the regression line's ends, at the smallest and largest market return."""
    g = aligned.where("r is not null").groupBy("ticker").agg(F.min("m").alias("x0"), F.max("m").alias("x1"), F.regr_slope("r", "m").alias("b"), F.regr_intercept("r", "m").alias("a"))
    return g.select("ticker", "x0", (F.col("a") + F.col("b") * F.col("x0")).alias("y0"), "x1", (F.col("a") + F.col("b") * F.col("x1")).alias("y1"))
