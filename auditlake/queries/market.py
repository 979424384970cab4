"""Queries of market inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import market as m
from auditlake.queries.common import Tables, query


def r(df, places=8):
    """Doubles rounded, so that both engines' last digits agree."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


CLEAN = "cl as (select * from {prices} where close is not null and close > 0 and volume <> 0)"
RET = CLEAN + """,
rt as (select *, ln(close) - ln(lag(close) over w) as lr, close / lag(close) over w - 1 as sr from cl window w as (partition by ticker order by date)),
td as (select ticker, case when count(*) >= 2 and date_diff('day', min(date), max(date)) > 0 then round(count(*) * 365.25 / date_diff('day', min(date), max(date)), 1) else 252.0 end as trading_days from cl group by 1)"""


def vol_sql(days: str, sigma: str = "lr", other: str = "sr") -> str:
    return RET + f""",
vs as (select ticker, stddev_samp({sigma}) * sqrt({days}) as sigma, stddev_samp({other}) * sqrt({days}) as osig, count(lr) as n_obs, count(*) as n_prices, {days} as trading_days from rt join td using (ticker) group by ticker, trading_days),
hv as (select ticker, sigma, sigma / sqrt(2 * n_obs) as sigma_se, n_obs, n_prices, cast(trading_days as double) as trading_days, abs(sigma - osig) * 100 as convention_diff_pp, case when n_prices < 2 then 'fewer than two closes' end as error from vs)"""


HV = "select ticker, round(sigma, 8) as sigma, round(sigma_se, 8) as sigma_se, round(case when sigma is not null then greatest(0.0, sigma - 1.96 * sigma_se) end, 8) as ci95_low, round(sigma + 1.96 * sigma_se, 8) as ci95_high, n_obs, n_prices, trading_days, round(convention_diff_pp, 8) as convention_diff_pp, error from hv"


def clean(t: Tables):
    return m.clean_closes(t.prices)


query("mkt_clean_closes", lambda t: clean(t), f"with {CLEAN}\nselect ticker, cast(date as varchar) as date, close, volume from cl")
query("mkt_clean_counts", lambda t: m.clean_counts(t.prices.withColumn("volume", F.when(F.col("volume") > 2, 0).otherwise(F.col("volume")))), "select ticker, count(*) filter (where close > 0 and not isnan(close) and volume <= 2) as kept, count(*) filter (where not coalesce(close > 0 and not isnan(close) and volume <= 2, false)) as removed from {prices} group by 1")
query("mkt_historical_vol", lambda t: r(m.historical_vol(clean(t))), f"with {vol_sql('252')}\n{HV}")
query("mkt_historical_vol_simple", lambda t: r(m.historical_vol(clean(t), None, False)), f"with {vol_sql('trading_days', 'sr', 'lr')}\n{HV}")
query("mkt_trading_days", lambda t: m.trading_days_auto(clean(t)), f"with {RET}\nselect ticker, cast(trading_days as double) as trading_days from td")
query(
    "mkt_trailing_vols",
    lambda t: r(m.trailing_vols(clean(t).withColumn("date", F.expr("date_add(date '2020-01-01', cast(datediff(date, date '2024-01-01') * 60 as int))")), least=10)),
    f"""with {CLEAN}, sp as (select ticker, date '2020-01-01' + cast(date_diff('day', date '2024-01-01', date) * 60 as int) as date, close from cl),
la as (select *, max(date) over (partition by ticker) as last from sp), pe(y) as (values (1), (2), (3), (5)),
tr as (select la.*, y as period_years from la join pe on date_diff('day', date, last) <= floor(y * 365.25)),
q as (select *, ln(close) - ln(lag(close) over (partition by ticker, period_years order by date)) as lr from tr),
g as (select ticker, period_years, count(lr) as n_obs, count(*) as n, stddev_samp(lr) * sqrt(252) as s from q group by 1, 2)
select ticker, period_years, n_obs, case when n >= 10 then round(s, 8) end as sigma, case when n >= 10 then round(s / sqrt(2 * n_obs), 8) end as sigma_se, case when n >= 10 and s is not null then round(greatest(0.0, s - 1.96 * s / sqrt(2 * n_obs)), 8) end as ci95_low, case when n >= 10 then round(s + 1.96 * s / sqrt(2 * n_obs), 8) end as ci95_high from g""",
)
FLAG = vol_sql("252") + """,
bk as (select *, cast(substr(ticker, 2) as int) % 10 as basket from hv),
qs as (select basket, count(sigma) as n, quantile_cont(sigma, 0.25) as q1, quantile_cont(sigma, 0.5) as m, quantile_cont(sigma, 0.75) as q3 from bk where sigma is not null group by 1),
md as (select basket, quantile_cont(abs(sigma - m), 0.5) as mad from bk join qs using (basket) where sigma is not null group by 1),
fl as (select bk.*, coalesce(n >= 5 and (sigma < q1 - 1.5 * (q3 - q1) or sigma > q3 + 1.5 * (q3 - q1) or (mad > 0 and abs(sigma - m) > 3 * mad)), false) as outlier from bk left join qs using (basket) left join md using (basket))"""


def flagged(t: Tables):
    vols = m.historical_vol(clean(t)).withColumn("basket", (F.expr("cast(substr(ticker, 2) as int)") % 10).cast("int"))
    return m.outlier_flags(vols, "basket", "iqr_or_mad")


query("mkt_outlier_flags", lambda t: flagged(t).select("ticker", "basket", F.round("sigma", 8).alias("sigma"), "outlier"), f"with {FLAG}\nselect ticker, basket, round(sigma, 8) as sigma, outlier from fl")
query(
    "mkt_aggregate_vol",
    lambda t: r(m.aggregate_vol(flagged(t).withColumn("cap", F.col("n_prices") * 100), "basket", "cap")),
    f"with {FLAG}\nselect basket, count(*) filter (where sigma is not null and not outlier) as n, count(*) filter (where outlier) as n_excluded, round(quantile_cont(sigma, 0.5) filter (where not outlier), 8) as median, round(avg(sigma) filter (where not outlier), 8) as mean, round(sum(sigma * n_prices * 100) filter (where not outlier and sigma is not null) / sum(n_prices * 100) filter (where not outlier and sigma is not null), 8) as cap_weighted, round(avg(sigma_se) filter (where not outlier), 8) as mean_se from fl group by 1",
)
ALIGNED = """al as (select p.ticker, p.date, p.close, k.close as market from {prices} p join {market} k using (date)),
lg as (select *, case when close > 0 then ln(close) end as lc, case when market > 0 then ln(market) end as lm from al),
ar as (select *, lc - lag(lc) over w as r, lm - lag(lm) over w as m from lg window w as (partition by ticker order by date))"""
WEEKLY = ALIGNED.replace("lg as (select *", "wk as (select ticker, max(date) as date, max_by(close, date) as close, max_by(market, date) as market from al group by ticker, date_trunc('week', date)), lg as (select *").replace("as lm from al)", "as lm from wk)")
BETA = "select ticker, round(regr_slope(r, m), 4) + 0.0 as raw_beta, round(0.67 * regr_slope(r, m) + 0.33, 4) + 0.0 as adjusted_beta, round(corr(r, m) * corr(r, m), 4) as r2, round(regr_intercept(r, m), 6) + 0.0 as alpha, count(*) - 1 as n_obs, cast(min(date) as varchar) as start, cast(max(date) as varchar) as \"end\" from ar group by 1 having count(*) >= {} and var_samp(m) > 0"
query("mkt_beta", lambda t: m.beta(t.prices, t.market, least=20), f"with {ALIGNED}\n{BETA.format(20)}")
query("mkt_beta_weekly", lambda t: m.beta(t.prices, t.market, True, least=4), f"with {WEEKLY}\n{BETA.format(4)}")
query("mkt_regression_line", lambda t: r(m.regression_line(m.aligned_returns(t.prices, t.market))), f"with {ALIGNED}\nselect ticker, round(min(m), 8) as x0, round(regr_intercept(r, m) + regr_slope(r, m) * min(m), 8) as y0, round(max(m), 8) as x1, round(regr_intercept(r, m) + regr_slope(r, m) * max(m), 8) as y1 from ar where r is not null group by 1")
query("mkt_even_downsample", lambda t: m.even_downsample(t.prices, "ticker", "date", 7).select("ticker", "date", "close"), """with n as (select ticker, date, close, row_number() over (partition by ticker order by date) - 1 as i, count(*) over (partition by ticker) as n from {prices}),
ks as (select unnest(range(0, 7)) as k) select ticker, cast(date as varchar) as date, close from n where n <= 7 or exists (select 1 from ks where floor(k * (n.n - 1) / 6) = n.i)""")  # fmt: skip
TARGETS = "tg as (select distinct ticker, date '2024-01-10' + cast(d as int) as target_date from {prices} cross join (values (0), (7), (19), (40)) as t(d))"


def targets(t: Tables):
    return t.spark.sql("select distinct ticker, date '2024-01-10' + cast(d as int) as target_date from {p} cross join (values (0), (7), (19), (40)) as t(d)", p=t.prices)


query("mkt_asof_price", lambda t: m.asof_price(targets(t), t.prices.where("volume % 2 = 0")), f"with {TARGETS}\nselect ticker, cast(target_date as varchar) as target_date, cast(date as varchar) as date, close from (select tg.*, p.date, p.close, row_number() over (partition by tg.ticker, target_date order by p.date desc) as n from tg join {{prices}} p on p.ticker = tg.ticker and p.volume % 2 = 0 and p.date between target_date - 14 and target_date) x where n = 1")
STARGETS = "st as (select distinct ticker, date '1999-01-15' + cast(d as int) as target_date from {statements} cross join (values (0), (180), (400)) as t(d))"


def stargets(t: Tables):
    return t.spark.sql("select distinct ticker, date '1999-01-15' + cast(d as int) as target_date from {s} cross join (values (0), (180), (400)) as t(d)", s=t.statements)


SHEET = STARGETS + ", bs as (select * from (select st.*, period_end, period_type, total_debt, coalesce(equity_a, equity_b) as equity, cash, row_number() over (partition by st.ticker, target_date order by case when period_type = 'quarter' then 0 else 1 end, period_end desc) as n from st join {statements} s on s.ticker = st.ticker and period_end <= target_date where total_debt is not null) x where n = 1)"
query("mkt_asof_balance_sheet", lambda t: m.asof_balance_sheet(stargets(t), t.statements), f"with {SHEET}\nselect ticker, cast(target_date as varchar) as target_date, cast(period_end as varchar) as period_end, period_type, total_debt, equity, cash from bs")


def snapshot(t: Tables):
    k = F.expr("cast(substr(ticker, 2) as int)")
    return stargets(t).withColumns({"snapshot_debt": k * 10.0, "snapshot_equity": k * 20.0, "market_cap": k * 30.0})


query("mkt_debt_equity", lambda t: m.debt_equity(m.asof_balance_sheet(stargets(t), t.statements.where("ticker not like '%7'")), snapshot(t)), f"""with {SHEET.replace("where total_debt is not null", "where total_debt is not null and s.ticker not like '%7'")},
sn as (select *, cast(substr(ticker, 2) as int) as k from st), j as (select sn.*, period_end, total_debt, coalesce(total_debt, k * 10.0::double) as debt, coalesce(equity, k * 20.0::double) as eq, k * 30.0::double as cap from sn left join bs using (ticker, target_date))
select ticker, cast(target_date as varchar) as target_date, case when total_debt is not null then 'statement' else 'snapshot' end as source, case when eq > 0 then round(debt / eq * 100, 2) end as de_book, case when cap > 0 then round(debt / cap * 100, 2) end as de_market, coalesce(abs(date_diff('day', period_end, target_date)) > 90, false) as stale from j""")  # fmt: skip
TTM = STARGETS + """,
ev as (select ticker, period_end, period_type, coalesce(ebitda, operating_income + coalesce(da, 0)) as v from {statements}),
q0 as (select st.*, v, period_end, row_number() over (partition by st.ticker, target_date order by period_end desc) as n from st join ev using (ticker) where period_type = 'quarter' and period_end <= target_date and date_diff('day', period_end, target_date) <= 400 and v is not null),
q1 as (select ticker, target_date, sum(v) as s, count(*) as n, max(period_end) as qe from q0 where n <= 4 group by 1, 2),
a1 as (select ticker, target_date, max_by(v, period_end) as a, max(period_end) as ae from st join ev using (ticker) where period_type = 'annual' and period_end <= target_date and v is not null group by 1, 2),
ttm as (select st.ticker, st.target_date, coalesce(s * 4.0 / n, a) as ebitda, coalesce(qe, ae) as period_end, case when n = 4 then 'quarterly_ttm' when n > 0 then 'quarterly_annualized' when a is not null then 'annual' end as basis from st left join q1 using (ticker, target_date) left join a1 using (ticker, target_date))"""
query("mkt_ttm_ebitda", lambda t: r(m.ttm_ebitda(stargets(t), t.statements), 6), f"with {TTM}\nselect ticker, cast(target_date as varchar) as target_date, round(ebitda, 6) as ebitda, cast(period_end as varchar) as period_end, basis from ttm")


def multiples(t: Tables):
    k = F.expr("cast(substr(ticker, 2) as int)")
    peers = m.ttm_ebitda(stargets(t), t.statements).join(m.asof_balance_sheet(stargets(t), t.statements), ["ticker", "target_date"], "left")
    return m.peer_multiples(peers.select("ticker", "target_date", (k % 5).alias("basket"), (k * 1000.0).alias("market_cap"), F.col("total_debt").alias("debt"), "cash", "ebitda"))


MULT = TTM + SHEET[len(STARGETS) :] + ", pm as (select t.ticker, t.target_date, cast(substr(t.ticker, 2) as int) % 5 as basket, cast(substr(t.ticker, 2) as int) * 1000.0::double as market_cap, total_debt as debt, cash, ebitda from ttm t left join bs using (ticker, target_date)), mu as (select *, market_cap + coalesce(debt, 0) - coalesce(cash, 0) as ev, case when ebitda > 0 then (market_cap + coalesce(debt, 0) - coalesce(cash, 0)) / ebitda end as ev_ebitda from pm)"
query("mkt_peer_multiples", lambda t: r(multiples(t), 6), f"with {MULT}\nselect ticker, cast(target_date as varchar) as target_date, basket, market_cap, debt, cash, round(ebitda, 6) as ebitda, round(ev, 6) as ev, round(ev_ebitda, 6) as ev_ebitda from mu")
query("mkt_multiple_summary", lambda t: r(m.multiple_summary(multiples(t), "basket"), 6), f"with {MULT}\nselect basket, round(quantile_cont(ev_ebitda, 0.5) filter (where ev_ebitda > 0 and ev_ebitda < 100), 6) as median, round(avg(ev_ebitda) filter (where ev_ebitda > 0 and ev_ebitda < 100), 6) as mean, count(*) filter (where ev_ebitda > 0 and ev_ebitda < 100) as n from mu group by 1")
HAM = ALIGNED + ", be as (select ticker, regr_slope(r, m) as beta, cast(substr(ticker, 2) as int) % 10 as basket, (cast(substr(ticker, 2) as int) % 7) / 10.0::double as de from ar group by 1), ha as (select basket, quantile_cont(beta / (1 + 0.78 * de), 0.5) as bu from be where beta is not null group by 1)"


def unlevered(t: Tables):
    k = F.expr("cast(substr(ticker, 2) as int)")
    betas = m.aligned_returns(t.prices, t.market).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta")).where("beta is not null")
    return m.hamada(betas.withColumns({"basket": (k % 10).cast("int"), "de": (k % 7) / 10.0}), "basket", 0.22, 0.4)


query("mkt_hamada", lambda t: r(unlevered(t)), f"with {HAM}\nselect basket, round(bu, 8) as beta_unlevered, round(bu * (1 + 0.78 * 0.4), 8) as beta_relevered from ha")
query("mkt_wacc", lambda t: r(m.wacc(unlevered(t), 0.03, 0.08, 0.05, 0.22, 0.4, 0.01)), f"with {HAM}, w as (select *, bu * (1 + 0.78 * 0.4) as br, 0.03 + bu * (1 + 0.78 * 0.4) * 0.08 + 0.01 as ke from ha) select basket, round(bu, 8) as beta_unlevered, round(br, 8) as beta_relevered, round(ke, 8) as ke, round(ke / 1.4 + (1 - 1 / 1.4::double) * 0.05 * 0.78, 8) as wacc from w")
query("mkt_latest_rate", lambda t: m.latest_rate(t.spark.sql("select ticker as item, date, case when volume % 3 = 0 then ' ' when volume % 3 = 1 then cast(close as string) else 'n/a' end as value from {p}", p=t.prices), "2024-01-25", 20),
      "select ticker as item, round(max_by(close, date) / 100, 6) as rate, cast(max(date) as varchar) as date from {prices} where volume % 3 = 1 and date between date '2024-01-05' and date '2024-01-25' group by 1")
