"""Queries of curves, cash flows, bond legs and covenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import curves as c
from auditlake.queries.common import Tables, query
from auditlake.queries.market import r


def lin(points: str, targets: str, out: str) -> str:
    """SQL of linear interpolation, flat outside."""
    return f"""(select g.*, case when lo.t is null then hi.y when hi.t is null or hi.t = lo.t then lo.y else lo.y + (hi.y - lo.y) * (g.t - lo.t) / (hi.t - lo.t) end as {out}
 from (select g.*, (select max(p.t) from {points} p where p.curve_id = g.curve_id and p.t <= g.t) as lt, (select min(p.t) from {points} p where p.curve_id = g.curve_id and p.t >= g.t) as ht from {targets} g) g
 left join {points} lo on lo.curve_id = g.curve_id and lo.t = g.lt left join {points} hi on hi.curve_id = g.curve_id and hi.t = g.ht)"""


XS = "xs as (select curve_id, cast(t as double) as t from (select distinct curve_id from {quotes}) q cross join (values (0.1), (0.25), (0.6), (1.0), (4.0), (8.5), (12.0)) as v(t))"


def xs(t: Tables):
    return t.spark.sql("select curve_id, cast(t as double) as t from (select distinct curve_id from {q}) q cross join (values (0.1), (0.25), (0.6), (1.0), (4.0), (8.5), (12.0)) as v(t)", q=t.quotes)


query("curve_interp_linear", lambda t: r(c.interp_linear(t.quotes, xs(t))), f"with {XS}, il as {lin('{quotes}', 'xs', 'y')}\nselect curve_id, t, round(y, 8) as y from il")
query("curve_interp_df", lambda t: r(c.interp_df(t.quotes.select("curve_id", "t", F.exp(-F.col("t") * F.col("y") / 100).alias("df")), xs(t))), f"with {XS}, zq as (select curve_id, t, -ln(exp(-t * y / 100)) / t as y from {{quotes}}), il as {lin('zq', 'xs', 'z')}\nselect curve_id, t, round(exp(-z * t), 8) as df from il")
# the twin's bootstrap is the step by step recursion
BOOT = """ends as (select curve_id, max(t) as input_max, least(max(t), 8.0) as last from {quotes} group by 1),
gr as (select curve_id, cast(k as int) as step, k / 2.0::double as t, input_max from ends, (select unnest(range(1, 21)) as k) where k / 2.0::double <= last + 1e-9),
yq as """ + lin("{quotes}", "gr", "ytm") + """,
rc as (select curve_id, step, t, ytm, 1 / (1 + ytm / 200) as df, 1 / (1 + ytm / 200) as s, 1.0::double as prev, input_max from yq where step = 1
 union all select y.curve_id, y.step, y.t, y.ytm, (1 - y.ytm / 200 * rc.s) / (1 + y.ytm / 200), rc.s + (1 - y.ytm / 200 * rc.s) / (1 + y.ytm / 200), rc.df, y.input_max from rc join yq y on y.curve_id = rc.curve_id and y.step = rc.step + 1)"""
query("curve_bootstrap", lambda t: r(c.bootstrap_par_curve(t.quotes, 2, 8.0)), f"with recursive {BOOT}\nselect curve_id, step, t, round(ytm / 2, 8) as ytm_per, round(df, 8) as df, round((pow(df, -1.0 / step) - 1) * 100, 8) as zper, round(ln(prev / df) * 200, 8) as forward, case when ln(prev / df) < 0 then 'negative forward' when ln(prev / df) * 2 > 0.5 then 'forward above 50 %' when input_max > 8 then 'longer input left out' end as warning from rc")
query("curve_bootstrap_output", lambda t: r(c.bootstrap_output(c.bootstrap_par_curve(t.quotes, 2, 8.0))), f"with recursive {BOOT}, zb as (select curve_id, t, -ln(df) / t as y from rc), og as (select curve_id, k / 4.0::double as t from ends, (select unnest(range(1, 33)) as k)), il as {lin('zb', 'og', 'z')}\nselect curve_id, t, round(exp(-z * t), 8) as df, round((pow(exp(-z * t), -1.0 / (2 * t)) - 1) * 100, 8) as zper, round(2 * ln(pow(exp(-z * t), -1.0 / (2 * t))) * 100, 8) as zcont from il")
query("curve_horizon_check", lambda t: c.curve_horizon_check(t.deals.withColumn("years", F.col("years") * 3), t.quotes), "select deal_id, curve_id, years * 3 as years, m as curve_max, coalesce(years * 3 <= m + 0.001, false) as ok from {deals} left join (select curve_id, max(t) as m from {quotes} group by 1) using (curve_id)")
FWD = """fg as (select curve_id, cast(k as int) as step, k / 12.0::double as t from (select distinct curve_id from {quotes}), (select unnest(range(1, 61)) as k)),
fz as """ + lin("zp", "fg", "z") + """,
fw as (select curve_id, step, t, z, case when step = 1 then z else (z * t - lag(z * t) over (partition by curve_id order by step)) * 12 end as forward from fz)"""
ZP = "zp as (select curve_id, t, y / 100 as y from {quotes})"


def forwards(t: Tables):
    return c.step_forwards(t.quotes.withColumn("y", F.col("y") / 100), t.quotes.select("curve_id", F.lit(5.0).alias("years")).distinct(), 12)


query("curve_step_forwards", lambda t: r(forwards(t)), f"with {ZP}, {FWD}\nselect curve_id, step, round(t, 8) as t, round(z, 8) as z, round(forward, 8) as forward from fw")
FC = "fc as (select *, ebit * (1 - tax) + da - capex - dnwc as fcff from {company_years})"
query("dcf_fcff", lambda t: r(c.fcff(t.company_years), 6), f"with {FC}\nselect company_id, yr, round(revenue, 6) as revenue, round(ebit, 6) as ebit, round(da, 6) as da, round(capex, 6) as capex, round(dnwc, 6) as dnwc, tax, round(fcff, 6) as fcff from fc")


def dcf_sql(tv: str, half: str = "0", w: str = "cast(wacc as double)", g: str = "cast(growth as double)", extra: str = "") -> str:
    return FC + f""",
cw as (select company_id, {w} as w, {g} as g, cast(multiple as double) as multiple, net_debt, shares{extra} from {{companies}}),
sm as (select company_id, w, g, sum(fcff * pow(1 / (1 + w), yr - {half})) as pv, max_by(fcff, yr) as last, max_by(ebit + da, yr) as ebitda, max(yr) as n from fc join cw using (company_id) group by 1, 2, 3),
dv as (select cw.*, pv, case when n is null then 'no cash flows' when w <= g then 'wacc not above growth' end as error, ({tv}) * pow(1 / (1 + w), n - {half}) as pt from cw left join sm using (company_id, w, g)),
dc as (select *, pv + pt as ev, pv + pt - net_debt as eq from dv)"""


GORDON, MULTIPLE = "last * (1 + g) / nullif(w - g, 0)", "ebitda * multiple"
OUT = "select company_id, " + ", ".join(f"case when error is null then round({x}, 6) end as {n}" for x, n in (("pv", "pv_explicit"), ("pt", "pv_terminal"), ("ev", "enterprise_value"), ("eq", "equity_value"))) + ", case when error is null then round(case when eq < 0 then 0 when shares > 0 then eq / shares else 0 end, 6) end as price, error, case when error is null and eq < 0 then 'negative equity' end as warning from dc"
query("dcf_value_gordon", lambda t: r(c.dcf_value(t.companies, t.company_years), 6), f"with {dcf_sql(GORDON)}\n{OUT}")
query("dcf_value_weighted_mid_year", lambda t: r(c.dcf_value(t.companies, t.company_years, "weighted", 0.4, True), 6), f"with {dcf_sql(f'{GORDON} * 0.4::double + {MULTIPLE} * 0.6::double', '0.5::double')}\n{OUT}")
query("dcf_steady_state", lambda t: r(c.steady_state_ratios(t.company_years)), """with l as (select *, row_number() over (partition by company_id order by yr desc) as n, lag(revenue) over (partition by company_id order by yr) as p from {company_years})
select company_id, round(max(capex / da) filter (where n = 1 and da > 0), 8) as capex_da, round(max(ebit / revenue) filter (where revenue > 0) - min(ebit / revenue) filter (where revenue > 0), 8) as margin_range, round(max(revenue / p - 1) filter (where n = 1 and p > 0), 8) as last_growth from l where n <= 3 group by 1""")  # fmt: skip


def shares(t: Tables):
    return t.shares.withColumnRenamed("interval_years", "interval")


# the twin walks the accrual dates one by one
DIV = """ks as (select s.*, cast(k as int) as k, cast(round_even(total / interval_years, 0) as int) as n, k * interval_years as pt from {shares} s, (select unnest(range(1, 61)) as k) where coupon > 0 and k <= round_even(total / interval_years, 0)),
pd as (select *, case when pt >= first_pay - 1e-9 then 1 when k = n and cumulative then 1 else 0 end as pays from ks),
am as (select *, case when pays = 0 then 0 when not cumulative then 1 else k - coalesce(max(case when pays = 1 then k end) over (partition by deal_id order by k rows between unbounded preceding and 1 preceding), 0) end * face * coupon * interval_years as amount from pd),
po as (select *, pt - elapsed as after from am where amount > 0),
ms as (select *, case when after <= 1e-9 then null else least(greatest(cast(round_even(after / dt, 0) as int), 1), steps) end as st from po),
f1 as (select deal_id, min_by(st, k) filter (where st is not null) as first_step from ms group by 1),
dv2 as (select deal_id, coalesce(st, first_step, steps) as step, sum(amount) as amount from ms join f1 using (deal_id) where st is not null or cumulative group by 1, 2)"""
query("bond_dividend_schedule", lambda t: r(c.dividend_schedule(shares(t)), 6), f"with {DIV}\nselect deal_id, step, round(amount, 6) as amount from dv2")
MODES = {"sp": "greatest(face, face * (1 + put_irr * x))", "contract": "face * 1.1::double"}
for mode, k in (("cp_y", 1), ("cp_h", 2), ("cp_q", 4)):
    MODES[mode] = f"greatest(face, face * pow(1 + put_irr / {k}, {k} * x))"
for mode, k in (("irr_y", 1), ("irr_q", 4)):
    MODES[mode] = f"greatest(face, face * pow(1 + put_irr / {k}, {k} * x) - coalesce(list_sum([face * coupon * interval_years * pow(1 + put_irr / {k}, {k} * (x - j * interval_years)) for j in range(1, cast(floor((x + 1e-9) / interval_years) as int) + 1)]), 0))"
query(
    "bond_exercise_price",
    lambda t: r(shares(t).withColumn("x", F.col("total") / 2).select("deal_id", *(c.exercise_price(F.col("face"), F.col("x"), F.col("put_irr"), k, F.col("coupon"), F.col("interval"), contract=F.lit(1.1)).alias(k) for k in MODES)), 6),
    "with e as (select *, total / 2 as x from {shares})\nselect deal_id, " + ", ".join(f"round({v}, 6) as {k}" for k, v in MODES.items()) + " from e",
)
query(
    "bond_date_to_step",
    lambda t: t.deals.withColumn("day", F.expr("case when deal_id % 7 = 0 then null else issue_date + cast(deal_id % 900 as int) end")).withColumn("maturity", F.expr("issue_date + cast(years * 365 as int)")).select("deal_id", c.date_to_step(F.col("day"), F.expr("issue_date + 30"), F.col("maturity"), F.col("years"), F.col("years") * 12).alias("step")),
    """with d as (select *, case when deal_id % 7 = 0 then null else issue_date + cast(deal_id % 900 as int) end as day, issue_date + cast(years * 365 as int) as maturity, issue_date + 30 as v from {deals})
select deal_id, case when day is null then years * 12 when day > maturity then years * 12 + 1 when day <= v then 0 else least(cast(round_even(date_diff('day', v, day) / (365.0::double * years) * (years * 12), 0) as int), years * 12) end as step from d""",
)
LEGS = ZP + ", " + FWD + ", " + DIV + """,
bs as (select s.*, f.step, f.forward, coalesce(d.amount, 0) as amt from {shares} s join fw f on f.curve_id = s.curve_id and f.step <= s.steps left join dv2 d on d.deal_id = s.deal_id and d.step = f.step)"""


def legs_sql(spread: str = "0.0", irr: str = "put_irr", keys: str = "deal_id", source: str = "bs") -> str:
    x = "step * dt"
    put = f"greatest(face, face * pow(1 + {irr}, {x}) - case when coupon > 0 and {irr} > 0 then coalesce(list_sum([face * coupon * interval_years * pow(1 + {irr}, {x} - j * interval_years) for j in range(1, cast(floor(({x} + 1e-9) / interval_years) as int) + 1)]), 0) else 0 end)"
    return f"""
b1 as (select *, exp(-sum((forward + {spread}) * dt) over (partition by {keys} order by step rows between unbounded preceding and current row)) as df, {put} as put from {source}),
b2 as (select *, amt * df as cpv from b1),
b3 as (select *, coalesce(sum(cpv) over (partition by {keys} order by step rows between unbounded preceding and 1 preceding), 0) + put * df as ex from b2),
b4 as (select {keys}, sum(cpv) + max(greatest(face, put) * df) filter (where step = steps) as bond_floor, max(ex) filter (where step >= put_step and step < steps) as x from b3 group by all)"""


def bonds(t: Tables):
    s = shares(t)
    return c.bond_steps(s, forwards(t), c.dividend_schedule(s))


query("bond_legs", lambda t: r(c.bond_legs(bonds(t)), 4), f"with {LEGS},{legs_sql()}\nselect deal_id, round(bond_floor, 4) as bond_floor, round(greatest(bond_floor, coalesce(x, bond_floor)), 4) as puttable_bond, round(greatest(bond_floor, coalesce(x, bond_floor)) - bond_floor, 4) as put_option from b4")
GRID = LEGS + ", bu as (select a.s as spread_bump, b.i as irr_bump from (values (-0.05::double), (-0.02), (0.0), (0.02), (0.05)) as a(s), (values (-0.02::double), (0.0), (0.02)) as b(i)), bz as (select bs.* exclude (put_irr), spread_bump, irr_bump, greatest(put_irr + irr_bump, 0.0) as put_irr from bs, bu)"
query("bond_scenario_grid", lambda t: r(c.scenario_grid(shares(t), forwards(t), c.dividend_schedule(shares(t))), 4).withColumn("change_pct", F.col("change_pct") + 0.0), f"with {GRID},{legs_sql('spread_bump', 'put_irr', 'deal_id, spread_bump, irr_bump', 'bz')}, b5 as (select *, greatest(bond_floor, coalesce(x, bond_floor)) as pb from b4), b6 as (select *, max(pb) filter (where spread_bump = 0 and irr_bump = 0) over (partition by deal_id) as b0 from b5)\nselect deal_id, spread_bump, irr_bump, round(pb, 4) as puttable_bond, round((pb / b0 - 1) * 100, 4) + 0.0 as change_pct from b6")
DB = "db as (select c.*, a as wacc_bump, b as growth_bump from {companies} c, (values (-0.01::double), (0.0), (0.01)) as x(a), (values (-0.005::double), (0.0), (0.005)) as y(b))"
DCFG = dcf_sql(GORDON, "0", "cast(wacc as double) + wacc_bump", "cast(growth as double) + growth_bump", ", wacc_bump, growth_bump").replace("from {companies}", "from db")
query("dcf_scenarios", lambda t: r(c.dcf_scenarios(t.companies, t.company_years), 4), f"with {DB}, {DCFG}\nselect company_id, wacc_bump, growth_bump, case when error is null then round(eq, 4) end as equity_value, error from dc")
query("covenant_monitor", lambda t: r(c.covenant_monitor(t.holdings), 6), """with a as (select *, row_number() over w as i, avg(price) over (partition by deal_id order by date rows between 2 preceding and current row) as reference from {holdings} window w as (partition by deal_id order by date)),
b as (select *, case when i % 5 = 0 and reference < conversion_price * 0.9::double then greatest(conversion_price * 0.7::double, price) end as reset from a),
d as (select *, least(conversion_price, coalesce(min(reset) over p, conversion_price)) as effective_price, sum(case when price >= 1.2::double * conversion_price then 1 else 0 end) over (partition by deal_id order by date rows between 9 preceding and current row) >= 6 as call_active, min(price) over p <= 0.8::double * first_value(price) over p as knocked_in from b window p as (partition by deal_id order by date rows between unbounded preceding and current row))
select deal_id, cast(date as varchar) as date, price, round(reference, 6) as reference, reset, effective_price, call_active, knocked_in, round(face / effective_price * price, 6) as conversion_value from d""")  # fmt: skip


def checked_deals(t: Tables):
    return t.deals.selectExpr(
        "deal_id", "case when deal_id % 50 = 0 then -face else face end as face", "case when deal_id % 40 = 0 then 7.0 else cast(volatility as double) end as volatility", "case when deal_id % 30 = 0 then -1.0 else conversion_price end as conversion_price", "spot", "issue_date",
        "issue_date + cast(years * 365 - case when deal_id % 25 = 0 then 3000 else 0 end as int) as maturity_date", "issue_date + cast(deal_id % 100 - 5 as int) as valuation_date", "issue_date + 30 as conversion_start", "issue_date + cast(put_from * 400 as int) as put_start", "deal_id % 9 = 0 as refixing", "case when deal_id % 2 = 0 then 0.9 end as refixing_trigger",
    )


query("bond_validate_deals", lambda t: c.validate_deals(checked_deals(t)), """with d as (select deal_id, case when deal_id % 50 = 0 then -face else face end as face, case when deal_id % 40 = 0 then 7.0 else volatility end as volatility, case when deal_id % 30 = 0 then -1.0 else conversion_price end as cp, spot, issue_date,
 issue_date + cast(years * 365 - case when deal_id % 25 = 0 then 3000 else 0 end as int) as mat, issue_date + cast(deal_id % 100 - 5 as int) as val, issue_date + 30 as cs, issue_date + cast(put_from * 400 as int) as ps, deal_id % 9 = 0 as refixing, deal_id % 2 = 0 as has from {deals})
select deal_id, unnest([v for v in [case when face <= 0 then 'face not positive' end, case when volatility < 0 then 'volatility negative' end, case when volatility > 5 then 'volatility above 5' end, case when cp < 0 then 'conversion price negative' end, case when spot < 0 then 'spot negative' end,
 case when issue_date >= mat then 'issue not before maturity' end, case when val >= mat then 'valuation not before maturity' end, case when val < issue_date then 'valuation before issue' end, case when cs > mat then 'conversion after maturity' end, case when ps > mat then 'put after maturity' end, case when refixing and not has then 'refixing without trigger' end] if v is not null]) as violation from d""")  # fmt: skip
