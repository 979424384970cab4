"""Yield curves, discounted cash flows, bond legs and covenants of many instruments.

points: curve_id, t (years), y. Everything runs in windows by curve or instrument; the recursions are closed forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.operators.ranges import PART, carried, cuts, with_halo, with_part

EPS = 1e-9


def interp_linear(points: DataFrame, targets: DataFrame, out: str = "y", rows: int | None = None) -> DataFrame:
    """targets (curve_id, t, ...) with the curve's value: linear between points, flat outside; of points of one t that of the
    largest y counts.

    Points and targets are sorted together by curve and t, and each target takes the last point in either direction, a scan
    forward and one backward, so the cost is a sort and grows with the rows alone. A curve of more than `rows` rows
    (ranges.ROWS) is cut into ranges of t, targets of a single t too; a range's outer neighbours come from a table with a
    row a range.
    """
    rest = [c for c in targets.columns if c not in ("curve_id", "t")]
    key, point = ["curve_id"], F.struct(F.col("t").alias("pt"), F.col("y").alias("py"))
    row = F.struct(F.lit(1).alias("_one"), *rest)  # null of points
    of_targets = targets.select("curve_id", "t", row.alias("_row"), F.xxhash64(*targets.columns).alias("_h"))
    of_points = points.select("curve_id", "t", point.alias("_p"))
    both = of_points.unionByName(of_targets, allowMissingColumns=True)
    at = cuts(both.select("curve_id", "t"), key, F.col("t"), rows)
    both = carried(with_part(both, key, F.col("t"), at, F.coalesce("_h", F.lit(0))), key, at, {"_before": (F.max("_p"), "last", "before"), "_after": (F.max_by("_p", F.struct(-F.col("_p.pt"), F.col("_p.py"))), "last", "after")})
    by, is_row = W.partitionBy("curve_id", PART), F.col("_row").isNotNull()
    scan = lambda w: F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    low, high = scan(by.orderBy("t", is_row, "_p")), scan(by.orderBy(F.desc("t"), is_row, "_p"))
    seen = both.withColumn("_lo", F.coalesce(low, "_before")).withColumn("_hi", F.coalesce(high, "_after")).where("_row is not null")
    t, a, b = F.col("t"), F.col("_lo"), F.col("_hi")
    value = F.when(a.isNull(), b["py"]).when(b.isNull() | (b["pt"] == a["pt"]), a["py"]).otherwise(a["py"] + (b["py"] - a["py"]) * (t - a["pt"]) / (b["pt"] - a["pt"]))
    return seen.withColumn(out, value).select("curve_id", "t", *(F.col(f"_row.`{c}`").alias(c) for c in rest), out)


def interp_df(factors: DataFrame, targets: DataFrame, out: str = "df") -> DataFrame:
    """Discount factors between those of `factors` (curve_id, t, df): linear in the zero rate -ln(df) / t, flat outside."""
    zero = factors.select("curve_id", "t", (-F.log("df") / F.col("t")).alias("y"))
    return interp_linear(zero, targets, "_z").withColumn(out, F.exp(-F.col("_z") * F.col("t"))).drop("_z")


def grid(curves: DataFrame, step: float) -> DataFrame:
    """curves (curve_id, last) by steps of `step` up to last: t and its number."""
    return curves.withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(F.floor((F.col("last") + EPS) / step), F.lit(1)).cast("int")))).withColumn("t", F.round(F.col("step") * step, 3)).where(F.col("t") <= F.col("last") + EPS)


def bootstrap_par_curve(quotes: DataFrame, m: int = 2, most: float = 20.0) -> DataFrame:
    """Par yields (percent) to discount factors on the grid 1/m to min(longest, most).

    With c the period yield and A the running product of 1 + c, the sum S of factors up to k is the sum of A before k over
    A at k, and df the growth of S: two window sums a curve. zper, forward and a warning (inverted, over 50 %, or a longer
    input that is left out) come with it; factors outside (0, 2) are reported with a warning.
    """
    valid = quotes.where("t > 0 and y > 0").select("curve_id", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    ends = valid.groupBy("curve_id").agg(F.max("t").alias("input_max")).withColumn("last", F.least("input_max", F.lit(most)))
    steps = interp_linear(valid, grid(ends, 1 / m), "ytm")
    w = W.partitionBy("curve_id").orderBy("step")
    log_a = F.sum(F.log1p(F.col("ytm") / 100 / m)).over(w.rowsBetween(W.unboundedPreceding, 0))
    s = steps.withColumn("_a", F.exp(log_a)).withColumn("_pre", F.coalesce(F.sum("_a").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + 1)
    s = s.withColumn("_s", F.col("_pre") / F.col("_a")).withColumn("df", F.col("_s") - F.coalesce(F.lag("_s").over(w), F.lit(0.0)))
    s = s.withColumn("forward", F.log(F.coalesce(F.lag("df").over(w), F.lit(1.0)) / F.col("df")) * m)
    warning = F.when(~F.col("df").between(0, 2), "factor out of range").when(F.col("forward") < 0, "negative forward").when(F.col("forward") > 0.5, "forward above 50 %").when(F.col("input_max") > most, "longer input left out")
    return s.select("curve_id", "step", "t", (F.col("ytm") / m).alias("ytm_per"), "df", ((F.pow("df", -1.0 / F.col("step")) - 1) * 100).alias("zper"), (F.col("forward") * 100).alias("forward"), warning.alias("warning"))


def bootstrap_output(boot: DataFrame, m: int = 2, step: float = 0.25) -> DataFrame:
    """The bootstrapped curve every quarter: df, periodic and continuous zero rates in percent."""
    ends = boot.groupBy("curve_id").agg(F.max("t").alias("last"))
    out = interp_df(boot, grid(ends, step).select("curve_id", "t"))
    zper = F.pow("df", -1.0 / (F.col("t") * m)) - 1
    return out.select("curve_id", "t", "df", (zper * 100).alias("zper"), (m * F.log(1 + zper) * 100).alias("zcont"))


def curve_horizon_check(deals: DataFrame, points: DataFrame) -> DataFrame:
    """deals (deal_id, curve_id, years) with the curve's longest t and whether it covers them (to 0.001)."""
    ends = points.groupBy("curve_id").agg(F.max("t").alias("curve_max"))
    return deals.select("deal_id", "curve_id", "years").join(ends, "curve_id", "left").withColumn("ok", F.coalesce(F.col("years") <= F.col("curve_max") + 0.001, F.lit(False)))


def step_forwards(points: DataFrame, horizons: DataFrame, per_year: int) -> DataFrame:
    """Forward rate of each step of 1 / per_year up to each curve's horizon (curve_id, years): (z2 t2 - z1 t1) / (t2 - t1),
    the first step's is z; z in the points' unit."""
    steps = interp_linear(points, grid(horizons.select("curve_id", F.col("years").cast("double").alias("last")), 1 / per_year).withColumn("t", F.col("step") / per_year), "z")
    w = W.partitionBy("curve_id").orderBy("step")
    zt = F.col("z") * F.col("t")
    return steps.withColumn("forward", F.when(F.col("step") == 1, F.col("z")).otherwise((zt - F.lag(zt).over(w)) * per_year)).select("curve_id", "step", "t", "z", "forward")


def fcff(years: DataFrame) -> DataFrame:
    """years with the free cash flow: EBIT after tax plus D&A less capex and working capital growth."""
    return years.withColumn("fcff", F.col("ebit") * (1 - F.col("tax")) + F.col("da") - F.col("capex") - F.col("dnwc"))


def discounted(companies: DataFrame, years: DataFrame, bumps: dict[str, float], mid_year: bool = False) -> DataFrame:
    """Per company with years its cash flows' present value at each bump of its cost of capital, the last flow and EBITDA,
    and the last year n."""
    flows = fcff(years).join(companies.select("company_id", F.col("wacc").cast("double").alias("w")).hint("merge"), "company_id")
    t = F.col("yr") - (0.5 if mid_year else 0.0)
    values = [F.sum(F.col("fcff") * F.pow(1 / (1 + (F.col("w") + a)), t)).alias(name) for name, a in bumps.items()]
    return flows.groupBy("company_id").agg(*values, F.max_by("fcff", "yr").alias("last"), F.max_by(F.col("ebit") + F.col("da"), "yr").alias("ebitda"), F.max("yr").alias("n"))


def dcf_value(companies: DataFrame, years: DataFrame, method: str = "gordon", weight_gordon: float = 0.5, mid_year: bool = False) -> DataFrame:
    """Per company explicit and terminal present value, enterprise and equity value, price, and error or warning.

    The terminal value is Gordon growth, an EBITDA multiple, or both weighed; it is discounted like the last year. A
    growth of at least the cost of capital, or no years, is an error; a negative equity prices at 0 with a warning.
    """
    sums = discounted(companies, years, {"pv_explicit": 0.0}, mid_year)
    j = companies.withColumns({c: F.col(c).cast("double") for c in ("wacc", "growth", "multiple")}).join(sums.hint("merge"), "company_id", "left")
    g, w = F.col("growth"), F.col("wacc")
    gordon, multiple = F.col("last") * (1 + g) / F.nullif(w - g, F.lit(0.0)), F.col("ebitda") * F.col("multiple")
    tv = {"gordon": gordon, "multiple": multiple, "weighted": gordon * weight_gordon + multiple * (1 - weight_gordon)}[method]
    bad = F.when(F.col("n").isNull(), "no cash flows").when(w <= g, "wacc not above growth")
    out = j.withColumn("error", bad).withColumn("pv_terminal", tv * F.pow(1 / (1 + w), F.col("n") - (0.5 if mid_year else 0.0)))
    equity = F.col("enterprise_value") - F.col("net_debt")
    out = out.withColumn("enterprise_value", F.col("pv_explicit") + F.col("pv_terminal")).withColumn("equity_value", equity)
    ok = F.col("error").isNull()
    price = F.when(F.col("equity_value") < 0, 0.0).when(F.col("shares") > 0, F.col("equity_value") / F.col("shares")).otherwise(0.0)
    return out.select("company_id", *(F.when(ok, F.col(c)).alias(c) for c in ("pv_explicit", "pv_terminal", "enterprise_value", "equity_value")), F.when(ok, price).alias("price"), "error", F.when(ok & (F.col("equity_value") < 0), "negative equity").alias("warning"))


def steady_state_ratios(years: DataFrame) -> DataFrame:
    """Per company the last capex / D&A, the range of EBIT margins of the last 3 years, the last revenue growth."""
    w = W.partitionBy("company_id").orderBy(F.desc("yr"))
    r = years.withColumn("_r", F.row_number().over(w)).withColumn("margin", F.when(F.col("revenue") > 0, F.col("ebit") / F.col("revenue"))).withColumn("_p", F.lead("revenue").over(w))
    last = F.col("_r") == 1
    return r.where("_r <= 3").groupBy("company_id").agg(F.max(F.when(last & (F.col("da") > 0), F.col("capex") / F.col("da"))).alias("capex_da"), (F.max("margin") - F.min("margin")).alias("margin_range"), F.max(F.when(last & (F.col("_p") > 0), F.col("revenue") / F.col("_p") - 1)).alias("last_growth"))


def dividend_schedule(deals: DataFrame) -> DataFrame:
    """(deal_id, step, amount): what a preferred share pays at each tree step after valuation.

    deals: deal_id, face, coupon, interval (years), total (years from issue to maturity), elapsed (to valuation), first_pay
    (years), cumulative, steps, dt. Dividends accrue every interval. Those of cumulative shares are paid together from the
    first pay date on, arrears of before valuation with the first payment after it (or at maturity); others lapse. Step is
    the half-even rounded time over dt, from 1 to steps.
    """
    n, k = F.bround(F.col("total") / F.col("interval")).cast("int"), F.col("k")
    first = F.greatest(F.ceil(F.col("first_pay") / F.col("interval") - EPS), F.lit(1)).cast("int")
    rows = deals.where("coupon > 0 and interval > 0").withColumn("n", n).where("n > 0").withColumn("k0", first).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    due = F.when(k < F.col("k0"), F.when(F.col("cumulative") & (F.col("k0") > F.col("n")) & (k == F.col("n")), F.col("n")).otherwise(0)).when((k == F.col("k0")) & F.col("cumulative"), F.col("k0")).otherwise(1)
    paid = rows.withColumn("amount", due * F.col("face") * F.col("coupon") * F.col("interval")).where("amount > 0").withColumn("after", k * F.col("interval") - F.col("elapsed"))
    before = F.col("after") <= EPS
    step = F.least(F.greatest(F.bround(F.col("after") / F.col("dt")).cast("int"), F.lit(1)), F.col("steps").cast("int"))
    w = W.partitionBy("deal_id")
    first_after = F.min(F.when(~before, k)).over(w)
    placed = paid.withColumn("_first", first_after).withColumn("step", F.when(~before, step).when(F.col("_first").isNull(), F.col("steps").cast("int")))
    first_step = F.min(F.when(k == F.col("_first"), step)).over(w)
    placed = placed.withColumn("step", F.coalesce("step", first_step)).where(~before | F.col("cumulative"))
    return placed.groupBy("deal_id", "step").agg(F.sum("amount").alias("amount"))


def exercise_price(face: Column, t: Column, rate: Column, mode: str, coupon: Column | None = None, interval: Column | None = None, fixed: Column | None = None, contract: Column | None = None) -> Column:
    """What a put or call pays t years after issue: fixed, contract (face x ratio), sp (simple), cp_y / cp_h / cp_q
    (compound), irr_y / irr_h / irr_q (compound less the coupons accrued so far, compounded alike). At least face but for
    fixed and contract, which fall back to it."""
    if mode == "fixed":
        return F.when(fixed > 0, fixed).otherwise(face)
    if mode == "contract":
        return F.when(contract > 0, face * contract).otherwise(face)
    if mode == "sp":
        return F.greatest(face, face * (1 + rate * t))
    m = {"y": 1, "h": 2, "q": 4}[mode[-1]]
    base = face * F.pow(1 + rate / m, m * t)
    if mode.startswith("cp"):
        return F.greatest(face, base)
    paid = F.aggregate(F.sequence(F.lit(0), F.floor((t + EPS) / interval).cast("int")), F.lit(0.0), lambda s, j: s + F.when(j > 0, face * coupon * interval * F.pow(1 + rate / m, m * (t - j * interval))).otherwise(0.0))
    return F.greatest(face, base - F.when((coupon > 0) & (rate > 0), paid).otherwise(0.0))


def date_to_step(day: Column, valuation: Column, maturity: Column, years: Column, steps: Column) -> Column:
    """A date's tree step: none: steps; after maturity: steps + 1; up to valuation: 0; else rounded half to even."""
    days = F.datediff(day, valuation)
    return F.when(day.isNull(), steps).when(day > maturity, steps + 1).when(days <= 0, F.lit(0)).otherwise(F.least(F.bround(days / (365.0 * years) * steps).cast("int"), steps))


def bond_steps(deals: DataFrame, forwards: DataFrame, coupons: DataFrame, spread: float = 0.0) -> DataFrame:
    """A row for each deal and step: discount factor from the curve's forwards plus spread, and coupon. deals: deal_id,
    curve_id, steps, dt; forwards: curve_id, step, forward (decimal); coupons: deal_id, step, amount."""
    rows = deals.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps").cast("int")))).join(forwards.select("curve_id", "step", "forward"), ["curve_id", "step"]).join(coupons, ["deal_id", "step"], "left")
    w = W.partitionBy("deal_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("df", F.exp(-F.sum((F.col("forward") + spread) * F.col("dt")).over(w))).withColumn("coupon_pv", F.coalesce("amount", F.lit(0.0)) * F.col("df"))


def bond_legs(steps: DataFrame, mode: str = "irr_y") -> DataFrame:
    """Per deal the bond floor, puttable bond and put option.

    The floor is max(face, put price at maturity) discounted plus all coupons. Nothing depends on a state, so the put's
    backward recursion is the largest, over exercise steps, of the coupons before plus the discounted put price, the floor
    included; the option is the difference. steps: bond_steps with face, put_irr, coupon, interval, put_step.
    """
    t = F.col("step") * F.col("dt")
    put = exercise_price(F.col("face"), t, F.col("put_irr").cast("double"), mode, F.col("coupon").cast("double"), F.col("interval"))
    before = F.coalesce(F.sum("coupon_pv").over(W.partitionBy("deal_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    last = F.col("step") == F.col("steps")
    rows = steps.withColumn("put", put).withColumn("exercised", F.when((F.col("step") >= F.col("put_step")) & ~last, before + F.col("put") * F.col("df")))
    out = rows.groupBy("deal_id").agg((F.sum("coupon_pv") + F.max(F.when(last, F.greatest("face", "put") * F.col("df")))).alias("bond_floor"), F.max("exercised").alias("_x"))
    return out.withColumn("puttable_bond", F.greatest("bond_floor", "_x")).select("deal_id", "bond_floor", "puttable_bond", (F.col("puttable_bond") - F.col("bond_floor")).alias("put_option"))


def scenario_grid(deals: DataFrame, forwards: DataFrame, coupons: DataFrame, spreads: tuple[float, ...] = (-0.05, -0.02, 0.0, 0.02, 0.05), irrs: tuple[float, ...] = (-0.02, 0.0, 0.02), mode: str = "irr_y") -> DataFrame:
    """Puttable bond under bumps of spread and put yield (not below 0), and its change against no bump in percent.

    A spread only multiplies a step's discount factor by exp(-spread x time), and a put price doesn't depend on it: a deal
    and step is one row, with a column for each spread's prefix sum of coupons and each yield's put price, so one shuffle
    and one window by deal serve all bumps. Bumps become rows in the end, a row each a deal.
    """
    rows = bond_steps(deals, forwards, coupons)
    t = F.col("step") * F.col("dt")
    last = F.col("step") == F.col("steps")
    may = (F.col("step") >= F.col("put_step")) & ~last
    before = W.partitionBy("deal_id").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    put = lambda r: exercise_price(F.col("face"), t, F.greatest(F.col("put_irr").cast("double") + r, F.lit(0.0)), mode, F.col("coupon").cast("double"), F.col("interval"))
    bumped = rows.withColumns({f"_df{i}": F.col("df") * F.exp(-t * s) for i, s in enumerate(spreads)} | {f"_put{k}": put(r) for k, r in enumerate(irrs)})
    bumped = bumped.withColumns({f"_pv{i}": F.coalesce("amount", F.lit(0.0)) * F.col(f"_df{i}") for i in range(len(spreads))})
    bumped = bumped.withColumns({f"_sum{i}": F.coalesce(F.sum(f"_pv{i}").over(before), F.lit(0.0)) for i in range(len(spreads))})
    cells = [(i, k) for i in range(len(spreads)) for k in range(len(irrs))]
    floor = lambda i, k: F.sum(f"_pv{i}") + F.max(F.when(last, F.greatest("face", f"_put{k}") * F.col(f"_df{i}")))
    best = lambda i, k: F.max(F.when(may, F.col(f"_sum{i}") + F.col(f"_put{k}") * F.col(f"_df{i}")))
    wide = bumped.groupBy("deal_id").agg(*(F.greatest(floor(i, k), best(i, k)).alias(f"_b{i}_{k}") for i, k in cells))
    base = next((F.col(f"_b{i}_{k}") for i, k in cells if spreads[i] == 0 and irrs[k] == 0), F.lit(None).cast("double"))
    each = F.array(*(F.struct(F.lit(float(spreads[i])).alias("spread_bump"), F.lit(float(irrs[k])).alias("irr_bump"), F.col(f"_b{i}_{k}").alias("puttable_bond")) for i, k in cells))
    out = wide.select("deal_id", base.alias("_base"), F.inline(each))
    return out.select("deal_id", "spread_bump", "irr_bump", "puttable_bond", ((F.col("puttable_bond") / F.col("_base") - 1) * 100).alias("change_pct"))


def dcf_scenarios(companies: DataFrame, years: DataFrame, waccs: tuple[float, ...] = (-0.01, 0.0, 0.01), growths: tuple[float, ...] = (-0.005, 0.0, 0.005)) -> DataFrame:
    """dcf_value's equity under bumps of cost of capital and growth.

    Growth bears on the terminal value alone, so a company is one row with a present value for each cost of capital; bumps
    become rows in the end. Companies and years meet by sorted shuffles: Spark's estimate of a few columns of a compressed
    file would have it broadcast millions of rows.
    """
    sums = discounted(companies, years, {f"_pv{i}": a for i, a in enumerate(waccs)})
    j = companies.join(sums.hint("merge"), "company_id", "left")

    def cell(i: int, a: float, b: float) -> Column:
        w, g = F.col("wacc").cast("double") + a, F.col("growth").cast("double") + b
        error = F.when(F.col("n").isNull(), "no cash flows").when(w <= g, "wacc not above growth")
        equity = F.col(f"_pv{i}") + F.col("last") * (1 + g) / F.nullif(w - g, F.lit(0.0)) * F.pow(1 / (1 + w), F.col("n").cast("double")) - F.col("net_debt")
        return F.struct(F.lit(float(a)).alias("wacc_bump"), F.lit(float(b)).alias("growth_bump"), F.when(error.isNull(), equity).alias("equity_value"), error.alias("error"))

    return j.select("company_id", F.inline(F.array(*(cell(i, a, b) for i, a in enumerate(waccs) for b in growths))))


def covenant_monitor(prices: DataFrame, trigger: float = 0.9, floor: float = 0.7, barrier: float = 1.2, window: int = 10, count: int = 6, average: int = 3, knock_in: float = 0.8, every: int = 5, rows: int | None = None) -> DataFrame:
    """Observed prices (deal_id, date, price, conversion_price, face) with covenant states day by day.

    reference: mean of the last `average` prices. On every `every`-th row a reference below conversion price x trigger
    resets to the larger of conversion price x floor and the price; effective_price is the lowest reset so far.
    call_active: at least `count` of the last `window` prices at or above barrier x conversion price. knocked_in: the
    price was at or below knock_in x the first price. conversion_value: face / effective price x price.

    A deal of more than `rows` rows (ranges.ROWS) is cut into ranges of dates; a range brings the last rows of those before it
    along for the windows, and its earlier ranges' count, first price and lowest price and reset come from a small table.
    """
    key, day = ["deal_id"], F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    at = cuts(prices.select("deal_id", day.alias("_o")), key, F.col("_o"), rows)
    dealt = carried(with_part(prices, key, day, at), key, at, {"_i0": (F.count("*"), "sum", "before"), "_low0": (F.min("price"), "min", "before"), "_first0": (F.min_by(F.struct("price"), "date"), "first", "before")})
    w = W.partitionBy("deal_id", PART).orderBy("date")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    k, p = F.col("conversion_price"), F.col("price")
    known = with_halo(dealt, key, [F.col("date")], at, max(window, average) - 1)
    known = known.withColumn("reference", F.avg("price").over(w.rowsBetween(1 - average, 0))).withColumn("_hits", F.sum((p >= barrier * k).cast("int")).over(w.rowsBetween(1 - window, 0))).where("not _halo")
    number = F.coalesce("_i0", F.lit(0)) + F.row_number().over(w)
    known = known.withColumn("reset", F.when((number % every == 0) & (F.col("reference") < k * trigger), F.greatest(k * floor, p)))
    known = carried(known, key, at, {"_reset0": (F.min("reset"), "min", "before")})
    known = known.withColumn("effective_price", F.least(k, F.coalesce(F.least(F.min("reset").over(past), "_reset0"), k)))
    first = F.coalesce("_first0", F.first(F.struct("price")).over(past))["price"]
    known = known.withColumn("call_active", F.col("_hits") >= count).withColumn("knocked_in", F.least(F.min("price").over(past), "_low0") <= knock_in * first)
    return known.select("deal_id", "date", "price", "reference", "reset", "effective_price", "call_active", "knocked_in", (F.col("face") / F.col("effective_price") * p).alias("conversion_value"))


def validate_deals(deals: DataFrame) -> DataFrame:
    """A row for each check that a deal fails."""
    n = lambda c: F.col(c)
    checks = {
        "face not positive": n("face") <= 0, "volatility negative": n("volatility") < 0, "volatility above 5": n("volatility") > 5, "conversion price negative": n("conversion_price") < 0, "spot negative": n("spot") < 0,
        "issue not before maturity": n("issue_date") >= n("maturity_date"), "valuation not before maturity": n("valuation_date") >= n("maturity_date"), "valuation before issue": n("valuation_date") < n("issue_date"),
        "conversion after maturity": n("conversion_start") > n("maturity_date"), "put after maturity": n("put_start") > n("maturity_date"), "refixing without trigger": n("refixing") & n("refixing_trigger").isNull(),
    }
    return deals.select("deal_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))).alias("violation"))
