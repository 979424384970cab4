"""Currency resolution and reconciliation of confirmation replies.

guide rows: engagement_id, party, account_group, currency, amount, pos (their order). rates: engagement_id, currency,
rate, rate_source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

E = "engagement_id"
#: Rates of a currency to KRW that are taken for real.
RATE_RANGES = {"USD": (800.0, 1800.0), "EUR": (900.0, 2000.0), "JPY": (5.0, 20.0), "CNY": (100.0, 300.0), "RMB": (100.0, 300.0), "SGD": (600.0, 1400.0), "AUD": (500.0, 1500.0), "MYR": (150.0, 500.0), "THB": (20.0, 60.0)}


def upper(guide: DataFrame) -> DataFrame:
    return guide.withColumn("currency", F.upper("currency"))


def implicit_rates(guide: DataFrame) -> DataFrame:
    """Per engagement and currency the upper median of KRW / foreign amounts of the same party and account that lie in
    the currency's range; unknown currencies have none."""
    g = upper(guide).where("amount > 0")
    krw = g.where("currency = 'KRW'").select(E, "party", "account_group", F.col("amount").alias("krw"))
    pairs = g.where("currency != 'KRW'").join(krw, [E, "party", "account_group"]).withColumn("rate", F.col("krw") / F.col("amount"))
    bounds = F.create_map(*[x for c, (lo, hi) in RATE_RANGES.items() for x in (F.lit(c), F.array(F.lit(lo), F.lit(hi)))])
    limits = F.element_at(bounds, F.col("currency"))
    sane = pairs.where(limits.isNull() | F.col("rate").between(limits[0], limits[1]))
    # exact upper median by rank, so no group is gathered in one row
    w = W.partitionBy(E, "currency")
    ranked = sane.withColumn("_r", F.row_number().over(w.orderBy("rate"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(E, "currency", "rate", F.lit("implicit").alias("rate_source"))


def all_rates(guide: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Manual rates, then implicit ones."""
    implicit = implicit_rates(guide)
    if manual is None:
        return implicit
    own = manual.select(E, F.upper("currency").alias("currency"), "rate", F.lit("manual").alias("rate_source"))
    return own.unionByName(implicit.join(own, [E, "currency"], "left_anti"))


def dominant_currency(guide: DataFrame) -> DataFrame:
    """Per party the currency of its largest foreign amount; of equal ones the first."""
    best = F.max(F.struct("amount", (-F.col("pos")).alias("p"), "currency"))
    return upper(guide).where("currency != 'KRW'").groupBy(E, "party").agg(best.getField("currency").alias("currency"))


def party_original_amount(guide: DataFrame) -> DataFrame:
    """Per party the sum of foreign amounts and the first foreign currency, else the KRW sum."""
    foreign = F.col("currency") != "KRW"
    out = upper(guide).groupBy(E, "party").agg(F.sum(F.when(foreign, F.col("amount"))).alias("f"), F.min_by(F.when(foreign, F.col("currency")), F.when(foreign, F.col("pos"))).alias("c"), F.sum(F.when(~foreign, F.col("amount"))).alias("k"))
    return out.select(E, "party", F.coalesce("f", "k").alias("original_amount"), F.coalesce("c", F.lit("KRW")).alias("original_currency"))


def to_krw(df: DataFrame, rates: DataFrame, amount: str, currency: str, out: str) -> DataFrame:
    """df with `out`: the amount in KRW, null without a rate."""
    r = rates.select(E, F.col("currency").alias("_c"), F.col("rate").alias("_rate"))
    return df.withColumn("_c", F.upper(currency)).join(r, [E, "_c"], "left").withColumn(out, F.when(F.col("_c") == "KRW", F.col(amount)).otherwise(F.col(amount) * F.col("_rate"))).drop("_c", "_rate")


def from_krw(df: DataFrame, rates: DataFrame, originals: DataFrame, amount: str) -> DataFrame:
    """df with the amount in the party's own currency: (in_original, original_currency), null without a rate."""
    r = rates.where("rate != 0").select(E, F.col("currency").alias("original_currency"), F.col("rate").alias("_rate"))
    kept = df.join(originals.select(E, "party", "original_currency"), [E, "party"], "left").join(r, [E, "original_currency"], "left")
    return kept.withColumn("in_original", F.when(F.col("original_currency") == "KRW", F.col(amount)).otherwise(F.col(amount) / F.col("_rate"))).drop("_rate")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def compare_amounts(replies: DataFrame, rates: DataFrame, originals: DataFrame) -> DataFrame:
    """Ledger against reply: reply_krw, diff_krw, diff_pct, rate_used, rate_source, comparison_possible. Without a rate
    the guide's amount in the reply's currency is compared, as a share only."""
    r = rates.select(E, F.col("currency").alias("_c"), F.col("rate").alias("_rate"), "rate_source")
    j = replies.withColumn("_c", F.upper("currency")).join(r, [E, "_c"], "left").join(originals, [E, "party"], "left")
    krw, same = F.col("_c") == "KRW", F.col("original_currency") == F.col("_c")
    reply_krw = F.when(krw, F.col("reply_amount")).otherwise(F.col("reply_amount") * F.col("_rate"))
    diff = F.col("ledger_amount") - F.col("reply_krw")
    direct = ratio(F.col("original_amount") - F.col("reply_amount"), F.col("original_amount"))
    return j.withColumn("reply_krw", reply_krw).select(
        "reply_id", E, "party", "ledger_amount", "reply_amount", F.col("_c").alias("currency"), "reply_krw", diff.alias("diff_krw"),
        F.when(krw | F.col("_rate").isNotNull(), ratio(diff, F.col("ledger_amount"))).when(same, direct).alias("diff_pct"),
        F.when(krw, 1.0).otherwise(F.col("_rate")).alias("rate_used"), F.when(~krw, F.col("rate_source")).alias("rate_source"),
        F.coalesce(krw | F.col("_rate").isNotNull() | same, F.lit(False)).alias("comparison_possible"),
    )


def reconcile(replies: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """matched if ledger less reply is within the tolerance, mismatch if not, extraction_failed without an amount."""
    diff = F.col("ledger_amount") - F.col("reply_amount")
    status = F.when(F.col("reply_amount").isNull(), "extraction_failed").when(F.abs(diff) <= tolerance, "matched").otherwise("mismatch")
    return replies.select("reply_id", E, "party", "kind", diff.alias("difference"), ratio(diff, F.col("ledger_amount")).alias("difference_pct"), status.alias("status"))


def reconcile_v2(replies: DataFrame, account_rows: DataFrame, guide: DataFrame, rates: DataFrame, tolerance: float = 0.0, pct: float = 0.0) -> DataFrame:
    """Status of each reply: its own statement first, then its accounts against the guide, then totals.

    A stated match holds unless the converted total is more than 5 % off (needs_review); a stated mismatch is one. The
    first guide row of an account stands for it; currencies that differ are compared in KRW. Any account beyond the
    tolerance makes a mismatch, else any within it a match, else needs_review; rows without an amount don't count, but
    a reply with such rows alone still says what it states. Totals compare in the party's own currency if the reply has
    it, else in KRW, unconverted without a rate. The tolerance is at least pct of a positive ledger amount.

    Besides status, basis and difference: its share of what it was held against, its currency, the findings for each
    account (account, reply and guide amount and currency, difference, within tolerance; in the rows' order if they have
    a `pos`) and notes.
    """
    first = upper(guide).groupBy(E, "party", "account_group").agg(F.min_by(F.struct(F.col("amount").alias("g_amount"), F.col("currency").alias("g_currency")), "pos").alias("g")).select(E, "party", "account_group", "g.*")
    led = F.col("ledger_amount")
    base = replies.withColumn("tol", F.when((F.lit(pct) > 0) & (led > 0), F.greatest(F.lit(tolerance), F.abs(led) * pct)).otherwise(F.lit(tolerance)))
    place = F.col("pos") if "pos" in account_rows.columns else F.lit(0)
    rows = account_rows.withColumn("_place", place).join(base.select("reply_id", E, "party", "tol"), "reply_id").join(first, [E, "party", "account_group"], "left").withColumn("row_currency", F.upper("row_currency"))
    rows = to_krw(to_krw(rows, rates, "row_amount", "row_currency", "row_krw"), rates, "g_amount", "g_currency", "g_krw")
    same = F.col("g_currency") == F.col("row_currency")
    diff = F.when(same, F.col("g_amount") - F.col("row_amount")).when(F.col("row_currency") != "KRW", F.col("g_krw") - F.col("row_krw"))
    within = F.abs("d") <= F.col("tol")
    usable = F.col("row_amount").isNotNull()
    found = F.struct("_place", F.col("account_group").alias("account"), "row_amount", "row_currency", "g_amount", "g_currency", F.col("d").alias("difference"), within.alias("within"))
    per = rows.withColumn("d", diff).groupBy("reply_id").agg(F.count("*").alias("n_all"), F.count_if(usable).alias("n_rows"), F.max(F.abs("d") > F.col("tol")).alias("off"), F.max(within).alias("on"), F.array_sort(F.collect_list(F.when(usable, found))).alias("found"))
    j = to_krw(base.withColumn("currency", F.upper("currency")), rates, "reply_amount", "currency", "krw").join(per, "reply_id", "left").join(party_original_amount(guide), [E, "party"], "left")
    yes, no = F.col("declared_match"), ~F.col("declared_match")
    compared = F.coalesce("krw", "reply_amount")
    far = F.coalesce((led != 0) & (F.abs((led - compared) / led) > 0.05), F.lit(False))
    own = (F.col("currency") != "KRW") & (F.col("original_currency") == F.col("currency"))
    total_diff = F.when(own, F.col("original_amount") - F.col("reply_amount")).otherwise(led - compared)
    silent, accounts = F.col("reply_amount").isNull(), F.coalesce("n_rows", F.lit(0)) > 0
    failed = silent & F.col("n_all").isNull()  # neither a total nor any row
    status = (
        F.when(failed, "extraction_failed").when(yes, F.when(far, "needs_review").otherwise("matched")).when(no, "mismatch")
        .when(accounts, F.when(F.col("off"), "mismatch").when(F.col("on"), "matched").otherwise("needs_review"))
        .when(silent, "extraction_failed").when(F.abs(total_diff) <= F.col("tol"), "matched").otherwise("mismatch")
    )
    basis = F.when(failed, "fallback").when(yes | no, "declared").when(accounts, "per_account").when(silent, "fallback").otherwise("total")
    agreed = (basis == "declared") & (status == "matched")
    difference = F.when(basis == "total", total_diff).when(agreed, 0.0)
    share = F.when(basis == "total", F.when(own, ratio(total_diff, F.col("original_amount"))).otherwise(ratio(total_diff, led))).when(agreed, 0.0)
    kept = F.when((basis == "total") & (own | F.col("krw").isNull()), F.col("currency")).otherwise("KRW")
    foreign = F.col("currency") != "KRW"
    notes = F.array_compact(F.array(
        F.when(failed, "no amount and no account rows"),
        F.when(~failed & (basis == "declared") & yes & F.col("reply_amount").isNotNull() & (led != 0), F.concat(F.lit("stated match, off by "), F.format_number(F.abs((led - compared) / led) * 100, 2), F.lit("%"))),
        F.when((basis == "declared") & (status == "needs_review"), "stated match but more than 5% off"),
        F.when((basis == "declared") & no, "stated mismatch"),
        F.when(basis == "per_account", F.concat(F.lit("accounts compared: "), F.col("n_rows").cast("string"))),
        F.when((basis == "total") & own, F.concat(F.lit("compared in "), F.col("currency"))),
        F.when((basis == "total") & ~own & foreign & F.col("krw").isNotNull(), F.concat(F.lit("converted from "), F.col("currency"))),
        F.when((basis == "total") & ~own & foreign & F.col("krw").isNull(), F.concat(F.lit("no rate for "), F.col("currency"), F.lit(", compared as it is"))),
        F.when(~failed & (basis == "fallback"), "no total to hold against the ledger"),
    ))
    return j.select(
        "reply_id", E, "party", status.alias("status"), basis.alias("decision_basis"), difference.alias("difference"), share.alias("difference_pct"), kept.alias("difference_currency"),
        F.col("tol").alias("tolerance"), F.coalesce("n_rows", F.lit(0)).alias("account_rows"),
        F.when(basis == "per_account", F.transform(F.filter("found", lambda x: x.isNotNull()), lambda x: x.dropFields("_place"))).alias("findings"), notes.alias("notes"),
    )


def reply_by_kind(parsed: DataFrame, sampled: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row per reply and kind it answers for: the kinds that its party was sampled in, and the other one if the reply
    has a table and total of it. The section's total counts, else the whole one; within the tolerance or 1 % it matches;
    replies without a party need review.

    parsed: reply_id, engagement_id, party (null: not found), asked_kind, receivable_total, payable_total, balance.
    sampled: engagement_id, party, kind (both for both), receivable_ledger, payable_ledger.
    """
    s = sampled.select(E, "party", F.col("kind").alias("_k"), "receivable_ledger", "payable_ledger")
    j = parsed.join(s, [E, "party"], "left").withColumn("_k", F.coalesce("_k", "asked_kind"))
    has = lambda k: (F.col("_k").isin(k, "both")) | (F.col("party").isNotNull() & F.col(f"{k}_total").isNotNull())
    kinds = F.when(F.col("party").isNull(), F.array("asked_kind")).otherwise(F.array_compact(F.array(F.when(has("receivable"), F.lit("receivable")), F.when(has("payable"), F.lit("payable")))))
    out = j.withColumn("kind", F.explode(kinds))
    pick = lambda s: F.when(F.col("kind") == "receivable", F.col(f"receivable_{s}")).otherwise(F.col(f"payable_{s}"))
    out = out.withColumn("amount", F.coalesce(pick("total"), "balance")).withColumn("ledger", pick("ledger"))
    diff = F.col("ledger") - F.col("amount")
    status = F.when(F.col("party").isNull() | diff.isNull(), "needs_review").when((F.abs(diff) <= tolerance) | F.coalesce(F.abs(ratio(diff, F.col("ledger"))) <= 0.01, F.lit(False)), "matched").otherwise("mismatch")
    return out.select("reply_id", E, "party", "kind", "amount", "ledger", diff.alias("difference"), status.alias("status"))


def status_rank(status: str = "status") -> Column:
    return F.when(F.col(status) == "matched", 3).when(F.col(status) == "mismatch", 2).when(F.col(status) == "needs_review", 1).otherwise(0)


def best_reply(statuses: DataFrame) -> DataFrame:
    """Per party and kind the best status: matched, mismatch, needs_review, else 미회신; of equal ones the first reply."""
    best = F.max(F.struct(status_rank().alias("r"), (-F.col("reply_id")).alias("i"), "status", "difference"))
    return statuses.groupBy(E, "party", "kind").agg(best.alias("b")).select(E, "party", "kind", F.when(F.col("b.r") > 0, F.col("b.status")).otherwise("미회신").alias("status"), (-F.col("b.i")).alias("reply_id"), F.col("b.difference").alias("difference"))


def reply_tracking(final: DataFrame, best: DataFrame) -> DataFrame:
    """Per engagement and kind: sent, replied, matched, mismatch, needs review and no-reply counts, and the sum of reply
    less ledger."""
    j = final.select(E, "party", "kind").join(best, [E, "party", "kind"], "left")
    n = lambda s: F.count_if(F.col("status") == s)
    replied = F.col("status").isNotNull() & (F.col("status") != "미회신")
    return j.groupBy(E, "kind").agg(F.count("*").alias("sent"), F.count_if(replied).alias("replied"), n("matched").alias("matched"), n("mismatch").alias("mismatch"), n("needs_review").alias("needs_review"), F.count_if(~replied).alias("no_reply"), F.sum(-F.col("difference")).alias("detail_difference"))


def confirmation_status(guide: DataFrame, best: DataFrame, procedures: DataFrame, key, newest: str | None = None) -> DataFrame:
    """Guide rows with how they are confirmed: 원본 (matched or differing reply), 대체적 (alternative procedure), 미회신; key
    makes the name that the three meet on. Of a party's replies, of any kind, that of the best status counts, the first of
    equal ones; of its procedures the latest by the column `newest`, without it the one that covers most."""
    first = F.struct(status_rank(), -F.col("reply_id"), "status", F.col("difference"))
    b = best.where("status != '미회신'").groupBy(E, key("party").alias("_n")).agg(F.max_by(F.struct("status", "difference"), first).alias("_b")).select(E, "_n", "_b.status", F.col("_b.difference").alias("_d"))
    last = F.struct(*([newest] if newest else []), "covered", "conclusion")
    p = procedures.groupBy(E, key("party").alias("_n")).agg(F.max_by(F.struct("conclusion", "covered"), last).alias("_p")).select(E, "_n", "_p.conclusion", F.col("_p.covered").alias("_v"))
    j = guide.withColumn("_n", key("party")).join(b, [E, "_n"], "left").join(p, [E, "_n"], "left")
    how = F.when(F.col("status").isNotNull(), "원본").when(F.col("conclusion").isNotNull(), "대체적").otherwise("미회신")
    return j.select(E, "party", "account_group", "currency", "amount", how.alias("confirmed_by"), F.when(how == "원본", -F.col("_d")).when(how == "대체적", F.col("_v") - F.col("amount")).alias("difference"), F.coalesce("status", "conclusion").alias("note"))


def confirmation_counts(rows: DataFrame) -> DataFrame:
    """Per engagement the guide rows of confirmation_status confirmed in each of the three ways."""
    n = lambda how: F.count_if(F.col("confirmed_by") == how)
    return rows.groupBy(E).agg(F.count("*").alias("rows"), n("원본").alias("replied"), n("대체적").alias("alternative"), n("미회신").alias("no_reply"))


def apply_explanations(statuses: DataFrame, explanations: DataFrame) -> DataFrame:
    """Replies of explained parties become matched when a reason is given, with the reason noted."""
    e = explanations.select(E, "party", F.col("reasons").alias("_r"))
    told = F.coalesce(F.col("_r"), F.lit("")) != ""
    j = statuses.join(e, [E, "party"], "left")
    return j.withColumn("reviewer_status", F.when(F.col("_r").isNotNull(), "reconciliation_applied")).withColumn("note", F.when(told, F.col("_r"))).withColumn("status", F.when(told, "matched").otherwise(F.col("status"))).drop("_r")
