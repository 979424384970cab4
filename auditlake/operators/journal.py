"""Journal-entry tests over general-ledger lines of many engagements.

Ledger lines have engagement_id, entry_no, entry_date, posting_date, user_id, account_code, debit_amount,
credit_amount, entry_type, description. Everything is keyed by engagement_id. Masters (accounts, users, document
types, parameters) are joined on it; Spark broadcasts them where its own size estimate allows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.operators.sampling import running_total
from auditlake.sources.shared import durable

E = "engagement_id"
#: User id patterns, document types, wordings and thresholds of the tests.
SYSTEM_USERS = ("^CEP_", "^FF_", "^BATCH", "^SYSTEM[_-]", "^RFC_", "^SAP_", "^GRC_", "^WF[_-]", "^AUTO", "^Z[0-9A-Z]+$", "^GLOBAL", "^OUTSOURCING", "^I[A-Z]", r"^9\d{4}$")
EXTERNAL_USERS = ("[A-Z]$",)
AUTO_DOC_TYPES = ("AF", "CO", "HR", "MD", "ML", "WA", "WE", "WL", "WI", "WN", "CH", "PR", "M9")
CLOSING_DOC_TYPES = ("SA", "SU", "CA", "C2", "M3", "M4", "M5", "M6", "M7", "M8")
COUNTER_SCENARIOS = ("^4", "^11201", "^1170", "^21502", "^1230[2-8]", "^12309")
VAGUE_WORDS = ("TBD", "기타", "임시", "test", "-", ".")
PL_NAME = "매출|수익|비용|원가|손실|이익|revenue|expense"
RULE_ORDER = ("B01", "B04", "B05", "B06", "B07", "B08", "B09", "B10", "B11", "B12", "A03")

LINE = (E, "entry_no", "entry_date", "posting_date", "user_id", "account_code", "entry_type", "debit_amount", "credit_amount")


def zero() -> Column:
    return F.lit(0).cast("decimal(20,2)")


def stripped(code: str | Column) -> Column:
    """An account code without leading zeros; all zeros stay."""
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.nullif(F.regexp_replace(code, "^0+", ""), F.lit("")), code)


def money(code: str) -> Column:
    return F.coalesce(F.col(code), zero())


def integrity(raw: DataFrame, checks: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Per column the rows, those filled, null and not castable to the type, the pass rate and OK or FAIL.

    One aggregation over the text columns, then turned to long form. A column fails if a value is invalid, or if a
    required one is missing. Blank counts as null.
    """
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    whole = raw.groupBy(E).agg(
        F.count("*").alias("total"),
        *(F.count(value(c)).alias(f"f_{c}") for c in checks),
        *(F.count_if(value(c).isNotNull() & value(c).try_cast(t).isNull()).alias(f"i_{c}") for c, t in checks.items()),
    )
    long = whole.select(E, "total", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"f_{c}").alias("filled"), F.col(f"i_{c}").alias("invalid"), F.lit(c in required).alias("required")) for c in checks))))
    missing = F.col("total") - F.col("filled")
    failed = (F.col("invalid") > 0) | (F.col("required") & (missing > 0))
    return long.select(E, "column", "total", "filled", missing.alias("missing"), "invalid", ((F.col("filled") - F.col("invalid")) / F.col("total")).alias("pass_rate"), F.when(failed, "FAIL").otherwise("OK").alias("status"))


def integrity_totals(raw: DataFrame, checks: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Per engagement the rows, the missing values of required columns, the values of a wrong format, and the columns
    that fail."""
    must = F.col("column").isin(*required) if required else F.lit(False)
    by = integrity(raw, checks, required).groupBy(E)
    return by.agg(F.max("total").alias("total"), F.coalesce(F.sum(F.when(must, F.col("missing"))), F.lit(0)).alias("missing_required"), F.sum("invalid").alias("format_errors"), F.count_if(F.col("status") == "FAIL").alias("failed_columns"))


def voucher_totals(gl: DataFrame) -> DataFrame:
    return gl.groupBy(E, "entry_no").agg(F.sum("debit_amount").alias("debit"), F.sum("credit_amount").alias("credit"), F.count("*").alias("line_count"), F.min("entry_date").alias("entry_date"))


def voucher_balance(gl: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Vouchers whose debit and credit differ by more than the tolerance."""
    difference = F.col("debit") - F.col("credit")
    return voucher_totals(gl).withColumn("difference", difference).where(F.abs(difference) > tolerance)


def voucher_balance_summary(gl: DataFrame, tolerance: float = 0.01, sample: int = 10) -> DataFrame:
    """Per engagement the vouchers, the balanced ones, and of these the `sample` lowest numbers."""
    v = voucher_totals(gl).withColumn("ok", F.abs(F.col("debit") - F.col("credit")) <= tolerance)
    low = v.where("ok").withColumn("n", F.row_number().over(W.partitionBy(E).orderBy("entry_no"))).where(F.col("n") <= sample)
    return v.groupBy(E).agg(F.count("*").alias("vouchers"), F.count_if("ok").alias("balanced")).join(low.groupBy(E).agg(F.array_join(F.array_sort(F.collect_list("entry_no")), ",").alias("sample")), E, "left")


def account_sums(gl: DataFrame, row_no: str | None = None) -> DataFrame:
    """Per engagement and stripped account code the sums, and the first name: in the order of the column `row_no`, without it in
    text order; null for a ledger without names."""
    first = F.min_by("account_name", "_no") if row_no else F.min("account_name")
    name = F.col("account_name") if "account_name" in gl.columns else F.lit(None).cast("string")
    kinds = [f.dataType for f in gl.select(F.sum("debit_amount"), F.sum("credit_amount")).schema]
    # the first of texts is found by sorting, so names are keys of a sum by hash before, which leaves few rows to sort
    cells = gl.groupBy(E, stripped("account_code").alias("account_code"), name.alias("account_name")).agg(F.sum("debit_amount").alias("debit_amount"), F.sum("credit_amount").alias("credit_amount"), F.min(row_no or F.lit(0)).alias("_no"))
    return cells.groupBy(E, "account_code").agg(F.sum("debit_amount").cast(kinds[0]).alias("gl_debit"), F.sum("credit_amount").cast(kinds[1]).alias("gl_credit"), first.alias("gl_name"))


def profit_loss_flag(accounts: DataFrame, coa: DataFrame, names: str = PL_NAME) -> DataFrame:
    """accounts (account_code, gl_name) with is_pl: the master's type, else the name if there is one, else the first
    digit 4 to 8."""
    types = coa.select(E, F.col("account_code"), (F.col("account_type") == "P").alias("_p"))
    by_name = F.when(F.nullif(F.trim("gl_name"), F.lit("")).isNotNull(), F.col("gl_name").rlike(names))
    return accounts.join(types, [E, "account_code"], "left").withColumn("is_pl", F.coalesce("_p", by_name, F.col("account_code").rlike("^[4-8]"))).drop("_p")


def tb_rollforward(gl: DataFrame, tb: DataFrame, coa: DataFrame, adjustments: DataFrame, tolerance: float = 0.5, row_no: str | None = None) -> DataFrame:
    """Accounts of the trial balance whose opening plus ledger movement misses its closing by more than 0.5.

    The opening takes the equity adjustment and is zero for profit and loss accounts. Ledger codes are stripped of
    leading zeros to meet the trial balance's codes. Engagements without ledger lines or trial balance give no rows. row_no: the
    ledger's column of line order, for the first name of an account.
    """
    ledger = account_sums(gl, row_no)
    adjust = adjustments.groupBy(E, "account_code").agg(F.sum("amount").alias("adjustment"))
    base = tb.join(ledger.select(E).distinct(), E, "left_semi").join(ledger, [E, "account_code"], "left")
    flagged = profit_loss_flag(base, coa).join(adjust, [E, "account_code"], "left")
    opening = F.when(F.col("is_pl"), zero()).otherwise(F.col("opening") + money("adjustment"))
    out = flagged.withColumn("used_opening", opening).withColumn("calculated", opening + money("gl_debit") - money("gl_credit")).withColumn("difference", F.col("calculated") - F.col("closing"))
    return out.where(F.abs("difference") > tolerance).select(
        E, "account_code", "is_pl", "used_opening", "calculated", "closing", "difference", (money("gl_debit") - F.col("period_debit")).alias("dr_diff"), (money("gl_credit") - F.col("period_credit")).alias("cr_diff")
    )


def tb_rollforward_scope(gl: DataFrame, tb: DataFrame) -> DataFrame:
    """Per engagement the accounts checked (codes of either side), the ratio of trial-balance to ledger debits, and
    whether it warns of a different scope (above 1.5 or below 0.67, both sums positive)."""
    both = account_sums(gl).select(E, "account_code").union(tb.select(E, "account_code")).distinct().groupBy(E).agg(F.count("*").alias("accounts_checked"))
    sums = gl.groupBy(E).agg(F.sum("debit_amount").alias("g")).join(tb.groupBy(E).agg(F.sum("period_debit").alias("t")), E)
    ratio = F.when((F.col("t") > 0) & (F.col("g") > 0), F.col("t").cast("double") / F.col("g").cast("double"))
    return both.join(sums, E).select(E, "accounts_checked", ratio.alias("ratio"), F.coalesce((ratio > 1.5) | (ratio < 0.67), F.lit(False)).alias("scope_warning"))


def sales(gl: DataFrame, pattern: str = "^4", basis: str = "net_credit") -> DataFrame:
    """Per engagement the sales: credit less debit, or credit alone for gross_credit, of accounts of the pattern."""
    amount = F.col("credit_amount") - F.col("debit_amount") if basis == "net_credit" else F.col("credit_amount")
    return gl.where(F.col("account_code").rlike(pattern)).groupBy(E).agg(F.sum(amount).alias("sales"))


def pl_threshold(gl: DataFrame, ratio: float = 0.005, absolute: float | None = None, basis: str = "net_credit") -> DataFrame:
    """(engagement_id, threshold) of engagements with sales. It is written out: joined with the ledger as it stands, its size would be
    taken for the ledger's, and all lines of an engagement would meet in a task."""
    limit = F.lit(absolute) if absolute is not None else F.col("sales").cast("double") * ratio
    return durable(sales(gl, basis=basis).select(E, limit.cast("double").alias("threshold")))


def line_amount() -> Column:
    return F.greatest("debit_amount", "credit_amount")


def large_pl(gl: DataFrame, coa: DataFrame, ratio: float = 0.005, absolute: float | None = None) -> DataFrame:
    """Profit and loss lines above the threshold, a share of sales or an absolute amount; no sales, no lines."""
    types = coa.select(E, "account_code", (F.col("account_type") == "P").alias("_p"))
    lines = gl.join(pl_threshold(gl, ratio, absolute), E).where(line_amount().cast("double") > F.col("threshold"))
    return lines.join(types, [E, "account_code"], "left").where(F.coalesce("_p", F.col("account_code").rlike("^[4-8]"))).select(*LINE, "threshold")


def line_and_voucher_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(E).agg(F.count("*").alias("lines"), F.countDistinct("entry_no").alias("vouchers"))


def unmatched_accounts(gl: DataFrame, coa: DataFrame) -> DataFrame:
    """Lines whose code, raw or stripped, isn't in the master; engagements without a master are skipped."""
    known = durable(coa.select(E, F.explode(F.array("account_code", stripped("account_code"))).alias("_c")).distinct())
    lines = gl.join(known.select(E).distinct(), E, "left_semi")
    for code in (F.col("account_code"), stripped("account_code")):
        lines = lines.withColumn("_c", code).join(known, [E, "_c"], "left_anti").drop("_c")
    return lines.select(*LINE)


def new_accounts(coa: DataFrame, tb: DataFrame, prior: DataFrame, params: DataFrame) -> DataFrame:
    """Accounts created in the period, or where the master has no dates, those absent from the prior balance."""
    p = params.select(E, "period_start", "period_end")
    dated = coa.groupBy(E).agg(F.max(F.col("created_date").isNotNull()).alias("dated"))
    created = coa.join(p, E).where(F.col("created_date").between(F.col("period_start"), F.col("period_end"))).select(E, "account_code", "created_date")
    had = prior.select(E, F.explode(F.array("account_code", stripped("account_code"))).alias("_c")).distinct()
    fresh = tb.select(E, "account_code").distinct()
    for code in (F.col("account_code"), stripped("account_code")):
        fresh = fresh.withColumn("_c", code).join(had, [E, "_c"], "left_anti").drop("_c")
    fresh = fresh.join(prior.select(E).distinct(), E, "left_semi").join(dated.where("dated"), E, "left_anti").join(p, E).select(E, "account_code", F.col("period_start").alias("created_date"))
    return created.unionByName(fresh)


def new_account_lines(gl: DataFrame, found: DataFrame) -> DataFrame:
    """Ledger lines of the new accounts, met by raw or stripped code."""
    codes = durable(found.select(E, F.explode(F.array_distinct(F.array("account_code", stripped("account_code")))).alias("_c"), "created_date").groupBy(E, "_c").agg(F.min("created_date").alias("created_date")))
    raw = gl.withColumn("_c", F.col("account_code")).join(codes, [E, "_c"])
    bare = gl.where(stripped("account_code") != F.col("account_code")).join(codes.select(E, F.col("_c").alias("account_code")), [E, "account_code"], "left_anti").withColumn("_c", stripped("account_code")).join(codes, [E, "_c"])
    return raw.unionByName(bare).select(*LINE, "created_date")


def new_account_summary(gl: DataFrame, found: DataFrame) -> DataFrame:
    lines = new_account_lines(gl, found)
    used = lines.groupBy(E).agg(F.count("*").alias("lines"), F.countDistinct("entry_no").alias("vouchers"), F.countDistinct("account_code").alias("used_accounts"))
    return found.groupBy(E).agg(F.count("*").alias("accounts")).join(used, E, "left").fillna(0, ["lines", "vouchers", "used_accounts"])


def seldom_used(gl: DataFrame, most: int = 5) -> DataFrame:
    """Lines of accounts with at most `most` lines."""
    rare = durable(gl.groupBy(E, "account_code").agg(F.count("*").alias("usage_count")).where(F.col("usage_count") <= most))
    return gl.join(rare, [E, "account_code"]).select(*LINE, "usage_count")


def unusual_users(gl: DataFrame, hr: DataFrame, doc_types: DataFrame, system=SYSTEM_USERS, external=EXTERNAL_USERS, affiliate: tuple[str, ...] = ()) -> DataFrame:
    """Lines by system, external, retired, affiliate or unregistered users, the first reason that holds.

    Patterns are searched in the id (anchor them to match its start). External users are those not registered. A
    registered user counts only after retirement, by posting date, else entry date. Engagements without a user master
    are skipped.
    """
    for patterns in (system, external, affiliate):
        if not isinstance(patterns, (list, tuple)):
            raise ValueError("patterns must be a list")
    uid, late = F.col("user_id"), F.datediff(F.coalesce("posting_date", "entry_date"), F.col("retire_date"))
    anchored = lambda ps: reduce(lambda a, p: a | uid.rlike(f"^(?:{p})"), ps, uid.isNull() & False)
    searched = reduce(lambda a, p: a | uid.rlike(p), external, F.lit(False))
    reason = (
        F.when(anchored(("SYSTEM-", *system)), "system")
        .when(F.col("_in").isNull() & searched, "external")
        .when(F.col("_in").isNotNull(), F.when(late > 0, "post_retirement"))
        .when(anchored(affiliate), "affiliate")
        .otherwise("not_registered")
    )
    code = F.substring(uid, 8, 1000)
    detail = (
        F.when((F.col("reason") == "system") & uid.startswith("SYSTEM-"), F.coalesce("_doc", F.when(code != "", F.concat(F.lit("자동전기 ("), code, F.lit(")"))).otherwise("시스템 자동전기")))
        .when(F.col("reason") == "system", uid)
        .when(F.col("reason") == "external", F.right(uid, F.lit(1)))
        .when(F.col("reason") == "affiliate", F.substring(uid, 1, 3))
    )
    users = hr.select(E, "user_id", "retire_date", F.lit(True).alias("_in"))
    docs = doc_types.select(F.concat(F.lit("SYSTEM-"), "entry_type").alias("user_id"), F.col("description").alias("_doc"))
    return (
        gl.join(hr.select(E).distinct(), E, "left_semi")
        .join(users, [E, "user_id"], "left")
        .join(docs, "user_id", "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select(*LINE, "reason", detail.alias("detail_type"), F.when(F.col("reason") == "post_retirement", late).alias("days_after"))
    )


def unusual_user_summary(found: DataFrame, hr_names: DataFrame | None = None, most: int = 100) -> DataFrame:
    """Per reason the `most` users with most lines: count, largest amount, detail type, and how many users are left
    out; with hr_names (engagement_id, user_id, user_name) their names."""
    users = found.groupBy(E, "reason", "user_id").agg(F.count("*").alias("lines"), F.max(line_amount()).alias("largest"), F.max("detail_type").alias("detail_type"))
    w = W.partitionBy(E, "reason")
    ranked = users.withColumn("place", F.row_number().over(w.orderBy(F.desc("lines"), "user_id"))).withColumn("omitted", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    top = ranked.where(F.col("place") <= most)
    return top if hr_names is None else top.join(hr_names.select(E, "user_id", "user_name"), [E, "user_id"], "left")


def self_approved(gl: DataFrame, approver: str = "approver_id") -> DataFrame:
    """Lines approved by their own user; without an approver column, none (the rule is waived)."""
    if approver not in gl.columns:
        return gl.where("false").select(*LINE)
    return gl.where(F.col("user_id") == F.col(approver)).select(*LINE)


def back_dated(gl: DataFrame, most_days: int = 30, include_backdated: bool = True) -> DataFrame:
    """Lines posted more than `most_days` after entry (late) or before it (reversed)."""
    delay = F.datediff("posting_date", "entry_date")
    kind = F.when(delay > most_days, "late").when((delay < 0) & F.lit(include_backdated), "reversed")
    return gl.withColumn("delay", delay).withColumn("class", kind).where("class is not null").select(*LINE, "delay", "class")


def back_dated_summary(gl: DataFrame, most_days: int = 30) -> DataFrame:
    delay = F.datediff("posting_date", "entry_date")
    return gl.groupBy(E).agg(
        F.count_if(delay > most_days).alias("late_lines"), F.countDistinct(F.when(delay > most_days, F.col("entry_no"))).alias("late_vouchers"),
        F.count_if(delay < 0).alias("reversed_lines"), F.countDistinct(F.when(delay < 0, F.col("entry_no"))).alias("reversed_vouchers"), F.count_if(F.col("posting_date").isNull()).alias("skipped_no_date"),
    )


def side() -> Column:
    return F.when(F.col("debit_amount") > 0, "D").otherwise("C")


def named(rows: DataFrame, doc_types: DataFrame | None, accounts: DataFrame | None) -> DataFrame:
    """rows with entry_type_name and account_name of the masters given."""
    if doc_types is not None:
        rows = rows.join(doc_types.select("entry_type", F.col("description").alias("entry_type_name")), "entry_type", "left")
    return rows if accounts is None else rows.join(accounts.select(E, "account_code", "account_name"), [E, "account_code"], "left")


def doc_type_accounts(gl: DataFrame, ratio: float = 0.005, absolute: float | None = None, doc_types: DataFrame | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """Lines above the sales threshold by document type, account and side; named by the masters given."""
    lines = gl.join(pl_threshold(gl, ratio, absolute), E).where(line_amount().cast("double") > F.col("threshold"))
    sums = lines.groupBy(E, "entry_type", "account_code", side().alias("side")).agg(F.sum("debit_amount").alias("debit"), F.sum("credit_amount").alias("credit"), F.count("*").alias("lines"))
    return named(sums, doc_types, accounts)


def rare_doc_type_accounts(gl: DataFrame, least: int = 2, doc_types: DataFrame | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """B08, first version: combinations of document type and account with at most `least` lines, and their sums."""
    sums = gl.groupBy(E, "entry_type", "account_code").agg(F.count("*").alias("frequency"), F.sum("debit_amount").alias("debit"), F.sum("credit_amount").alias("credit"))
    return named(sums.where(F.col("frequency") <= least), doc_types, accounts)


def counter_accounts(gl: DataFrame, scenarios: tuple[str, ...] = COUNTER_SCENARIOS) -> DataFrame:
    """For vouchers with a main account of a scenario, the sums of every account and side beside each main one.

    Lines are summed to (voucher, account, side) first, so a large batch voucher joins accounts, not lines; a counter
    amount counts once for each main account and side of its voucher.
    """
    dealt = gl.select(E, "entry_no", "account_code", "debit_amount", "credit_amount").repartition(E, "entry_no")  # once, for the sums and both sides of the join
    cells = dealt.groupBy(E, "entry_no", "account_code", side().alias("side")).agg(F.sum("debit_amount").alias("debit"), F.sum("credit_amount").alias("credit"))
    hits = F.filter(F.array(*(F.when(F.col("account_code").rlike(p), F.lit(p)) for p in scenarios)), lambda p: p.isNotNull())
    main = cells.select(E, "entry_no", F.explode(hits).alias("scenario"), F.col("account_code").alias("main_account"), F.col("side").alias("main_side"))
    pairs = main.join(cells, [E, "entry_no"])
    relation = F.when(F.col("account_code") == F.col("main_account"), "본계정").when(F.col("side") != F.col("main_side"), "상대계정").otherwise("참고계정")
    return pairs.groupBy(E, "scenario", "main_account", "main_side", "account_code", "side", relation.alias("relation")).agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count("*").alias("vouchers"))


def description_quality(gl: DataFrame, vague: tuple[str, ...] = VAGUE_WORDS, least: int = 5) -> DataFrame:
    """Lines whose description is absent, vague or short, the first that holds."""
    text = F.trim("description")
    issue = F.when(F.coalesce(text, F.lit("")) == "", "absent").when(text.isin(*vague), "vague").when(F.length(text) < least, "short")
    return gl.withColumn("issue", issue).where("issue is not null").select(*LINE, "description", "issue")


def period_end(gl: DataFrame, params: DataFrame, days: int = 10) -> DataFrame:
    """Lines within `days` of the period's end, or entered by it and posted after it; proximity comes first."""
    lines = gl.join(params.select(E, "period_end"), E)
    near = F.col("entry_date").between(F.date_sub("period_end", days), F.date_add("period_end", days))
    after = (F.col("entry_date") <= F.col("period_end")) & (F.col("posting_date") > F.col("period_end"))
    kind = F.when(near, "proximity").when(after, "post_close")
    return lines.withColumn("class", kind).where("class is not null").select(*LINE, "class", F.datediff("period_end", "entry_date").alias("days_to_period_end"), F.coalesce(after, F.lit(False)).alias("post_close_too"))


def top_side(gl: DataFrame, params: DataFrame, doc_types: DataFrame, closing: tuple[str, ...] = CLOSING_DOC_TYPES, days: int = 10) -> DataFrame:
    """Lines of closing document types near or after the period's end, with the type's name."""
    lines = gl.where(F.col("entry_type").isin(*closing)).join(params.select(E, "period_end"), E)
    off = F.datediff("period_end", "entry_date")
    return lines.where((F.abs(off) <= days) | (off < 0)).join(doc_types.select("entry_type", F.col("description").alias("doc_name")), "entry_type", "left").select(*LINE, "doc_name", off.alias("days_to_period_end"))


def doc_type_stats(gl: DataFrame, doc_types: DataFrame, auto: tuple[str, ...] = AUTO_DOC_TYPES) -> DataFrame:
    """Per document type (blank: (없음)): auto or manual, lines, sums, average debit, share of debits in percent, lines
    of system users."""
    kind = F.upper(F.trim("entry_type"))
    kind = F.when(F.coalesce(kind, F.lit("")) == "", "(없음)").otherwise(kind)
    stats = gl.groupBy(E, kind.alias("entry_type")).agg(
        F.count("*").alias("lines"), F.sum("debit_amount").alias("debit"), F.sum("credit_amount").alias("credit"), F.avg(F.col("debit_amount").cast("double")).alias("average_debit"), F.count_if(F.col("user_id").rlike("^SYSTEM[-_]")).alias("system_lines")
    )
    share = F.round(F.col("debit").cast("double") / F.sum("debit").over(W.partitionBy(E)).cast("double") * 100, 2)
    is_auto = F.col("entry_type").isin(*auto) | F.coalesce(F.col("settlement_type") == "SYSTEM", F.lit(False))
    return stats.withColumn("share", share).join(doc_types.select("entry_type", "settlement_type"), "entry_type", "left").withColumn("class", F.when(is_auto, "auto").otherwise("manual")).drop("settlement_type")


def auto_manual_rollup(stats: DataFrame) -> DataFrame:
    """Per class its document types, lines and debits; and the total, class null."""
    return stats.rollup(E, "class").agg(F.countDistinct("entry_type").alias("doc_types"), F.sum("lines").alias("lines"), F.sum("debit").alias("debit")).where(F.col(E).isNotNull())


def finding(df: DataFrame, rule: str, amount: Column | None = None, reason: Column | None = None) -> DataFrame:
    """A rule's lines in the common form (engagement_id, rule_code, entry_no, entry_date, account_code, amount, reason)."""
    has = df.columns
    pick = lambda c, t: F.col(c) if c in has else F.lit(None).cast(t)
    return df.select(E, F.lit(rule).alias("rule_code"), pick("entry_no", "string").alias("entry_no"), pick("entry_date", "date").alias("entry_date"), F.col("account_code"), (line_amount() if amount is None else amount).cast("decimal(38,2)").alias("amount"), (F.lit(rule) if reason is None else reason).alias("reason"))


def run_rules(gl: DataFrame, ctx: dict[str, DataFrame], enabled: tuple[str, ...] = RULE_ORDER, own: dict | None = None, params: dict[str, dict] | None = None, stage: bool = True) -> DataFrame:
    """Findings of the enabled rules in one table. B06 always runs. `params` gives rules their own parameters, as
    {"B04": {"most": 3}, "B09": {"scenarios": ("^4",)}}; without, their defaults hold. `own` adds rules: code -> function
    of (gl, ctx) that returns lines in the form of finding(). With `stage` ledger and masters are written out once, since
    a dozen rules read them; leave it out if they are tables already."""
    if stage:
        with ThreadPoolExecutor(4) as pool:  # small jobs beside the ledger's
            tables = dict(zip(["", *ctx], pool.map(durable, [gl, *ctx.values()])))
        gl = tables.pop("")
        ctx = tables
    given = params or {}
    unknown = set(given) - {*RULE_ORDER, "B02", "B03"}
    if unknown:
        raise ValueError(f"parameters for unknown rules: {sorted(unknown)}")

    def call(rule: str, f, *args):
        return f(*args, **given.get(rule, {}))

    rules = {
        "B01": lambda: finding(call("B01", large_pl, gl, ctx["coa"]), "B01"),
        "B02": lambda: finding(call("B02", unmatched_accounts, gl, ctx["coa"]), "B02"),
        "B03": lambda: finding(new_account_lines(gl, call("B03", new_accounts, ctx["coa"], ctx["tb"], ctx["tb_prior"], ctx["params"])), "B03"),
        "B04": lambda: finding(call("B04", seldom_used, gl), "B04"),
        "B05": lambda: finding(call("B05", unusual_users, gl, ctx["hr"], ctx["doc_types"]), "B05", reason=F.col("reason")),
        "B06": lambda: finding(call("B06", self_approved, gl), "B06"),
        "B07": lambda: finding(call("B07", back_dated, gl), "B07", reason=F.col("class")),
        "B08": lambda: finding(call("B08", doc_type_accounts, gl), "B08", F.greatest("debit", "credit"), F.col("entry_type")),
        "B09": lambda: finding(call("B09", counter_accounts, gl).where("relation = '상대계정'"), "B09", F.greatest("debit", "credit"), F.col("scenario")),
        "B10": lambda: finding(call("B10", description_quality, gl), "B10", reason=F.col("issue")),
        "B11": lambda: finding(call("B11", period_end, gl, ctx["params"]), "B11", reason=F.col("class")),
        "B12": lambda: finding(call("B12", top_side, gl, ctx["params"], ctx["doc_types"]), "B12"),
        "A03": lambda: finding(call("A03", tb_rollforward, gl, ctx["tb"], ctx["coa"], ctx["equity_adjustments"]), "A03", F.abs("difference")),
    } | {k: (lambda f=f: f(gl, ctx)) for k, f in (own or {}).items()}
    return reduce(DataFrame.unionByName, (rules[r]() for r in dict.fromkeys([*enabled, "B06", *(own or {})])))


def inquiry_list(findings: DataFrame, order: tuple[str, ...] = RULE_ORDER, most: int = 100, stage: bool = True) -> DataFrame:
    """The findings of the listed rules, at most `most` a rule and engagement, numbered Q-001 on within each engagement
    by rule order, date, voucher, account, amount and reason; with the rule's count, total and whether it was cut.

    Findings are read twice, for the totals and for the first ones, of which each task passes on only `most` a rule; with
    `stage` they are written out once before."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("rule_code"))
    by = [F.col("entry_date").asc_nulls_first(), F.col("entry_no").asc_nulls_first(), F.col("account_code").asc_nulls_first(), F.col("amount"), F.col("reason").asc_nulls_first()]
    listed = findings.where(F.col("rule_code").isin(*order)).select(E, "rule_code", "entry_date", "entry_no", "account_code", "amount", "reason")
    listed = durable(listed) if stage else listed
    totals = listed.groupBy(E, "rule_code").agg(F.count("*").alias("section_total"))
    cut = listed.withColumn("seq", F.row_number().over(W.partitionBy(E, "rule_code").orderBy(*by))).where(F.col("seq") <= most).join(totals, [E, "rule_code"])
    number = F.row_number().over(W.partitionBy(E).orderBy(place, "seq"))
    return cut.withColumn("q", number).select(E, F.concat(F.lit("Q-"), F.lpad(F.col("q").cast("string"), 3, "0")).alias("q_no"), "rule_code", "seq", "entry_no", "account_code", "amount", F.least("section_total", F.lit(most)).alias("section_count"), "section_total", (F.col("section_total") > most).alias("is_sampled"))


def sample_findings(findings: DataFrame, method: str, n: int, key: str = "entry_no", seed: str = "0", amount: str = "amount", parts: int | None = None) -> DataFrame:
    """n findings a rule and engagement; all where there are no more.

    random: the n lowest md5(key, seed), of which each task passes on only n a rule; systematic: every floor(N / n)-th by
    key, the first n; mus: those in which a multiple of (sum of abs(amount) / n) falls, by key. Ranks and running sums of
    the last two are made on two levels (sampling.running_total), so one rule spans `parts` tasks.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, "account_code", amount, "reason")]
    if method == "random":
        mark = F.md5(F.concat_ws("|", key, "account_code", F.lit(seed)))
        return findings.withColumn("_r", F.row_number().over(W.partitionBy(E, "rule_code").orderBy(mark, *by))).where(F.col("_r") <= n).drop("_r")
    group, size = [E, "rule_code"], F.lit(1) if method == "systematic" else F.abs(F.coalesce(F.col(amount), zero()))
    run = running_total(findings.withColumn("_size", size.cast("decimal(38,2)")), group, [key, "account_code", amount, "reason"], "_size", "_run", parts)
    total = run.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    run = run.join(total, group)
    if method == "systematic":
        step, place = F.greatest(F.floor(F.col("_n") / n), F.lit(1)), F.col("_run").cast("long") - 1
        chosen = (F.pmod(place, step) == 0) & (F.floor(place / step) < n)
    else:
        step = F.col("_sum").cast("double") / n
        hit = F.floor(F.col("_run").cast("double") / step) > F.floor((F.col("_run") - F.col("_size")).cast("double") / step)
        chosen = (F.col("_n") <= n) | F.coalesce(hit, F.lit(False))
    return run.where(chosen).select(*findings.columns)


def rule_summary(findings: DataFrame, scenarios: DataFrame, warn: int = 1, fail: int = 100) -> DataFrame:
    """Per engagement and scenario (rule_code, status run, waived or not_run): the findings, a label and a badge."""
    n = findings.groupBy(E, "rule_code").agg(F.count("*").alias("n"))
    out = scenarios.join(n, [E, "rule_code"], "left").withColumn("findings", F.coalesce("n", F.lit(0)))
    label = F.when(F.col("status") == "waived", "면제").when(F.col("status") == "not_run", "미실행").when(F.col("findings") == 0, "정상").otherwise(F.concat(F.lit("적출 "), F.col("findings").cast("string"), F.lit("건")))
    badge = F.when(F.col("findings") >= fail, "fail").when(F.col("findings") >= warn, "warn").otherwise("pass")
    return out.select(E, "rule_code", "status", "findings", label.alias("label"), badge.alias("badge"))
