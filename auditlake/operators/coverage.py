"""Alternative procedures, evidence and coverage of confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.fx import E, best_reply, ratio, to_krw

#: Shares of the ledger amount from which evidence is 충분 or 부분, and unresolved parties still accepted.
ENOUGH, PART, ACCEPTED = 0.95, 0.50, 5
CONCLUSIONS = {"충분": "대체적_충분", "부분": "대체적_부분", "미해소": "대체적_미해소", "needs_review": "대체적_pending"}


def sampled_candidates(decisions: DataFrame) -> DataFrame:
    """Final parties of either kind: kind `both` when in both, with the receivable's balance first."""
    one = lambda k: decisions.where((F.col("kind") == k) & F.col("is_final")).select(E, "party", F.col("balance").alias(k))
    j = one("receivable").join(one("payable"), [E, "party"], "full")
    kind = F.when(F.col("receivable").isNotNull() & F.col("payable").isNotNull(), "both").when(F.col("receivable").isNotNull(), "receivable").otherwise("payable")
    return j.select(E, "party", kind.alias("kind"), F.coalesce("receivable", "payable").alias("balance"))


def pending_parties(final: DataFrame, best: DataFrame) -> DataFrame:
    """Final parties to follow up: without a reply (미회신), or whose reply differs (차이, with the difference)."""
    j = final.select(E, "party", "kind", "balance").join(best.select(E, "party", "kind", "status", "difference"), [E, "party", "kind"], "left")
    why = F.when(F.col("status").isNull() | (F.col("status") == "미회신"), "미회신").when(F.col("status") == "mismatch", "차이")
    return j.withColumn("why", why).where("why is not null").select(E, "party", "kind", "balance", "why", F.when(F.col("why") == "차이", F.col("difference")).alias("difference"))


def auto_identify(final: DataFrame, replies: DataFrame, evidence: DataFrame, normal) -> DataFrame:
    """Final parties without any reply, by name or by normalised name, and without evidence."""
    left = final.select(E, "party", "kind", "balance").withColumn("_n", normal("party"))
    names = replies.select(E, normal("party").alias("_n")).distinct()
    return left.join(replies.select(E, "party").distinct(), [E, "party"], "left_anti").join(names, [E, "_n"], "left_anti").drop("_n").join(evidence.select(E, "party").distinct(), [E, "party"], "left_anti")


def evidence_by_currency(evidence: DataFrame) -> DataFrame:
    """Per party and currency (none: KRW) the amount of successful files."""
    return evidence.where("success and amount is not null").groupBy(E, "party", F.coalesce(F.upper("currency"), F.lit("KRW")).alias("currency")).agg(F.sum("amount").alias("amount"))


def evidence_summary(evidence: DataFrame, low: float = 0.5) -> DataFrame:
    """Per party: files read with an amount (success); failed ones, which includes those read without an amount; failed
    ones whose file is there (needs_review: all, unless a column `has_file` denies it for an unread one); files of low
    confidence, which are those to review and the successes below `low`; and the representative currency: KRW if there,
    else that of the largest amount."""
    read, done = F.coalesce("success", F.lit(False)), F.coalesce("success", F.lit(False)) & F.col("amount").isNotNull()
    there = read | (F.coalesce("has_file", F.lit(False)) if "has_file" in evidence.columns else F.lit(True))
    review = ~done & there
    counts = evidence.groupBy(E, "party").agg(F.count_if(done).alias("success"), F.count_if(~done).alias("failed"), F.count_if(review).alias("needs_review"), F.count_if(review | (done & (F.col("confidence") < low))).alias("low_confidence"))
    by = evidence_by_currency(evidence).groupBy(E, "party").agg(F.max(F.col("currency") == "KRW").alias("krw"), F.max(F.struct("amount", "currency")).getField("currency").alias("c"))
    return counts.join(by, [E, "party"], "left").select(E, "party", "success", "failed", "needs_review", "low_confidence", F.when(F.col("krw"), "KRW").otherwise(F.col("c")).alias("currency"))


def conclude(share: Column) -> Column:
    return F.when(share.isNull(), "needs_review").when(share >= ENOUGH, "충분").when(share >= PART, "부분").otherwise("미해소")


def coverage_ratio(evidence: DataFrame, ledgers: DataFrame, rates: DataFrame, mixed: bool = False) -> DataFrame:
    """Per party of ledgers (party, ledger): covered amount, share (at most 1) and conclusion.

    A KRW amount hides other currencies; else their converted sum counts, null if nothing converts. `mixed` adds up all
    currencies as they are when there is no KRW (the single-file rule).
    """
    by = to_krw(evidence_by_currency(evidence), rates, "amount", "currency", "krw")
    own = F.sum(F.when(F.col("currency") == "KRW", F.col("amount"))).cast("double")
    other = F.sum("amount").cast("double") if mixed else F.sum(F.col("krw").cast("double"))
    sums = by.groupBy(E, "party").agg(own.alias("own"), other.alias("other")).select(E, "party", F.coalesce("own", F.when(F.col("other") > 0, F.col("other"))).alias("covered"))
    j = ledgers.join(sums, [E, "party"], "left")
    share = F.when((F.col("ledger") > 0) & F.col("covered").isNotNull(), F.least(F.lit(1.0), F.col("covered") / F.col("ledger")))
    return j.select(E, "party", "ledger", "covered", share.alias("share"), conclude(share).alias("conclusion"))


def procedure_summary(procedures: DataFrame) -> DataFrame:
    """Per engagement: procedures by conclusion, covered and ledger sums and their ratio."""
    n = lambda c: F.count_if(F.col("conclusion") == c)
    return procedures.groupBy(E).agg(F.count("*").alias("procedures"), n("충분").alias("enough"), n("부분").alias("part"), n("미해소").alias("unresolved"), n("needs_review").alias("needs_review"), F.sum("covered").alias("covered"), F.sum("ledger").alias("ledger")).withColumn("share", ratio(F.col("covered"), F.col("ledger")))


def classify_party_status(df: DataFrame) -> DataFrame:
    """df (reply_status, conclusion) with `state`: a match first; a mismatch unless a procedure found enough or part; a
    procedure's conclusion; needs_review; else unresolved."""
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONCLUSIONS.items() for x in kv]), F.col("conclusion")), F.lit("대체적_pending"))
    r, c = F.col("reply_status"), F.col("conclusion")
    state = F.when(r == "matched", "matched").when(r == "mismatch", F.when(c.isin("충분", "부분"), mapped).otherwise("mismatch")).when(F.coalesce(c, F.lit("")) != "", mapped).when(r == "needs_review", "needs_review").otherwise("unresolved")
    return df.withColumn("state", state)


def party_states(final: DataFrame, statuses: DataFrame, procedures: DataFrame, newest: str | None = None) -> DataFrame:
    """Final parties with reply_status (the best reply's), conclusion and state. Of a party's procedures the latest by the
    column `newest` counts; without it that of the strongest conclusion."""
    strength = F.array_position(F.array(*map(F.lit, reversed(list(CONCLUSIONS)))), F.col("conclusion"))
    chosen = procedures.groupBy(E, "party").agg(F.max_by("conclusion", F.struct(*([newest] if newest else []), strength, "conclusion")).alias("conclusion"))
    best = best_reply(statuses).select(E, "party", "kind", F.col("status").alias("reply_status"))
    j = final.select(E, "party", "kind").distinct().join(best, [E, "party", "kind"], "left").join(chosen, [E, "party"], "left")
    return classify_party_status(j)


def coverage_report(states: DataFrame, accepted: int = ACCEPTED) -> DataFrame:
    """Per engagement the parties by state, and whether unresolved and needs_review ones are few enough."""
    names = ["matched", "mismatch", "needs_review", "unresolved", *CONCLUSIONS.values()]
    out = states.groupBy(E).agg(F.count("*").alias("parties"), *(F.count_if(F.col("state") == s).alias(s) for s in names))
    return out.withColumn("passed", F.col("unresolved") + F.col("needs_review") <= accepted)


def audit_trail_latest(trail: DataFrame, project: str, value, newest: str = "created_at") -> DataFrame:
    """A project's history, newest first."""
    return trail.where(F.col(project) == value).orderBy(F.desc(newest))


def detail_coverage(details: DataFrame, final: DataFrame) -> DataFrame:
    """Sum of absolute detail amounts per sampled party."""
    return details.join(final.select(E, "party").distinct(), [E, "party"], "left_semi").groupBy(E, "party").agg(F.sum(F.abs("amount")).alias("detail_amount"))


def explanation_summary(rows: DataFrame) -> DataFrame:
    """Per party: sums sent and replied, their difference, distinct reasons and account types in text order, and the first
    row's currency. rows: engagement_id, party, row_no, sent, reply, reason, account_type, currency."""
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit("")))), ", ")
    return rows.groupBy(E, "party").agg(F.sum("sent").alias("sent"), F.sum("reply").alias("reply"), texts("reason").alias("reasons"), texts("account_type").alias("account_types"), F.min_by("currency", "row_no").alias("currency")).withColumn("difference", F.col("sent") - F.col("reply"))
