"""Confirmation sampling: party balances, completeness, key items, sample sizes and monetary-unit selection.

Ledger rows have engagement_id, kind (receivable or payable), party, account_name, ending. Balances are decimals, so
sums don't depend on how rows are dealt.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.sources.shared import durable

E = "engagement_id"
#: Characters of related names that a task holds in one automaton.
BLOCK_CHARACTERS = 4_000_000
#: Share of performance materiality above which an item is key, and confidence factor, by risk and reliance.
KEY_RATIO = {"낮음": {"Y": 0.875, "N": 0.375}, "보통": {"Y": 0.75, "N": 0.30}, "높음": {"Y": 0.625, "N": 0.175}, "유의적위험": {"Y": 0.75, "N": 0.15}}
CONFIDENCE = {"낮음": {"Y": 0.7, "N": 1.6}, "보통": {"Y": 1.2, "N": 2.3}, "높음": {"Y": 1.9, "N": 2.6}, "유의적위험": {"Y": 1.4, "N": 3.0}}


def map_account_groups(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    """ledger with account_group: the standard group of the trimmed, lower-cased account name, else the trimmed name."""
    return ledger.join(groups.select(F.col("alias").alias("_a"), "account_group"), F.lower(F.trim("account_name")) == F.col("_a"), "left").withColumn("account_group", F.coalesce("account_group", F.trim("account_name"))).drop("_a")


def party_groups(ledger: DataFrame, groups: DataFrame, signed: bool = False) -> DataFrame:
    amount = F.col("ending") if signed else F.abs("ending")
    return map_account_groups(ledger, groups).where("trim(party) != ''").groupBy(E, "kind", "party", "account_group").agg(F.sum(amount).alias("amount"))


def aggregate_by_party(ledger: DataFrame, groups: DataFrame, signed: bool = False) -> DataFrame:
    """Per party the balance and the map of account group to amount, in group order."""
    entries = F.array_sort(F.collect_list(F.struct("account_group", "amount")))
    return party_groups(ledger, groups, signed).groupBy(E, "kind", "party").agg(F.sum("amount").alias("balance"), F.map_from_entries(entries).alias("by_account"))


def check_completeness(ledger: DataFrame, groups: DataFrame, fs: DataFrame) -> DataFrame:
    """Ledger less statement amount by group, of all parties, with a note; the kind's total has a null group."""
    own = party_groups(ledger, groups).groupBy(E, "kind", "account_group").agg(F.sum("amount").alias("ledger_amount"))
    both = own.join(fs.select(E, "kind", "account_group", F.col("amount").alias("fs_amount")), [E, "kind", "account_group"], "full").fillna({"account_group": ""})
    note = F.when(F.col("ledger_amount").isNull(), "ledger missing").when(F.col("fs_amount").isNull(), "statement missing")
    nought = F.lit(0).cast("decimal(38,2)")
    both = both.withColumn("note", note).withColumn("ledger_amount", F.coalesce("ledger_amount", nought)).withColumn("fs_amount", F.coalesce("fs_amount", nought))
    out = both.groupingSets([[E, "kind", "account_group"], [E, "kind"]], E, "kind", "account_group").agg(F.sum("ledger_amount").alias("ledger_amount"), F.sum("fs_amount").alias("fs_amount"), F.max("note").alias("note"))
    return out.withColumn("difference", F.col("ledger_amount") - F.col("fs_amount")).withColumn("note", F.when(F.col("account_group").isNotNull(), F.col("note")))


def bare_name(name: str) -> Column:
    return F.upper(F.regexp_replace(name, r"㈜|\(주\)|주식회사|[ ,.]", ""))


def _holders(names: DataFrame, inside: list[tuple]) -> DataFrame:
    """Rows (engagement_id, text) of names (engagement_id, n, text) whose n holds one of the strings `inside` (engagement_id,
    string) of its engagement. An automaton of all strings reads each name once."""
    shared = names.sparkSession.sparkContext.broadcast(inside)

    def run(batches):
        import ahocorasick

        of: dict[str, set] = {}
        for engagement, string in shared.value:
            of.setdefault(string, set()).add(engagement)
        automaton = ahocorasick.Automaton()
        for string, engagements in of.items():
            automaton.add_word(string, engagements)
        automaton.make_automaton()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.filter(pa.array([any(key in found for _, found in automaton.iter(n)) for key, n in zip(keys, texts)], pa.bool_()))

    return names.mapInArrow(run, names.schema).select(E, "text")


def related_parties(parties: DataFrame, related: DataFrame) -> DataFrame:
    """Parties whose bare name equals, contains or is contained in that of a related one of the engagement. Names that are
    bare of everything match nobody.

    Related names go out in blocks of at most BLOCK_CHARACTERS to all tasks, each of which streams its parties through an
    automaton of the block's names; so names that start alike, as those of a group do, meet under no common key. For
    the other direction a related name is cut into its substrings of the lengths that party names of the engagement have,
    and these meet the names by equality.
    """
    left = parties.select(E, "party", bare_name("party").alias("n")).where("n != ''").distinct()
    right = related.select(E, bare_name("name").alias("r")).where("r != ''").distinct()
    size = right.agg(F.sum(F.length("r"))).first()[0] or 0
    if size <= BLOCK_CHARACTERS:
        blocks = [right] if size else []
    else:  # a hash deals the names into slices of about a block each, running sums cut a slice into blocks of bounded size
        right = durable(right)
        before = F.sum(F.length("r")).over(W.partitionBy("_s").orderBy(E, "r")) - F.length("r")
        dealt = durable(right.withColumn("_s", F.pmod(F.xxhash64(E, "r"), F.lit(1 + int(size // BLOCK_CHARACTERS)))).withColumn("_b", F.floor(before / BLOCK_CHARACTERS)))
        blocks = [dealt.where((F.col("_s") == s) & (F.col("_b") == b)).select(E, "r") for s, b in dealt.select("_s", "_b").distinct().orderBy("_s", "_b").collect()]
    names = left.select(E, "n", F.col("party").alias("text"))
    holds = [_holders(names, [tuple(r) for r in block.collect()]) for block in blocks]
    lengths = left.select(E, F.length("n").alias("_k")).distinct()
    starts = F.sequence(F.lit(1), F.length("r") - F.col("_k") + 1)
    pieces = right.join(lengths, E).where(F.col("_k") < F.length("r")).select(E, F.explode(F.transform(starts, lambda i: F.substring("r", i, F.col("_k")))).alias("n")).distinct()
    held = left.join(pieces, [E, "n"], "left_semi").select(E, "party")
    return reduce(DataFrame.unionByName, (h.withColumnRenamed("text", "party") for h in holds), held).distinct()


def by_risk(matrix: dict[str, dict[str, float]]) -> Column:
    """A matrix by the columns risk and reliance."""
    entries = [x for risk, row in matrix.items() for reliance, v in row.items() for x in (F.lit(f"{risk}|{reliance}"), F.lit(v))]
    return F.element_at(F.create_map(*entries), F.concat_ws("|", "risk", "reliance"))


def classify_parties(parties: DataFrame, related: DataFrame, excluded: DataFrame, params: DataFrame) -> DataFrame:
    """Party balances with is_excluded, its reason, is_active (not excluded, balance above 0), is_key (balance of at
    least performance materiality times the ratio), is_related. Excluded parties without a balance are appended at 0; of
    several reasons for a party the last one listed (row_no) counts, without such a column the first in text order."""
    reason = F.coalesce(F.max_by("reason", "row_no") if "row_no" in excluded.columns else F.min("reason"), F.lit(""))
    out = excluded.groupBy(E, "kind", "party").agg(reason.alias("exclusion_reason"))
    both = parties.join(out, [E, "kind", "party"], "full").withColumn("balance", F.coalesce("balance", F.lit(0).cast("decimal(38,2)")))
    rel = related_parties(both, related).withColumn("is_related", F.lit(True))
    p = params.select(E, F.col("pm").alias("_pm"), by_risk(KEY_RATIO).alias("_ratio"))
    active = F.col("exclusion_reason").isNull() & (F.col("balance") > 0)
    return (
        both.join(rel, [E, "party"], "left").join(p, E)
        .withColumn("is_related", F.coalesce("is_related", F.lit(False)))
        .withColumn("is_excluded", F.col("exclusion_reason").isNotNull())
        .withColumn("is_active", active)
        .withColumn("is_key", active & (F.col("balance").cast("double") >= F.col("_pm") * F.col("_ratio")))
        .drop("_pm", "_ratio")
    )


def sample_size(classified: DataFrame, params: DataFrame) -> DataFrame:
    """Per engagement and kind: key threshold, population, key amount, remaining, base and final size, interval."""
    sums = classified.where("is_active").groupBy(E, "kind").agg(F.sum("balance").cast("double").alias("population"), F.coalesce(F.sum(F.when(F.col("is_key"), F.col("balance"))).cast("double"), F.lit(0.0)).alias("key_amount"))
    ratio, factor = by_risk(KEY_RATIO), by_risk(CONFIDENCE)
    out = sums.join(params.select(E, "pm", "risk", "reliance"), E).withColumn("key_ratio", ratio).withColumn("confidence_factor", factor)
    out = out.withColumn("threshold", F.col("pm") * F.col("key_ratio")).withColumn("remaining", F.greatest(F.col("population") - F.col("key_amount"), F.lit(0.0)))
    out = out.withColumn("base_size", F.when(F.col("pm") > 0, F.col("remaining") / F.col("pm")).otherwise(0.0))
    out = out.withColumn("final_size", F.when(F.col("base_size") > 0, F.ceil(F.col("base_size") * F.col("confidence_factor"))).otherwise(0).cast("long"))
    return out.withColumn("interval", F.when(F.col("final_size") > 0, F.col("remaining") / F.col("final_size")).otherwise(0.0)).select(E, "kind", "population", "key_amount", "threshold", "key_ratio", "confidence_factor", "remaining", "base_size", "final_size", "interval")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with the sum of `value` up to each row in order within its group, and the largest such sum up to the row
    ({out}_top) and before it ({out}_top_before, null for the first row); one huge group is spread over many tasks.

    Rows are dealt by range of (group, order). A range gives its sum and the largest of its own running sums; these pairs,
    a row for each group and range, add up in range order, (s, m) before (t, n) to (s + t, max(m, s + n)), and what
    comes before a range is added to its rows. The dealt rows are written out, so that both reads see the same ranges, also
    after an executor is lost.
    """
    keys, top = [*group, *order], f"{out}_top"
    dealt = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy(*group, "_part").orderBy(*order, value)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    inside = durable(dealt).withColumn("_in", F.sum(value).over(upto))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    of_range = inside.groupBy(*group, "_part").agg(F.sum(value).alias("_s"), F.max("_in").alias("_m"))
    of_range = of_range.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0).cast("decimal(38,2)"))).withColumn("_high", F.max(F.col("_before") + F.col("_m")).over(earlier))
    rows = inside.withColumn("_top", F.max("_in").over(upto)).withColumn("_top0", F.max("_in").over(before))
    rows = rows.join(of_range.drop("_s", "_m"), [*group, "_part"])
    at = F.col("_before")
    return rows.withColumns({out: at + F.col("_in"), top: F.greatest("_high", at + F.col("_top")), f"{top}_before": F.greatest("_high", at + F.col("_top0"))}).drop("_part", "_before", "_high", "_in", "_top", "_top0")


def run_mus(pool: DataFrame, sizes: DataFrame, seed: str = "0", parts: int | None = None) -> DataFrame:
    """Monetary-unit selection in party order: with cumulative C, interval J and start r0, N is floor((H - r0) / J) + 1 (at least
    0) of the largest cumulative H so far; a party's selections are the growth of N, remainder_after is C - r0 - J N.

    pool: engagement_id, kind, party, balance (of any sign). sizes: interval, and start where given (of any size); else the
    start is J times a hash of (engagement, kind, seed) in [0, 1). Without an interval nothing is selected. Sums and
    largest sums run on two levels (running_total), so a huge stratum spans many tasks; parts: how many, else Spark's number.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(E).cast("string"), "kind", F.lit(seed))), 1, 8), 16, 10).cast("double") / float(2**32)
    start = F.coalesce("start", F.col("interval") * drawn) if "start" in sizes.columns else F.col("interval") * drawn
    rows = pool.join(sizes.withColumn("r0", start).select(E, "kind", "interval", "r0"), [E, "kind"]).where("interval > 0")
    rows = running_total(rows, [E, "kind"], ["party"], "balance", "cumulative", parts)
    count = lambda c: F.coalesce(F.greatest(F.floor((F.col(c).cast("double") - F.col("r0")) / F.col("interval")) + 1, F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = rows.withColumn("n", count("cumulative_top")).withColumn("selections", F.col("n") - count("cumulative_top_before"))
    return rows.select(E, "kind", "party", "balance", "cumulative", "selections", (F.col("cumulative").cast("double") - F.col("r0") - F.col("interval") * F.col("n")).alias("remainder_after"), (F.col("selections") > 0).alias("hit"))


def final_selection(classified: DataFrame, params: DataFrame, force_related: bool = True, seed: str = "0") -> DataFrame:
    """classified with selections, is_representative (selected unit) and is_final (key, representative, or related and
    not excluded if forced)."""
    pool = classified.where("is_active and not is_key").select(E, "kind", "party", "balance")
    picked = run_mus(pool, sample_size(classified, params), seed).select(E, "kind", "party", "selections")
    out = classified.join(picked, [E, "kind", "party"], "left").withColumn("selections", F.coalesce("selections", F.lit(0).cast("long"))).withColumn("is_representative", F.col("selections") > 0)
    return out.withColumn("is_final", F.col("is_key") | F.col("is_representative") | (F.lit(force_related) & F.col("is_related") & ~F.col("is_excluded")))


def summary_distribution(decisions: DataFrame) -> DataFrame:
    """Counts and population by kind and, kind null, in total."""
    n = lambda c, name: F.count_if(c).alias(name)
    return decisions.rollup(E, "kind").agg(
        n(~F.col("is_excluded"), "included"), n(F.col("is_key"), "key_items"), n(F.col("is_representative") & ~F.col("is_key"), "representative"), n(F.col("is_related"), "related"),
        n(F.col("is_excluded"), "excluded"), n(F.col("is_final"), "final"), F.sum(F.when(~F.col("is_excluded"), F.col("balance"))).alias("population"),
    ).where(F.col(E).isNotNull())


def merge_kinds(decisions: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """One row per party of both kinds: flags of either, balances and total, excluded only if the other side's balance is
    0, the reply's status (미회신 without one), and its place: final first, excluded last, larger totals first."""
    flags = ["is_key", "is_representative", "is_related", "is_final"]
    one = lambda k: decisions.where(F.col("kind") == k).select(E, "party", F.col("balance").alias(k), F.col("is_excluded").alias(f"x_{k}"), *(F.col(f).alias(f"{f}_{k}") for f in flags))
    nought = F.lit(0).cast("decimal(38,2)")
    both = one("receivable").join(one("payable"), [E, "party"], "full").withColumns({k: F.coalesce(k, nought) for k in ("receivable", "payable")})
    no = F.lit(False)
    either = lambda f: (F.coalesce(f"{f}_receivable", no) | F.coalesce(f"{f}_payable", no)).alias(f)
    out_x = (F.coalesce("x_receivable", no) & (F.col("payable") == 0)) | (F.coalesce("x_payable", no) & (F.col("receivable") == 0))
    merged = both.select(E, "party", "receivable", "payable", (F.col("receivable") + F.col("payable")).alias("total"), out_x.alias("is_excluded"), *map(either, flags))
    if replies is not None:
        merged = merged.join(replies.select(E, "party", F.col("status").alias("reply_status")), [E, "party"], "left").fillna({"reply_status": "미회신"})
    order = W.partitionBy(E).orderBy(F.desc("is_final"), "is_excluded", F.desc("total"), "party")
    return merged.withColumn("place", F.row_number().over(order))


def key_item_matrix(ledger: DataFrame, groups: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """Final parties by account group of both kinds: a column for each group, the sum, and the flags of either kind."""
    flags = ["is_key", "is_representative", "is_related", "is_final"]
    final = merge_kinds(decisions).where("is_final").select(E, "party", *flags)
    wide = party_groups(ledger, groups).join(final.select(E, "party"), [E, "party"], "left_semi").groupBy(E, "party").pivot("account_group", columns).sum("amount")
    wide = wide.fillna(0, columns)
    return wide.withColumn("total", sum((F.col(f"`{c}`") for c in columns), F.lit(0).cast("decimal(38,2)"))).join(final, [E, "party"])


def send_list(decisions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Final parties of a kind by balance with their contact, numbered, and whether that is complete (e-mail or phone);
    row 0 is the total."""
    ranked = decisions.where("is_final").withColumn("no", F.row_number().over(W.partitionBy(E, "kind").orderBy(F.desc("balance"), "party")))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rows = ranked.join(contacts.select(E, "party", "email", "phone"), [E, "party"], "left").select(E, "kind", "no", "party", "balance", "email", "phone", F.when(filled("email") | filled("phone"), "완료").otherwise("미완료").alias("contact"))
    total = rows.groupBy(E, "kind").agg(F.sum("balance").alias("balance")).select(E, "kind", F.lit(0).alias("no"), F.lit("합계").alias("party"), "balance", *(F.lit(None).cast("string").alias(c) for c in ("email", "phone", "contact")))
    return rows.unionByName(total)
