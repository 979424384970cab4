"""Readers, column mapping and normalisation of ledgers, trial balances, guides, prices and yield tables; result sinks."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.sources.archives import ArchiveSource

#: Header keywords of ledger fields, in order of preference.
LEDGER_KEYWORDS = {
    "code": ["거래처코드", "고객코드", "공급업체코드", "vendorcode", "customercode", "vendor code", "customer code", "party code", "bp code", "code", "코드"],
    "party": ["거래처명", "고객명", "공급업체명", "vendorname", "customername", "vendor name", "customer name", "company name", "party name", "bp name", "name", "명"],
    "account_code": ["계정과목코드", "계정코드", "accountcode", "gl account code", "account code", "gl code", "gl account", "계정과목", "account"],
    "account_name": ["계정과목명", "계정명", "accountname", "gl account name", "account name", "account description"],
    "currency": ["통화", "currency", "ccy", "curr"],
    "beginning": ["기초", "기초잔액", "전기말", "beginningbalance", "openingbalance", "opening balance", "opening", "beginning balance", "beg balance", "beg bal"],
    "change": ["증감", "증감액", "당기증감", "change", "movement", "net change", "net movement"],
    "ending": ["기말", "잔액", "기말잔액", "당기말", "endingbalance", "closingbalance", "closing balance", "closing", "ending balance", "end balance", "end bal", "balance"],
}
GL_REQUIRED = ("entry_no", "entry_date", "account_code")
TOTAL_ASSETS = ("자산총계", "자산 총계", "총자산", "total assets")
#: Words of a statement's header for its items, its amounts, and the amounts of the current period.
ITEM_WORDS, VALUE_WORDS, CURRENT_WORDS = ("항목", "계정", "item", "account", "과목"), ("금액", "잔액", "value", "amount", "balance"), ("당기", "기말", "current", "ending")
YEAR_TOKEN = r"(?i)^\s*(?:(\d+(?:\.\d+)?)\s*(?:Y|년))?\s*(?:(\d+(?:\.\d+)?)\s*(?:M|개월))?\s*$"


def read_gl(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Ledger files of one format, each by Spark's reader, united by column name; missing columns are null. Of zip archives the
    csv and txt members are read, all fields as text."""
    if fmt == "zip":
        spark.dataSource.register(ArchiveSource)
        return spark.read.format(ArchiveSource.name()).options(paths=json.dumps(list(paths)), **options).load()
    read = {"csv": spark.read.option("header", True).csv, "txt": spark.read.option("header", True).option("sep", "\t").csv, "parquet": spark.read.parquet, "json": spark.read.json}[fmt]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read(p, **options) for p in paths))


def suggest_mapping(columns: list[str], keywords: dict[str, list[str]] | None = None, override: dict[str, str] | None = None) -> dict[str, str | None]:
    """field -> column: for the first keyword, in order, that equals or is part of a header, without spaces and case, the
    first such column; a column may serve several fields; `override` wins. Metadata only."""
    bare = lambda x: x.strip().lower().replace(" ", "")
    plain = [(c, bare(c)) for c in columns]
    fields = (LEDGER_KEYWORDS if keywords is None else keywords).items()
    found = {name: next((c for w in words for c, h in plain if bare(w) in h), None) for name, words in fields}
    return found | (override or {})


def apply_mapping(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(f) for f, c in mapping.items()))


def preview(df: DataFrame, n: int = 10, required: tuple[str, ...] = GL_REQUIRED) -> dict:
    """The first n rows, the number of rows, and the required fields without a column."""
    return {"rows": df.limit(n), "total": df.count(), "missing": [c for c in required if c not in df.columns]}


def preview_table(df: DataFrame, n: int = 10, required: tuple[str, ...] = GL_REQUIRED) -> DataFrame:
    """preview's figures as one row: total rows, rows shown, required fields without a column."""
    missing = ",".join(c for c in required if c not in df.columns)
    return df.agg(F.count("*").alias("total")).select("total", F.least(F.lit(n).cast("long"), F.col("total")).alias("shown"), F.lit(missing).alias("missing"))


def filled(c: str) -> Column:
    """Text without the ways of writing nothing."""
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "NaN", "None", "NaT"), t)


def normalize_gl(raw: DataFrame, amount_unit: int = 1, pad: int = 0, dr_cr: str = "split") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): typed ledger lines, and rows without a required field, with the reason.

    Dates and amounts are cast, amounts scaled, codes padded left with zeros to `pad`. dr_cr: split (debit_amount,
    credit_amount), single_signed (amount: above 0 is debit) or single_indicator (amount, indicator D or C). A line
    without a user is the system's: SYSTEM-{entry_type}.
    """
    typed = cleaned(raw, amount_unit, pad, dr_cr)
    return typed.where("reason = ''").drop("reason"), typed.where("reason != ''")


def cleaned(raw: DataFrame, amount_unit: int, pad: int, dr_cr: str) -> DataFrame:
    """Typed ledger lines, with the required fields that they lack as `reason`. All fields of a line are made in one array
    of one struct, whose inlining is a step that the optimiser doesn't fold into what reads it, so each is made once."""
    amount = lambda c: F.coalesce(F.translate(filled(c), ",", "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")) * amount_unit
    nought = F.lit(0).cast("decimal(20,2)")
    if dr_cr == "split":
        debit, credit = amount("debit_amount"), amount("credit_amount")
    elif dr_cr == "single_signed":
        debit, credit = F.greatest(amount("amount"), nought), F.greatest(-amount("amount"), nought)
    else:
        is_debit = F.upper(filled("indicator")).isin("D", "S", "차변")
        debit, credit = F.when(is_debit, amount("amount")).otherwise(nought), F.when(is_debit, nought).otherwise(amount("amount"))
    code = filled("account_code")
    code = F.when(F.length(code) < pad, F.lpad(code, pad, "0")).otherwise(code) if pad else code
    made = {
        "entry_no": filled("entry_no"), "entry_date": filled("entry_date").try_cast("date"), "posting_date": filled("posting_date").try_cast("date"), "account_code": code,
        "debit_amount": debit.cast("decimal(20,2)"), "credit_amount": credit.cast("decimal(20,2)"), "is_system_generated": filled("user_id").isNull(), "user_id": F.coalesce(filled("user_id"), F.concat(F.lit("SYSTEM-"), F.coalesce(filled("entry_type"), F.lit("")))),
    }
    rest = [c for c in raw.columns if c not in made]
    typed = raw.select(*(F.col(f"`{c}`") for c in rest), F.inline(F.array(F.struct(*(x.alias(c) for c, x in made.items())))))
    return typed.withColumn("reason", F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in GL_REQUIRED)))


def account_sign(code: Column) -> Column:
    """1 for codes that start with 1 or 9 after leading zeros, -1 for others."""
    return F.when(F.regexp_extract(code, "^0*(.)", 1).isin("1", "9"), 1).otherwise(-1)


def last_of(df: DataFrame, keys: list[str], row_no: str) -> DataFrame:
    """The last row, by row_no, of each key."""
    return df.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(row_no)))).where("_last = 1").drop("_last")


def coded(df: DataFrame) -> DataFrame:
    """Rows whose `account` text is a code and a name, with both apart."""
    pattern = r"^\s*(\d+)\s+(.+)$"
    return df.where(F.col("account").rlike(pattern)).withColumn("account_code", F.regexp_extract("account", pattern, 1)).withColumn("account_name", F.trim(F.regexp_extract("account", pattern, 2)))


def load_tb_positional(df: DataFrame, keys: list[str] | None = None, row_no: str | None = None) -> DataFrame:
    """Trial-balance sheet without headers, columns c0 to c5 by position: code and name, opening, unused, closing, debit
    and credit so far; movements absolute, other rows dropped. With row_no the last row of a repeated code (within keys)
    stays. The opening is left to merge_opening_closing."""
    num = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    rows = coded(df.withColumn("account", F.col("c0")))
    rows = last_of(rows, [*(keys or []), "account_code"], row_no) if row_no else rows
    keep = [*(keys or []), *([row_no] if row_no else [])]
    return rows.select(*keep, "account_code", "account_name", F.abs(num("c4")).alias("period_debit"), F.abs(num("c5")).alias("period_credit"), num("c3").alias("closing"))


def pick_opening_closing(names: list[str]) -> tuple[str | None, str | None]:
    """(opening, closing) sheet or file of a list of names, in their order: the first one dated in months up to 3 and from
    10, or, without a date, named 기초 and 기말; if neither is found the first and the last one, a single one being the
    closing."""
    opening = closing = None
    for name in names:
        dated = re.search(r"(\d{4})[./\-](\d{1,2})", name)
        month = int(dated[2]) if dated else None
        if opening is None and (month <= 3 if dated else "기초" in name):
            opening = name
        elif closing is None and (month >= 10 if dated else "기말" in name):
            closing = name
    if opening is None and closing is None and names:
        opening, closing = (names[0] if len(names) > 1 else None), names[-1]
    return opening, closing


def load_tb_split(df: DataFrame, keys: list[str] | None = None, row_no: str | None = None) -> DataFrame:
    """Trial balance with `account` text (code and name), opening, debit, credit, closing, or closing_parts to sum: signed
    by code, movements absolute, a missing closing rolled forward; both balances also split by side. Other rows drop; with
    row_no the last row of a repeated code (within keys) stays."""
    num = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    rows = coded(df)
    rows = last_of(rows, [*(keys or []), "account_code"], row_no) if row_no else rows
    sign = account_sign(F.col("account_code"))
    rows = rows.withColumn("o", num("opening") * sign).withColumn("d", F.abs(num("debit"))).withColumn("c", F.abs(num("credit")))
    parts = F.aggregate("closing_parts", F.lit(0).cast("decimal(20,2)"), lambda s, x: (s + x).cast("decimal(20,2)")) if "closing_parts" in df.columns else F.lit(None).cast("decimal(20,2)")
    closing = F.coalesce(F.when(F.col("closing").isNotNull(), num("closing") * sign), parts * sign, F.col("o") + F.col("d") - F.col("c"))
    rows = rows.withColumn("z", closing)
    nought = F.lit(0)
    side = lambda c, n: [F.greatest(F.col(c), nought).alias(f"{n}_dr"), F.greatest(-F.col(c), nought).alias(f"{n}_cr")]
    keep = [c for c in df.columns if c not in ("account", "opening", "debit", "credit", "closing", "closing_parts")]
    return rows.select(*keep, "account_code", "account_name", F.col("o").alias("opening"), F.col("d").alias("period_debit"), F.col("c").alias("period_credit"), F.col("z").alias("closing"), *side("o", "opening"), *side("z", "closing"))


def join_headers(top: list[str | None], sub: list[str | None]) -> list[str]:
    """Two header rows as one: the upper filled forward, joined by _."""
    out, last = [], ""
    for a, b in zip(top, sub):
        last = a or last
        out.append(f"{last}_{b}" if b else last)
    return out


def load_tb_multiheader(df: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("engagement_id",)) -> DataFrame:
    """Trial balance of two header rows (see join_headers): code of digits only and at least 4, opening and closing debit
    less credit; of a code repeated in a sheet of the same `keys` (a client's file) the last row stays. columns: code, name, dr_open, dr, dr_close, cr_open, cr, cr_close."""
    num = lambda k: F.coalesce(F.regexp_replace(F.col(f"`{columns[k]}`").cast("string"), ",", "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    code = F.regexp_replace(F.col(f"`{columns['code']}`").cast("string"), "[^0-9]", "")
    rows = df.withColumn("account_code", code).where(F.length("account_code") >= 4)
    last = F.row_number().over(W.partitionBy(*keys, "sheet", "account_code").orderBy(F.desc("row_no")))
    out = rows.withColumn("_r", last).where("_r = 1")
    return out.select(*keys, "sheet", "account_code", F.col(f"`{columns['name']}`").alias("account_name"), (num("dr_open") - num("cr_open")).alias("opening"), num("dr").alias("period_debit"), num("cr").alias("period_credit"), (num("dr_close") - num("cr_close")).alias("closing"))


def tb_current_prior(df: DataFrame, sheet: str = "sheet", keys: tuple[str, ...] = ("engagement_id",)) -> tuple[DataFrame, DataFrame]:
    """For each client (keys) the rows of the sheet with the last name, and of the one before it."""
    names = df.select(*keys, sheet).distinct().withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(sheet))))  # a row a sheet
    ranked = df.join(names, [*keys, sheet]).select(*df.columns, "_r")
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r = 2").drop("_r")


def merge_opening_closing(close: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """The closing file with the prior file's closing as opening, 0 without one; codes only there stay with no movement."""
    old = open_.select(*keys, F.col("closing").alias("_o"), F.col("account_name").alias("_n"))
    nought = F.lit(0).cast("decimal(20,2)")
    j = close.drop("opening").join(old, keys, "full")
    return j.select(*keys, F.coalesce("account_name", "_n").alias("account_name"), F.coalesce("_o", nought).alias("opening"), *(F.coalesce(c, nought).alias(c) for c in ("period_debit", "period_credit", "closing")))


def load_party_ledger(df: DataFrame) -> DataFrame:
    """Ledger rows with a party; no currency is KRW, no amount 0; unreadable amounts drop the row."""
    text = lambda c: F.regexp_replace(filled(c), ",", "")
    rows = df.withColumn("party", filled("party")).where("party is not null").withColumn("currency", F.coalesce(F.upper(filled("currency")), F.lit("KRW")))
    for c in ("beginning", "change", "ending"):
        rows = rows.where(text(c).isNull() | text(c).try_cast("decimal(20,2)").isNotNull()).withColumn(c, F.coalesce(text(c).try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")))
    return rows


def fs_columns(headers: list[str]) -> tuple[str | None, str | None]:
    """The columns of a statement's items and amounts, by their headers: the first one named like items; of those named like
    amounts the first of the current period, else the last one. None where no header fits."""
    plain = {h: h.strip().lower().replace(" ", "") for h in headers}
    holds = lambda words: [h for h in headers if any(w in plain[h] for w in words)]
    amounts = holds(VALUE_WORDS)
    current = [h for h in amounts if h in holds(CURRENT_WORDS)]
    return next(iter(holds(ITEM_WORDS)), None), next(iter(current or amounts[::-1]), None)


def load_fs_amounts(df: DataFrame, keys: list[str], headers: bool = False) -> DataFrame:
    """item -> value of a statement (item, value, row_no), the last row with a number of a repeated item. With `headers` the
    columns of items and amounts are found by fs_columns."""
    if headers:
        item, value = fs_columns([c for c in df.columns if c not in (*keys, "row_no")])
        if item is None or value is None:
            raise ValueError("no column of items or of amounts")
        df = df.select(*keys, "row_no", F.col(f"`{item}`").alias("item"), F.col(f"`{value}`").alias("value"))
    last = F.row_number().over(W.partitionBy(*keys, "item").orderBy(F.desc("row_no")))
    return df.withColumn("item", filled("item")).where("item is not null and value is not null").withColumn("_r", last).where("_r = 1").select(*keys, "item", "value")


def total_assets(fs: DataFrame, keys: list[str]) -> DataFrame:
    """The total's value, by the first of its names that a statement has; else current plus non-current assets, each 0 where
    missing."""
    pick = lambda *names: F.coalesce(*(F.max(F.when(F.lower("item") == n, F.col("value"))) for n in names))
    parts = F.coalesce("c", F.lit(0)) + F.coalesce("n", F.lit(0))
    return fs.groupBy(*keys).agg(pick(*TOTAL_ASSETS).alias("t"), pick("유동자산", "current assets").alias("c"), pick("비유동자산", "non-current assets").alias("n")).select(*keys, F.coalesce("t", parts).alias("total_assets"))


def explode_upload_guide(df: DataFrame) -> DataFrame:
    """Guide rows (party, account, currency, amount, currency2, amount2) as one row for each amount that isn't 0: the first
    needs an account, and is KRW without a currency; the second needs a currency, and shares the account, which may be
    blank. Rows without a party are left out; amounts may be text with commas, unreadable ones are 0."""
    amount = lambda a: F.coalesce(F.regexp_replace(F.col(a).cast("string"), ",", "").try_cast("double"), F.lit(0.0))
    made = lambda c, a, n: F.struct(F.coalesce(F.upper(filled(c)), F.lit("KRW")).alias("currency"), amount(a).alias("amount"), F.lit(n).alias("pos"))
    one = F.when(filled("account").isNotNull() & (amount("amount") != 0), made("currency", "amount", 1))
    two = F.when(filled("currency2").isNotNull() & (amount("amount2") != 0), made("currency2", "amount2", 2))
    return df.where(filled("party").isNotNull()).select(filled("party").alias("party"), F.coalesce(filled("account"), F.lit("")).alias("account"), F.inline(F.array_compact(F.array(one, two))))


def excluded_parties(df: DataFrame) -> DataFrame:
    """The guide's list of parties that get no letter (party, account, currency, amount, kind): blanks for missing texts, 0
    for missing or unreadable amounts; rows without a party are left out. Missing columns are blank."""
    text = lambda c: F.coalesce(filled(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
    amount = F.coalesce(F.regexp_replace(F.col("amount").cast("string"), ",", "").try_cast("double"), F.lit(0.0)) if "amount" in df.columns else F.lit(0.0)
    return df.where(filled("party").isNotNull()).select(*([F.col("engagement_id")] if "engagement_id" in df.columns else []), text("party"), text("account"), text("currency"), amount.alias("amount"), text("kind"))


def unpivot_prices(df: DataFrame, date: str = "date") -> DataFrame:
    """Date by ticker columns to rows; blanks and what isn't a number are left out."""
    tickers = [c for c in df.columns if c != date]
    values = F.array(*(F.col(f"`{c}`").cast("string") for c in tickers))
    # one array a row, however many tickers there are
    long = df.select(F.col(date), F.inline(F.arrays_zip(F.array(*map(F.lit, tickers)).alias("ticker"), values.alias("raw"))))
    return long.withColumn("close", F.translate(F.trim("raw"), ",", "").try_cast("double")).where("close is not null").select("ticker", date, "close")


def unpivot_price_sheets(sheets: DataFrame, headers: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """unpivot_prices for any number of wide tables at once: sheets has their rows (keys, date, and a column a place),
    headers one row a sheet (keys) with the ticker of each place, null where it has none. The tickers may be as many as
    they like, since a sheet's places alone are columns."""
    places = [c for c in headers.columns if c not in keys]
    row = lambda name: F.array(*(F.col(f"`{c}`").cast("string") for c in places)).alias(name)
    both = sheets.select(*keys, date, row("raw")).join(headers.select(*keys, row("ticker")), keys)
    long = both.select(date, F.inline(F.arrays_zip("ticker", "raw")))
    return long.withColumn("close", F.translate(F.trim("raw"), ",", "").try_cast("double")).where("close is not null and ticker is not null").select("ticker", date, "close")


def years_of(token: Column) -> Column:
    """Years of 3M, 1.5Y, 1Y6M, 3개월, 1년; else null."""
    y, m = (F.regexp_extract(token, YEAR_TOKEN, i).try_cast("double") for i in (1, 2))
    return F.when(y.isNotNull() | m.isNotNull(), F.coalesce(y, F.lit(0.0)) + F.coalesce(m, F.lit(0.0)) / 12)


def yield_rows(cells: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Points (keys, label, subtype, category, t, y) of published tables given as cells (keys, row_no, col_no, value).

    The header of a table is its first row with at least `least` maturities; without one, rows and columns change
    places. The columns before the first maturity are labels, filled down: the first is the category, the second the
    subtype, the last the label; series without a label, and values that aren't numbers, are left out. All of it is
    joins and windows by table, so any number of tables is read at once.
    """
    token = cells.select(*keys, "row_no", "col_no", F.trim(F.col("value").cast("string")).alias("value")).withColumn("years", years_of(F.col("value")))
    rows = token.groupBy(*keys, "row_no").agg(F.count("years").alias("n")).where(F.col("n") >= least).groupBy(*keys).agg(F.min("row_no").alias("head"))
    columns = token.groupBy(*keys, "col_no").agg(F.count("years").alias("n")).where(F.col("n") >= least).groupBy(*keys).agg(F.min("col_no").alias("head"))
    straight = token.join(rows, keys)
    turned = token.join(rows, keys, "left_anti").join(columns, keys).select(*keys, F.col("col_no").alias("row_no"), F.col("row_no").alias("col_no"), "value", "years", "head")
    table = straight.unionByName(turned)
    terms = table.where("row_no = head and years is not null").select(*keys, "col_no", F.col("years").alias("t"))
    first = terms.groupBy(*keys).agg(F.min("col_no").alias("first"))
    body = table.where("row_no > head").join(first, keys)
    down = W.partitionBy(*keys, "col_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    said = F.when(~F.col("value").isin("", "-"), F.col("value"))
    labels = body.where("col_no < first").withColumn("text", F.last(said, True).over(down))
    at = lambda i: F.max(F.when(i, F.col("text")))
    c = F.col("col_no") - F.min("col_no").over(W.partitionBy(*keys))
    named = labels.withColumn("_c", c).groupBy(*keys, "row_no").agg(at(F.col("_c") == 0).alias("category"), at(F.col("_c") == 1).alias("subtype"), at(F.col("col_no") == F.col("first") - 1).alias("label"))
    y = F.regexp_replace("value", ",", "").try_cast("double")
    points = body.join(terms, [*keys, "col_no"]).withColumn("y", y).where("y is not null").join(named.where("label is not null"), [*keys, "row_no"])
    return points.select(*keys, "row_no", "category", "subtype", "label", "t", "y")


def unpivot_yield_matrix(df: DataFrame, labels: list[str], row_no: str = "row_no", keys: list[str] | None = None) -> DataFrame:
    """Yield table with label columns (filled down) and a column for each maturity to label, subtype, t, y points; other
    columns and values that aren't numbers are left out. `keys` tell many tables apart; without them df is one published
    table, which one task fills down."""
    keys = keys or []
    terms = [c for c in df.columns if c not in labels and c != row_no and c not in keys]
    w = W.partitionBy(*keys).orderBy(row_no).rowsBetween(W.unboundedPreceding, 0)
    down = df.select(*keys, row_no, *(F.last(filled(c), True).over(w).alias(c) for c in labels), *(F.col(f"`{c}`").cast("string").alias(c) for c in terms))
    long = down.unpivot([*keys, row_no, *labels], terms, "term", "raw").withColumn("t", years_of(F.col("term"))).withColumn("y", F.regexp_replace(F.trim("raw"), ",", "").try_cast("double"))
    return long.where("t is not null and y is not null").select(*keys, *labels, "t", "y")


def merge_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Points (source, keys, t, y): per key those of the source with most points, of equal ones the first."""
    n = series.groupBy(*keys, "source").agg(F.count("*").alias("n"))
    best = n.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "source"))).where("_r = 1").select(*keys, "source")
    return series.join(best, [*keys, "source"])


def union_listings(sources: list[DataFrame]) -> DataFrame:
    """Symbols of several exchanges in order of priority: blank ones drop, a repeated one keeps the first."""
    every = reduce(DataFrame.unionByName, (s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources))).withColumn("symbol", filled("symbol")).where("symbol is not null")
    return every.groupBy("symbol").agg(F.min_by("name", F.struct("priority", "name")).alias("name"), F.min("priority").alias("priority"))


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("engagement_id", "rule_code"), mode: str = "error") -> None:
    """A result table in folders by engagement and rule; Spark's writers have no row limit."""
    df.write.mode(mode).partitionBy(*by).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
