"""Fields of reply texts as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Patterns with weights by form, thresholds and divisors of their scores.
FORMS = {
    "kr_standard": ([("채권채무조회서", 2.0), (r"당사\[", 1.5), (r"귀사\[", 1.5), ("확인통지", 1.0), (r"받을\s*금액", 0.8), (r"지급할\s*금액", 0.8), ("계정과목", 0.5), ("감사인명", 0.5), ("발송금액", 0.8), ("일치여부", 0.8)], 4.0, 8.0),
    "en_standard": ([("Confirmation of Accounts", 2.0), (r"TO\s*:", 1.5), ("Receivable", 0.5), ("Payable", 0.5), ("Accounting Firm", 0.8), ("Our Amount", 0.8), ("Your Amount", 0.8), (r"as per\s+\d{4}", 0.5)], 3.5, 7.0),
    "email_freeform": ([(r"^From\s*:", 2.0), (r"^To\s*:", 1.0), (r"^Subject\s*:", 1.5), (r"^Date\s*:", 0.5)], 2.5, 5.0),
}
#: Currency codes and signs, and those that another code stands for.
CURRENCIES = r"(KRW|USD|EUR|JPY|CNY|RMB|SGD|AUD|MYR|THB|\$|￥|¥|€)"
CURRENCY_OF = {"RMB": "CNY", "$": "USD", "￥": "JPY", "¥": "JPY", "€": "EUR"}
NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: Account names of a balance line, and the endings of others.
#: Account names with a bracket.
BRACKETED = r"외상매입금\(관계사\)|외상매입금\(국외\)|미지급금\(국외\)"
ACCOUNTS = "외상매출금|받을어음|미수금|선급금|장기대여금|임차보증금|기타채권|외상매입금|미지급금|지급어음|선수금|임대보증금|외담대미지급금"
ACCOUNT_ENDINGS = "채권|어음|지급금|매출금|매입금|수금|급금|보증금|대여금"
#: What a cell says for a match and against it, by form.
STATED = {
    "kr_standard": (["일치", "○", "O", "✓"], ["불일치", "×", "X", "✗"]),
    "en_standard": (["agree", "match", "confirmed", "yes", "✓"], ["disagree", "mismatch", "discrepancy", "no", "×"]),
    "email_freeform": (["일치", "agree", "match"], ["불일치", "disagree", "mismatch"]),
}
#: Headers of reply tables by form: statement, reply and sent amount; and texts above either section.
HEADERS = {
    "kr_standard": (["일치여부", "확인"], ["회신금액", "회신 금액"], ["발송금액", "발송 금액"]),
    "en_standard": (["Match", "Status", "Agree", "Confirm"], ["Your Amount", "Confirmed Amount", "Reply Amount"], ["Our Amount", "Sent Amount", "Book Amount"]),
    "email_freeform": (["일치여부", "Match", "Status"], ["회신금액", "Your Amount", "Amount"], ["발송금액", "Our Amount"]),
}
SECTIONS = {
    "kr_standard": (r"받을\s*금액|채권", r"지급할\s*금액|채무"),
    "en_standard": ("Receivable", "Payable"),
    "email_freeform": (r"받을\s*금액|Receivable", r"지급할\s*금액|Payable"),
}
TOTAL_ROW = r"^\s*(합계|TOTAL|Total|total)\s*$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def form_score(text: Column, form: str) -> Column:
    return sum((F.when(text.rlike(f"(?im){p}"), w).otherwise(0.0) for p, w in FORMS[form][0]), F.lit(0.0))


def classify_form(df: DataFrame, text: str = "text", filename: str | None = None, headers: str | None = None) -> DataFrame:
    """df with form and form_confidence: under 100 characters the text needs OCR (0.95); else the form whose weighted
    patterns reach its threshold, Korean before English before e-mail; below, the best of Korean and English at 0.5 at
    most; else unknown. A file name that tells of a confirmation adds to Korean; so does each table header (`headers`:
    an array, a text a table) with account and statement, and one with account and amount to English."""
    t = F.col(text)
    named = F.when(F.lower(filename).rlike("cc-|채권|채무|조회서"), 0.5).otherwise(0.0) if filename else F.lit(0.0)
    heads = F.coalesce(F.transform(headers, lambda h: F.lower(F.coalesce(h, F.lit("")))), F.array().cast("array<string>")) if headers else F.array().cast("array<string>")
    korean = lambda h: h.contains("계정과목") & h.contains("일치여부")
    of_kr = F.size(F.filter(heads, korean)) * 1.5
    of_en = F.size(F.filter(heads, lambda h: ~korean(h) & h.contains("account") & h.contains("amount"))) * 1.0
    s = df.withColumns({"_kr": F.round(form_score(t, "kr_standard") + named + of_kr, 4), "_en": F.round(form_score(t, "en_standard") + of_en, 4), "_em": F.round(form_score(t, "email_freeform"), 4)})
    kr, en, em = F.col("_kr"), F.col("_en"), F.col("_em")
    conf = lambda c, form, most: F.least(F.lit(most), c / FORMS[form][2])
    cases = [
        (F.length(F.trim(t)) < 100, "ocr_required", F.lit(0.95)),
        ((kr >= 4.0) & (kr >= en), "kr_standard", conf(kr, "kr_standard", 1.0)),
        ((en >= 3.5) & (en > kr), "en_standard", conf(en, "en_standard", 1.0)),
        ((em >= 2.5) & (em > kr) & (em > en), "email_freeform", conf(em, "email_freeform", 1.0)),
        ((kr > 0) & (kr >= en) & (kr >= em), "kr_standard", conf(kr, "kr_standard", 0.5)),
        ((en > 0) & (en >= em), "en_standard", conf(en, "en_standard", 0.5)),
    ]
    form, confidence = F.lit("unknown"), F.lit(0.0)
    for condition, name, c in reversed(cases):
        form, confidence = F.when(condition, name).otherwise(form), F.when(condition, c).otherwise(confidence)
    return s.withColumn("form", form).withColumn("form_confidence", F.round(confidence, 3)).drop("_kr", "_en", "_em")


def number(raw: Column) -> Column:
    """A number with commas; in brackets it is negative."""
    bare = F.regexp_replace(raw, r"[（）()\s,，]", "").try_cast("double")
    return F.when(F.trim(raw).rlike("^[(（]"), -bare).otherwise(bare)


def amount_of(t: Column) -> Column:
    """The number after a currency code or sign; without any, the first number of at least 1."""
    coded = rf"(?i){CURRENCIES}\s*([\d,]+(?:\.\d+)?)"
    first = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"([\d,]+(?:\.\d+)?)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").try_cast("double")), lambda v: v >= 1)
    return F.when(t.rlike(coded), number(F.regexp_extract(t, coded, 2))).otherwise(F.get(first, 0))


def currency_of(t: Column) -> Column:
    """The code of the first currency before a number: signs and RMB as the codes they stand for; KRW without one."""
    found = F.upper(F.nullif(F.regexp_extract(t, rf"(?i){CURRENCIES}\s*[\d,]", 1), F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in CURRENCY_OF.items() for x in kv])
    return F.coalesce(F.element_at(known, found), found, F.lit("KRW"))


def parse_amount(text: str) -> Column:
    return amount_of(F.col(text))


def parse_currency(text: str) -> Column:
    return currency_of(F.col(text))


def largest_number(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").try_cast("double")))


def day(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def period_end(text: str) -> Column:
    """The date before 현재, else after `as per`."""
    ko, en = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일\s*현재", r"(?i)as per\s+(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    return F.coalesce(*(day(*(F.regexp_extract(text, p, i) for i in (1, 2, 3))) for p in (ko, en)))


def since(t: Column, marks: tuple[str, ...]) -> Column:
    """The text from the first of `marks` that it holds, in their order; all of it without any."""
    out = t
    for mark in reversed(marks):
        at = F.regexp_instr(t, F.lit(mark))
        out = F.when(at > 0, F.substring(t, at, F.lit(2**31 - 1))).otherwise(out)
    return out


def reply_date(text: str, end: str) -> Column:
    """The last date from 확인통지 (else from the English signature line) on, or anywhere without one there, that isn't the
    period's end; four ways of writing. Years of dates in figures lie in 2000 to 2100."""
    t = F.col(text)
    zone = since(t, ("확인통지", "(?i)Signature and Company"))
    any_date = r"(\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일|\d{4}[-./]\s*\d{1,2}[-./]\s*\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})"

    def read(s: Column) -> Column:
        p = F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))
        first = F.length(p[0]) == 4
        year = F.when(first, p[0]).otherwise(p[2])
        made = F.when(first, day(p[0], p[1], p[2])).otherwise(day(p[2], p[0], p[1]))
        return F.when(s.contains("년") | year.between("2000", "2100"), made)

    dates = lambda z: F.filter(F.transform(F.regexp_extract_all(z, F.lit(any_date), F.lit(1)), read), lambda d: d.isNotNull() & (F.col(end).isNull() | (d != F.col(end))))
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.coalesce(last(dates(zone)), last(dates(t)))


def evidence_date(text: str) -> Column:
    """The first date of a piece of evidence: year first in figures, else a month's name first (APR.02,2025), else a day
    first (02 APR 2025); years 2000 to 2099."""
    t = F.col(text)
    name = f"({'|'.join(MONTHS)})[a-z]*"
    month = lambda c: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3))).cast("string")
    ways = [
        (r"(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})", lambda a, b, c: day(a, b, c)),
        (rf"(?i)\b{name}[.\s]*(\d{{1,2}})\s*,?\s*(\d{{4}})", lambda a, b, c: day(c, month(a), b)),
        (rf"(?i)\b(\d{{1,2}})[\s.\-]*{name}[\s.,\-]*(\d{{4}})", lambda a, b, c: day(c, month(b), a)),
    ]
    found = [make(*(F.regexp_extract(t, p, i) for i in (1, 2, 3))) for p, make in ways]
    return F.coalesce(*(F.when(F.year(d).between(2000, 2099), d) for d in found))


def extract_party(text: str) -> Column:
    """The name in 귀사[...], before 귀중 or 귀하, or after TO:, of 2 to 80 characters and no title."""
    t = F.col(text)
    fit = lambda a: F.get(F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: (F.length(s) >= 2) & (F.length(s) <= 80) & ~s.rlike("조회서|확인통지")), 0)
    every = lambda p: fit(F.regexp_extract_all(t, F.lit(p), F.lit(1)))
    return F.coalesce(every(r"귀사\[([^\]]+)\]"), every(r"(?m)^(.+?)\s+(?:귀중|귀하|貴下|貴中)"), F.rtrim(every(r"(?im)^TO\s*:\s*(.+?)\s+\d{4}"), F.lit(",")))


def party_of_folder(folder: str) -> Column:
    """BC-5,12_name: the name."""
    return F.nullif(F.regexp_extract(F.col(folder), r"^BC-[\d,]+_(.+)$", 1), F.lit(""))


def extract_balances(df: DataFrame, text: str = "text") -> DataFrame:
    """df with receivable and payable: maps of account to amount of the two sections, and their totals (the total line,
    else the sum); and balance: receivable, else payable total.

    A section starts at its Korean or English name; receivables end where payables follow, else at the signature, else
    with the text; payables at the signature. Accounts are the listed names and any other Hangul name with one of the
    known endings; of a repeated one the last amount counts, and amounts of 0 don't. If neither section says anything,
    receivable_total is the number after a balance word, else the first of at least five figures that is 10,000 or more.
    """
    t = F.col(text)
    at = lambda p: F.regexp_instr(t, F.lit(f"(?i){p}"))
    # each step is a column of its own, so none is read again by those after it
    df = df.withColumns({"_r": at(r"받을\s*금액|Receivable"), "_p": at(r"지급할\s*금액|Payable"), "_c": at("확인통지|Signature and Company")})
    r, p, c = F.col("_r"), F.col("_p"), F.col("_c")
    part = lambda a, b: F.when(b > 0, F.substring(t, a, b - a)).otherwise(F.substring(t, a, F.lit(2**31 - 1)))
    end = lambda a, *stops: F.coalesce(*(F.when(x > a, x) for x in stops), F.lit(0))
    df = df.withColumns({"_recv": F.when(r > 0, part(r, end(r, p, c))), "_payb": F.when(p > 0, part(p, end(p, c)))})
    amounts = lambda s, pattern, i: F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(i)), lambda n: F.regexp_replace(n, ",", "").try_cast("double"))

    line = rf"({BRACKETED}|{ACCOUNTS}|[가-힣]{{2,8}}(?:{ACCOUNT_ENDINGS}))\s+(?:KRW|USD|EUR|JPY|CNY|SGD|AUD|MYR|THB)?\s*([\d,]+(?:\.\d+)?)"

    def lines(s: str) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(s, F.lit(line), F.lit(1)).alias("k"), amounts(s, line, 2).alias("v"))
        return F.coalesce(F.filter(found, lambda e: e["v"] > 0), F.array().cast("array<struct<k:string,v:double>>"))

    def rows(kept: str) -> Column:
        keys = F.array_distinct(F.transform(kept, lambda e: e["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(kept, lambda e: e["k"] == k), -1)["v"].alias("value"))))

    total = lambda s: F.get(amounts(s, r"(?im)^(?:합계|TOTAL)\s+(?:KRW|USD|EUR|JPY|CNY)?\s*([\d,]+(?:\.\d+)?)", 1), 0)
    df = df.withColumns({"_rl": lines("_recv"), "_pl": lines("_payb"), "_rt": total("_recv"), "_pt": total("_payb")})
    out = df.withColumns({"receivable": rows("_rl"), "payable": rows("_pl")})
    word = r"(?i)(?:잔액|확인금액|Balance|금액|합계)[\s:：]*(?:KRW|USD|EUR|JPY|CNY|SGD|AUD|MYR|THB|\$|￥|¥|€)?\s*([\(（]?\s*[\d,]+(?:\.\d+)?\s*[\)）]?)"
    near = F.get(F.filter(F.transform(F.regexp_extract_all(t, F.lit(word), F.lit(1)), number), lambda v: F.abs(v) >= 1), 0)
    big = F.get(F.filter(amounts(t, r"([\d,]{5,}(?:\.\d+)?)", 1), lambda v: v >= 10_000), 0)
    silent = (F.size("receivable") == 0) & (F.size("payable") == 0) & F.col("_rt").isNull() & F.col("_pt").isNull()
    summed = lambda m: F.when(F.size(m) > 0, F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("receivable_total", F.when(silent, F.coalesce(near, big)).otherwise(F.coalesce("_rt", summed("receivable")))).withColumn("payable_total", F.coalesce("_pt", summed("payable")))
    return out.withColumn("balance", F.coalesce("receivable_total", "payable_total")).drop("_rt", "_pt", "_r", "_p", "_c", "_recv", "_payb", "_rl", "_pl")


def declared_match(text: str) -> Column:
    """불일치 or a discrepancy is false, 일치 standing alone is true, else null."""
    t = F.col(text)
    return F.when(t.rlike("불일치"), False).when(t.rlike(r"(^|\s)일치(\s|$)"), True).when(t.rlike("(?i)discrepan"), False)


def declared_cell(cell: Column, form: str | Column | None = None) -> Column:
    """A table cell's statement by the form's words, in any case and place; negative words first, a blank says nothing.
    form: a name, or a column of names, of which unknown ones read as the Korean standard; without it the words of all
    forms count."""
    low = F.lower(F.trim(cell))
    says = lambda words: reduce(or_, (low.contains(w.lower()) for w in dict.fromkeys(words)))
    read = lambda yes, no: F.when(low == "", None).when(says(no), False).when(says(yes), True)
    if form is None:
        return read(*([w for lists in STATED.values() for w in lists[i]] for i in (0, 1)))
    return by_form(form, {f: read(*STATED[f]) for f in STATED})


def by_form(form: str | Column, values: dict[str, Column]) -> Column:
    if isinstance(form, str):
        return values.get(form, values["kr_standard"])
    out = values["kr_standard"]
    for f in ("en_standard", "email_freeform"):
        out = F.when(form == f, values[f]).otherwise(out)
    return out


def overall_declared(cells: DataFrame, keys: list[str], text_match: str) -> DataFrame:
    """Per reply: false if any cell is, true if all that say something are, else what the text says."""
    g = cells.groupBy(*keys).agg(F.min("declared").alias("lowest"), F.first(text_match, True).alias("of_text"))
    return g.select(*keys, F.coalesce("lowest", "of_text").alias("declared_match"))


def table_cells(replies: DataFrame) -> DataFrame:
    """Rows below the header of reply tables (reply_id, rows: array of arrays, the first one the header; and where known
    table_no from 0, text, form): pos, cells, form, and the places of account, sent amount, statement and reply amount.

    Tables without an account column in the header are left out, and rows too short for the columns found. Without a
    reply column it is the third of an English table and the fourth of another, or the last one.

    Replies are dealt by id before they are read, as with_section's windows need them: few tasks would read a small file. Places
    are found once a table, before it becomes rows.
    """
    form = F.col("form") if "form" in replies.columns else F.lit("kr_standard")
    head = F.transform(F.col("rows")[0], lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    joined = F.array_join(head, " ")
    where = lambda words: F.get(F.filter(F.sequence(F.lit(0), F.size(head) - 1), lambda i: reduce(or_, (F.get(head, i).contains(w.lower()) for w in words))), 0)
    at = lambda k: by_form(form, {f: where(HEADERS[f][k]) for f in HEADERS})
    last = F.size(head) - 1
    english = joined.contains("account")
    fallback = F.least(F.when(english & (F.size(head) > 2), F.lit(2)).otherwise(F.lit(3)), last)
    keep = ["reply_id", *(c for c in ("table_no", "text") if c in replies.columns)]
    tables = replies.repartition("reply_id").where((F.size("rows") > 1) & (F.size(F.col("rows")[0]) > 0) & (joined.contains("계정과목") | english))
    placed = tables.select(*keep, form.alias("form"), F.coalesce(where(["계정과목", "Account"]), F.lit(0)).alias("_a"), at(2).alias("_s"), at(0).alias("_d"), F.coalesce(at(1), fallback).alias("_r"), "rows")
    placed = placed.select(*(c for c in placed.columns if c != "rows"), F.posexplode("rows").alias("pos", "cells"))
    need = F.greatest("_a", "_r", F.coalesce("_d", F.lit(0)), F.coalesce("_s", F.lit(0)))
    return placed.where((F.col("pos") > 0) & (F.size("cells") > need))


def with_section(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with the section they stand in: of a heading row above, which only names it, else of the text (receivable
    before payable), else by the table's place, the first one being receivables."""
    joined = F.array_join("cells", " ")
    named = by_form(F.col("form"), {f: F.when(joined.rlike(f"(?i){a}"), "receivable").when(joined.rlike(f"(?i){b}"), "payable") for f, (a, b) in SECTIONS.items()})
    heading = r"(?i)^\s*(받을\s*금액|지급할\s*금액|((trade|amount|accounts?)\s+)?(receivable|payable)s?)\s*$"
    mark = F.when(joined.rlike(heading), named)
    past = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    above = by_form(F.col("form"), {f: F.when(F.col("text").rlike(f"(?i){a}"), "receivable").when(F.col("text").rlike(f"(?i){b}"), "payable") for f, (a, b) in SECTIONS.items()}) if "text" in rows.columns else F.lit(None).cast("string")
    order = F.when(F.col("table_no") > 0, "payable").otherwise("receivable") if "table_no" in rows.columns else F.lit("receivable")
    return rows.withColumn("mark", mark).withColumn("section", F.coalesce(F.last("mark", True).over(past), above, order)).where("mark is null").drop("mark")


def parse_account_rows(replies: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of reply tables (see table_cells and with_section) as section, account, sent, declared, reply, currency and the
    account's group. Totals, rows without an account and unreadable cells are left out."""
    by = ["reply_id", *(["table_no"] if "table_no" in replies.columns else [])]
    rows = with_section(table_cells(replies), by)
    get = lambda c: F.trim(F.get("cells", F.col(c)))
    rows = rows.withColumn("account_name", get("_a")).where((F.coalesce("account_name", F.lit("")) != "") & ~F.col("account_name").rlike(rf"{TOTAL_ROW}|\(cid:"))
    rows = rows.select(*by, "pos", "section", "account_name", amount_of(get("_s")).alias("sent"), declared_cell(get("_d"), F.col("form")).alias("declared"), amount_of(get("_r")).alias("reply"), currency_of(F.coalesce(get("_r"), F.lit(""))).alias("currency"))
    g = groups.select(F.col("alias").alias("_k"), "account_group")
    return rows.join(g, F.lower("account_name") == F.col("_k"), "left").withColumn("account_group", F.coalesce("account_group", "account_name")).drop("_k")


def parse_total_rows(replies: DataFrame) -> DataFrame:
    """(reply_id, section, stated): the total that a section's total row states, the last one with a number."""
    by = ["reply_id", *(["table_no"] if "table_no" in replies.columns else [])]
    get = lambda c: F.trim(F.get("cells", F.col(c)))
    rows = with_section(table_cells(replies), by).where(get("_a").rlike(TOTAL_ROW)).withColumn("stated", amount_of(get("_r"))).where("stated is not null")
    return rows.groupBy("reply_id", "section").agg(F.max_by("stated", F.struct(*[c for c in by if c != "reply_id"], "pos")).alias("stated"))


SIGNATURE = r"(?i)확인통지|인\)|（인）|\(인\)|서명|sign|chop"
FOUND = ("party", "period_end", "reply_date", "has_accounts", "has_total", "has_signature")


def found_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with balances, party, dates, and whether accounts, a total and a signature are there."""
    out = extract_balances(df, text).withColumn("party", extract_party(text)).withColumn("period_end", period_end(text)).withColumn("reply_date", reply_date(text, "period_end"))
    said = lambda c: F.when(c, True)
    return out.withColumns({"has_accounts": said((F.size("receivable") > 0) | (F.size("payable") > 0)), "has_total": said(F.coalesce("receivable_total", "payable_total").isNotNull()), "has_signature": said(F.col(text).rlike(SIGNATURE))})


def reply_confidence(df: DataFrame, parts: tuple[str, ...] = FOUND) -> DataFrame:
    """df with the share of six findings that are there (not null), to 4 places."""
    return df.withColumn("reply_confidence", F.round(sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0)) / len(parts), 4))


def find_total(text: str, keywords: tuple[str, ...]) -> Column:
    """For the first keyword that a line holds: the largest number of that line and the next two."""
    lines = F.split(F.col(text), "\n")

    def near(word: str) -> Column:
        at = F.array_position(F.transform(lines, lambda s: F.contains(F.lower(s), F.lit(word.lower()))), True)
        return F.when(at > 0, largest_number(F.array_join(F.slice(lines, at.cast("int"), F.lit(3)), "\n")))

    return F.coalesce(*map(near, keywords))


def section_totals(rows: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Per reply and section the stated total (of parse_total_rows), else the sum of the accounts, and their number."""
    sums = rows.groupBy("reply_id", "section").agg(F.sum("reply").alias("summed"), F.count("*").alias("accounts"))
    if stated is None:
        return sums.withColumnRenamed("summed", "total").select("reply_id", "section", "total", "accounts")
    both = sums.join(stated, ["reply_id", "section"], "full")
    return both.select("reply_id", "section", F.coalesce("stated", "summed").alias("total"), F.coalesce("accounts", F.lit(0)).alias("accounts"))
