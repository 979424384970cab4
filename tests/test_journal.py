"""Literal cases of the journal-entry tests."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from auditlake.operators import journal as j
from auditlake.sources import ledger as s

LINE = "engagement_id long, entry_no string, entry_date date, posting_date date, user_id string, account_code string, debit_amount decimal(20,2), credit_amount decimal(20,2), entry_type string, description string, l_linenumber int, account_name string"


def line(no="1", day=dt.date(2025, 6, 1), post=None, user="1001", code="1001", dr=0, cr=0, kind="SA", text="fine text", n=1, name=None):
    return (1, no, day, post, user, code, D(dr), D(cr), kind, text, n, name)


def gl(spark, *rows):
    return spark.createDataFrame(list(rows), LINE)


def tb(spark, opening, dr, cr, closing, code="1001"):
    return spark.createDataFrame([(1, code, D(opening), D(dr), D(cr), D(closing))], "engagement_id long, account_code string, opening decimal(20,2), period_debit decimal(20,2), period_credit decimal(20,2), closing decimal(20,2)")


def coa(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "engagement_id long, account_code string, account_type string, created_date date")


def no_adjustments(spark):
    return spark.createDataFrame([], "engagement_id long, account_code string, amount decimal(20,2)")


@pytest.mark.parametrize("closing,findings", [(550_000, 0), (700_000, 1)])
def test_rollforward(spark, closing, findings):
    lines = gl(spark, line(code="0001001", dr=100_000), line(code="1001", cr=50_000))
    assert j.tb_rollforward(lines, tb(spark, 500_000, 100_000, 50_000, closing), coa(spark, ("1001", "B", None)), no_adjustments(spark)).count() == findings


def test_rollforward_starts_profit_and_loss_at_zero(spark):
    lines = gl(spark, line(code="4001", cr=100))
    found = j.tb_rollforward(lines, tb(spark, -900, 0, 100, -1000, "4001"), coa(spark, ("4001", "P", None)), no_adjustments(spark)).collect()
    assert [r.used_opening for r in found] == [0]


def test_users(spark):
    hr = spark.createDataFrame([(1, "7000001", dt.date(2025, 3, 31)), (1, "7000002", None), (1, "1234568C", None)], "engagement_id long, user_id string, retire_date date")
    types = spark.createDataFrame([("HR", "payroll", "MANUAL")], "entry_type string, description string, settlement_type string")
    users = ["9900001", "Z001", "ZBATCH", "ZBATCHC", "1234567C", "1234568C", "7000002", "SYSTEM-HR", "SYSTEM-XX"]
    lines = gl(spark, *(line(user=u) for u in users), line(user="7000001", day=dt.date(2025, 3, 1), post=dt.date(2025, 6, 15)))
    got = {r.user_id: (r.reason, r.detail_type, r.days_after) for r in j.unusual_users(lines, hr, types).collect()}
    assert got == {
        "9900001": ("not_registered", None, None), "Z001": ("system", "Z001", None), "ZBATCH": ("system", "ZBATCH", None), "ZBATCHC": ("system", "ZBATCHC", None),
        "1234567C": ("external", "C", None), "SYSTEM-HR": ("system", "payroll", None), "SYSTEM-XX": ("system", "자동전기 (XX)", None), "7000001": ("post_retirement", None, 76),
    }
    with pytest.raises(ValueError):
        j.unusual_users(lines, hr, types, system="^Z")


def test_back_dating(spark):
    d = dt.date
    lines = gl(spark, line("a", d(2025, 1, 1), d(2025, 2, 15)), line("b", d(2025, 1, 1), d(2025, 1, 15)), line("c", d(2025, 3, 1), d(2025, 1, 1)), line("d", d(2025, 3, 1)))
    assert {r.entry_no: r["class"] for r in j.back_dated(lines).collect()} == {"a": "late", "c": "reversed"}
    assert {r.entry_no for r in j.back_dated(lines, include_backdated=False).collect()} == {"a"}


def test_counter_accounts(spark):
    lines = gl(spark, line(code="41101010", cr=1_000_000), line(code="11201010", dr=1_100_000), line(code="25401010", cr=100_000))
    got = {r.account_code: r.relation for r in j.counter_accounts(lines, ("^4",)).collect()}
    assert got == {"11201010": "상대계정", "25401010": "참고계정", "41101010": "본계정"}


def test_new_accounts_by_date_and_by_prior_balance(spark):
    params = spark.createDataFrame([(1, dt.date(2025, 1, 1), dt.date(2025, 12, 31))], "engagement_id long, period_start date, period_end date")
    now, prior = tb(spark, 0, 0, 0, 0, "0010"), tb(spark, 0, 0, 0, 0, "10")
    assert [r.account_code for r in j.new_accounts(coa(spark, ("55", "B", dt.date(2025, 3, 1)), ("56", "B", dt.date(2024, 3, 1))), now, prior, params).collect()] == ["55"]
    assert j.new_accounts(coa(spark, ("55", "B", None)), now, prior, params).count() == 0
    assert [r.account_code for r in j.new_accounts(coa(spark, ("55", "B", None)), tb(spark, 0, 0, 0, 0, "77"), prior, params).collect()] == ["77"]


def test_normalisation(spark):
    raw = spark.createDataFrame([("1", "2025-01-01", None, None, "12", "1,000", "", "HR"), (None, "2025-01-01", None, "u", "12", "1", "", "SA"), ("3", "soon", None, "u", "12", "1", "", "SA")], "entry_no string, entry_date string, posting_date string, user_id string, account_code string, debit_amount string, credit_amount string, entry_type string")
    good, bad = s.normalize_gl(raw, pad=4)
    row = good.collect()[0]
    assert (row.user_id, row.is_system_generated, row.account_code, row.debit_amount) == ("SYSTEM-HR", True, "0012", D("1000.00"))
    assert sorted(r.reason for r in bad.collect()) == ["entry_date", "entry_no"]


def test_mapping_prefers_the_first_keyword():
    assert s.suggest_mapping(["거래처 코드", "거래처명", "계정 과목", "통화", "기말"], override={"code": None})["party"] == "거래처명"
    assert s.suggest_mapping(["Name", "Code"], {"name": ["party", "name"], "code": ["code"]}) == {"name": "Name", "code": "Code"}
    assert s.join_headers(["차변", None, "대변"], ["이월", "당기", "이월"]) == ["차변_이월", "차변_당기", "대변_이월"]


def test_user_rule_joins_the_findings(spark):
    lines = gl(spark, line(user="x"))
    own = {"X1": lambda gl, ctx: j.finding(gl.where("user_id = 'x'"), "X1")}
    assert {r.rule_code for r in j.run_rules(lines.withColumn("approver_id", F.lit("x")), {}, (), own).collect()} == {"B06", "X1"}


def test_same_rows_with_one_and_many_partitions(spark):
    lines = gl(spark, *(line(str(i % 7), code=str(1000 + i % 5), dr=i, cr=i % 3) for i in range(60)))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, j.sample_findings(j.finding(lines, "X"), "mus", 7).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
