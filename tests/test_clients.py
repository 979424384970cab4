"""Two clients that differ, and parties with several replies, reasons or procedures."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import coverage, fx, journal, sampling
from auditlake.sources import ledger as s


def test_sheets_of_two_clients(spark):
    names = dict(zip(["code", "name", "dr_open", "dr", "dr_close", "cr_open", "cr", "cr_close"], ["code", "nm", "a", "b", "c", "d", "e", "f"]))
    rows = [(e, sheet, code, f"{e}{sheet}{n}", 10, 1, 20, 3, 2, 4, n) for e, years in ((1, ("2024", "2023")), (2, ("2023", "2022"))) for sheet in years for code in ("1001", "10-02") for n in (1, 2)]
    df = s.load_tb_multiheader(spark.createDataFrame(rows, "engagement_id int, sheet string, code string, nm string, a int, b int, c int, d int, e int, f int, row_no int"), names)
    assert df.count() == 8 and {r.account_name[-1] for r in df.collect()} == {"2"}
    current, prior = ({(r.engagement_id, r.sheet) for r in x.collect()} for x in s.tb_current_prior(df))
    assert current == {(1, "2024"), (2, "2023")} and prior == {(1, "2023"), (2, "2022")}


def test_total_assets_of_every_name(spark):
    rows = [(1, "총자산", 500.0), (2, "유동자산", 7.0), (3, "비유동자산", 8.0), (4, "유동자산", 1.0), (4, "비유동자산", 2.0), (5, "매출", 9.0), (6, "자산총계", 3.0), (6, "총자산", 4.0)]
    got = s.total_assets(spark.createDataFrame(rows, "engagement_id int, item string, value double"), ["engagement_id"])
    assert {r.engagement_id: r.total_assets for r in got.collect()} == {1: 500.0, 2: 7.0, 3: 8.0, 4: 3.0, 5: 0.0, 6: 3.0}


@pytest.mark.parametrize("headers,want", [(["No", "계정과목", "전기 금액", "당기 금액", "비고"], ("계정과목", "당기 금액")), (["항목", "기말잔액", "기초잔액"], ("항목", "기말잔액")), (["Item", "Amount 2023", "Amount 2024"], ("Item", "Amount 2024")), (["x"], (None, None))])
def test_statement_columns(headers, want):
    assert s.fs_columns(headers) == want


def test_repeated_items_keep_the_last_number(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 1), (1, " a ", 6.0, 2), (1, "a", None, 3)], "engagement_id int, `계정` string, `금액` double, row_no int")
    assert [tuple(r) for r in s.load_fs_amounts(df, ["engagement_id"], headers=True).collect()] == [(1, "a", 6.0)]


def test_bracketed_accounts(spark):
    body = "지급할 금액\n외상매입금(관계사) KRW 500\n외상매입금(국외) 1,200\n외상매입금 7\n미지급금(국외) USD 30\n확인통지"
    r = text.extract_balances(spark.createDataFrame([(body,)], "text string")).first()
    assert r.payable == {"외상매입금(관계사)": 500.0, "외상매입금(국외)": 1200.0, "외상매입금": 7.0, "미지급금(국외)": 30.0} and r.payable_total == 1737.0


def test_best_reply_of_a_party_confirms(spark):
    best = spark.createDataFrame([(1, "a", "receivable", "mismatch", 1, 9.0), (1, "A", "payable", "matched", 2, 4.0), (1, "b", "payable", "mismatch", 4, 2.0), (1, "b", "receivable", "mismatch", 3, 1.0)], "engagement_id int, party string, kind string, status string, reply_id int, difference double")
    done = spark.createDataFrame([(1, "c", "부분", 5.0, 1), (1, "c", "충분", 4.0, 2)], "engagement_id int, party string, conclusion string, covered double, n int")
    guide = spark.createDataFrame([(1, p, "g", "KRW", 10.0) for p in "abc"], "engagement_id int, party string, account_group string, currency string, amount double")
    rows = {r.party: (r.note, r.difference) for r in fx.confirmation_status(guide, best, done, F.lower, "n").collect()}
    assert rows == {"a": ("matched", -4.0), "b": ("mismatch", -1.0), "c": ("충분", -6.0)}
    assert {r.party: r.note for r in fx.confirmation_status(guide, best, done, F.lower).collect()}["c"] == "부분"


def test_states_by_the_latest_or_strongest_procedure(spark):
    final = spark.createDataFrame([(1, "a", "receivable")], "engagement_id int, party string, kind string")
    none = spark.createDataFrame([], "engagement_id int, party string, kind string, status string, reply_id int, difference double")
    done = spark.createDataFrame([(1, "a", "미해소", 2), (1, "a", "충분", 1), (1, "a", "needs_review", 0)], "engagement_id int, party string, conclusion string, n int")
    assert coverage.party_states(final, none, done).first().state == "대체적_충분"
    assert coverage.party_states(final, none, done, "n").first().state == "대체적_미해소"


def test_reason_of_a_party_excluded_twice(spark):
    parties = spark.createDataFrame([(1, "receivable", "a", 5)], "engagement_id int, kind string, party string, b int").select("engagement_id", "kind", "party", F.col("b").cast("decimal(38,2)").alias("balance"))
    related = spark.createDataFrame([], "engagement_id int, name string")
    params = spark.createDataFrame([(1, 10.0, "낮음", "Y")], "engagement_id int, pm double, risk string, reliance string")
    out = spark.createDataFrame([(1, "receivable", "a", "z", 2), (1, "receivable", "a", "m", 1)], "engagement_id int, kind string, party string, reason string, row_no int")
    assert sampling.classify_parties(parties, related, out, params).first().exclusion_reason == "z"
    assert sampling.classify_parties(parties, related, out.drop("row_no"), params).first().exclusion_reason == "m"


def test_names_of_a_ledger_without_line_numbers(spark):
    gl = spark.createDataFrame([(1, "0010", 1.0, 0.0, "b", 1), (1, "10", 1.0, 0.0, "a", 2)], "engagement_id int, account_code string, debit_amount double, credit_amount double, account_name string, line int")
    assert journal.account_sums(gl.drop("line")).first().gl_name == "a" and journal.account_sums(gl, "line").first().gl_name == "b"
    assert journal.account_sums(gl.drop("account_name")).first().gl_name is None
