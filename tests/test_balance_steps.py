"""Balances are read step by step: no mark is looked for twice, and null texts have empty maps."""

from auditlake.functions import text


def test_marks_are_found_once(spark):
    rows = [(1, "Receivable\n외상매출금 5,000\n외상매출금 6,000\nPayable\n외상매입금 7"), (2, None), (3, "잔액 1,234")]
    df = text.extract_balances(spark.createDataFrame(rows, "reply_id long, text string"))
    got = {r.reply_id: (r.receivable, r.payable, r.receivable_total, r.payable_total) for r in df.collect()}
    assert got == {1: ({"외상매출금": 6000.0}, {"외상매입금": 7.0}, 6000.0, 7.0), 2: ({}, {}, None, None), 3: ({}, {}, 1234.0, None)}
    assert df.columns == ["reply_id", "text", "receivable", "payable", "receivable_total", "payable_total", "balance"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_instr") == 3
