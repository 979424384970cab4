"""The places of a reply table's columns are found once a table, not once for each of its rows."""

from auditlake.functions import text


def test_places_are_found_before_rows(spark):
    replies = spark.createDataFrame([(1, [["계정과목", "발송금액", "일치여부", "회신금액"], ["a", "1", "일치", "2"], ["b"]]), (2, [["x"], ["y"]])], "reply_id long, rows array<array<string>>")
    cells = text.table_cells(replies)
    assert [(r.reply_id, r.pos, r["_a"], r["_s"], r["_d"], r["_r"]) for r in cells.collect()] == [(1, 1, 0, 1, 2, 3)]
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("Generate posexplode")[0] and "lambda" in plan
