"""The ledger is made once a query, and small tables are broadcast by their size, so an engagement's lines don't meet in a task."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import journal as j
from auditlake.queries import QUERIES
from auditlake.queries.common import Tables

SF = "/root/testdata/sf0.001"
STAGED = ["je_b01_large_pl", "je_b01_counts", "je_b02_unmatched", "je_b03_new_account_lines", "je_b03_summary", "je_b05_unusual_users", "je_b05_user_summary", "je_b08_doc_type_accounts", "je_b_pl_accounts", "je_run_rules", "je_q01_inquiry_list", "je_7401_rule_summary", "src_tb_current", "src_tb_prior"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", STAGED)
def test_ledger_is_made_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "l_shipdate" not in text  # a column of the table that the ledger is made of


def test_staged_views_are_written_once_and_equal(spark):
    one, other = Tables(spark, SF, ("gl", "coa")), Tables(spark, SF)
    assert one.gl is one.gl and "l_shipdate" not in plan(one.coa) and "l_shipdate" in plan(other.coa)
    for name in ("gl", "coa", "tb"):
        a, b = getattr(one, name), getattr(other, name)
        assert a.dtypes == b.dtypes and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_account_sums_sort_no_lines(spark):
    t = Tables(spark, SF, ("gl",))
    got = j.account_sums(t.gl_named, "l_linenumber")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("HashAggregate") > text.rindex("SortAggregate")
    plain = t.gl_named.groupBy("engagement_id", j.stripped("account_code").alias("account_code")).agg(F.sum("debit_amount").alias("gl_debit"), F.sum("credit_amount").alias("gl_credit"), F.min_by("account_name", "l_linenumber").alias("gl_name"))
    assert got.dtypes == plain.dtypes and got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
