"""Bumped values against dcf_value of bumped companies; no table of companies is broadcast, whatever Spark's estimate."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import curves
from auditlake.queries import QUERIES


def test_scenarios_are_values_of_bumped_companies(spark):
    companies = spark.createDataFrame([(1, 0.09, 0.02, 10.0, 100.0, 6.0), (2, 0.03, 0.025, 5.0, 100.0, 6.0), (3, 0.1, 0.0, 1.0, 1.0, 5.0), (4, 0.5, 0.5, 1.0, 1.0, 5.0)], "company_id long, wacc double, growth double, net_debt double, shares double, multiple double")
    years = spark.createDataFrame([(c, y, 100.0, 10.0 * c + y, 1.0, 2.0, 0.5, 0.22) for c in (1, 2, 4) for y in (1, 2, 3)], "company_id long, yr int, revenue double, ebit double, da double, capex double, dnwc double, tax double")
    got = {(r.company_id, r.wacc_bump, r.growth_bump): (r.equity_value, r.error) for r in curves.dcf_scenarios(companies, years).collect()}
    assert len(got) == 36
    for a in (-0.01, 0.0, 0.01):
        for b in (-0.005, 0.0, 0.005):
            for r in curves.dcf_value(companies.withColumn("wacc", F.col("wacc") + a).withColumn("growth", F.col("growth") + b), years).collect():
                value, error = got[r.company_id, a, b]
                assert error == r.error and value == (pytest.approx(r.equity_value) if r.equity_value is not None else None)


def test_nothing_is_broadcast(spark):
    plan = QUERIES["dcf_scenarios"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
