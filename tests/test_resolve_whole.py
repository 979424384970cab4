"""The name cascade meets every supplier's contact and business number."""

from auditlake.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_every_business_number_is_met(spark):
    names = {r.s_suppkey: r.s_name for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    got = {r.query_id: r for r in QUERIES["name_resolve"](spark, SF).collect()}
    assert got.keys() == names.keys()
    asked = [k for k in names if k and k % 8 == 0]
    assert max(asked) > 50 and all((got[k].matched, got[k].method, got[k].confidence) == (names[k], "alias", 1.0) for k in asked)
