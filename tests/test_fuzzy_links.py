"""Fuzzy links of names by blocks against all pairs; names asked twice are scored once."""

import random

from pyspark.sql import functions as F

from auditlake.functions.similarity import NameIndex, partial_ratio, token_set_ratio
from auditlake.operators import names


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_NAMES", 7)
    monkeypatch.setattr(names, "BLOCK_CANDIDATES", 11)
    monkeypatch.setattr(names, "BOUNDS", 3)
    rng = random.Random(5)
    known = [(e, f"acme{rng.randrange(10 ** 5):05d}{'x' * (i % 3)}", i) for e in (1, 2) for i in range(60)]
    asked = [(e, i, rng.choice(known)[1][i % 2 :] if i % 5 else "none of them") for e in (1, 2, 3) for i in range(30)]
    asked += [(1, 100, None), (1, 101, ""), (1, 102, " Co., Ltd.")]
    q = spark.createDataFrame(asked, "engagement_id long, query_id long, name string")
    c = spark.createDataFrame(known, "engagement_id long, candidate string, pos long")
    got = {(r.engagement_id, r.query_id): tuple(r)[2:] for r in names.fuzzy_links(q, c).collect()}
    plain = {r.name: r.n for r in names.normal(q.select("name").union(c.select("candidate")).distinct(), "name").collect()}
    want = {}
    for e, i, name in asked:
        if plain[name]:
            pairs = [(-partial_ratio(plain[name], plain[k]), -token_set_ratio(plain[name], plain[k]), p, k) for f, k, p in known if f == e]
            hits = sorted(x for x in pairs if -x[0] >= names.PARTIAL or -x[1] >= names.TOKENS)
            least = min(j for f, j, other in asked if f == e and other and plain[other] == plain[name])
            want[e, i] = (least, len(hits), *((hits[0][3], -hits[0][0], -hits[0][1]) if hits else (None, None, None)))
    assert got == want and any(x[1] > 1 for x in want.values()) and any(x[1] == 0 for x in want.values())


def test_written_rows_grow_with_names_not_pairs(spark):
    from auditlake.queries import QUERIES

    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert QUERIES["name_fuzzy"](spark, "/root/testdata/sf0.01").count() == suppliers


def test_equal_texts_are_scored_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    best = NameIndex.best

    def counted(self, *args, **more):
        made.add(1)
        return best(self, *args, **more)

    c = spark.range(20).selectExpr("0 as engagement_id", "concat('c', id) as candidate", "concat('c', id) as c", "cast(id as int) as pos")
    q = spark.range(50).select(F.lit(0).alias("engagement_id"), F.col("id").alias("query_id"), F.lit("none").alias("n"), F.lit(None).cast("string").alias("h"))
    monkeypatch.setattr(names, "NameIndex", type("Counted", (NameIndex,), {"best": counted}))
    assert names.best_three(q, c).count() == 100 and 1 <= made.value <= 4
