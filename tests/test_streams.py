"""Keyed state kept for ever, and coverage snapshots: restarts, repeated batches and crashes change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from auditlake.streaming import jobs

REPLY = "document_id long, party string, kind string, received_at timestamp, note string"
DAY = lambda y, d=1: dt.datetime(y, 1, d)


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(REPLY).parquet(source)
    jobs.first_replies(stream).writeStream.format("parquet").option("path", out).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return sorted(((r.document_id, r.party, r.note) for r in spark.read.schema(REPLY).parquet(out).collect()), key=str)


def test_a_reply_two_years_late_is_ignored_also_after_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    batch = lambda rows: spark.createDataFrame(rows, REPLY).coalesce(1).write.mode("append").parquet(source)
    one = [(1, "a", "receivable", DAY(2024, 5), "second"), (1, "a", "receivable", DAY(2024, 2), "first"), (2, "b", "payable", DAY(2024), "b"), (3, None, "payable", None, "no date")]
    two = [(1, "a", "receivable", DAY(2026), "late"), (1, "a", "payable", DAY(2026), "other kind"), (3, None, "payable", DAY(2024), "again"), (2, "b", "payable", DAY(2020), "earlier but late")]
    batch(one)
    assert run(spark, source, out, checkpoint) == [(1, "a", "first"), (2, "b", "b"), (3, None, "no date")]
    batch(two)
    got = run(spark, source, out, checkpoint)  # a new query from the checkpoint
    want = sorted([(1, "a", "first"), (2, "b", "b"), (3, None, "no date"), (1, "a", "other kind")], key=str)
    assert got == want
    # the batch twin over the same two batches
    stored = jobs.new_replies(spark.createDataFrame(one, REPLY), spark.createDataFrame([], REPLY))
    both = stored.unionByName(jobs.new_replies(spark.createDataFrame(two, REPLY), stored))
    assert sorted(((r.document_id, r.party, r.note) for r in both.collect()), key=str) == want


def test_snapshots(spark, tmp_path):
    path, ledger = str(tmp_path / "c"), spark.createDataFrame([(1, p, 100.0) for p in "abcd"], "engagement_id long, party string, ledger double")
    wrote = lambda n, **rows: spark.createDataFrame([(1, p, v) for p, v in rows.items()], "engagement_id long, party string, c double").select("engagement_id", "party", F.col("c").cast("decimal(30,2)").alias("covered")).write.mode("overwrite").parquet(f"{path}/batch={n}")
    latest = lambda: {r.party: None if r.covered is None else float(r.covered) for r in jobs.latest_coverage(spark, path, ledger).collect()}
    assert jobs.compact_coverage(spark, path) == -1 and latest() == dict.fromkeys("abcd")
    wrote(0, a=1.0, b=2.0)
    wrote(1, a=3.0)
    want = {"a": 3.0, "b": 2.0, "c": None, "d": None}
    assert latest() == want and jobs.compact_coverage(spark, path) == 1 and latest() == want and jobs.compact_coverage(spark, path) == 1
    wrote(1, a=3.0)  # a batch run twice, after its snapshot
    assert latest() == want
    wrote(2, b=5.0, c=7.0)
    want |= {"b": 5.0, "c": 7.0}
    assert latest() == want
    # a crash between the rows of a snapshot and its end: files without a mark
    jobs._since_snapshot(spark, path)[0].limit(0).write.parquet(f"{path}/_snapshot/upto=2")
    (tmp_path / "c" / "_snapshot" / "upto=2" / "_SUCCESS").unlink()
    assert latest() == want and jobs.compact_coverage(spark, path) == 2 and latest() == want
    # only the snapshot and later batches are read
    wrote(3, d=9.0)
    files = [f for f in jobs._since_snapshot(spark, path)[0].inputFiles()]
    assert all("upto=2" in f or "batch=3" in f for f in files) and latest() == want | {"d": 9.0}
