"""The earliest rows of a batch, folded many times, against a loop."""

import datetime as dt
import random

from auditlake.streaming import jobs


def test_earliest_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_ROWS", 7)
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.2 else dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**12))
    rows = [(rng.choice([None, 2**60 + 1, 2**60 + 2, 5]), rng.choice([None, "", "a"]), rng.choice(["receivable", "payable"]), when(), str(i)) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = jobs.earliest(spark.createDataFrame(rows, "document_id long, party string, kind string, received_at timestamp, note string"), "received_at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in rows:
        if r[:3] not in want or (r[3] or dt.datetime.max) < (want[r[:3]][3] or dt.datetime.max):
            want[r[:3]] = r
    assert {tuple(r)[:3]: r.received_at for r in got} == {k: r[3] for k, r in want.items()} and len(got) == len(want)
    assert {r.note for r in got if r.received_at} == {r[4] for r in want.values() if r[3]}
