"""Closes of zero and times of microseconds: queries over events and their SQL."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import TABLES, assert_same

from auditlake.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("events"), random.Random(11)
    rows = [(u, dt.datetime(1969, 12, 25) + dt.timedelta(days=d, microseconds=rng.randrange(86_400_000_000)), 0.0 if u % 4 == 0 and d in (3, 10, 11) else round(rng.uniform(1, 99), 2)) for u in range(40) for d in range(30) for _ in range(rng.randrange(1, 4))]
    pq.write_table(pa.table({"event_id": range(len(rows)), "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "user_id": [r[0] for r in rows], "event_type": ["view"] * len(rows), "value": [r[2] for r in rows], "props": [""] * len(rows)}), path / "events.parquet")
    for t in TABLES:
        if t != "events":
            (path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["mkt_beta", "mkt_beta_weekly", "mkt_clean_counts", "mkt_hamada", "mkt_regression_line", "mkt_wacc"])
def test_closes_of_zero(spark, folder, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], folder)


def test_milliseconds_are_cut(spark, folder):
    got = {tuple(r) for r in QUERIES["batch_new_replies"](spark, folder).select("document_id", "party", "kind", "received_ms").collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    assert got == {tuple(r) for r in con.execute(ORACLE_SQL["batch_new_replies"]).fetchall()}
