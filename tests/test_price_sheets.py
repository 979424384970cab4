"""Prices of more tickers than a table can have columns."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from compare import assert_same

from auditlake.queries import ORACLE_SQL, QUERIES


def test_more_tickers_than_columns(spark, tmp_path):
    n = 10_050
    users = [i * 3 for i in range(n)] + [0, 1]
    pq.write_table(pa.table({"event_id": range(n + 2), "ts": pa.array([dt.datetime(2024, 1, 1)] * n + [dt.datetime(2024, 1, 2)] * 2, pa.timestamp("us")), "user_id": users, "event_type": ["view"] * (n + 2), "value": [i + 0.5 for i in range(n + 2)], "props": [""] * (n + 2)}), tmp_path / "events.parquet")
    for t in ("customer", "orders", "lineitem", "supplier", "part", "nation", "region", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert_same(spark, QUERIES["src_unpivot_prices"], ORACLE_SQL["src_unpivot_prices"], str(tmp_path))
