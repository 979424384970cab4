"""op9's counts by kind, in whatever order the kinds stand."""

import pyarrow as pa
import pyarrow.parquet as pq

from auditlake.llm.queries import QUERIES


def test_counts_by_kind(spark, tmp_path):
    texts = ["1.2.3.4 then a@b.co and c@d.co", "+1 212 555 0100, a@b.co", "4111111111111111, 1.2.3.4 5.6.7.8 x@y.org", None, ""]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 1, 0, 0), 1: (1, 0, 0, 1), 2: (1, 2, 1, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}
