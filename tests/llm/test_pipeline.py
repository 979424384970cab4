"""The corpus pipeline's stages against brute force on a small table."""

import re

from corpus_pipeline import STAGES, run

from auditlake.llm import common, decontaminate

from test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in STAGES:
        seen.append(common.durable(stage(spark, seen[-1], SF)))
        if name != "tokens":
            assert seen[-1].columns == columns
    rows = [d.collect() for d in seen]
    assert 0.7 * len(rows[0]) < len(rows[1]) < len(rows[0])
    assert sorted(r.doc_id for r in rows[2]) == brute([(r.doc_id, r.text) for r in rows[1]])
    grams = set()
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words(b.text.encode())
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    dirty = {r.doc_id for r in rows[2] for w in [decontaminate.words(r.text.encode())] if any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]} - dirty
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rs)
    assert abs(words(rows[4]) / words(rows[3]) - 1.5) < 0.15
    assert len(rows[5]) == len(rows[4]) and sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    assert [r.start for r in sorted(rows[5], key=lambda r: r.start)] == sorted(sum(x.n_tokens for x in rows[5] if x.start < r.start) for r in rows[5])


def test_run(spark):
    assert run(spark, SF).count() > 0
