"""Each stage on nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from auditlake.llm import common

DOC = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "Plain words of a good text, written as people write them, and long enough to say a thing or two. "
ROWS = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (None, GOOD + "no id", "en", "a", 9), (None, GOOD + "no id", "en", "a", 9),
    (5, GOOD * 2, "en", "b", 1), (5, GOOD * 2, "en", "b", 1), (6, GOOD * 2, "en", "b", 1), (7, "word " * 60000, "en", "b", 300000), (8, GOOD + "benchmark one two three four five six seven eight nine ten", "en", "c", 1), (9, "短い 文", "ja", "c", 4),
]
CLASH = ["score", "fingerprint", "hits", "items", "n_words", "copies", "copy", "taken", "size", "key", "content", "_at", "_row", "doc", "part", "_k", "_f", "component"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, 1, None), (6, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("x", "one two three four five six seven eight nine ten"), ("y", None), (None, GOOD), ("z", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return common.durable(spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit(f"own {c}") for c in CLASH}))


def kept(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:200]) for r in df.collect())


EVERY = sorted((r[0] if r[0] is not None else -1, (r[1] or "")[:200]) for r in ROWS)


def test_columns_and_values_stay(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all(r[c] == f"own {c}" for r in out.select(*(f"`{c}`" for c in CLASH)).distinct().collect() for c in CLASH), name


def test_quality_keeps_what_has_no_bad_label(spark, docs, sf):
    assert kept(corpus_pipeline.quality(spark, docs, sf)) == EVERY


def test_one_of_each_group_stays(spark, docs, sf):
    got = kept(corpus_pipeline.near_duplicates(spark, docs, sf))
    # the blank ones are a group, the two without id and the three equal ones; 8 differs from those without id
    assert [i for i, _ in got] == [-1, 1, 5, 7, 8, 9]


def test_only_the_document_with_the_passage_goes(spark, docs, sf):
    assert kept(corpus_pipeline.benchmark_passages(spark, docs, sf)) == [r for r in EVERY if r[0] != 8]


def test_mix_of_odd_rows(spark, docs, sf):
    known = set(EVERY)
    got = kept(corpus_pipeline.mix(spark, docs, sf))
    assert got and set(got) <= known and 3 not in [i for i, _ in got]  # a source without words gives nothing


def test_every_row_has_a_place(spark, docs, sf):
    rows = corpus_pipeline.tokens(spark, docs, sf).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(r.doc_id is not None, r.doc_id or 0) for r in rows] and len(rows) == len(ROWS)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}


def test_empty_tables(spark, docs, sf, tmp_path):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert kept(corpus_pipeline.quality(spark, docs, str(tmp_path))) == EVERY
    assert kept(corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path))) == EVERY


def test_a_run_leaves_its_result_and_the_token_files(spark, docs, sf):
    import os

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    root = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(root)) - before
    assert len([x for x in left if x.startswith("stage-")]) == 1 and len([x for x in left if x.startswith("token_files-")]) == 1 and len(left) == 2
    assert out.count() > 0
