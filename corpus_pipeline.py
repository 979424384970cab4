"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, token files.

Every stage takes all rows of `docs` and, but for the last, returns rows of it with its columns as they are, whatever
further columns it has and however they are named. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import durable, forget, scratch
from auditlake.llm.decontaminate import decontaminate
from auditlake.llm.mixing import mixed_documents
from auditlake.llm.near_copies import drop_near_copies
from auditlake.llm.quality import THRESHOLD, fit, with_quality
from auditlake.llm.token_files import tokenize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null, empty and blank texts have no terms and get the share of good labels, so they stay where most labels are good.
    Equal texts get equal scores and go or stay together; each of repeated rows counts. Ids only tell which rows are
    labelled: a null id is a row like any other. Without usable labels all rows stay. Whole texts are scored.
    """
    scored, name = with_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where(scored[name] >= THRESHOLD).select(*(scored[f"`{c}`"] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: steps of 5-word Jaccard similarity of 0.8 or more.

    Of a group the row with the smallest doc_id stays; of its repeats one; in a group without any doc_id one row. Null,
    empty and blank texts are one group, since they have the same words: none. Texts of fewer than five words are one
    shingle. Whole texts are compared.
    """
    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts have no words and stay; so do all where the benchmark is empty. Items without id or text take no
    part. Repeated rows go or stay together, ids play no part. Whole texts are read.
    """
    found, name = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(f"size(`{name['hits']}`) = 0").select(*(found[f"`{c}`"] for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them.

    A null source is a source. Null and empty texts have size 0 and are drawn by rank like others, at no cost; a source
    of no words has target 0 and gives none. Ties of size go by doc_id, null first; of equal ones any may be taken.
    Repeated rows count each.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the token files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone. Files are in ascending doc_id order, null first; rows of one doc_id, and
    repeats, stand side by side in any order, each with a place of its own. Whole texts are encoded.
    """
    return tokenize(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mix", mix),
    ("tokens", tokens),
]
#: SQL can't express the classifier, fingerprints and token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each one's result is written before the next reads it, and deleted,
    like all that the stage wrote on the way, once the next one's is there. The last result and the token files stay."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = durable(stage(spark, before, sf_dir), kept=True)
        if k:
            forget(before)
        before = docs
    return docs
