"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.llm.common import bounded_batches, durable, running_sums, small_side

SIZE_WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, n_docs) with `target`: the words to take from each source.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size; what is over goes to the others by weight. In the order of cap / weight, a source
    is capped if its cap is within its part of what the capped ones before it leave; the rest share by weight.
    """
    ranked = running_sums(sources.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"_rank": "_one"})
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    weighed = ranked.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("source_size") * most
    )
    filled = running_sums(
        weighed.withColumn("_ratio", F.col("_cap") / F.col("_w")),
        [F.col("_ratio"), F.col("source").asc_nulls_last()],
        {"_cap_before": "_cap", "_w_before": "_w"},
    )
    whole = sources.agg((F.sum("source_size") * F.lit(share)).alias("_all")).crossJoin(weighed.agg(F.sum("_w").alias("_w_all")))  # one row
    left, weight = F.col("_all") - F.col("_cap_before"), F.col("_w_all") - F.col("_w_before")
    marked = durable(filled.crossJoin(F.broadcast(whole)).withColumn("_capped", F.col("_cap") * weight <= left * F.col("_w")))
    used = marked.agg(  # one row
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.lit(0)).alias("_c"),
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_w"))), F.lit(0)).alias("_cw"),
    )
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        (F.col("_all") - F.col("_c")) * F.col("_w") / (F.col("_w_all") - F.col("_cw"))
    )
    return marked.crossJoin(F.broadcast(used)).select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, source: str = "source", size=None, key: str = "doc_id", weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """(doc: all columns of docs, size, source_size, target, copies, taken) for every row of docs.

    A document of source s is expected target / source_size times. Within s the documents stand by size, then key; the
    expected copies are summed up, one offset in [0, 1) drawn from md5(seed, source) is added, and a document is emitted
    once for each integer boundary that its interval crosses. Order by size keeps a source's taken words within one
    largest document of its target.

    Rows are dealt by range of (source, size, key), so a source with most rows spans many tasks; a row's rank is its
    place in its range plus the counts of the ranges before. Null sources are one source. Null texts have size 0 and
    take 0 words; a source of size 0 has target 0. Repeated rows count each. Empty input gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(SIZE_WORDS)), F.lit(0)).cast("long") if size is None else size
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("key").asc_nulls_first()]
    dealt = durable(
        docs.select(row, docs[source].alias("source"), docs[key].alias("key"), size.alias("size"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", 33))
    pieces = durable(dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("at").alias("first")))
    sources = source_targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, most)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumnRenamed("source", "_s")
        .join(sources, F.col("_s").eqNullSafe(F.col("source")))
        .select(F.col("_s"), F.col("part").alias("_p"), "first", "before", "source_size", "target")
    )
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")), F.lit("|"), F.col("source").isNull().cast("int").cast("string")))
    offset = F.conv(F.substring(drawn, 1, 5), 16, 10).cast("double") / F.lit(float(16**5))
    rank = F.col("at") - F.col("first") + F.col("before")  # from 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a row a range and source: with a checked size they go out to the documents, which aren't shuffled anew
    return (
        dealt.join(small_side(durable(offsets)), (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset))
        .select("doc", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # words are counted once: the ranking reads its rows twice, to find the ranges and to deal them
    slim = durable(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SIZE_WORDS)), F.lit(0)).cast("long").alias("n")))
    return mix_sources(slim, size=slim["n"]).select("doc.doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, 2 * source_size as cap,
         [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w from src),
filled as (
  select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as cap_before,
         coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as w_before,
         (sum(source_size) over ())::double * 1.5::double as whole, (sum(w) over ())::double as w_all from weighed),
marked as (select *, cap::double * (w_all - w_before) <= (whole - cap_before) * w::double as capped from filled),
used as (select coalesce(sum(cap) filter (where capped), 0)::double as c, coalesce(sum(w) filter (where capped), 0)::double as cw from marked),
targets as (
  select source, source_size, case when capped then cap::double else (whole - c) * w::double / (w_all - cw) end as target
  from marked, used),
ranked as (
  select s.doc_id, s.size, t.source_size, t.target,
         row_number() over (partition by s.source order by s.size, s.doc_id nulls first) as k,
         case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
         ('0x' || substr(md5('mix|' || coalesce(s.source, '') || '|' || case when s.source is null then '1' else '0' end), 1, 5))::bigint::double / 1048576.0::double as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(k::double * rate + u) - floor((k - 1)::double * rate + u))::bigint * size)::bigint as taken
from ranked
"""
