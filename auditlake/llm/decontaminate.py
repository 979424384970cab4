"""Benchmark decontamination by a prefix-filtered set join of item windows and documents."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, bounded_batches, byte_slices, durable, field, fresh, utf8, words

WINDOW = 10
#: Bytes of benchmark text held by a task at once; a larger benchmark is taken in blocks, one after the other.
BLOCK_BYTES = 8 << 20
#: Words that a task counts before it sends them on.
HELD_WORDS = 200_000


def _blocks(bench: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_BYTES."""
    rows = bench.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else rows for b in range(n)]


def _word_counts(docs: DataFrame, text: str, vocabulary: set[bytes] | None) -> DataFrame:
    """(word, n): documents of the whole corpus that hold each word, of the vocabulary if there is one; a task sends a row a
    word, or a row each time that it holds HELD_WORDS of them."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else frozenset(vocabulary))

    def count(batches):
        import pyarrow as pa

        def told(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen, only = Counter(), known.value
        for batch in (part for whole in batches for part in byte_slices(whole)):
            for t in utf8(batch.column(0)):
                seen.update(set(words(t)) if only is None else only.intersection(words(t)))
            if len(seen) > HELD_WORDS:
                yield told(seen)
                seen.clear()
        yield told(seen)

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Windows:
    """A block's item windows. items[key]: the items with the window of these joined words. shapes[word]: (offset, length)
    of the windows whose rarest word that is: a window lies in a document only if that word does, at that offset, so for
    full containment this one-word prefix is the necessary one."""

    def __init__(self, items: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], window: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        shapes = defaultdict(set)
        for name, w in items:
            n = min(window, len(w))
            for s in range(len(w) - n + 1 if w else 0):
                p = min(range(s, s + n), key=lambda i: (rarity.get(w[i], 0), w[i]))
                if rarity.get(w[p], 0):  # a word of no document is in none
                    self.items[b" ".join(w[s : s + n])].add(name)
                    shapes[w[p]].add((p - s, n))
        self.shapes = {w: sorted(x) for w, x in shapes.items()}

    def hits(self, w: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Document words that lie in an occurrence of a window, as disjoint [start, end), and the items they come from.
        Each place of a prefix word is checked against the window's words once for each offset and length, however many
        items and places share them."""
        spans, got, seen, n = [], set(), set(), len(w)
        for i, x in enumerate(w):
            for offset, length in self.shapes.get(x, ()):
                s = i - offset
                if s < 0 or s + length > n:  # positional and length bounds
                    continue
                key = b" ".join(w[s : s + length])
                if key in self.items:
                    spans.append((s, s + length))
                    if key not in seen:
                        seen.add(key)
                        got |= self.items[key]
        return merged(spans), got


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, hits (disjoint word spans [start, end)) and items (sorted ids), and those columns' names.

    An item of fewer than `window` words is one window; without words it has none. Null item ids and texts take no
    part; null document texts have no words. Documents aren't shuffled: the benchmark goes to them, with the corpus's word
    counts to order words by rarity. A benchmark over BLOCK_BYTES goes in blocks, one after the other: words are counted
    once for all, each block's hits are written out before the next one starts, and join the documents in the end.
    Several documents, items or windows that are equal each count. Empty inputs give no hits.
    """
    spark = docs.sparkSession
    name = {k: fresh(docs, k) for k in ("n_words", "hits", "items")}
    fields = [field(name["n_words"], T.LongType()), field(name["hits"], T.ArrayType(T.ArrayType(T.LongType()))), field(name["items"], T.ArrayType(T.StringType()))]
    drop = () if keep_text else (text,)
    blocks = _blocks(bench, item, item_text)

    def made(block: DataFrame, counts: DataFrame | None):
        rows = [(r.item, v) for r in block.collect() if (v := words(r.text.encode()))]  # a block is bounded
        vocabulary = {x for _, v in rows for x in v}
        if counts is None:
            counts = _word_counts(docs, text, vocabulary)
        else:
            counts = counts.join(F.broadcast(spark.createDataFrame([(bytearray(x),) for x in vocabulary], "word binary")), "word")
        return spark.sparkContext.broadcast(Windows(rows, {bytes(w): n for w, n in counts.collect()}, window))  # at most the block's words

    if len(blocks) <= 1:
        shared = made(blocks[0], None) if blocks else spark.sparkContext.broadcast(Windows([], {}, window))

        def scan(batch):
            split = [words(t) for t in utf8(batch.column(batch.schema.get_field_index(text)))]
            found = [shared.value.hits(w) for w in split]
            return [len(w) for w in split], [h for h, _ in found], [sorted(i) for _, i in found]

        return arrow_columns(docs, scan, fields, drop=drop), name

    row = fresh(docs, "_row")
    base, counts = durable(docs.withColumn(row, F.monotonically_increasing_id())), durable(_word_counts(docs, text, None))
    parts = []
    for block in blocks:
        shared = made(block, counts)

        def look(batch, shared=shared):
            found = [shared.value.hits(words(t)) for t in utf8(batch.column(1))]
            return [h for h, _ in found], [sorted(i) for _, i in found]

        hit = arrow_columns(base.select(row, text), look, [field("_h", fields[1].dataType), field("_i", fields[2].dataType)], drop=(text,))
        parts.append(durable(hit.where(F.size("_h") > 0)))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.flatten(F.collect_list("_h")).alias("_h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_i")))).alias("_i"))
    joined = base.join(every, row, "left")

    def count(batch):
        at = batch.schema.get_field_index
        return [len(words(t)) for t in utf8(batch.column(at(text)))], [merged(h or ()) for h in batch.column(at("_h")).to_pylist()], [i or [] for i in batch.column(at("_i")).to_pylist()]

    return arrow_columns(joined, count, fields, drop=(row, "_h", "_i", *drop)), name


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, _ = decontaminate(docs, bench, keep_text=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
bw as (
  select item_id, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s, w from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g from bw),
sizes as (select distinct n from win),
dp as (select r, n, w, unnest(range(1, len(w) - n + 2)) as s from d join sizes on len(w) >= n),
dw as (select r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as g from dp),
hit as (select dw.r, dw.s, dw.n, win.item_id from dw join win on dw.n = win.n and dw.g = win.g),
pos as (select distinct r, unnest(range(s, s + n)) as p from hit),
np as (select r, count(*) as n_hit from pos group by r),
it as (select r, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct r, item_id::varchar as i from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join np using (r) left join it using (r)
"""
