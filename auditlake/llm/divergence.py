"""Source divergence audit: term counts of sources against each other and against their language, by in-mapper stripes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, byte_slices, durable, lean_memory, scratch, utf8

LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Counts that a task holds before it spills its stripes; cells of sums of pairs that it holds; probabilities at once.
HELD, CELLS, CHUNK = 400_000, 4_000_000, 500_000
#: Groups (language, source) whose totals are broadcast at most; their pairs, which are the result, grow with the square.
GROUPS = 1_000_000

# Bytes of no term become spaces, A-Z become a-z: split() gives the terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else (b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))
_STRIPE = pa.struct([("source", pa.string()), ("n", pa.int64())])
_SCHEMA = "lang string, term string, docs long, sources array<struct<source:string,n:long>>"


def _stripes(lang: list, term: list, docs, lengths, source: pa.Array, n) -> pa.RecordBatch:
    sources = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.StructArray.from_arrays([source.cast(pa.string()), pa.array(n, pa.int64())], fields=list(_STRIPE)))
    columns = [pa.array(lang, pa.string()) if isinstance(lang, list) else lang, pa.array(term, pa.string()) if isinstance(term, list) else term]
    return pa.RecordBatch.from_arrays([*columns, pa.array(docs, pa.int64()), sources], names=["lang", "term", "docs", "sources"])


def _spilled(docs_of: dict[bytes, Counter], counts: dict[tuple[bytes, bytes], Counter]):
    """What a task has folded so far as stripes, a language a batch: each term's documents and counts by source; and, under
    a null term, which sources there are."""
    for lang, docs in docs_of.items():
        mine = [(source, c) for (of, source), c in counts.items() if of == lang]
        stripes: dict[bytes, list] = {term: [] for term in docs}
        for i, (_, c) in enumerate(mine):
            for term, n in c.items():
                stripes[term].append((i, n))
        flat = [x for s in stripes.values() for x in s] + [(i, 0) for i in range(len(mine))]
        names = pa.array([source for source, _ in mine], pa.string()).take(pa.array([i for i, _ in flat], pa.int32()))
        yield _stripes([lang] * (len(docs) + 1), [*stripes, None], [*docs.values(), 0], [*map(len, stripes.values()), len(mine)], names, [n for _, n in flat])


def _fold(batches):
    """Stripes of whole documents (lang, source, text), held in hash tables and spilled at HELD counts."""
    lean_memory()
    docs_of: dict[bytes, Counter] = {}
    counts: dict[tuple[bytes, bytes], Counter] = {}
    held = 0
    for batch in (part for all_of in batches for part in byte_slices(all_of)):
        for lang, source, text in zip(*map(utf8, batch.columns)):
            key = (lang or b"", source or b"")
            found = text.translate(_TERM_BYTES).split() if text else []
            docs, mine = docs_of.setdefault(key[0], Counter()), counts.setdefault(key, Counter())
            before = len(docs) + len(mine)
            mine.update(found)
            docs.update(set(found))
            held += len(docs) + len(mine) - before
            if held >= HELD:
                yield from _spilled(docs_of, counts)
                docs_of, counts, held = {}, {}, 0
    if docs_of:
        yield from _spilled(docs_of, counts)


def _merge(batches):
    """Stripes sorted by language and term, added up by key. A key's rows so far are held as one stripe."""
    lean_memory()
    rest = None
    for batch in batches:
        batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else batch
        if not batch.num_rows:
            continue
        merged = _added(batch)
        rest = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield _kept(merged.slice(0, merged.num_rows - 1))
    if rest is not None:
        yield _kept(rest)


def _kept(stripes: pa.RecordBatch) -> pa.RecordBatch:
    return stripes.filter(pc.or_(pc.is_null(stripes.column("term")), pc.greater_equal(stripes.column("docs"), LEAST_DOCS)))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before (null is a value of its own)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _added(batch: pa.RecordBatch) -> pa.RecordBatch:
    lang, term, docs, sources = batch.columns
    starts = np.flatnonzero(np.r_[True, _changes(lang) | _changes(term)])
    lengths = np.diff(sources.offsets.to_numpy())
    group = np.repeat(np.cumsum(np.isin(np.arange(len(batch)), starts)) - 1, lengths)
    flat = sources.flatten()
    sums = pa.table({"g": group, "source": flat.field("source"), "n": flat.field("n")}).group_by(["g", "source"], use_threads=False).aggregate([("n", "sum")]).sort_by("g").combine_chunks()
    per = np.bincount(sums["g"].to_numpy(), minlength=len(starts))
    take = pa.array(starts)
    source = sums["source"].combine_chunks()
    return _stripes(lang.take(take), term.take(take), np.add.reduceat(docs.to_numpy(), starts), per, source.chunk(0) if isinstance(source, pa.ChunkedArray) else source, sums["n_sum"].to_numpy())


def merged_stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A stripe for each language and term of at least LEAST_DOCS documents: lang, term, docs (how many hold it), sources
    (source and count); and for each language one of a null term with all its sources. Nulls read as ''."""
    bounded_batches(docs.sparkSession)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(none(lang), none(source), F.col(text)).mapInArrow(_fold, _SCHEMA)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, _SCHEMA)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division: nothing leaves 64 bits while total is under 9e15."""
    left, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, np.shape(total)), np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each language and source its divergence from each other source of the
    language (part `pair`), and its `top` terms by divergence from the language (part `term`).

    Terms are runs of ASCII letters and characters past ASCII, A-Z lower-cased; a language's kept terms are those in at least
    LEAST_DOCS of its documents. With count + 1 over (all counts + number of terms) as billionths p and q, rounded down plus
    one, a term diverges by floor((p - q)**2 / q). Ranks go by value, then by the item's bytes.

    Null text, language and source read as ''; repeated rows are documents of their own; a source without terms has counts
    of 0; without kept terms all pairs are 0 and there are no term rows; an empty table gives no rows. Tasks fold whole
    documents into stripes (a term's documents and its counts by source), spill them at HELD counts, and Spark merges them by
    language and term, so a frequent term is one stripe a spill. Totals by group, at most GROUPS rows (more are refused),
    are broadcast; tasks add up their terms' divergences before they send them.
    """
    spark = docs.sparkSession
    stripes = durable(merged_stripes(docs, text, lang, source))
    of_group = stripes.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = stripes.groupBy("lang").agg(F.count("term").alias("v"))
    groups = durable(of_group.join(of_lang, "lang"))
    held = groups.orderBy("lang", "source").limit(GROUPS + 1).collect()
    if len(held) > GROUPS:
        raise ValueError(f"more than {GROUPS:,} groups of language and source")
    totals: dict[str, tuple[dict[str, int], list[int], int]] = {}
    for r in held:
        place, n, _ = totals.setdefault(r["lang"], ({}, [], r["v"]))
        place[r["source"]] = len(place)
        n.append(r["n"])
    shared = spark.sparkContext.broadcast(totals)
    schema = "lang string, source string, part string, item string, value long"

    def rows(of: str, names: list[str], s, part: str, items, values) -> pa.RecordBatch:
        sources = pa.array(names, pa.string()).take(pa.array(s, pa.int32()))
        n = len(sources)
        items = items if isinstance(items, pa.Array) else pa.array(names, pa.string()).take(pa.array(items, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([of] * n, pa.string()), sources, pa.array([part] * n, pa.string()), items, pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def pair_rows(of: str, names: list[str], sums: np.ndarray) -> pa.RecordBatch:
        s, r = np.divmod(np.arange(len(names) ** 2), len(names))
        other = s != r
        return rows(of, names, s[other], "pair", r[other], sums.ravel()[other])

    def emit(batches):
        lean_memory()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("term")))
            edges = np.flatnonzero(np.r_[True, _changes(batch.column("lang")), True]) if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                of = batch.column("lang")[int(a)].as_py()
                place, n, v = shared.value[of]
                names = list(place)
                group_total = np.array(n, np.int64) + v
                step = max(1, CHUNK // len(names))
                for at in range(a, b, step):
                    part = batch.slice(at, min(step, b - at))
                    sources = part.column("sources")
                    row = np.repeat(np.arange(part.num_rows), np.diff(sources.offsets.to_numpy()))
                    flat = sources.flatten()
                    count = np.zeros((part.num_rows, len(names)), np.int64)
                    count[row, [place[s] for s in flat.field("source").to_pylist()]] = flat.field("n").to_numpy()
                    p, whole = share(count, group_total), share(count.sum(axis=1), group_total.sum() - v * len(names) + v)
                    hit, s = np.nonzero((count > 0) & (p > whole[:, None]))
                    yield rows(of, names, s, "term", part.column("term").take(pa.array(hit)), divergence(p[hit, s], whole[hit]))
                    if of not in sums:
                        sums[of] = np.zeros((len(names), len(names)), np.int64)
                    for i in range(len(names)):
                        sums[of][i] += divergence(p[:, i : i + 1], p).sum(axis=0)
                if sum(x.size for x in sums.values()) > CELLS:
                    yield from (pair_rows(k, list(shared.value[k][0]), x) for k, x in sums.items())
                    sums = {}
        yield from (pair_rows(k, list(shared.value[k][0]), x) for k, x in sums.items())

    bounded_batches(spark)
    found = durable(stripes.select("lang", "term", "sources").mapInArrow(emit, schema))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.unionByName(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    with scratch(spark):
        return durable(source_divergence(docs), kept=True)


OP11_SQL = """
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term from t group by all having count(distinct id) >= 3),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
g as (select lang, source, coalesce(v, 0) as v, coalesce((select sum(n) from c where c.lang = s.lang and c.source = s.source), 0) as total from (select distinct lang, source from d) s left join v using (lang)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (select sum(total) + any_value(v) from g where g.lang = p.lang) as q from p group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every_pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from every_pair union all from terms)
qualify part = 'pair' or rank <= 200
"""
