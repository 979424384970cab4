"""Near copies: SimHash fingerprints under several hashes find the candidates, bit-sliced as in `simhash`; exact Jaccard
similarity of 5-word shingles confirms them."""

from __future__ import annotations

from functools import reduce
from math import ceil, comb, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, durable, field, fresh, small_side, utf8
from auditlake.llm.components import components, look_up
from auditlake.llm.simhash import _LOWER, SEED, bit_counts, drop_copies, least_of, links, majority
from auditlake.llm.tiles import first_cells, open_cells, open_rows

SHINGLE, SIMILAR = 5, 0.8
#: The most that a bit of two fingerprints differs with at similarity 0.8: 0.151 for long texts, 0.161 for 13 and 14 shingles,
#: 3 / 16 for the one pair of shorter texts that can be so similar and stands out, 4 and 5 shingles.
DIFFER, DIFFER_SHORT = 0.1612, 0.1875
#: A pair of similarity 0.8 is found under no fingerprint with this probability at most; one of more is missed far less.
MISS = 3e-6
#: Values that a key of one block joins by chance, in the mean; so many are compared with each other.
RUN = 512
#: Keys that a text has in one search: fingerprints are searched so many at a time.
KEYS = 192
#: Fingerprints that tell which pairs are compared exactly, and the bits in which those may differ: 5 standard deviations
#: more than 3 / 16 of them.
WIDE, WIDE_BITS = 16, 256
#: Documents and words of a group that one task compares at once; a larger group is cut into tiles.
TILE, TILE_WORDS = 1024, 2_000_000


def content(text: bytes | None) -> tuple[int, list[bytes]]:
    """A hash of the text's lower-cased words in order, 0 without words, and the words."""
    import xxhash

    w = text.translate(_LOWER).split() if text else []
    return (int(np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64).view(np.int64)[0]) if w else 0), w


def shingles(w: list[bytes]) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; fewer words than a shingle has are one shingle."""
    import xxhash

    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    k = min(SHINGLE, len(w))
    starts = [0, *ends[: len(w) - k].tolist()]
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.array([h64(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64))


def prints(s: np.ndarray, n: int) -> np.ndarray:
    """n fingerprints of distinct shingles, each under a hash of its own."""
    counts, family = np.zeros(64 * n, np.int64), np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(s), 255):  # a byte holds the counts of so many
        h = s[a : a + 255, None] + family
        for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(times)
        counts += bit_counts(h ^ (h >> np.uint64(33)), np.uint8)
    return majority(counts, len(s))


def search(texts: int) -> tuple[int, int]:
    """Blocks and radius of the search among so many texts: the shortest blocks that bring at most RUN together by chance,
    and a radius at which chance links fewer than one in five texts."""
    blocks = next((b for b in (8, 7, 6, 5, 4) if texts <= RUN * 2 ** (64 / b)), 3)
    return blocks, min(11, blocks + 4)


def needed(blocks: int, radius: int, differ: float) -> int:
    """Fingerprints, such that a pair whose bits differ with this probability is missed by all with at most MISS: one finds
    the pair if at most `radius` bits differ and some block is equal."""
    any_, none = np.ones(1), np.ones(1)  # by number of differing bits: all cases, those without an equal block
    for i in range(blocks):
        size = round(64 * (i + 1) / blocks) - round(64 * i / blocks)
        p = np.array([comb(size, k) * differ**k * (1 - differ) ** (size - k) for k in range(size + 1)])
        any_, none = np.convolve(any_, p), np.convolve(none, np.r_[0, p[1:]])
    return ceil(log(MISS) / log(1 - (any_ - none)[: radius + 1].sum()))


def with_content(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the hash of their words, and its column's name."""
    name = fresh(docs, "content")

    def make(batch):
        return [[content(t)[0] for t in utf8(batch.column(batch.schema.get_field_index(text)))]]

    return arrow_columns(docs, make, [field(name, T.LongType())]), name


def similar(texts: list[bytes], nodes: list[int]) -> list[tuple[int, int]]:
    """Links (node, first node) of texts that are joined by steps of similarity SIMILAR or more; pairs already connected
    aren't compared, nor are texts of one node. Nodes are sorted."""
    sets = [shingles(content(t)[1]) for t in texts]
    sizes = np.array([len(s) for s in sets])
    wide = np.array([prints(s, WIDE) for s in sets])
    _, at, inverse = np.unique(nodes, return_index=True, return_inverse=True)
    root = at[inverse]
    for i in range(1, len(sets)):
        near = (np.bitwise_count(wide[:i] ^ wide[i]).sum(1, dtype=np.int64) <= WIDE_BITS) & (root[:i] != root[i])
        while near.any():
            j = int(near.argmax())
            near[j] = False
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= SIMILAR * (sizes[i] + sizes[j] - both):
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
                near &= root[:i] != root[i]
    return sorted({(n, nodes[r]) for n, r in zip(nodes, root.tolist()) if n != nodes[r]})


def _compare(batches):
    import pyarrow as pa

    def links(nodes, texts):
        found = similar(texts, nodes) if len(texts) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    now, nodes, texts = None, [], []
    for batch in batches:
        for cell, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            if cell != now:
                yield links(nodes, texts)
                now, nodes, texts = cell, [], []
            nodes.append(node)
            texts.append(text)
    yield links(nodes, texts)


def candidates(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(a, b) contents of `nodes` (fingerprint, prints) that a fingerprint links, by the bit-sliced search of `simhash`."""
    each = nodes.select(F.col("fingerprint").alias("node"), F.posexplode("prints").alias("family", "fingerprint"))
    at_once, most = KEYS // blocks, nodes.agg(F.max(F.size("prints"))).first()[0] or 0
    found = [durable(links(each.where(F.col("family").between(a, a + at_once - 1)), radius, blocks, 1, "family")) for a in range(0, max(1, most), at_once)]
    return reduce(DataFrame.unionByName, found)


def near_copies(docs: DataFrame, sketched: DataFrame, blocks: int, radius: int, text: str = "text") -> DataFrame:
    """(fingerprint, component): for each content in `sketched` (key, fingerprint, words, prints) the smallest key over all
    documents that can be reached by steps of similarity SIMILAR or more.

    Contents with a fingerprint within the radius are candidates, which gives loose groups. In a loose group all pairs are
    held against each other exactly, but those that are connected already; a large group's tiles meet the first one, then two
    by two with what that leaves apart, in tasks of their own.
    """
    nodes = durable(sketched.groupBy("fingerprint").agg(F.min("key").alias("smallest"), F.max("words").alias("words"), F.first("prints").alias("prints")))
    loose = components(candidates(nodes, blocks, radius), "a", "b").withColumnRenamed("node", "fingerprint")
    grouped = durable(nodes.join(loose, "fingerprint").select("fingerprint", "root", "words"))
    tiles = durable(grouped.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("words") / TILE_WORDS)).alias("tiles"), F.count("*").alias("n")))
    placed = durable(look_up(grouped, tiles, "root").select("fingerprint", F.col("fingerprint").alias("node"), F.col("root").alias("group"), "words", "tiles"))
    read, name = with_content(docs.select(docs[text].alias("text")))
    read = read.withColumnRenamed(name, "fingerprint")

    def confirmed(rows: DataFrame, cells: Column) -> DataFrame:
        rows = durable(rows.drop("words"))
        # an exact copy's text goes to its group once
        texts = read.join(small_side(rows), "fingerprint").groupBy("fingerprint").agg(*(F.first(c).alias(c) for c in (*rows.columns, "text") if c != "fingerprint"))
        dealt = texts.select(F.explode(cells).alias("cell"), "node", "text")
        return durable(dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_compare, "a long, b long"))

    first = confirmed(placed, first_cells("group", "fingerprint", F.col("tiles")))
    near = durable(components(first, "a", "b"))
    large = placed.where("tiles > 1").drop("tiles")
    if large.take(1):
        apart = open_rows(large, near, "group", lambda which: F.greatest(F.ceil(F.sum(which.cast("long")) / TILE), F.ceil(F.sum(F.when(which, F.col("words"))) / TILE_WORDS)))
        if apart is not None:
            found = near.select(F.col("node").alias("a"), F.col("root").alias("b"))
            near = durable(components(durable(found.unionByName(confirmed(apart, open_cells("group")))), "a", "b"))
    near = near.withColumnRenamed("node", "fingerprint")
    return least_of(nodes, near)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of a group of near copies other than that of its smallest key; of repeats of that row one
    stays. In a group without any key one row stays."""

    blocks, radius = search(docs.count())
    usual, short = (needed(blocks, radius, p) for p in (DIFFER, DIFFER_SHORT))

    def sketch(batch):
        found = [content(t) for t in utf8(batch.column(1))]
        sets = [shingles(w) if w else () for _, w in found]
        made = [prints(s, short if len(s) in (4, 5) else usual).view(np.int64).tolist() if len(s) else [] for s in sets]
        return [[c for c, _ in found], [len(w) for _, w in found], made]

    fields = [field("fingerprint", T.LongType()), field("words", T.LongType()), field("prints", T.ArrayType(T.LongType()))]
    sketched = durable(arrow_columns(docs.select(docs[key].alias("key"), docs[text].alias("text")), sketch, fields, drop=("text",)))
    found = durable(near_copies(docs, sketched, blocks, radius, text))
    return drop_copies(docs, sketched.select("key", "fingerprint"), found, *with_content(docs, text), key)
