"""SimHash near-duplicates: bit-sliced comparison of fingerprints that share bits of a key."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from auditlake.llm.common import arrow_columns, durable, field, fresh, small_side, utf8
from auditlake.llm.components import components, look_up
from auditlake.llm.tiles import first_cells, open_cells, open_rows

RADIUS, SHINGLE, SEED = 4, 4, 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Rows of a key that one task compares at once; a larger key is cut into tiles.
TILE = 8192
#: Rows taken from the sorted stream at once; a key's rows stay together.
CHUNK = 1 << 17


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half of the XXH64 values of the text's 4-word shingles, repeats included; 0 without words."""
    import xxhash

    w = text.translate(_LOWER).split() if text else []
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    k = min(SHINGLE, len(w))
    starts = [0, *ends[: len(w) - k].tolist()]
    h64, view = xxhash.xxh64_intdigest, joined
    h = np.array([h64(view[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for s in range(0, len(h), 4096):
        counts += bit_counts(h[s : s + 4096, None])
    return int(majority(counts, len(h))[0])


def bit_counts(h: np.ndarray, kind=np.int64) -> np.ndarray:
    """How many of the rows of h (uint64, contiguous) have each bit, for the bits of all columns; `kind` holds the counts."""
    return np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=kind)


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints, one for 64 counts, of bits that over half of n hashes have."""
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """docs with their fingerprint as a signed long, and its column's name."""
    name = fresh(docs, "fingerprint")

    def make(batch):
        return [np.array([fingerprint(t) for t in utf8(batch.column(batch.schema.get_field_index(text)))], np.uint64).view(np.int64).tolist()]

    return arrow_columns(docs, make, [field(name, T.LongType())], drop=drop), name


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 x: row b holds bit b of every value, packed into words, with a spare word at the end."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = -(-len(x) // 64) * 8
    out = np.zeros((64, n + 8), np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def within(planes: np.ndarray, lag: int, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of `lanes` (packed) hold an i whose value and the one `lag` after differ in at most `radius` bits.

    Carry-save counters, as many as the radius has bits, and a sticky overflow hold all distances at once, one bit a lane;
    after every 8 planes lanes beyond the radius drop out, and when none is left the block is abandoned.
    """
    n, (word, bit) = len(lanes), divmod(lag, 64)
    counters = [np.zeros(n, np.uint64)] * radius.bit_length()
    alive = lanes.copy()
    for b in range(64):
        row = planes[b]
        low = row[word : word + n]
        if len(low) < n:
            low = np.concatenate([low, np.zeros(n - len(low), np.uint64)])
        if bit:
            high = row[word + 1 : word + 1 + n]
            if len(high) < n:
                high = np.concatenate([high, np.zeros(n - len(high), np.uint64)])
            low = (low >> np.uint64(bit)) | (high << np.uint64(64 - bit))
        carry = row[:n] ^ low
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        alive &= ~carry
        if b % 8 == 7:
            alive &= ~beyond(counters, radius)
            if not alive.any():
                break
    return alive


def beyond(counters: list[np.ndarray], radius: int):
    """Lanes whose count, lowest bit first, is over the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def sunk(root: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """root, the smallest known index of each index's group, after links left to right; groups so far stay together."""
    held = np.flatnonzero(root != np.arange(len(root)))
    left, right = np.concatenate([held, *left]), np.concatenate([root[held], *right])
    while True:  # labels sink to the smallest index of their group
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, first linked node) within runs of equal key: a spanning star for each group of a run, in which all
    nodes whose values are joined by steps of at most `radius` bits meet. A node is its value where none are given; rows of
    one node are joined already. Rows are sorted by key, and by node where one has several of a run."""
    nodes = values if nodes is None else nodes
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(keys)]
    sizes = ends - starts
    again = np.r_[False, (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])][: len(keys)]
    root = np.maximum.accumulate(np.where(again, 0, np.arange(len(values))))
    top = 1
    while top < sizes.max(initial=1):
        top, low = top * 2, top
        pick = (sizes > low) & (sizes <= top)
        if not pick.any():
            continue
        # runs of like size are compared together, lag by lag
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts[pick], ends[pick])])
        run = np.repeat(np.arange(pick.sum()), sizes[pick])
        v, planes = values[at], planes_of(values[at])
        n = len(v)
        left, right, waiting, met = [], [], 0, root[at] if again.any() else None
        for lag in range(1, int(sizes[pick].max())):
            same = np.zeros(planes.shape[1] * 64 - 64, bool)
            same[: n - lag] = run[lag:] == run[:-lag]
            if met is not None:  # what is joined already isn't compared
                same[: n - lag] &= met[lag:] != met[:-lag]
                if not same.any():
                    continue
            hit = within(planes, lag, np.packbits(same, bitorder="little").view(np.uint64), radius)
            if hit.any():
                i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
                left.append(at[i])
                right.append(at[i + lag])
                waiting += len(i)
                if waiting > n:  # a crowd: its links become a star, so they never are more than a few for each value
                    root = sunk(root, left, right)
                    left, right, waiting, met = [], [], 0, root[at]
        if left:
            root = sunk(root, left, right)
    got = np.flatnonzero(nodes != nodes[root])
    return nodes[got], nodes[root[got]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join the same nodes as the links a to b: one for each node but the smallest of its
    group, however many keys link it."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = sunk(np.arange(len(nodes)), [at[: len(a)]], [at[len(a) :]])
    got = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[got], nodes[root[got]]


def _runs(batches):
    """(key, value, node) arrays of a stream that is sorted by key, node its column of that name or the value; a key's rows
    come in one piece."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1))]
        got.append(batch.column("node").to_numpy(zero_copy_only=False) if "node" in batch.schema.names else got[1])
        held = [np.r_[a, b] for a, b in zip(held, got)]
        key = held[0]
        if len(key) >= CHUNK and key[-1] != key[0]:
            cut = np.flatnonzero(key != key[-1])[-1] + 1
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield held


def _comparer(radius: int):
    def compare(batches):
        import pyarrow as pa

        for key, value, node in _runs(batches):
            a, b = forest(*linked(key, value.view(np.uint64), radius, node))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return compare


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = 6, agree: int | None = None, family: str | None = None) -> DataFrame:
    """(a, b) fingerprints, such that those of `prints` (fingerprint, distinct) within the radius are connected.

    The 64 bits are cut into `blocks`; values that differ in at most `radius` bits agree on blocks - radius of them, so
    they meet under one of the keys that any such blocks make (15 keys of about 21 bits, two of six blocks each). A key's
    rows are sorted together and compared bit-sliced. Keys are counted first; those of one row are dropped before
    Python, and a key of more than TILE rows is cut into tiles, dealt by tile from the start, so no task sees a whole large
    key: all tiles meet the first one, and each two of them with the rows that aren't joined by then (`tiles`), so no row is
    left out, and a crowd's links don't grow with the square of its size.

    With `agree` keys are made of that many blocks instead, and only those within the radius that agree on some such blocks
    are connected: fingerprints of one text under several hashes, told apart by the column `family`, then make up for it.
    Where prints has a column `node`, (a, b) are nodes.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), agree or blocks - radius):
        m = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    parts = [F.col(family)] if family else []
    made = F.array(*(F.xxhash64(F.lit(i), *parts, F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    columns = ["key", "fingerprint", *(["node"] if "node" in prints.columns else [])]
    keyed = prints.withColumn("key", F.explode(made)).select(*columns)
    counts = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))  # combined before the shuffle
    schema, compare = "a long, b long", _comparer(radius)
    # a key's rows must stand in one task, where the join has dealt them; the window asks for that, so adaptive execution, which
    # may else split a skewed partition of the join, leaves it whole
    # smallest nodes first: they become the stars' centres, so a crowd's links under many keys mostly are the same ones
    place = F.row_number().over(W.partitionBy("key").orderBy(columns[-1]))
    plain = keyed.join(counts.where(F.col("n") <= TILE).hint("shuffle_hash"), "key").select(*columns, place.alias("place")).sortWithinPartitions("key", columns[-1]).mapInArrow(compare, schema)
    large = counts.where(F.col("n") > TILE)  # at most keys / TILE rows
    if not large.take(1):
        return plain.where("a != b").distinct()

    def met(rows: DataFrame, cells: Column) -> DataFrame:
        dealt = rows.select(F.explode(cells).alias("key"), "fingerprint", "node").repartition("key").sortWithinPartitions("key", "node")
        return dealt.mapInArrow(compare, schema)

    # a large key's tiles meet its first one; what that leaves apart meets in cells of two tiles
    tiled = keyed.join(small_side(large), "key").select("key", "fingerprint", F.col(columns[-1]).alias("node"), F.ceil(F.col("n") / TILE).alias("tiles"))
    first = met(tiled, first_cells("key", "fingerprint", F.col("tiles")))
    near = durable(components(durable(plain.unionByName(first)), "a", "b"))
    found = near.select(F.col("node").alias("a"), F.col("root").alias("b"))
    apart = open_rows(tiled.drop("tiles"), near, "key", lambda which: F.ceil(F.sum(which.cast("long")) / TILE))
    return found if apart is None else found.unionByName(met(apart, open_cells("key"))).where("a != b").distinct()


def near_duplicates(prints: DataFrame, key: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """(fingerprint, component): for each fingerprint that a document has, the smallest key over all documents that can
    be reached by steps of at most RADIUS differing bits. Equal fingerprints are one node; null keys are reached but
    never smallest."""
    nodes = durable(prints.groupBy(F.col(print_col).alias("fingerprint")).agg(F.min(key).alias("smallest")))
    near = durable(components(durable(links(nodes.select("fingerprint"))), "a", "b").withColumnRenamed("node", "fingerprint"))
    return least_of(nodes, near)


def least_of(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(fingerprint, component) of nodes (fingerprint, smallest), where near (fingerprint, root) groups some of them: the
    smallest of the group. Both are durable."""
    grouped = durable(nodes.select("fingerprint", "smallest").join(near, "fingerprint"))
    least = durable(grouped.groupBy("root").agg(F.min("smallest").alias("component"), F.count("*").alias("n")))
    alone = nodes.select("fingerprint", F.col("smallest").alias("component")).join(near, "fingerprint", "left_anti")
    return look_up(grouped, least, "root").select("fingerprint", "component").unionByName(alone)


def label_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component) for every row of docs. Null and empty texts have fingerprint 0 and link alike;
    repeated rows each come back; an empty table gives an empty result."""
    prints = durable(with_fingerprints(docs.select(docs[key].alias("key"), docs[text].alias("text")), drop=("text",))[0])
    found = durable(near_duplicates(prints, "key"))
    return prints.join(found, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of a group other than that of its smallest key; of repeats of that row one stays. In a
    group without any key one row stays."""
    slim = durable(with_fingerprints(docs.select(docs[key].alias("key"), docs[text].alias("text")), drop=("text",))[0])
    return drop_copies(docs, slim, durable(near_duplicates(slim, "key")), *with_fingerprints(docs, text), key)


def drop_copies(docs: DataFrame, slim: DataFrame, found: DataFrame, with_print: DataFrame, name: str, key: str) -> DataFrame:
    """docs without all but one row of each component. slim has (key, fingerprint) of every row, found (fingerprint,
    component), with_print is docs with the fingerprint in column `name`."""
    marked = durable(slim.join(found, "fingerprint").withColumn("stays", F.coalesce(F.col("key") == F.col("component"), F.col("component").isNull())))
    out = marked.where("not stays").select("key").where("key is not null").distinct()
    repeats = marked.where("stays").groupBy("key", "component", F.when(F.col("key").isNull(), F.col("fingerprint"))).count().where("count > 1")
    loose = marked.where("not stays and key is null")
    # the usual case: a key is one row, so rows go by key alone; the text isn't shuffled if those that go are few
    if not repeats.take(1) and not loose.take(1) and not marked.where("stays").join(out, "key", "left_semi").take(1):
        gone = fresh(docs, "_gone")
        return docs.join(small_side(durable(out)).withColumnRenamed("key", gone), docs[f"`{key}`"] == F.col(gone), "left_anti")
    # names that no column of docs has
    k, f, c, group = (fresh(with_print, x) for x in ("_k", "_f", "_c", "_group"))
    keep = durable(marked.where("stays").select(F.col("key").alias(k), F.col("fingerprint").alias(f), F.col("component").alias(c)).distinct())
    one = with_print.join(keep, with_print[f"`{key}`"].eqNullSafe(F.col(k)) & (with_print[name] == F.col(f)))
    one = one.withColumn(group, F.when(F.col(c).isNull(), F.col(f))).dropDuplicates([k, group])
    return one.select(*(with_print[f"`{x}`"] for x in docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
