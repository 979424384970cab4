"""Nearest neighbours by shifted space-filling curves, with an exact check of blocks that may still hold a nearer one."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from auditlake.llm.common import bounded_batches, durable

CURVES, DIMENSIONS, BITS = 6, 8, 8
#: Vectors of one key window; a query looks through its own and the two next to it on each curve.
WINDOW = 4096
#: Bytes of placed vectors in one range of the curves, which a task streams; how many windows it holds doesn't matter.
RANGE_BYTES = 128 << 20
#: Bytes of queries held by a task at once, and rows of them and of vectors that meet at once.
QUERY_BYTES, ROW_BLOCK, QUERY_STEP = 16 << 20, 1024, 512
#: What a row of the search is: a pair, a row of the window before or after the edge of two ranges, a vector.
FOUND, EARLIER, LATER, ROW = range(4)
#: Inner products from a matrix product are taken up to this, then computed anew one by one.
SLACK = 1e-9


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with integer coordinates below 2**bits, a row each: undo the curve's rotations bit by
    bit, Gray-code, then interleave (Skilling 2004)."""
    x = x.astype(np.uint64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            on = (x[i] & q) > 0
            t = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[d - 1] >> np.uint64(b)) & np.uint64(1) > 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


class Curves:
    """Seeded random projections, each with a shift of a part of its range, and the Hilbert keys they give."""

    def __init__(self, dims: int, n: int = CURVES, seed: int = 7):
        r = np.random.default_rng(seed)
        self.d = min(DIMENSIONS, dims)
        self.axes = [np.linalg.qr(r.standard_normal((dims, dims)))[0][:, : self.d] for _ in range(n)]
        self.shifts = [r.random(self.d) for _ in range(n)]

    def keys(self, v: np.ndarray, spread: float):
        """Signed keys of each curve. `spread` is the vectors' root mean square coordinate, the same for all of them."""
        for axes, shift in zip(self.axes, self.shifts):
            at = (v @ axes) / (6 * spread) + 0.25 + shift / 2  # most within [0, 1)
            cell = np.clip(np.floor(at * (1 << BITS)), 0, (1 << BITS) - 1)
            yield (hilbert(cell, BITS) ^ np.uint64(1 << 63)).view(np.int64) if self.d * BITS == 64 else hilbert(cell, BITS).view(np.int64)


def best_pairs(q_ids, q, ids, v, k: int, floor: np.ndarray | None = None):
    """(query, vector, score) of each query's k largest inner products, not below its floor; ties to smaller ids. An id that
    repeats, on either side, counts once, at its best score."""
    out, most = [], k * int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else k
    for a in range(0, len(q), QUERY_STEP):
        qs, qi = q[a : a + QUERY_STEP], q_ids[a : a + QUERY_STEP]
        s = qs @ v.T
        s[qi[:, None] == ids[None, :]] = -np.inf  # the query's own row
        least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most] if s.shape[1] > most else np.full(len(qs), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[a : a + QUERY_STEP])
        i, j = np.nonzero((s >= (least - SLACK)[:, None]) & (s > -np.inf))
        for b in range(0, len(i), 200_000):
            out.append((qi[i[b : b + 200_000]], ids[j[b : b + 200_000]], (qs[i[b : b + 200_000]] * v[j[b : b + 200_000]]).sum(1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y, s = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((y, -s, x))
    x, y, s = x[order], y[order], s[order]
    if most > k or len(np.unique(q_ids)) < len(q_ids):
        best = np.zeros(len(x), bool)
        best[np.unique(np.stack([x, y]), axis=1, return_index=True)[1]] = True  # the first of each pair
        x, y, s = x[best], y[best], s[best]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return x[rank < k], y[rank < k], s[rank < k]


def _matrix(column, kind: str) -> np.ndarray:
    """Vectors of a binary column, a row each, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def _distinct(ids: np.ndarray, v: np.ndarray):
    """Ids and vectors with each pair once: ids may repeat, and windows where a curve ends and the next one starts hold
    vectors of both."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    first = list({(i, x.tobytes()): at for at, (i, x) in enumerate(zip(ids.tolist(), v))}.values())
    return ids[first], v[first]


def _windows(batches, size: int, kind: str):
    """(ids, vectors) of each `size` rows of a sorted stream of (vec_id, v, ...), the last window with what is left."""
    ids, data = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        data += batch.column(1).to_pylist()
        while len(ids) >= size:
            yield np.array(ids[:size], np.int64), np.frombuffer(b"".join(data[:size]), kind).reshape(size, -1)
            ids, data = ids[size:], data[size:]
    if ids:
        yield np.array(ids, np.int64), np.frombuffer(b"".join(data), kind).reshape(len(ids), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a non-zero vector of finite components, of the most common length (of equally
    common ones the smaller)."""
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n")).drop("n")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, exact: bool = True, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product for each row whose id is divisible by `every`.

    Each vector gets keys on `curves` shifted Hilbert curves of random projections. The curves, one after the other, are
    cut into ranges of (curve, key, hash of id) of about RANGE_BYTES, and each task streams its range in windows of
    `window` rows: a query meets its own window and both neighbours on every curve, in double precision. The first and
    the last window of a range go to the ranges beside it. The windows' best merge: that is the index's answer, and all
    of it if not `exact`. The hash splits equal keys, so a vector that many rows share fills many windows.

    With `exact`, a check follows for vectors without structure, where no fixed number of windows holds the nearest: the
    k-th score found is a floor, and queries, in blocks of QUERY_BYTES one after the other, meet each block of rows
    unless the block's centre and radius show that none reaches the floor; only rows at or above it are returned, and
    written out before the next block of queries starts.

    Rows whose id or vector is null, zero, non-finite or of another length than most take no part. Repeated ids are one
    neighbour, at their best score. Fewer candidates than k give all; an empty table gives none. Other columns are not
    read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "<f4" if vectors.schema[vector].dataType.elementType == T.FloatType() else "<f8"  # as given: half the bytes
    rows = durable(usable(vectors, key, vector))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) / F.size("v")).alias("ms")).first()
    result = "query_id long, vec_id long, score double"
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared, spread = spark.sparkContext.broadcast(Curves(shape.d, curves)), float(np.sqrt(shape.ms))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            ids, v = batch.column(0), np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            data = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            for c, keys in enumerate(shared.value.keys(v, spread)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), ids, data], names=["curve", "key", "vec_id", "v"])

    placed = rows.mapInArrow(place, "curve int, key long, vec_id long, v binary")
    width = shape.d * int(kind[-1]) + 24
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), curves * shape.n * width // RANGE_BYTES)
    ranges = max(1, min(ranges, curves * shape.n // (2 * window)))  # two windows at least, where the table is small
    order = ["curve", "key", F.xxhash64("vec_id"), "vec_id"]
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("vec_id", "v", "curve", F.spark_partition_id().alias("part"))

    def search(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(kind_of, n, query_id=None, vec_id=None, score=None, edge=None, v=None):
            columns = [pa.array(np.full(n, kind_of, np.int32))]
            for x, t in ((query_id, pa.int64()), (vec_id, pa.int64()), (score, pa.float64()), (edge, pa.int32()), (v, pa.binary())):
                columns.append(pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t))
            return pa.RecordBatch.from_arrays(columns, names=["kind", "query_id", "vec_id", "score", "edge", "v"])

        def edge(kind_of, at, rows):
            return out(kind_of, len(rows[0]), vec_id=rows[0], edge=np.full(len(rows[0]), at, np.int32), v=[x.tobytes() for x in rows[1]])

        def met(middle, beside):
            """The queries of `middle` among its rows and those beside it."""
            asks = middle[0] % every == 0
            if asks.any():
                q_ids, q = _distinct(middle[0][asks], middle[1][asks].astype(np.float64))
                ids, v = _distinct(np.concatenate([w[0] for w in beside]), np.concatenate([w[1] for w in beside]).astype(np.float64))
                x, y, s = best_pairs(q_ids, q, ids, v, k)
                yield out(FOUND, len(x), x, y, s)

        part, near, first = None, [], []  # range, last windows up to three, rows of the first curve to be written

        def stream():
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(3)[0].as_py()
                    if exact:
                        first.append(batch.filter(pc.equal(batch.column(2), 0)))
                    yield batch

        for w in _windows(stream(), window, kind):
            while first:
                rows = first.pop(0)
                yield out(ROW, rows.num_rows, vec_id=rows.column(0), v=rows.column(1))
            if not near:
                yield edge(LATER, part, w)
            near = [*near[-2:], w]
            if len(near) > 1:
                yield from met(near[-2], near)
        if near:
            yield edge(EARLIER, part + 1, near[-1])
            yield from met(near[-1], near[-2:])

    crossed = durable(dealt.mapInArrow(search, "kind int, query_id long, vec_id long, score double, edge int, v binary"))

    def meet(table):
        """Queries of the window before an edge among the rows of the one after it, and the other way round."""
        import pyarrow as pa

        sides = table.column("kind").to_numpy()
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), kind)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b in ((EARLIER, LATER), (LATER, EARLIER)):
            asks = (sides == a) & (ids % every == 0)
            if asks.any() and (sides == b).any():
                parts.append(best_pairs(*_distinct(ids[asks], v[asks]), *_distinct(ids[sides == b], v[sides == b]), k))
        x, y, s = (np.concatenate(c) for c in zip(*parts))
        return pa.table({"query_id": x, "vec_id": y, "score": s})

    edges = crossed.where(F.col("kind").isin(EARLIER, LATER)).select("edge", "kind", "vec_id", "v").groupBy("edge").applyInArrow(meet, result)
    met = crossed.where(F.col("kind") == FOUND).select("query_id", "vec_id", "score").unionByName(edges)
    place_of = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place_of).where(F.col("rank") <= k)
    found = durable(top(met))
    if exact:
        floor = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        base = crossed.where(F.col("kind") == ROW).select("vec_id", "v")  # in the order of the first curve
        queries = durable(base.where(F.col("vec_id") % every == 0).join(floor, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "floor"))
        blocks = -(-queries.count() * shape.d * 8 // QUERY_BYTES)
        parts = [found.select("query_id", "vec_id", "score")]
        for b in range(blocks):
            mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BYTES
            if mine:
                parts.append(_checked(base, mine, k, result, kind))
        found = top(reduce(DataFrame.unionByName, parts))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _checked(base: DataFrame, queries: list, k: int, schema: str, kind: str) -> DataFrame:
    """Rows of base at or above a query's floor, at most k a query and block of rows; written out."""
    ids, q = np.array([r.vec_id for r in queries], np.int64), np.frombuffer(b"".join(bytes(r.v) for r in queries), kind).astype(np.float64).reshape(len(queries), -1)
    floor = np.array([-np.inf if r.floor is None else r.floor for r in queries])
    shared = base.sparkSession.sparkContext.broadcast((ids, q, floor, np.linalg.norm(q, axis=1)))

    def run(batches):
        import pyarrow as pa

        ids, q, floor, length = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(a, ROW_BLOCK)
                v = _matrix(part.column(1), kind)
                centre = v.mean(0)
                radius = np.sqrt(((v - centre) ** 2).sum(1).max())
                near = q @ centre + length * radius >= floor - SLACK
                if near.any():
                    x, y, s = best_pairs(ids[near], q[near], part.column(0).to_numpy(), v, k, floor[near])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(s)], names=["query_id", "vec_id", "score"])

    done = durable(base.mapInArrow(run, schema))
    shared.destroy()
    return done


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
