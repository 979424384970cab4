"""Centroid clustering: exact integer k-means whose assignments go through a LAESA table of distances to fixed pivots."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, bounded_batches, durable, field, fresh, scratch

SCALE, CLUSTERS, ROUNDS, DIMS, SEED = 1024, 8, 10, 64, "3"
#: Pivots of the table, and the vectors (those of the smallest hashes) that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 8, 512
#: Integers below SAFE in amount are squared and added up in 64 bits, up to 64 at a time; larger ones as Python's integers.
SAFE, LONG = 1 << 27, (1 << 63) - 1
LIMB = 32
#: Vectors whose distances are computed at once.
CHUNK = 4096


def usable(vector: str, dims: int = DIMS) -> Column:
    """Whether a vector has exactly `dims` components, none null, infinite or no number."""
    return F.coalesce((F.size(vector) == dims) & F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def floats(column: pa.Array, dims: int) -> np.ndarray:
    """A column of usable vectors as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers if all are below SAFE in amount, else Python's."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale))  # noqa: E731  (from 2**53 on, a double is an integer)
    return np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if a.shape[1] > 64 or len(a) and max(_most(a), _most(b)) >= SAFE:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=1)


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _roots(d: np.ndarray) -> np.ndarray:
    """Square roots as doubles, infinite where a double can't hold the square."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([float(v) ** 0.5 if v < 10**300 else np.inf for v in d.tolist()], np.float64)


def to_points(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances, as doubles, of each row of q to each point."""
    return np.stack([_roots(squared(q, points[j : j + 1])) for j in range(len(points))], axis=1) if len(points) else np.zeros((len(q), 0))


def choose_pivots(q: np.ndarray, n: int) -> np.ndarray:
    """n rows of q far from each other: the first one, then ever the one of the largest sum of distances to those chosen."""
    if not len(q):
        return q
    chosen, total = [0], np.zeros(len(q))
    while len(chosen) < min(n, len(q)):
        total = total + to_points(q, q[chosen[-1] : chosen[-1] + 1])[:, 0]
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
    return q[chosen]


def nearest(q: np.ndarray, table: np.ndarray, centroids: np.ndarray, table_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the number of its nearest centroid (ties: the smaller), the exact squared distance, and how many
    exact distances that took.

    table: distances of the rows to the pivots, table_of: those of the centroids. The largest difference of a row's and a
    centroid's distances to a pivot is a lower bound of their distance. Centroids are tried by rising bound, and a row is
    done once the next bound exceeds its best distance, by more than doubles may be wrong.
    """
    n, k = len(q), len(centroids)
    with np.errstate(invalid="ignore"):
        gap = np.abs(table[:, None, :] - table_of[None, :, :]) - 1e-9 * (table[:, None, :] + table_of[None, :, :])
    low = np.nan_to_num(gap, nan=0.0, posinf=0.0, neginf=0.0).max(axis=2, initial=0.0)
    order = np.argsort(low, axis=1, kind="stable")
    best, number, tried = np.zeros(n, q.dtype), np.full(n, -1), np.zeros(n, np.int64)
    alive = np.arange(n)
    for j in range(k):
        c = order[alive, j]
        d = squared(q[alive], centroids[c])
        if d.dtype != best.dtype:
            best = best.astype(object)
        better = (number[alive] < 0) | (d < best[alive]) | ((d == best[alive]) & (c < number[alive]))
        best[alive[better]], number[alive[better]] = d[better], c[better]
        tried[alive] += 1
        if j + 1 < k:
            alive = alive[low[alive, order[alive, j + 1]] <= _roots(best[alive])]
    return number, best, tried


def _assigned(batch: pa.RecordBatch, dims: int, scale: int, centroids: np.ndarray, table_of: np.ndarray):
    """Chunks of a batch (vector, pivot distances): integers, cluster, distance, tries."""
    x = floats(batch.column(0), dims)
    table = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    for a in range(0, len(x), CHUNK):
        q = whole(x[a : a + CHUNK], scale)
        yield q, *nearest(q, table[a : a + CHUNK], centroids, table_of)


def _limbs(v: int):
    """v as digits to the base 2**LIMB, least first, the last one signed: long columns then hold any integer."""
    at = 0
    while not -(1 << 62) < v < (1 << 62):
        yield at, v & ((1 << LIMB) - 1)
        v, at = v >> LIMB, at + 1
    if v:
        yield at, v


def _next_centroids(stored: DataFrame, vector: str, table: str, dims: int, scale: int, centroids: np.ndarray, table_of: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each centroid's vectors; an empty one stays. Tasks add up what they read and send
    one row a centroid and component; k x dims sums reach the driver."""
    shared = stored.sparkSession.sparkContext.broadcast((centroids, table_of))

    def sums(batches):
        held, held_of = shared.value
        total = np.zeros((len(held), dims + 1), object)
        for batch in batches:
            for q, number, _, _ in _assigned(batch, dims, scale, held, held_of):
                for c in np.unique(number):
                    mine = q[number == c]
                    total[c, :dims] += np.array(mine.sum(axis=0).tolist(), object)
                    total[c, dims] += len(mine)
        rows = [(c, d, at, v) for c in range(len(held)) for d in range(dims + 1) for at, v in _limbs(int(total[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "d", "at", "v"])

    bounded_batches(stored.sparkSession)
    parts = stored.select(vector, table).mapInArrow(sums, "c int, d int, at int, v long")
    got = parts.groupBy("c", "d", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # k x dims numbers
    shared.destroy()
    total = np.zeros((len(centroids), dims + 1), object)
    for r in got:
        total[r.c, r.d] += int(r.v) << (LIMB * r.at)
    new = [[int(s) // int(row[dims]) for s in row[:dims]] if row[dims] else [int(v) for v in old] for row, old in zip(total, centroids)]
    return _held(new)


def _held(rows: list[list[int]]) -> np.ndarray:
    fits = all(abs(v) < SAFE for row in rows for v in row)
    return np.array(rows, np.int64 if fits else object)


def centroid_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, tuple[str, str, str]]:
    """df's rows with a usable vector, with their cluster (int), squared distance (long) and number of exact distances that
    the last assignment took; the final centroids; and the three columns' names (with an underscore before them where df
    has a column of that name).

    Components become floor(scale * x). Centroids start as the k vectors of the smallest sha256 of "seed:key" (rows without
    a key last; equal ones by vector; all, if fewer), go through `rounds` of assignment and floor of mean, and a last
    assignment. A row's distances to `pivots` fixed vectors are stored with it once, in the shared folder; each round reads
    that table, bounds every centroid's distance by them, and computes exact integer distances to those that remain.

    Vectors of another length, or null, or holding null or non-finite components are left out. Repeated rows each count.
    A distance that a long can't hold (components past 2**27) is null; clusters are exact all the same. An empty table
    gives an empty one. What reaches the driver is k x dims sums a round and PIVOT_SAMPLE vectors at the start.
    """
    names = tuple(fresh(df, n) for n in ("cluster", "distance", "exact_distances"))
    table = fresh(df, "pivot_distances")
    fields = [field(names[0], T.IntegerType()), field(names[1], T.LongType()), field(names[2], T.IntegerType())]
    kept = df.where(usable(vector, dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = kept.select(digest.alias("_h"), F.col(key).alias("_k"), F.col(vector).alias("_v")).orderBy(F.asc_nulls_last("_h"), "_k", "_v").limit(max(PIVOT_SAMPLE, k)).select("_v").collect()
    sample = whole(np.array([r[0] for r in first], np.float64).reshape(-1, dims), scale)
    centroids, points = _held(sample[:k].tolist()) if len(sample) else np.zeros((0, dims), np.int64), choose_pivots(sample, pivots)
    if not len(sample):
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return kept.limit(0).select("*", *nothing), centroids, names

    at, of_table = df.columns.index(vector), len(df.columns)
    measured = arrow_columns(kept, lambda b: [pa.array(list(to_points(whole(floats(b.column(at), dims), scale), points)), pa.list_(pa.float64()))], [field(table, T.ArrayType(T.DoubleType()))])
    stored = durable(measured)
    for _ in range(rounds):
        centroids = _next_centroids(stored, vector, table, dims, scale, centroids, to_points(centroids, points))

    def last(batch):
        pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(of_table)], names=["v", "t"])
        found = [(number.tolist(), [int(d) if d <= LONG else None for d in best.tolist()], tried.tolist()) for _, number, best, tried in _assigned(pair, dims, scale, centroids, to_points(centroids, points))]
        return [[v for part in found for v in part[i]] for i in range(3)]

    return arrow_columns(stored, last, fields, drop=(table,)), centroids, names


def inertias(assigned: DataFrame, centroids: np.ndarray, cluster: str, distance: str) -> DataFrame:
    """A row for each cluster: its and the whole sum of distances (null where a long can't hold it), and the digest of its
    centroid. At most k rows."""
    wide = F.when(F.count("*") == F.count(distance), F.sum(F.col(distance).cast("decimal(38,0)")))
    sums = {r[0]: r[1] for r in assigned.groupBy(cluster).agg(wide).collect()}
    fits = lambda v: None if v is None or v > LONG else int(v)
    total = fits(None if None in sums.values() else sum(sums.values()))
    rows = [(c, fits(sums[c]), total, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids.tolist()) if c in sums]
    return assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    with scratch(spark):
        assigned, centroids, (cluster, distance, _) = centroid_clusters(vectors)
        slim = durable(assigned.select("vec_id", cluster, distance), kept=True)
    return slim.join(F.broadcast(inertias(slim, centroids, cluster, distance)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds one after the other, each a pair of CTEs."""
    near = "select v.r, min({{'d': list_sum([z[1] * z[1] for z in [[v.q[i] - c.q[i]] for i in range(1, 65)]]), 'c': c.c}}) as m from v, c{i} c group by v.r"
    parts = [
        "v as materialized (select row_number() over () as r, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as q from embeddings where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64)",
        "c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), vec_id, q) - 1 as c, q from v qualify c < 8)",
    ]
    for i in range(ROUNDS):
        parts += [
            f"a{i} as materialized ({near.format(i=i)})",
            f"s{i} as materialized (select m.c as c, i, sum(q[i])::hugeint as s, count(*) as n from (select a.m, v.q, unnest(range(1, 65)) as i from a{i} a join v using (r)) group by all)",
            f"c{i + 1} as materialized (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as q from s{i} group by c union all select c, q from c{i} where c not in (select c from s{i}))",
        ]
    parts.append(f"a{ROUNDS} as materialized ({near.format(i=ROUNDS)})")
    return (
        f"with {', '.join(parts)} select vec_id, m.c::int as cluster, m.d::bigint as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia, "
        f"sha256(array_to_string(c.q, ',')) as centroid_sha256 from a{ROUNDS} a join v using (r) join c{ROUNDS} c on c.c = a.m.c"
    )


OP13_SQL = _sql()
