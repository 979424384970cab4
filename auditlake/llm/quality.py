"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, field, fresh, utf8

#: Labelled documents that are fitted and broadcast at most, those of the smallest hash of their id; 4,000 vectors of
#: RANK float32 are under 1 MB.
SAMPLE, RANK, NEIGHBOURS, SHARPNESS, THRESHOLD = 4000, 32, 9, 4, 0.3
#: Documents whose cosines are computed at once, bytes of a long text whose terms are counted at once, and of short texts.
BLOCK, PIECE, PACK = 256, 1 << 20, 1 << 18

# The terms: hashed runs of three bytes, hashed words, pairs of neighbouring character kinds, and four of the whole text.
GRAMS, WORDS, PAIRS = 1024, 512, 256
N_TERMS = GRAMS + WORDS + PAIRS + 4
# A byte's kind:
_KINDS = ["\n\r", " \t", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "*#$%&~^=+", "\"'`", "()[]{}<>", "-_/\\@:;"]
_KIND = np.array([next((k for k, s in enumerate(_KINDS) if b < 128 and chr(b) in s), 14 if b < 128 else 15) for b in range(256)], np.int16)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: Odd multipliers, for hashing.
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def _counts(parts: list[bytes], of: list[int], n: int) -> np.ndarray:
    """How often each gram, word and kind pair stands in the parts of each of n texts; part i is of text of[i]. No part is
    empty, and none of a run of bytes, a word or a pair spans two parts."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    x, size = b.astype(np.uint32), np.array([len(p) for p in parts])
    owner, end = np.repeat(np.array(of, np.int64), size), np.cumsum(size)
    gram = ((x[:-2] * _A) ^ (x[1:-1] * _B) ^ (x[2:] * _C)) * _A >> np.uint32(22)
    gram = owner[:-2] * GRAMS + gram
    # what begins at a part's end goes to a bin after all others
    edges = np.concatenate([end - 1, end - 2])
    gram[edges[(edges >= 0) & (edges < len(gram))]] = n * GRAMS
    kind, blank = _KIND[b], _BLANK[b]
    pair = owner[:-1] * PAIRS + (kind[:-1] * 16 + kind[1:])
    pair[end[:-1] - 1] = n * PAIRS
    first = ~blank
    first[1:] &= blank[:-1]
    heads = end[:-1]
    first[heads] = ~blank[heads]
    starts = np.flatnonzero(first)
    word = np.zeros(0, np.int64)
    if len(starts):
        # a word's hash is the sum of a hash of each byte and its place in the word
        at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
        mixed = (x[starts[0] :] + np.uint32(1)) * (_A * (at.astype(np.uint32) * np.uint32(2) + np.uint32(1)))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _B
        mixed[blank[starts[0] :]] = 0
        word = owner[starts] * WORDS + (np.add.reduceat(mixed, starts - starts[0], dtype=np.uint32) * _A >> np.uint32(23))
    counted = ((gram, GRAMS), (word, WORDS), (pair, PAIRS))
    return np.concatenate([np.bincount(v, minlength=n * k)[: n * k].reshape(n, k) for v, k in counted], 1)


def all_terms(texts: list[bytes | None]) -> np.ndarray:
    """Documents' term weights, a row each: square roots of the shares of its grams, words and kind pairs, each of their own
    kind, and those of repetition (words like the one before, words seen before), of the number of words and of their
    length. Whole texts are counted: short ones together, about PACK bytes at once, long ones in pieces of PIECE bytes, a
    word on the edge of two counting as two. Zeros for null, empty and blank texts."""
    counts, rest, worded = np.zeros((len(texts), GRAMS + WORDS + PAIRS)), np.zeros((len(texts), 4)), []
    for i, text in enumerate(texts):
        if w := text.split() if text else []:
            n, distinct = len(w), len(set(w))
            rest[i] = sum(map(eq, w, w[1:])) / n, 1 - distinct / n, np.log1p(n), min(1.0, len(text) / n / 40)
            worded.append(i)
    parts, of, held = [], [], 0

    def count():
        low = of[0]
        got = _counts(parts, [i - low for i in of], of[-1] + 1 - low)
        counts[low : of[-1] + 1] += got

    for i in worded:
        for a in range(0, len(texts[i]), PIECE):
            piece = texts[i][a : a + PIECE]
            if parts and held + len(piece) > PACK:
                count()
                parts, of, held = [], [], 0
            parts.append(piece)
            of.append(i)
            held += len(piece)
    if parts:
        count()
    for part in np.split(counts, (GRAMS, GRAMS + WORDS), axis=1):
        part /= np.maximum(1.0, part.sum(1, keepdims=True))
    rest[:, (0, 1, 3)] = np.sqrt(rest[:, (0, 1, 3)])
    rest[:, 2] /= 10
    return np.concatenate([np.sqrt(counts), rest], 1).astype(np.float32)


def terms(text: bytes | None) -> np.ndarray:
    """One document's term weights."""
    return all_terms([text])[0]


class Model:
    """Latent-semantic space of labelled documents: terms' mean and inverse document frequencies, the axes of largest
    spread of the weighted terms, the documents' unit vectors in it, and their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(0) if len(x) else np.zeros(N_TERMS, np.float32)
        self.scale = (1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))).astype(np.float32)
        # the right singular vectors of the weighted terms, largest first, are the eigenvectors of their products' sum, which is
        # added up a block at a time, so the driver holds no second copy of them
        both = np.zeros((N_TERMS, N_TERMS))
        for a in range(0, len(x), BLOCK):
            z = self._weighted(x[a : a + BLOCK]).astype(np.float64)
            both += z.T @ z
        self.axes = np.linalg.eigh(both)[1][:, : -RANK - 1 : -1].astype(np.float32) if len(x) else np.zeros((N_TERMS, 1), np.float32)
        del both
        vectors = [self._weighted(x[a : a + BLOCK]) @ self.axes for a in range(0, len(x), BLOCK)]
        self.vectors, self.y = self._unit(np.concatenate(vectors) if vectors else np.zeros((0, self.axes.shape[1]), np.float32)), y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 1.0

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale).astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with every labelled vector; the nearest NEIGHBOURS vote with cosine ** SHARPNESS, and the prior
        with a small weight, so a text without terms, or near none, gets the prior."""
        if not len(self.y):
            return np.full(len(x), self.prior)
        v = self._unit(self._weighted(x) @ self.axes)
        cos = v @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
        out = ((weight * self.y[near]).sum(1) + 0.01 * self.prior) / (weight.sum(1) + 0.01)
        return np.where(x.any(1), np.clip(out, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most `sample` labelled rows that aren't held out (crc32(id as text) mod 5 is not 0).

    Labels null, or other than 0 and 1, take no part; of an id with both, 0 counts. An id's several rows of documents
    each count. The sample is of bounded size and comes by hash of the id; only term weights reach the driver.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
        .groupBy(F.col(key).alias("_k"))
        .agg(F.min(label).alias("_y"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(sample)
    )
    rows = docs.select(docs[key].alias("_id"), docs[text].alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_k")).select("_k", "_y", "text")
    got = arrow_columns(rows, lambda b: [[x.tobytes() for x in all_terms(utf8(b.column(2)))]], [field("x", T.BinaryType())], drop=("text",))
    got = got.orderBy(F.xxhash64("_k"), "_k").limit(sample).collect()  # bounded by `sample`
    x, y = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, N_TERMS), np.array([r["_y"] for r in got], np.float32)
    del got  # as large as x
    return Model(x, y)


def with_quality(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """docs with the probability of label 1, and its column's name. Whole texts are scored; null and empty ones get the
    labelled share of 1."""
    name, shared = fresh(docs, "score"), docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        t = utf8(batch.column(batch.schema.get_field_index(text)))
        blocks = [shared.value.score(all_terms(t[i : i + BLOCK])) for i in range(0, len(t), BLOCK)]
        return [np.concatenate(blocks).tolist() if blocks else []]

    return arrow_columns(docs, make, [field(name, T.DoubleType())], drop=drop), name


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, _ = with_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), drop=("text",))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # no id, not held out
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
