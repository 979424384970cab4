"""Language identification: words first, then ever shorter character n-grams of the words that aren't known."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, field, fresh, strings

#: Bounds of what is fitted: documents a language (those of the smallest hashes of their ids), languages (those of most
#: documents), and words and n-grams of each length a language (the most frequent).
LEARNED, LANGUAGES, TERMS = 800, 500, 10000
#: Cells of the model at most; with many languages each has fewer terms.
CELLS = 40_000_000
#: Documents that must hold a word for it to count as known, the longest n-gram, and what a term costs that a language hasn't:
#: minus the decimal logarithm of its share.
LEAST, LONGEST, PENALTY = 2, 5, 7.0
#: Unseen words whose costs a worker remembers.
REMEMBERED = 200_000
UNKNOWN = "und"

# A word: letters and the marks on them; a longer run than 32 is several words.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,31}")
_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else (b if 0x61 <= b <= 0x7A else 0x20) for b in range(128)) + b" " * 128


def words(text: str | None) -> list[str]:
    """Lower-cased words of the whole text."""
    if not text:
        return []
    if text.isascii():  # the same words, several times quicker
        found = text.encode().translate(_ASCII).decode().split()
        return found if max(map(len, found), default=0) <= 32 else [w[i : i + 32] for w in found for i in range(0, len(w), 32)]
    return _WORD.findall(text.lower())


class Model:
    """Costs of terms (minus the decimal logarithm of their share in a language), a row a term and a column a language.

    languages are in order; counts[0] are words, counts[n] n-grams: (language, term, n) each. common: the language for texts
    that hold no known term.
    """

    def __init__(self, languages: list[str], counts: list[list[tuple[str, str, int]]], common: str | None = None):
        self.languages, self.common = languages, languages.index(common) if common in languages else 0
        column = {v: i for i, v in enumerate(languages)}
        self.rows: list[dict[str, int]] = []
        tables, start = [], 0
        for kind in counts:
            ids: dict[str, int] = {}
            total = np.zeros(len(languages))
            for lang, term, n in kind:
                ids.setdefault(term, start + len(ids))
                total[column[lang]] += n
            table = np.full((len(ids), len(languages)), PENALTY, np.float32)
            for lang, term, n in kind:
                table[ids[term] - start, column[lang]] = min(PENALTY, -np.log10(n / total[column[lang]]))
            self.rows.append(ids)
            tables.append(table)
            start += len(ids)
        self.costs = np.concatenate(tables) if tables else np.zeros((0, len(languages)), np.float32)
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of unseen words: each one's row of a table, -1 for those without any known n-gram."""
        self._unseen: dict[str, int] = {}
        self._table = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self):
        return {**self.__dict__, "_unseen": {}, "_table": self._table[:0]}

    def _learn(self, words_: list[str]) -> None:
        """Remember the costs of unseen words: the mean costs of a word's known n-grams of the largest n that has any."""
        flat: list[int] = []
        starts: list[int] = []
        row = len(self._table)
        kinds = [(n, self.rows[n].get) for n in range(LONGEST, 0, -1)]
        for word in words_:
            padded = f" {word} "
            self._unseen[word] = -1
            for n, get in kinds:
                ids = [i for at in range(len(padded) - n + 1) if (i := get(padded[at : at + n])) is not None]
                if ids:
                    self._unseen[word] = row + len(starts)
                    starts.append(len(flat))
                    flat += ids
                    break
        if starts:
            sums = np.add.reduceat(self.costs[flat].astype(np.float64), starts, axis=0)
            self._table = np.concatenate([self._table, (sums / np.diff([*starts, len(flat)])[:, None]).astype(np.float32)])

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language of the least mean cost a word (ties: the smaller name) and its share of 10 ** -cost;
        `und` and 0 for a text that is null or has no letter, or if nothing was learned; the commonest language, and an even
        share, for a text of letters never seen."""
        out: list[tuple[str, float]] = []
        found = [Counter(words(t)) for t in texts]
        if len(self._unseen) >= REMEMBERED:
            self._forget()
        known, unseen = self.rows[0] if self.rows else {}, self._unseen
        if self.languages:
            self._learn(list({w for c in found for w in c if w not in known and w not in unseen}))
        for c in found:
            if not c or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            ids = np.array([known[w] if w in known else -2 - unseen[w] for w in c], np.int64)  # -1: no known n-gram
            times = np.fromiter(c.values(), np.float64, len(c))
            first, second = ids >= 0, ids < -1
            n = times[first].sum() + times[second].sum()
            if not n:
                out.append((self.languages[self.common], 1 / len(self.languages)))
                continue
            mean = (times[first] @ self.costs[ids[first]] + times[second] @ self._table[-2 - ids[second]]) / n
            best = int(np.argmin(mean))
            out.append((self.languages[best], float(1 / np.sum(10 ** (mean[best] - mean)))))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(key: str) -> Column:
    """Whether a row is held out: crc32 of its id as text, mod 3, is 1. Rows without id aren't, nor are they learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learned: int = LEARNED, most: int = TERMS) -> Model:
    """The model of the documents that have an id and a language and aren't held out.

    Of each language at most `learned` documents are read, by hash of their ids, and its `most` most frequent words and
    n-grams of each length kept; languages beyond the LANGUAGES ones of most documents aren't learned. Counting is Spark's;
    the kept terms, a bounded table, reach the driver.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted((r["lang"] for r in sizes), key=lambda v: v.encode())
    most = max(100, min(most, CELLS // max(1, (LONGEST + 1) * len(languages) ** 2)))
    by_hash = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = rows.where(F.col("lang").isin(languages)).select("lang", "id").distinct().withColumn("_r", by_hash).where(F.col("_r") <= learned)  # at most LANGUAGES x learned
    chosen = rows.join(F.broadcast(ids), ["lang", "id"]).withColumn("_r2", F.row_number().over(W.partitionBy("lang").orderBy("_r", F.xxhash64("text")))).where(F.col("_r2") <= learned).select("lang", "text")

    def counted(batch):
        each = [Counter(words(t)) for t in strings(batch.column(1))]
        return [[[(w, n) for w, n in c.items()] for c in each]]

    pair = T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    seen = arrow_columns(chosen, counted, [field("words", T.ArrayType(pair))], drop=("text",)).select("lang", F.inline("words"))
    # a small table of much work: dealt to all cores by number, since few bytes would else be one task
    vocabulary = seen.repartition(docs.sparkSession.sparkContext.defaultParallelism, "lang", "w").groupBy("lang", "w").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    padded, size = F.concat(F.lit(" "), "w", F.lit(" ")), F.length("w") + 2
    each_gram = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(F.lit(n).alias("kind"), F.substring(padded, i, F.lit(n)).alias("term"))))
    known = F.when(F.col("docs") >= LEAST, F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("term"))))
    terms = vocabulary.select("lang", "n", F.inline(F.flatten(F.array_compact(F.array(known, *map(each_gram, range(1, LONGEST + 1))))))).where("term != ' '")
    top = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "term"))
    kept = terms.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n")).withColumn("r", top).where(F.col("r") <= most).select("lang", "kind", "term", "n").collect()  # bounded by CELLS
    counts: list[list[tuple[str, str, int]]] = [[] for _ in range(LONGEST + 1)]
    for r in sorted(kept, key=lambda r: (r["kind"], r["lang"], r["term"])):
        counts[r["kind"]].append((r["lang"], r["term"], r["n"]))
    return Model(languages, counts, sizes[0]["lang"] if sizes else None)


def with_language(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """docs with the predicted language and its score, and the two columns' names. Whole texts of any length are read."""
    name, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def make(batch):
        found = shared.value.predict_all(strings(batch.column(at)))
        return [[f[0] for f in found], [f[1] for f in found]]

    return arrow_columns(docs, make, [field(name, T.StringType()), field(score, T.DoubleType())], drop=drop), name, score


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, name, score = with_language(docs.select("doc_id", "text"), fit(docs), drop=("text",))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"))
