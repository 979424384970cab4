"""Structured Streaming: replies that arrive over time, and evidence that adds to coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditlake.operators.coverage import conclude

REPLY_KEYS = ["document_id", "party", "kind"]
#: The state store that keyed state with an expiry of its own needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Rows that wait before a partition's earliest are found among them.
FOLD_ROWS = 100_000


def stream_replies(replies: DataFrame, delay: str = "30 days", at: str = "received_at") -> DataFrame:
    """The first reply of each document, party and kind; later ones within the watermark are ignored, and its state goes
    when the watermark passes. For keys kept for ever see first_replies."""
    return replies.withWatermark(at, delay).dropDuplicatesWithinWatermark(REPLY_KEYS)


class FirstOfKey(StatefulProcessor):
    """Passes a key's first row, of the rows that arrive together the earliest by `at`, and remembers when it was."""

    def __init__(self, at: str, keep_ms: int | None):
        self.at, self.keep_ms = at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            one = part.sort_values(self.at, kind="stable", na_position="last").head(1)
            if best is None or pd.isna(best[self.at].iloc[0]) or one[self.at].iloc[0] < best[self.at].iloc[0]:
                best = one
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def earliest(replies: DataFrame, at: str) -> DataFrame:
    """Of the rows that arrive together each key's earliest by `at`, null last. A partition holds a row a key."""

    def run(batches):
        kept, waiting = None, []

        def fold():
            rows = pa.Table.from_batches(waiting) if kept is None else pa.concat_tables([kept, pa.Table.from_batches(waiting)])
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(at, "ascending")]))
            first = rows.select(REPLY_KEYS).append_column("_i", pa.array(range(rows.num_rows), pa.int64())).group_by(REPLY_KEYS, use_threads=False).aggregate([("_i", "min")])
            return rows.take(first.column("_i_min"))

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) > max(FOLD_ROWS, kept.num_rows if kept is not None else 0):
                kept, waiting = fold(), []
        if waiting:
            kept = fold()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=10_000)

    return replies.repartition(*REPLY_KEYS).mapInArrow(run, replies.schema)


def first_replies(replies: DataFrame, at: str = "received_at", keep_ms: int | None = None) -> DataFrame:
    """The first reply of each document, party and kind, however late another one comes: each key has a state of its own,
    on its key's partition and in the checkpoint, kept for ever or for `keep_ms` of processing time. Of replies that
    arrive in one batch the earliest counts. The session needs the settings of STORE; null keys are a key.

    What is kept for ever is Spark's own state of seen keys, behind the earliest of each batch; only keys that expire call
    Python, once each.
    """
    for name, value in STORE.items():
        replies.sparkSession.conf.set(name, value)
    if keep_ms is None:
        return earliest(replies, at).dropDuplicates(REPLY_KEYS)
    return replies.groupBy(*REPLY_KEYS).transformWithStateInPandas(FirstOfKey(at, keep_ms), replies.schema, "Append", "ProcessingTime")


def new_replies(batch: DataFrame, stored: DataFrame, at: str = "received_at") -> DataFrame:
    """The batch form: replies whose key isn't stored, the first of each by `at` (ties by a hash of the row)."""
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in REPLY_KEYS]
    fresh = batch.alias("b").join(stored.select(*REPLY_KEYS).distinct().alias("s"), same[0] & same[1] & same[2], "left_anti")
    first = F.min_by(F.struct(*batch.columns), F.struct(F.col(at).isNull(), at, F.xxhash64(*batch.columns)))
    return fresh.groupBy(*(F.col(k).alias(f"_{k}") for k in REPLY_KEYS)).agg(first.alias("_first")).select("_first.*")


def stream_evidence(evidence: DataFrame) -> DataFrame:
    """Covered amount per engagement and party so far, for update mode; a row of state a party."""
    return evidence.where("success").groupBy("engagement_id", "party").agg(F.sum(F.col("amount").cast("decimal(20,2)")).alias("covered"))


def coverage_of(covered: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Share and conclusion of covered amounts against ledgers (engagement_id, party, ledger): foreachBatch's body."""
    share = F.when((F.col("ledger") > 0) & F.col("covered").isNotNull(), F.least(F.lit(1.0), F.col("covered").cast("double") / F.col("ledger")))
    return ledgers.join(covered, ["engagement_id", "party"], "left").withColumn("share", share).withColumn("conclusion", conclude(share))


def run_evidence_coverage(evidence: DataFrame, ledgers: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of evidence (of what is there now) in update mode: each batch writes the parties that it changed, with
    covered amount, share and conclusion, to its own folder of `path`. A batch that is run again overwrites its folder."""

    def write(changed: DataFrame, batch: int) -> None:
        coverage_of(changed, ledgers).where("covered is not null").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = stream_evidence(evidence).writeStream.outputMode("update").foreachBatch(write)
    stream.trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of path's folders `prefix`number whose write was ended, in order: a folder a batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    found = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
    done = [n for n in found if n.startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[len(prefix) :]) for n in done)


COVERED = "engagement_id long, party string, covered decimal(30,2), batch long"


def _since_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[int]]:
    """The latest covered amount of each party (with its batch), the snapshot that it starts from (-1: none), and the batches
    after it."""
    upto = max(_numbers(spark, f"{path}/_snapshot", "upto="), default=-1)
    later = [n for n in _numbers(spark, path, "batch=") if n > upto]
    parts = [spark.read.schema(COVERED).parquet(f"{path}/_snapshot/upto={upto}")] if upto >= 0 else []
    if later:
        parts.append(spark.read.schema(COVERED).option("basePath", path).parquet(*(f"{path}/batch={n}" for n in later)))
    seen = parts[0] if parts else spark.createDataFrame([], COVERED)
    for more in parts[1:]:
        seen = seen.unionByName(more)
    newest = seen.groupBy("engagement_id", "party").agg(F.max_by("covered", "batch").alias("covered"), F.max("batch").alias("batch"))
    return newest, upto, later


def compact_coverage(spark: SparkSession, path: str) -> int:
    """Fold the batches since the last snapshot into a new one and return its number, the last batch it holds (-1 if there is
    nothing). A snapshot is a folder named by that number, and counts once its write was ended, so a crash leaves the one
    before in force; folding twice, or a batch that is written again, gives the same rows."""
    newest, upto, later = _since_snapshot(spark, path)
    if not later:
        return upto
    newest.write.mode("overwrite").parquet(f"{path}/_snapshot/upto={later[-1]}")
    return later[-1]


def latest_coverage(spark: SparkSession, path: str, ledgers: DataFrame) -> DataFrame:
    """Each ledger party's coverage by its latest batch, read from the last snapshot and the batches after it; needs_review for
    parties without any."""
    return coverage_of(_since_snapshot(spark, path)[0].drop("batch"), ledgers)
