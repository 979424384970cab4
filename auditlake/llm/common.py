"""Helpers shared by the corpus operators: durable tables, size-checked broadcasts, Arrow columns, words."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a slim table (an id or two) that may be broadcast; above it Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of a batch that Spark sends to Python, and of one that become Python objects at once.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 5 << 20
#: Bytes of a row group of a durable table, which its writer holds and of which its reader holds the columns, and rows that
#: a reader makes of it at once: Spark's defaults, 128 MB and 4,096 rows, hold much of a heap if texts are long.
GROUP_BYTES, READ_ROWS = 16 << 20, 512

# Bytes that belong to no word become spaces and A-Z become a-z, so split() gives the words
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text (all bytes from 0x80 on belong to words).
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else (b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20)
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


#: Folders that durable() made inside of each open scratch(), innermost last.
_MADE: list[list[str]] = []


def durable(df: DataFrame, kept: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: later reads don't recompute it, lost executors don't lose it.
    Inside of scratch() the folder goes at its end, unless `kept`."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    if _MADE and not kept:
        _MADE[-1].append(path)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete the durable tables made inside when it ends: results must be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("stage-"):
            _delete(df.sparkSession, folder)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, else as it is. df should be durable: it is counted."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).groupBy().count().where(F.col("count") <= rows).take(1)) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name near `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """The batch's rows in order, in slices of at most `most` bytes or of one row: what Python makes of a slice is bounded
    by that, however many rows Spark puts in a batch and however long they are."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from byte_slices(batch.slice(0, half), most)
        yield from byte_slices(batch.slice(half), most)


def bounded_batches(spark: SparkSession) -> None:
    """Have this session send Python batches of about BATCH_BYTES, however long the texts are, and read Parquet in batches of
    READ_ROWS, unless it has settings of its own: Spark's defaults bound rows alone, and Spark's side and Python's each hold
    a batch a task."""
    for name, value, usual in (("execution.arrow.maxBytesPerBatch", BATCH_BYTES, None), ("parquet.columnarReaderBatchSize", READ_ROWS, "4096")):
        if spark.conf.get(f"spark.sql.{name}", None) in (None, usual):
            spark.conf.set(f"spark.sql.{name}", str(value))


def lean_memory() -> None:
    """Let Arrow return what it frees to the system at once: a worker waits beside the next stage's with what it holds."""
    pa.set_memory_pool(pa.system_memory_pool())


def arrow_columns(df: DataFrame, make, fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df without `drop`, with the columns that make(batch) returns as Arrow arrays or lists, one for each field."""
    bounded_batches(df.sparkSession)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in drop]
    schema = T.StructType([T.StructField(df.schema.fields[i].name, df.schema.fields[i].dataType) for i in keep] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        lean_memory()
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in (part for whole in batches for part in byte_slices(whole)):
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(make(batch), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, names=schema.names)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as bytes, without decoding."""
    return column.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def strings(column: pa.Array) -> list[str | None]:
    """A string column's values; by way of numpy, which is several times quicker than a scalar each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each name -> column of `sums`, the sum of the column over all rows before it in `order`.

    Two levels: rows are dealt by range and summed within their partition; the partitions' totals, one row each,
    are summed in partition order and joined back. No task sees more than a range of rows or one row a partition.
    """
    at, part = fresh(df, "_at"), fresh(df, "_part")
    dealt = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(at, 33))
    from pyspark.sql import Window as W

    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(part, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.join(totals, part)
        .withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
        .drop(at, part, *(f"_b_{n}" for n in sums))
    )
