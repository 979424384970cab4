"""Ordered work within one long group, spread over many tasks.

A group of more than ROWS rows is cut into ranges of its order, about ROWS rows each; windows then run by group and range,
and what a range needs of those before or after it comes from a small table with a row a range. Cuts are values of the order
column itself, so a row's range is the same whenever it is computed, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a group above which it is cut, and ranges of a group at most.
ROWS, RANGES = 1_000_000, 256
PART = "_part"


def cuts(df: DataFrame, group: list[str], order: Column, rows: int | None = None) -> DataFrame | None:
    """(group, _cuts): the values between the ranges of each group of more than `rows` rows; None if there is no such group.
    One number for every `rows` rows of df at most."""
    rows = rows or ROWS
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    if not sizes.take(1):
        return None
    shares = [i / RANGES for i in range(1, RANGES)]
    each = df.join(F.broadcast(sizes.select(*group)), group).groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx(order.cast("double"), shares, 10_000).alias("_q"))
    n = F.least(F.ceil(F.col("_n") / rows), F.lit(RANGES)).cast("int")
    return each.select(*group, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("_q", F.floor(i * RANGES / n).cast("int"))).alias("_cuts"))


def with_part(df: DataFrame, group: list[str], order: Column, at: DataFrame | None, spread: Column | None = None) -> DataFrame:
    """df with the number of its range in column _part: how many cuts lie below its order. With `spread`, a hash, rows equal
    to several cuts (a value that fills ranges of its own) are dealt over those ranges; else they go to the first."""
    if at is None:
        return df.withColumn(PART, F.lit(0))
    value = order.cast("double")
    part = F.size(F.filter("_cuts", lambda x: x < value))
    if spread is not None:
        part = part + F.pmod(spread, F.size(F.filter("_cuts", lambda x: x == value)) + 1)
    joined = df.join(F.broadcast(at), group, "left")
    return joined.withColumn(PART, F.when(F.col("_cuts").isNull(), 0).otherwise(part).cast("int")).select(*df.columns, PART)


def by_part(df: DataFrame, group: list[str], at: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of each range of the groups that are cut: a row a range."""
    return df.join(F.broadcast(at.select(*group)), group, "left_semi").groupBy(*group, PART).agg(*(c.alias(n) for n, c in aggregates.items()))


def carried(df: DataFrame, group: list[str], at: DataFrame | None, aggregates: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """df (with _part) with a column for each name -> (aggregate of a range, how, direction): `first`, `last`, `min`, `max` or `sum`
    of the aggregate over the ranges before (direction "before") or after it ("after"; `last` is then the nearest one's). Null
    where there is none, and in groups that aren't cut."""
    if at is None:
        kinds = df.groupBy().agg(*(c.alias(n) for n, (c, _, _) in aggregates.items())).schema
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds.fields})
    how = {"first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "min": F.min, "max": F.max, "sum": F.sum}
    ranges = by_part(df, group, at, {n: c for n, (c, _, _) in aggregates.items()})
    edge = lambda d: W.partitionBy(*group).orderBy(F.col(PART) if d == "before" else F.desc(PART)).rowsBetween(W.unboundedPreceding, -1)
    table = ranges.select(*group, PART, *(how[h](n).over(edge(d)).alias(n) for n, (_, h, d) in aggregates.items()))
    return df.join(F.broadcast(table), [*group, PART], "left").select(*df.columns, *aggregates)


def with_halo(df: DataFrame, group: list[str], order: list[Column], at: DataFrame | None, rows: int) -> DataFrame:
    """df (with _part) and, with _halo true, before each range the last `rows` rows of its group that come before it, so that
    windows over that many rows need no other range."""
    if at is None:
        return df.withColumn("_halo", F.lit(False))
    of_cut = df.join(F.broadcast(at.select(*group)), group, "left_semi")
    backwards = [c.desc() for c in order]
    ends = of_cut.withColumn("_r", F.row_number().over(W.partitionBy(*group, PART).orderBy(*backwards))).where(F.col("_r") <= rows).drop("_r")
    later = of_cut.select(*group, F.col(PART).alias("_to")).distinct()  # a row a range
    nearest = F.row_number().over(W.partitionBy(*group, "_to").orderBy(F.desc(PART), *backwards))
    halo = ends.join(F.broadcast(later), group).where(F.col("_to") > F.col(PART)).withColumn("_r", nearest).where(F.col("_r") <= rows)
    halo = halo.withColumn(PART, F.col("_to")).drop("_to", "_r").withColumn("_halo", F.lit(True))
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def previous(df: DataFrame, group: list[str], order: Column, values: Column, out: str, rows: int | None = None) -> DataFrame:
    """df with the struct `values` of the row before in its group, by the number `order`; null for a group's first row."""
    at = cuts(df.select(*group, order.alias("_o")), group, F.col("_o"), rows)
    dealt = carried(with_part(df, group, order, at), group, at, {"_edge": (F.max_by(values, order), "last", "before")})
    return dealt.withColumn(out, F.coalesce(F.lag(values).over(W.partitionBy(*group, PART).orderBy(order)), "_edge")).drop("_edge", PART)
