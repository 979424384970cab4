"""Exact percentiles of groups of any size, without a buffer that grows with the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.operators import ranges
from auditlake.sources.shared import durable

#: Cells of a histogram pass, and passes at most: each narrows a rank's interval of values by the factor CELLS. What is left
#: then, values over hundreds of powers of two, is sorted as it is.
CELLS, PASSES = 1024, 32


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], count: str | None = None, rows: int | None = None) -> DataFrame:
    """Per group the percentiles name -> share of the non-null values, as `percentile` gives them to the bit (linear between the
    two neighbouring ranks), and the number of values in `count` if named. Groups without values have no row.

    Groups of up to `rows` values (ranges.ROWS) are `percentile`'s, whose buffer is then bounded. Of a larger group each
    rank's interval of values is narrowed by histograms: a pass counts the values of the interval in CELLS equal cells and
    keeps the cell that holds the rank, until it holds at most `rows` values or a single one; these few are sorted.
    """
    rows = rows or ranges.ROWS
    values = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    n = F.count("*").alias("_n")
    sizes = values.groupBy("_g").agg(n).where(F.col("_n") > rows)
    big = bool(sizes.take(1))
    sizes = durable(sizes) if big else sizes  # at most one row for every `rows` values
    small = values.join(F.broadcast(sizes), values["_g"].eqNullSafe(sizes["_g"]), "left_anti") if big else values
    of_small = small.groupBy("_g").agg(n, *(F.percentile("_v", s).alias(c) for c, s in shares.items()))
    found = of_small.unionByName(_large(values, sizes, shares, rows)) if big else of_small
    return found.select(F.col("_g").alias(group), *([F.col("_n").alias(count)] if count else []), *shares)


def _large(values: DataFrame, sizes: DataFrame, shares: dict[str, float], rows: int) -> DataFrame:
    """_g, _n and the percentiles of the groups of `sizes` (_g, _n)."""
    ask = sizes.withColumn("_k", F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(_position(s)), F.ceil(_position(s))) for s in shares.values()))))))
    span = values.join(F.broadcast(sizes.select(F.col("_g").alias("_s"))), F.col("_g").eqNullSafe(F.col("_s"))).groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # an interval for each group and rank: values from _lo to _hi, of which _below lie below it, and _m in it
    at = durable(_same_group(ask, span).withColumn("_below", F.lit(0).cast("long")).withColumn("_m", F.col("_n")))
    for _ in range(PASSES):
        wide = (F.col("_m") > rows) & (F.col("_lo") < F.col("_hi"))
        if not at.where(wide).take(1):
            break
        # equal intervals of several ranks are counted once
        cell = lambda v: F.least(F.floor((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * CELLS), F.lit(CELLS - 1))  # noqa: E731  (halves, so that the span of doubles of either sign is finite)
        open_ = at.where(wide).select("_g", "_lo", "_hi").distinct()
        inside = _same_group(values, open_).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy("_g", "_lo", "_hi", cell(F.col("_v")).alias("_c")).agg(F.count("*").alias("_x"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.sum("_x").over(W.partitionBy("_g", "_lo", "_hi").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
        cells = counts.withColumn("_y", F.coalesce(before, F.lit(0)))
        narrow = _same_group(cells, at.where(wide), "_lo", "_hi").withColumn("_y", F.col("_below") + F.col("_y")).where((F.col("_k") >= F.col("_y")) & (F.col("_k") < F.col("_y") + F.col("_x")))
        at = durable(at.where(~wide).unionByName(narrow.select("_g", "_n", "_k", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_y").alias("_below"), F.col("_x").alias("_m"))))
    # the few values of an interval, equal ones as one, in order
    few = _same_group(values, at.where("_lo < _hi").select("_g", "_lo", "_hi").distinct()).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    few = few.groupBy("_g", "_lo", "_hi", "_v").agg(F.count("*").alias("_x"))
    few = few.withColumn("_y", F.coalesce(F.sum("_x").over(W.partitionBy("_g", "_lo", "_hi").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = _same_group(few, at.where("_lo < _hi"), "_lo", "_hi").where((F.col("_k") >= F.col("_below") + F.col("_y")) & (F.col("_k") < F.col("_below") + F.col("_y") + F.col("_x")))
    ranks = placed.select("_g", "_n", "_k", "_v").unionByName(at.where("_lo = _hi").select("_g", "_n", "_k", F.col("_lo").alias("_v")))
    by_rank = ranks.groupBy("_g", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_r"))  # two ranks a share

    def percentile(s: float):
        p = _position(s)
        low, high = F.floor(p), F.ceil(p)
        a, b = F.col("_r")[low], F.col("_r")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return by_rank.select("_g", "_n", *(percentile(s).alias(c) for c, s in shares.items()))


def _position(share: float):
    return (F.col("_n") - 1) * F.lit(float(share))


def _same_group(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Join with `right`, a table of a few rows a large group, whose _g may be null."""
    other = F.broadcast(right.withColumnsRenamed({c: f"{c}2" for c in ("_g", *more)}))
    same = F.col("_g").eqNullSafe(F.col("_g2"))
    for c in more:
        same = same & (F.col(c) == F.col(f"{c}2"))
    return left.join(other, same).drop("_g2", *(f"{c}2" for c in more))
