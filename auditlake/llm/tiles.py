"""All pairs of a large group, cut into tiles: what the first tile joins isn't held against each other again."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import durable, small_side


def tile(node: str, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(7)), tiles)


def first_cells(group: str, node: str, tiles: Column) -> Column:
    """Array of the cells where a row meets the first tile of its group: each other tile has a cell, the first one is in all
    of them."""
    i = tile(node, tiles)
    return F.transform(F.when((i == 0) & (tiles > 1), F.sequence(F.lit(1).cast("long"), tiles - 1)).otherwise(F.array(i)), lambda j: F.xxhash64(group, j))


def open_rows(rows: DataFrame, near: DataFrame, group: str, many: Callable[[Column], Column]) -> DataFrame | None:
    """Rows of `rows` (`group`, fingerprint, node, ...) that must meet others yet, in open_cells, their node replaced by that
    of its class; None if each group is one class.

    near (node, root) has the classes that are known, after first_cells for one. Rows of one class needn't meet. Of a group
    of several, those outside of its largest class, the rest, meet each other and the largest class, tile by tile; rows of the
    largest class meet the rest alone, so where it is most of the group a row is copied a few times, however large the group.
    `many` makes the number of tiles of the rows that a condition tells, an aggregate.
    """
    classed = durable(rows.join(near, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root"))
    classes = classed.groupBy(group, "node").agg(F.count("*").alias("n")).groupBy(group)
    several = durable(classes.agg(F.max(F.struct("n", "node"))["node"].alias("largest"), F.count("*").alias("classes")).where("classes > 1").drop("classes"))
    if not several.take(1):
        return None
    sides = durable(classed.join(small_side(several), group).withColumn("rest", F.col("node") != F.col("largest")).drop("largest"))
    tiles = durable(sides.groupBy(group).agg(many(F.col("rest")).alias("u"), many(~F.col("rest")).alias("g")))
    return sides.join(small_side(tiles), group)


def open_cells(group: str) -> Column:
    """Array of the cells of a row of open_rows: two tiles of the rest, or one of the rest, which meets itself there, and one
    of the largest class."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    i = tile("fingerprint", F.when(F.col("rest"), F.col("u")).otherwise(F.col("g")))
    two = F.transform(F.filter(upto("u"), lambda j: j != i), lambda j: F.xxhash64(group, F.lit(0), F.least(i, j), F.greatest(i, j)))
    own = F.transform(upto("g"), lambda j: F.xxhash64(group, F.lit(1), i, j))
    met = F.transform(upto("u"), lambda j: F.xxhash64(group, F.lit(1), j, i))
    return F.when(F.col("rest"), F.concat(two, own)).otherwise(met)
