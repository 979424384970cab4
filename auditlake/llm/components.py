"""Connected components of an edge table, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import durable, forget


#: A key of more rows than this share of all is hot; so at most its inverse many are.
HOT_SHARE = 1e-5
#: And of more rows than this.
HOT_ROWS = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with `table`, a row a key, on `key`; table's column `count` says how many of rows have the key, and
    goes. rows and table should be durable.

    Rows of a hot key get their entry from a broadcast, of 1 / HOT_SHARE entries at most, and stay where they are; only
    the others are dealt by key, so no task gets a hot key's rows. how: inner or left.
    """
    all_rows, most = table.agg(F.sum(count), F.max(count)).first()
    least = max(HOT_ROWS, (all_rows or 0) * HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(table.drop(count), key, how)
    others = [c for c in table.columns if c not in (key, count)]
    hot = table.where(F.col(count) > least).select(key, *others)
    mark = "_hot"
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    cold = marked.where(F.col(mark).isNull()).drop(mark, *others).join(table.where(F.col(count) <= least).drop(count), key, how)
    return marked.where(F.col(mark)).drop(mark).unionByName(cold)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node of the edges the smallest node that it is connected to; loops alone give no row.

    Alternating large-star and small-star steps: each joins edges to their node's smallest neighbour, found by a
    map-side combined min, and replaces them, until every edge points to a root, which the table of smallest neighbours
    tells before a step is made. Edges never become more, and each round is written to the shared folder, the round before
    it deleted. A node of many edges, as the root of a large group becomes, is looked up from a broadcast (look_up), so its
    edges needn't meet in a task.
    """
    spent: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        spent.append(durable(df))
        return spent[-1]

    now = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        # edges are distinct: where no node with a smaller neighbour has a second one, those neighbours are roots
        if not low.agg(F.max(F.expr("m < u and n > 1"))).first()[0]:
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        # large star: larger neighbours point to the smallest one
        large = look_up(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = kept(large.distinct())
        # small star: a node and its smaller neighbours point to the smallest of those
        least = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = look_up(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        for old in spent[:-1]:
            forget(old)
        del spent[:-1]
