"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetstone.llm.common import cut

#: Rounds before giving up: each at least halves the longest path of labels, so this is far beyond any table.
ROUNDS = 60
#: Neighbours of a node from which its rows don't meet in one task, and such nodes up to which they are broadcast.
CROWD, CROWDED = 100_000, 1_000_000


def _with_least(rows: DataFrame, crowd: bool) -> DataFrame:
    """rows (u, v) with m, the least of u and its neighbours v. A node with a crowd of them is looked up where its rows are."""
    least = F.least("u", F.min("v")).alias("m")
    if not crowd:
        here = rows.repartition("u")  # one exchange for both sides
        return here.join(here.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    many = cut(rows.groupBy("u").agg(least, F.count(F.lit(1)).alias("many")))
    hot = many.where(F.col("many") >= CROWD).select("u", F.col("m").alias("hot"))
    if hot.count() > CROWDED:
        return rows.join(many.drop("many"), "u")
    there = rows.join(F.broadcast(hot), "u", "left")
    cold = there.where("hot is null").select("u", "v").join(many.drop("many"), "u").select("u", "v", "m")
    return cold.union(there.where("hot is not null").select("u", "v", F.col("hot").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(n, c): every node of the edges (a, b) with the least node of its component.

    Large-star and small-star rounds: every node's larger, then smaller neighbours are linked to the least one, until
    the edges are stars. Each is a group-by with a partial minimum; a round's rows are as many as the edges.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, before = now.count(), None
    for _ in range(ROUNDS):
        crowd = count >= CROWD and (now.union(now.select("v", "u")).groupBy("u").count().agg(F.max("count")).first()[0] or 0) >= CROWD
        large = _with_least(now.union(now.select("v", "u")), crowd).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # what a node's other neighbours are linked to is its least one, and so is the node itself
        small = _with_least(large, crowd).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        count, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("n"), F.col("v").alias("c")).union(now.select("v", "v").distinct())
