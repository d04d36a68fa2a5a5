"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join. Minima are pre-aggregated before the shuffle; in the join, the edges of a hot
vertex are dealt to several parts, each of which gets the minimum. Each round is written to the shared folder, which cuts
lineage, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stored, tidy

#: Edges of one vertex that lie together in a join, about.
TOGETHER = 256


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with the m of their u. least: u, m, n (rows of u, as many as edges has or more), which sum to at most
    2 * total: so the vertices that are dealt out, which are broadcast, are 8,192 at most."""
    together = max(TOGETHER, total // 4096)
    parts = F.ceil(F.col("n") / together).cast("long")
    hot = least.where(F.col("n") > together).select("u", parts.alias("parts"))
    one = F.lit(0).cast("long")
    dealt = edges.join(F.broadcast(hot), "u", "left").select("u", "v", F.when(F.col("parts").isNull(), one).otherwise(F.pmod(F.xxhash64("v"), F.col("parts"))).alias("part"))
    each = least.select("u", "m", F.explode(F.sequence(one, F.when(F.col("n") > together, parts).otherwise(one + 1) - 1)).alias("part"))
    return dealt.join(each, ["u", "part"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


@tidy
def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (u long, v long), any direction, repeats and loops allowed. Returns (u, v): v is the least vertex of u's
    component. Vertices that are the least of theirs, or that have no edge but a loop, are left out."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 999983)).first())

    now = Stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = state(now.df)
    for _ in range(most_rounds):
        if not before[0]:
            return now.df
        total = before[0]
        after = Stored(_small_star(_large_star(now.df, total), total), "edges")
        now.drop()
        now, then = after, state(after.df)
        if then == before:
            return now.df
        before = then
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
