"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_path, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


#: Rows of one node from which on its joins are dealt over PARTS tasks, and the least share of all rows that this is.
#: Below, they are some hundred kB in one task, and the plans of a dealt round would only cost the driver memory.
HOT_ROWS, HOT_SHARE, PARTS = 20_000, 2000, 32


def _hot_from(total: int) -> int:
    return max(total // HOT_SHARE, HOT_ROWS)


def _to_nodes(rows: DataFrame, nodes: DataFrame, total: int, any_hot: bool) -> DataFrame:
    """rows (u, v) joined with nodes (u, m, n: the number of rows with this u).

    Where any are hot, nodes with very many rows - no more than 2 * HOT_SHARE of them, as there are `total` edges - are dealt by the other end.
    """
    if not any_hot:
        return rows.join(nodes.select("u", "m"), "u")
    hot = F.col("n") > _hot_from(total)
    flags = nodes.where(hot).select("u", F.lit(True).alias("__hot"))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64("v"), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(flags), "u", "left").select("u", "v", part.alias("__part"))
    parts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(nodes.select("u", "m", F.explode(parts).alias("__part")), ["u", "__part"]).drop("__part")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being the smallest node that it reaches.

    Edges from a node to itself count for nothing, repeated ones once; no edges give no rows. Each step takes minima with
    partial aggregation and joins them back, nodes with very many edges in parts; each round is written to the shared folder.
    """
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    check = (F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    mark = now.agg(*check).first()
    for _ in range(most):
        both = _both(now)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # a node has no more rows in `down` than in `both`
        any_hot = 2 * mark["n"] > HOT_ROWS and bool(least.where(F.col("n") > _hot_from(mark["n"])).head(1))
        large = _to_nodes(both, least, mark["n"], any_hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_nodes(down, low, mark["n"], any_hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new = written(small, "edges")
        new_mark = after.agg(*check).first()
        drop_path(edges.sparkSession, path)
        now, path = after, new
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
