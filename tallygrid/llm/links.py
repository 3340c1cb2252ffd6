"""Shared by the operators that link rows: connected components, and joins with hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallygrid.session import store

#: A key is hot if it holds more rows than this and more than one in HOT_SHARE of all rows.
HOT_ROWS = 1_000
HOT_SHARE = 1_000
#: Rounds of :func:`components`; the rounds needed grow with the logarithm of a component's size.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the undirected edges (a, b), the least node it is joined to.

    Alternates the two star operations: neighbours above a node are linked to its least
    neighbour, then neighbours below it. Every round is written to the checkpoint folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = store(edges.distinct())
    seen = state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and, in ``size``, the key's rows in ``left``.

    Keys with more than HOT_ROWS rows and 1/HOT_SHARE of the ``total`` are at most HOT_SHARE
    keys, so their rows of ``right`` are broadcast; all others meet in a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(size) > limit))
    cold = right.filter(F.col(size) <= limit)
    hit = left.join(hot, keys)
    rest = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return hit.unionByName(rest)


def any_equal_null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    """Condition: all columns of these names equal, null equal to null."""
    return reduce(lambda x, y: x & y, [left[n].eqNullSafe(right[n]) for n in names])
