"""Exact order statistics of many columns in two scans, without sorting the columns.

The scan that finds each column's count and extremes also feeds a mergeable quantile sketch
(KLL, Spark's own aggregate). Its quantiles a little below and above each wanted position bracket it. The
second scan counts what lies below each bracket and the distinct values inside, a fixed small
share of the column, and the position is read off: by a window where they are few, by a
distributed running total where they are many.

A sketch errs by more than :data:`SKETCH_ERROR` only rarely, but it can. The second scan's counts
prove whether a position lies in its bracket. One that does not lies in a gap between brackets, whose
extremes and count are known as well, and is searched there by bins: a scan counts the bracket's values in equal-width
bins, and the bin that holds the position becomes the next bracket. Values so uneven that bins
do not separate them fall back to a distributed sort of the distinct values in the bracket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.operators.order import running_total

BINS = 2048
#: A bracket with at most this many values is finished in one pass.
SMALL_BRACKET = 20_000
MAX_ZOOMS = 5
QUARTILES = (0.25, 0.5, 0.75)
#: Size of a sketch, about 25 KB a column, and the rank error that a bracket allows for on either
#: side: more than twice the sketch's at 99 percent confidence.
SKETCH_K = 1024
SKETCH_ERROR = 0.008
#: So many small brackets' values of a column are few enough for a window.
SKETCHED_BRACKETS = 20
#: Columns counted in one scan.
SKETCHED_AT_ONCE = 15
#: Sketches of so many groups of tasks are merged apart before the last merge.
SKETCH_GROUPS = 256


@dataclass(frozen=True)
class Bracket:
    """Values of column ``pos`` in ``low..high``: ``inside`` of them, ``below`` smaller ones."""

    pos: int
    low: float
    high: float
    below: int
    inside: int
    ranks: tuple[int, ...]


def _inside(b: Bracket) -> Column:
    value = F.col(f"n{b.pos}")
    return F.when((value >= F.lit(b.low)) & (value <= F.lit(b.high)), value)


def _bin(b: Bracket) -> Column:
    # Halving first keeps the width finite over the whole range of doubles.
    width = b.high / 2 - b.low / 2
    place = F.floor((_inside(b) / 2 - F.lit(b.low / 2)) / F.lit(width) * BINS)
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")


def _hits(counted: DataFrame, brackets: list[Bracket], sort_column: str, distributed: bool) -> list:
    """Rows of ``counted`` (``b, <sort_column>, n, ..``) that cover a target position."""
    if distributed:
        total = running_total(counted, ["b"], [sort_column], "n")
    else:
        # At most BINS or SMALL_BRACKET rows per bracket.
        earlier = Window.partitionBy("b").orderBy(sort_column).rowsBetween(Window.unboundedPreceding, -1)
        total = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    local = F.array(*(F.array(*(F.lit(r - b.below).cast("bigint") for r in b.ranks)) for b in brackets))
    covered = F.filter(
        F.get(local, F.col("b")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    )
    return total.withColumn("covered", covered).filter(F.size("covered") > 0).collect()


def _stacked(numbers: DataFrame, brackets: list[Bracket], *makers) -> DataFrame:
    names = ["b", "v", "bin"][: len(makers) + 1]
    values = [x for i, b in enumerate(brackets) for x in (F.lit(i), *(make(b) for make in makers))]
    return numbers.select(F.stack(F.lit(len(brackets)), *values).alias(*names)).filter(F.col("v").isNotNull())


def _zoom(numbers: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    counted = (
        _stacked(numbers, brackets, _inside, _bin)
        .groupBy("b", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    narrowed = []
    for row in _hits(counted, brackets, "bin", distributed=False):
        parent = brackets[row["b"]]
        ranks = tuple(r + parent.below for r in row["covered"])
        narrowed.append(Bracket(parent.pos, row["low"], row["high"], parent.below + row["before"], row["n"], ranks))
    return narrowed


def _finish(numbers: DataFrame, brackets: list[Bracket], distributed: bool) -> dict[tuple[int, int], float]:
    counted = _stacked(numbers, brackets, _inside).groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    found = {}
    for row in _hits(counted, brackets, "v", distributed):
        parent = brackets[row["b"]]
        found.update({(parent.pos, r + parent.below): row["v"] for r in row["covered"]})
    return found


def order_statistics(
    numbers: DataFrame, brackets: list[Bracket], small: int = SMALL_BRACKET, zooms: int = MAX_ZOOMS
) -> dict[tuple[int, int], float]:
    """``(column, position) -> value`` for the positions in ``brackets`` (0-based, sorted order)."""
    found: dict[tuple[int, int], float] = {}
    open_brackets = list(brackets)
    for _ in range(zooms + 1):
        constant = [b for b in open_brackets if b.low == b.high]
        found.update({(b.pos, r): b.low for b in constant for r in b.ranks})
        open_brackets = [b for b in open_brackets if b.low != b.high]
        large = [b for b in open_brackets if b.inside > small]
        if not large or _ == zooms:
            break
        open_brackets = [b for b in open_brackets if b.inside <= small] + _zoom(numbers, large)
    ready = [b for b in open_brackets if b.inside <= small]
    stubborn = [b for b in open_brackets if b.inside > small]
    for group, distributed in ((ready, False), (stubborn, True)):
        if group:
            found.update(_finish(numbers, group, distributed))
    return found


def sketch_ranks(probabilities: tuple[float, ...]) -> list[float]:
    """Ranks of a sketch that bracket the probabilities: a lower and an upper one for each."""
    return [r for p in probabilities for r in (max(0.0, p - SKETCH_ERROR), min(1.0, p + SKETCH_ERROR))]


def _merged(edges: list[float]) -> list[tuple[float, float]]:
    """Disjoint intervals in order, from pairs of edges in order of their lower ones."""
    out: list[tuple[float, float]] = []
    for low, high in zip(edges[::2], edges[1::2]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _region(value: Column, intervals: list[tuple[float, float]]) -> Column:
    """2 i + 1 inside the interval i, 2 i in the gap before it, the next even number above the last one."""
    out = F.when(value < F.lit(intervals[0][0]), F.lit(0))
    for i, (low, high) in enumerate(intervals):
        if i:
            out = out.when(value < F.lit(low), F.lit(2 * i))
        out = out.when(value <= F.lit(high), F.lit(2 * i + 1))
    return out.otherwise(F.lit(2 * len(intervals)))


def _sketched(
    numbers: DataFrame, wanted: dict[int, tuple[list[tuple[float, float]], int, tuple[int, ...]]], small: int
) -> tuple[dict[tuple[int, int], float], list[Bracket]]:
    """Positions found inside sketch brackets in one scan, and brackets of those that lie between them.

    ``wanted`` maps a column to its intervals, its count and its positions. Values between intervals are
    counted as one group each, so a task hands on little more than the values inside.
    """
    columns = list(wanted)
    cells = [x for p in columns for x in (F.lit(p), F.col(f"n{p}"), _region(F.col(f"n{p}"), wanted[p][0]))]
    stacked = numbers.select(F.stack(F.lit(len(columns)), *cells).alias("pos", "v", "region")).filter(F.col("v").isNotNull())
    inside = F.when(F.col("region") % 2 == 1, F.col("v"))
    counted = (
        stacked.groupBy("pos", "region", inside.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    if any(n * 2.5 * SKETCH_ERROR * len(intervals) > SKETCHED_BRACKETS * small for intervals, n, _ in wanted.values()):
        total = running_total(counted, ["pos"], ["region", "value"], "n")
    else:
        earlier = Window.partitionBy("pos").orderBy("region", "value").rowsBetween(Window.unboundedPreceding, -1)
        total = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranks = F.create_map(*(x for p in columns for x in (F.lit(p), F.array(*(F.lit(r).cast("bigint") for r in wanted[p][2])))))
    covered = F.filter(
        F.element_at(ranks, F.col("pos")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    )
    found: dict[tuple[int, int], float] = {}
    outside = []
    for row in total.withColumn("covered", covered).filter(F.size("covered") > 0).collect():
        if row["value"] is not None:
            found.update({(row["pos"], r): row["value"] for r in row["covered"]})
        else:
            outside.append(Bracket(row["pos"], row["low"], row["high"], row["before"], row["n"], tuple(row["covered"])))
    return found, outside


def quantiles(
    numbers: DataFrame,
    spans: dict[int, tuple[int, float, float]],
    probabilities: tuple[float, ...] = QUARTILES,
    cuts: dict[int, list[float]] | None = None,
    **limits,
) -> dict[int, list[float]]:
    """Linearly interpolated quantiles per column.

    ``spans`` maps a column to ``(count, min, max)`` of its values in ``numbers``, ``cuts`` to its sketch's
    values at :func:`sketch_ranks`. Without cuts the whole search goes by bins.
    """
    places, brackets, sketched, value = {}, [], {}, {}
    for pos, (n, low, high) in spans.items():
        at = [(n - 1) * p for p in probabilities]
        places[pos] = at
        ranks = tuple(sorted({int(f(x)) for x in at for f in (math.floor, math.ceil)}))
        if low == high:
            value.update({(pos, r): low for r in ranks})
        elif cuts and pos in cuts:
            sketched[pos] = (_merged(cuts[pos]), n, ranks)
        else:
            brackets.append(Bracket(pos, low, high, 0, n, ranks))
    every = list(sketched)
    for start in range(0, len(every), SKETCHED_AT_ONCE):
        some = {pos: sketched[pos] for pos in every[start : start + SKETCHED_AT_ONCE]}
        found, outside = _sketched(numbers, some, limits.get("small", SMALL_BRACKET))
        value |= found
        brackets += outside
    value |= order_statistics(numbers, brackets, **limits)
    out = {}
    for pos, at in places.items():
        out[pos] = []
        for x in at:
            low, high = value[pos, math.floor(x)], value[pos, math.ceil(x)]
            out[pos].append(low + (high - low) * (x - math.floor(x)))
    return out
