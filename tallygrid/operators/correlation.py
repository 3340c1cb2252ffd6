"""Pearson and Spearman matrices over pairwise complete rows.

Pearson needs sums of products only: one pass over a narrow frame of centred values, 30 sums
per aggregate, or, for many columns, one scan of blocked matrix products. Spearman is Pearson on average ranks. Ranks come from value counts (one row
per distinct value, so ties are free) and a distributed running total.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.functions.display import strength
from tallygrid.grid import Grid, union
from tallygrid.operators.gram import pair_coefficients
from tallygrid.operators.numeric import spans
from tallygrid.operators.order import running_total
from tallygrid.options import DEFAULT, ProfileOptions
from tallygrid.session import store

# Fixed value: rows of the list of strongest pairs.
STRONGEST = 15

#: Sums per aggregate; wider ones compile to methods that the JVM leaves interpreted.
_SUMS = 60
#: Rank tables up to this many distinct values are broadcast.
SMALL_RANKS = 100_000
#: A value is hot above ``rows / HOT_SHARE`` occurrences, so a column has at most HOT_SHARE hot values.
HOT_SHARE = 1_000
#: From so many columns on, all pairs come from blocked matrix products in one scan; sums of fewer take three or four.
GRAM_FROM = 10
#: Matrices of fewer columns are held on the driver, so that a result read twice costs one scan.
SMALL_MATRIX = 24

MATRIX_SCHEMA = "i int, j int, r double, n bigint"


@dataclass(frozen=True)
class Candidates:
    positions: tuple[int, ...]
    truncated: bool


def candidates(numeric: list[int], limit: int | None = None) -> Candidates | None:
    """The numeric columns, the first ``limit`` of them if one is given; None if fewer than two."""
    if len(numeric) < 2:
        return None
    return Candidates(tuple(numeric[:limit]), limit is not None and len(numeric) > limit)


def _pair_sums(frame: DataFrame, positions, prefix: str, rows: int, span: dict) -> dict[tuple[int, int], tuple]:
    """``(n, Sx, Sy, Sxx, Syy, Sxy)`` of centred values per pair i < j.

    Missing values count as zero in the sums, and masks restrict each sum to pairs. Where
    both columns are complete only the product sum differs from pair to pair.
    """
    positions = [p for p in positions if p in span]
    full = {p for p in positions if span[p][0] == rows}
    centred, mask = {}, {}
    for p in positions:
        value = F.col(f"{prefix}{p}") - F.lit(span[p][3])
        centred[p] = F.coalesce(value, F.lit(0.0)) if p not in full else value
        mask[p] = F.lit(1.0) if p in full else F.when(F.col(f"{prefix}{p}").isNotNull(), 1.0).otherwise(0.0)
    narrow = frame.select(
        *(centred[p].alias(f"x{p}") for p in positions),
        *(mask[p].alias(f"m{p}") for p in positions if p not in full),
    )

    def x(p: int) -> Column:
        return F.col(f"x{p}")

    def times_mask(value: Column, p: int) -> Column:
        return value if p in full else value * F.col(f"m{p}")

    sums: dict[tuple, Column] = {}
    wanted: dict[tuple[int, int], list[tuple]] = {}
    for a, i in enumerate(positions):
        for j in positions[a + 1 :]:
            # The key says what is summed, so that equal sums are computed once.
            mi, mj = (None if i in full else i), (None if j in full else j)
            parts = {
                ("n", mi, mj): times_mask(times_mask(F.lit(1.0), i), j),
                ("s", i, mj): times_mask(x(i), j),
                ("s", j, mi): times_mask(x(j), i),
                ("q", i, mj): times_mask(x(i) * x(i), j),
                ("q", j, mi): times_mask(x(j) * x(j), i),
                ("p", i, j): x(i) * x(j),
            }
            sums.update(parts)
            wanted[i, j] = list(parts)
    keys = list(sums)
    value = {}
    for start in range(0, len(keys), _SUMS):
        group = keys[start : start + _SUMS]
        row = narrow.agg(*(F.sum(sums[k]) for k in group)).first()
        value.update(zip(group, row))
    return {pair: tuple(value[k] or 0.0 for k in parts) for pair, parts in wanted.items()}


def _coefficient(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> float | None:
    if n < 3:
        return None
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # Below the rounding error of the sums a variance is zero.
    if vx <= 1e-12 * sxx or vy <= 1e-12 * syy:
        return None
    return max(-1.0, min(1.0, (sxy - sx * sy / n) / math.sqrt(vx) / math.sqrt(vy)))


def _upper_triangle(frame: DataFrame, positions, prefix: str) -> dict[tuple[int, int], tuple[float | None, int]]:
    rows = frame.count()
    span = spans(frame.select(*(F.col(f"{prefix}{p}").alias(f"n{p}") for p in positions)), positions)
    sums = _pair_sums(frame, positions, prefix, rows, span)
    out = {}
    for a, i in enumerate(positions):
        for j in positions[a + 1 :]:
            found = sums.get((i, j), (0.0,) * 6)
            out[i, j] = (_coefficient(*found), int(found[0]))
    return out


def average_ranks(values: DataFrame) -> DataFrame:
    """``pos, v, n, rank`` from ``pos, v`` rows: 1-based, equal values share their mean rank."""
    counted = values.groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counted, ["pos"], ["v"], "n")
    return placed.select("pos", "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def _unpivot(numbers: DataFrame, positions, keep=()) -> DataFrame:
    pairs = [x for p in positions for x in (F.lit(p), F.col(f"n{p}"))]
    stacked = numbers.select(*keep, F.stack(F.lit(len(positions)), *pairs).alias("pos", "v"))
    return stacked.filter(F.col("v").isNotNull())


def rank_frame(
    numbers: DataFrame, positions, small: int = SMALL_RANKS, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Average ranks ``r<pos>`` of the columns ``n<pos>``, row by row; NULL stays NULL.

    Columns with few distinct values look their ranks up in a broadcast table and never
    move. The others are joined on the value, column after column, with the rows kept whole;
    values that occur too often for one task, at most ``hot_share`` per column, are looked up
    by broadcast as well.
    """
    positions = list(positions)
    rows = numbers.count()
    # Frozen: the row number must mean the same row in every later read.
    narrow = store(numbers.select(F.monotonically_increasing_id().alias("row"), *(f"n{p}" for p in positions)))
    ranks = store(average_ranks(_unpivot(narrow, positions)), "pos")
    distinct = {r["pos"]: r["count"] for r in ranks.groupBy("pos").count().collect()}
    few = [p for p in positions if distinct.get(p, 0) <= small]
    many = [p for p in positions if p not in few]

    wide = narrow
    for p in few:
        table = ranks.filter(F.col("pos") == p).select(F.col("v").alias(f"n{p}"), F.col("rank").alias(f"r{p}"))
        wide = wide.join(F.broadcast(table), f"n{p}", "left")
    wide = wide.select("row", *(f"r{p}" for p in few), *(f"n{p}" for p in many))
    hot_at = max(1, rows // hot_share)
    for p in many:
        of = ranks.filter(F.col("pos") == p)
        hot = of.filter(F.col("n") > hot_at).select(F.col("v").alias(f"n{p}"), F.col("rank").alias("hot"))
        rest = of.filter(F.col("n") <= hot_at).select(F.col("v").alias("key"), F.lit(False).alias("apart"), F.col("rank").alias("cold"))
        found = wide.join(F.broadcast(hot), f"n{p}", "left")
        # Rows that need no look-up, with hot values or none, spread over the tasks by their numbers.
        apart = F.col("hot").isNotNull() | F.col(f"n{p}").isNull()
        key = F.when(apart, F.col("row").cast("double")).otherwise(F.col(f"n{p}"))
        found = found.withColumns({"apart": apart, "key": key}).drop(f"n{p}").join(rest, ["key", "apart"], "left")
        wide = found.withColumn(f"r{p}", F.coalesce("hot", "cold")).drop("key", "apart", "hot", "cold")
    return wide.select("row", *(f"r{p}" for p in positions))


def _matrix(g: Grid, positions, method: str, triangle: dict) -> DataFrame:
    rows = [(i, j, r, n) for (i, j), (r, n) in triangle.items()]
    pairs = g.frame.sparkSession.createDataFrame(rows, MATRIX_SCHEMA)
    return pairs.select(F.lit(method).alias("method"), "i", "j", "r", "n")


def pair_table(g: Grid, positions, method: str = "pearson", options: ProfileOptions = DEFAULT, numbers=None) -> DataFrame:
    """``method, i, j, a, b, r, n`` for i < j. ``r`` is NULL below three pairs or without variance.

    Spearman ranks each column over its own values first and drops incomplete pairs then.
    """
    positions = list(positions)
    numbers = g.numbers(positions, options.tokens) if numbers is None else numbers
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    frame, prefix = (numbers, "n") if method == "pearson" else (store(rank_frame(numbers, positions)), "r")
    if len(positions) >= SMALL_MATRIX:
        matrix = pair_coefficients(frame, positions, prefix).withColumn("method", F.lit(method))
    elif len(positions) >= GRAM_FROM:
        every = {(i, j): (None, 0) for a, i in enumerate(positions) for j in positions[a + 1 :]}
        found = {(r["i"], r["j"]): (r["r"], r["n"]) for r in pair_coefficients(frame, positions, prefix).collect()}
        matrix = _matrix(g, positions, method, every | found)
    else:
        matrix = _matrix(g, positions, method, _upper_triangle(frame, positions, prefix))
    return matrix.select(
        "method", "i", "j", g.name_of(F.col("i")).alias("a"), g.name_of(F.col("j")).alias("b"), "r", "n"
    )


def full_matrix(g: Grid, positions, pairs: DataFrame) -> DataFrame:
    """``i, j, a, b, r, shown``: both triangles and a diagonal of ones."""
    spark = g.frame.sparkSession
    listed = spark.range(len(positions), numPartitions=1)
    p = F.get(F.array(*map(F.lit, positions)), F.col("id").cast("int"))
    diagonal = listed.select(p.alias("i"), p.alias("j"), F.lit(1.0).alias("r"))
    cells = union(
        [
            pairs.select("i", "j", "r"),
            pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"),
            diagonal,
        ]
    )
    return cells.select(
        "i", "j", g.name_of(F.col("i")).alias("a"), g.name_of(F.col("j")).alias("b"), "r", F.round("r", 3).alias("shown")
    )


def strongest_pairs(pairs: DataFrame, top: int = STRONGEST) -> DataFrame:
    """``method, a, b, r, strength`` by descending absolute coefficient, column order on ties."""
    best = pairs.filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "i", "j").limit(top)
    return best.select("method", "a", "b", "r", strength(F.col("r")).alias("strength"))
