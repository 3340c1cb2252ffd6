"""Descriptive statistics and outlier counts of numeric columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallygrid.grid import Grid, union
from tallygrid.operators.quantiles import QUARTILES, SKETCH_GROUPS, SKETCH_K, quantiles, sketch_ranks
from tallygrid.options import DEFAULT, ProfileOptions

# Outlier rules.
FENCE_IQR = 1.5
Z_LIMIT = 3

#: Columns per wide aggregate; each group scans only its own columns.
_GROUP = 15
#: Bytes of input from which quantile sketches save more than they cost.
SKETCHED_FROM = 1 << 30


@dataclass(frozen=True)
class NumericSummary:
    """Scalars of one column, from which later plans take their constants."""

    pos: int
    count: int
    mean: float
    std: float
    min: float
    q1: float
    median: float
    q3: float
    max: float
    skew: float
    kurt: float

    @property
    def fences(self) -> tuple[float, float]:
        iqr = self.q3 - self.q1
        return self.q1 - FENCE_IQR * iqr, self.q3 + FENCE_IQR * iqr


def _groups(positions):
    positions = list(positions)
    return [positions[i : i + _GROUP] for i in range(0, len(positions), _GROUP)]


def spans(numbers: DataFrame, positions) -> dict[int, tuple[int, float, float, float]]:
    """``(count, min, max, mean)`` of the columns that hold any finite value."""
    return sketched_spans(numbers, positions, ())[0]


def sketched_spans(numbers: DataFrame, positions, probabilities=QUARTILES):
    """:func:`spans`, and each column's sketch read at the ranks that bracket the probabilities, in one scan."""
    out, cuts = {}, {}
    ranks = F.array(*map(F.lit, sketch_ranks(probabilities)))
    for group in _groups(positions):
        aggregates = []
        for p in group:
            value = f"n{p}"
            aggregates += [F.count(value).alias(f"c{p}"), F.min(value).alias(f"a{p}"), F.max(value).alias(f"b{p}")]
            # A mean is the sum of the groups' sums, divided once.
            aggregates.append(F.sum(value).alias(f"s{p}"))
            if probabilities:
                aggregates.append(F.kll_sketch_agg_double(value, SKETCH_K).alias(f"k{p}"))
        # Sketches of many tasks do not meet in one place at once.
        parts = numbers.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("task")).agg(*aggregates) if probabilities else numbers.agg(*aggregates)
        merged = []
        for p in group:
            n = F.sum(f"c{p}")
            merged += [n, F.min(f"a{p}"), F.max(f"b{p}"), F.sum(f"s{p}") / n]
            if probabilities:
                sketch = F.kll_merge_agg_double(f"k{p}")
                merged.append(F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, ranks)))
        row = parts.agg(*merged).first()
        step = 5 if probabilities else 4
        for i, p in enumerate(group):
            n, low, high, mean = row[step * i : step * i + 4]
            if n:
                out[p] = (n, low, high, mean)
                if probabilities:
                    cuts[p] = list(row[step * i + 4])
    vast = [p for p, s in out.items() if not math.isfinite(s[3])]
    if vast:  # sums beyond the doubles: means of scaled values
        scale = {p: max(abs(out[p][1]), abs(out[p][2])) for p in vast}
        row = numbers.agg(*(F.avg(F.col(f"n{p}") / F.lit(scale[p])) for p in vast)).first()
        out |= {p: (*out[p][:3], mean * scale[p]) for p, mean in zip(vast, row)}
    return out, cuts


def _shape(n: int, d2: float, d3: float, d4: float) -> tuple[float, float, float]:
    """Sample deviation, adjusted skewness and excess kurtosis from centred power sums.

    Values come in units of their column's range, so no power leaves the range of doubles.
    """
    m2, m3, m4 = d2 / n, d3 / n, d4 / n
    if not m2 > 0 or not m2 * m2 > 0:
        return 0.0, 0.0, 0.0
    std = math.sqrt(d2 / (n - 1)) if n > 1 else 0.0
    skew = math.sqrt(n * (n - 1)) / ((n - 2) or 1) * (m3 / (m2 * math.sqrt(m2)))
    return std, skew if math.isfinite(skew) else 0.0, m4 / (m2 * m2) - 3


def _in_ranges(value: Column, low: float, high: float, mean: float) -> Column:
    """Distance from the mean in units of the range."""
    if low == high:
        return F.when(value.isNotNull(), F.lit(0.0))
    if math.isinf(high - low):
        return (value / 2 - F.lit(mean / 2)) / F.lit(high / 2 - low / 2)
    return (value - F.lit(mean)) / F.lit(high - low)


def worth_sketching(numbers: DataFrame) -> bool:
    """Whether a scan costs more than feeding sketches to save some: by the plan's size, as Spark estimates it."""
    return int(numbers._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SKETCHED_FROM


def summarize(numbers: DataFrame, positions, sketches: bool | None = None, **limits) -> dict[int, NumericSummary]:
    """Everything but the outlier counts: one scan for the extremes, means and sketches, one for the
    power sums around those means, and one that reads the quartiles off the sketches' brackets.
    Without sketches (None: if the input is small) the quartiles are searched by bins, in more scans."""
    sketches = worth_sketching(numbers) if sketches is None else sketches
    span, cuts = sketched_spans(numbers, positions, QUARTILES if sketches else ())
    shape = {}
    for group in _groups(span):
        sums = []
        for p in group:
            d = _in_ranges(F.col(f"n{p}"), *span[p][1:])
            sums += [F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)]
        row = numbers.agg(*sums).first()
        for i, p in enumerate(group):
            n, low, high, _ = span[p]
            # Rounding noise around the mean of a constant is not a deviation.
            std, skew, kurt = _shape(n, *row[3 * i : 3 * i + 3]) if low < high else (0.0, 0.0, 0.0)
            size = std * (high / 2 - low / 2) * 2 if math.isinf(high - low) else std * (high - low)
            shape[p] = (size, skew, kurt)
    quartiles = quantiles(numbers, {p: s[:3] for p, s in span.items()}, cuts=cuts, **limits) if span else {}
    return {
        p: NumericSummary(p, n, mean, shape[p][0], low, *quartiles[p], high, *shape[p][1:])
        for p, (n, low, high, mean) in span.items()
    }


def profile_numbers(numbers: DataFrame, summaries: dict[int, NumericSummary]) -> DataFrame:
    """``pos, count .. kurt, iqr_outliers, z_outliers`` from one more scan."""
    fields = ("count", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurt")
    parts = []
    for group in _groups(summaries):
        counts, rows = [], []
        for p in group:
            s = summaries[p]
            value = F.col(f"n{p}")
            low, high = s.fences
            far = F.abs(value - F.lit(s.mean)) > F.lit(Z_LIMIT * s.std)
            counts.append(F.count_if((value < F.lit(low)) | (value > F.lit(high))).alias(f"i{p}"))
            counts.append(F.count_if(far if s.std > 0 else F.lit(False)).alias(f"z{p}"))
            scalars = [F.lit(s.count).cast("bigint"), *(F.lit(float(getattr(s, f))) for f in fields[1:])]
            rows += [F.lit(p), *scalars, F.col(f"i{p}"), F.col(f"z{p}")]
        table = F.stack(F.lit(len(group)), *rows).alias("pos", *fields, "iqr_outliers", "z_outliers")
        parts.append(numbers.agg(*counts).select(table))
    return union(parts)


def numeric_profile(g: Grid, positions=None, options: ProfileOptions = DEFAULT, sketches: bool | None = None) -> DataFrame:
    """Statistics of the finite values of ``positions``; columns without any are left out."""
    positions = range(g.width) if positions is None else positions
    numbers = g.numbers(positions, options.tokens)
    summaries = summarize(numbers, positions, sketches)
    if not summaries:
        schema = "pos int, name string, count bigint, mean double, std double, min double, q1 double, median double"
        rest = "q3 double, max double, skew double, kurt double, iqr_outliers bigint, z_outliers bigint"
        return g.frame.sparkSession.createDataFrame([], f"{schema}, {rest}")
    profile = profile_numbers(numbers, summaries)
    return profile.select("pos", g.name_of(F.col("pos")).alias("name"), *profile.columns[1:])
