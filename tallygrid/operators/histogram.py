"""Equal-width histograms with automatic or given bin counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallygrid.functions.display import range_label
from tallygrid.grid import Grid, union
from tallygrid.operators.numeric import NumericSummary, sketched_spans, spans, worth_sketching
from tallygrid.operators.quantiles import quantiles
from tallygrid.options import DEFAULT, ProfileOptions

# Bounds of automatic and given bin counts.
MAX_AUTO_BINS = 80
MAX_BINS = 200

_GROUP = 15


@dataclass(frozen=True)
class Bins:
    pos: int
    low: float
    high: float
    count: int

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.count


def auto_bin_count(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """Freedman-Diaconis; Sturges where the quartiles coincide."""
    iqr = q3 - q1
    if iqr > 0:
        ranges = (high / 2 - low / 2) / (q3 / 2 - q1 / 2) if math.isinf(high - low) else (high - low) / iqr
        wanted = ranges * math.cbrt(n) / 2
        return max(1, min(MAX_AUTO_BINS, math.ceil(min(wanted, MAX_AUTO_BINS))))
    return max(1, min(MAX_AUTO_BINS, math.ceil(math.log2(n)) + 1))


def _bins(pos: int, low: float, high: float, count: int) -> Bins:
    # A constant column gets one bin of width one.
    return Bins(pos, low, high, count) if low < high else Bins(pos, low, low + 1, 1)


def auto_bins(summaries: dict[int, NumericSummary]) -> list[Bins]:
    return [
        _bins(p, s.min, s.max, auto_bin_count(s.count, s.min, s.max, s.q1, s.q3)) for p, s in summaries.items()
    ]


def count_bins(numbers: DataFrame, bins: list[Bins]) -> DataFrame:
    """``pos, bin, lo, hi, n``. Empty bins are kept; the last bin includes its upper edge."""
    parts = []
    for start in range(0, len(bins), _GROUP):
        group = bins[start : start + _GROUP]
        pairs = []
        for b in group:
            value = F.col(f"n{b.pos}")
            place = F.floor((value - F.lit(b.low)) / F.lit(b.width))
            # least and greatest skip NULL, so NULL values need a guard of their own.
            inside = F.least(F.greatest(place, F.lit(0)), F.lit(b.count - 1)).cast("int")
            pairs += [F.lit(b.pos), F.when(value.isNotNull(), inside)]
        stacked = numbers.select(F.stack(F.lit(len(group)), *pairs).alias("pos", "bin"))
        parts.append(stacked.filter(F.col("bin").isNotNull()))
    counted = union(parts).groupBy("pos", "bin").agg(F.count(F.lit(1)).alias("n"))

    def lookup(values):
        return F.get(F.array(*map(F.lit, values)), F.col("id").cast("int"))

    edges = numbers.sparkSession.range(len(bins), numPartitions=1).select(
        lookup([b.pos for b in bins]).alias("pos"),
        lookup([b.low for b in bins]).alias("low"),
        lookup([b.high for b in bins]).alias("high"),
        lookup([b.width for b in bins]).alias("width"),
        lookup([b.count for b in bins]).alias("k"),
    )
    all_bins = edges.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    # Both sides have at most MAX_BINS rows per column.
    return all_bins.join(F.broadcast(counted), ["pos", "bin"], "left").select(
        "pos",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("lo"),
        F.when(F.col("bin") == F.col("k") - 1, F.col("high"))
        .otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
        .alias("hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def histogram(g: Grid, positions, bins: float | None = None, options: ProfileOptions | None = DEFAULT) -> DataFrame:
    """``pos, name, bin, lo, hi, n, label``.

    ``bins`` below 1 or None chooses automatically. ``options=None`` ignores the missing
    tokens, as when a user changes the bin count of one column.
    """
    positions = [positions] if isinstance(positions, int) else list(positions)
    for p in positions:
        if not 0 <= p < g.width:
            raise ValueError("欄位不存在")
    numbers = g.numbers(positions, None if options is None else options.tokens)
    if bins is not None and bins >= 1:
        span = spans(numbers, positions)
        given = max(1, min(int(bins), MAX_BINS))
        plan = [_bins(p, low, high, given) for p, (_, low, high, _) in span.items()]
    else:
        span, cuts = sketched_spans(numbers, positions, (0.25, 0.75) if worth_sketching(numbers) else ())
        quartiles = quantiles(numbers, {p: s[:3] for p, s in span.items()}, (0.25, 0.75), cuts) if span else {}
        plan = [
            _bins(p, low, high, auto_bin_count(n, low, high, *quartiles[p])) for p, (n, low, high, _) in span.items()
        ]
    # A column without numbers shows one empty bin from 0 to 1.
    plan += [Bins(p, 0.0, 1.0, 1) for p in positions if p not in span]
    counted = count_bins(numbers, plan)
    return counted.select(
        "pos", g.name_of(F.col("pos")).alias("name"), "bin", "lo", "hi", "n", range_label(F.col("lo"), F.col("hi")).alias("label")
    )
