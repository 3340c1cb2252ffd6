"""An ordered index of the numbers of many columns: one scan and one sort, then look-ups.

The index is a stored table of distinct values, range-partitioned by column and value, with each
value's count and the count of all smaller ones. Its *zones*, the stretches of one column in one
folder of files, are known by their extremes, counts and running counts; there are hardly more zones than
sort tasks and columns, so the driver holds them. They answer most of a question alone: counts and
extremes, which zones a position falls into, and how many values lie below a bound but for
one zone. Only zones that a question cannot do without are opened: they are folders of
the stored table, and filters on column and value reach its files.

So quartiles, fences and outlier counts, any number of re-binned histograms, and average
ranks come from one index with one scan of the cells. Moments read the index once: its rows are
distinct values, not cells.

A table without numbers gives an index without zones and empty results. Values that
fill any share of a column are one row of the index, so no task is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallygrid.functions.display import range_label
from tallygrid.grid import Grid, union
from tallygrid.operators import histogram, numeric
from tallygrid.operators.order import running_total
from tallygrid.operators.quantiles import QUARTILES
from tallygrid.options import DEFAULT, ProfileOptions
from tallygrid.session import store

#: Columns that are stacked in one pass.
_GROUP = 15


@dataclass(frozen=True)
class Zone:
    """One column's values in one file: ``rows`` distinct ones, ``n`` in all, ``before`` smaller ones elsewhere."""

    zone: int
    pos: int
    low: float
    high: float
    before: int
    n: int
    rows: int


class ValueIndex:
    """Look-ups in an index of numbers; see the module."""

    def __init__(self, frame: DataFrame, names: tuple[str, ...]):
        self.frame = frame
        self.names = names
        rows = frame.groupBy("zone", "pos").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.min("before").alias("before"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")
        )
        self.zones: dict[int, list[Zone]] = {}
        for r in sorted(rows.collect(), key=lambda r: (r["pos"], r["low"])):
            self.zones.setdefault(r["pos"], []).append(Zone(*(r[k] for k in ("zone", "pos", "low", "high", "before", "n", "rows"))))

    @classmethod
    def build(cls, g: Grid, positions: Iterable[int] | None = None, tokens: frozenset[str] | None = DEFAULT.tokens) -> ValueIndex:
        """One scan of the cells: distinct finite values with counts, sorted once and stored."""
        positions = list(range(g.width) if positions is None else positions)
        numbers = g.numbers(positions, tokens)
        parts = []
        for start in range(0, len(positions), _GROUP):
            group = positions[start : start + _GROUP]
            cells = [x for p in group for x in (F.lit(p), F.col(f"n{p}"))]
            parts.append(numbers.select(F.stack(F.lit(len(group)), *cells).alias("pos", "v")).filter(F.col("v").isNotNull()))
        # Both zeros are one number.
        counted = union(parts).groupBy("pos", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return cls.from_counts(counted, g.names)

    @classmethod
    def from_counts(cls, counted: DataFrame, names: tuple[str, ...]) -> ValueIndex:
        """An index of ``pos, v, n`` rows, one for each finite value of a column."""
        ranked = running_total(counted, ["pos"], ["v"], "n", part="zone")
        return cls(store(ranked.select("pos", "v", "n", "before", "zone"), "zone"), names)

    def _rows(self, zones: Iterable[Zone]) -> DataFrame:
        """The index rows of some zones; files and row groups without them are not read."""
        wanted = sorted({(z.zone, z.pos) for z in zones})
        rows = self.frame.filter(F.col("zone").isin(sorted({z for z, _ in wanted})) & F.col("pos").isin(sorted({p for _, p in wanted})))
        pairs = self.frame.sparkSession.createDataFrame(wanted, "zone int, pos int")
        return rows.join(F.broadcast(pairs), ["zone", "pos"], "left_semi")  # zones are as many as files

    def spans(self) -> dict[int, tuple[int, float, float]]:
        """(count, least, greatest value) of the columns that hold any; nothing is read."""
        return {p: (z[-1].before + z[-1].n, z[0].low, z[-1].high) for p, z in self.zones.items()}

    def at_ranks(self, wanted: dict[int, Iterable[int]]) -> dict[tuple[int, int], float]:
        """(column, position) -> value, for 0-based positions in sorted order, from the zones that hold them."""
        held, rows = {}, []
        for p, ranks in wanted.items():
            for r in set(ranks):
                zone = next(z for z in self.zones[p] if z.before <= r < z.before + z.n)
                if zone.rows == 1:
                    held[p, r] = zone.low
                else:
                    rows.append((zone, r))
        if rows:
            targets = self.frame.sparkSession.createDataFrame([(z.zone, z.pos, r) for z, r in rows], "zone int, pos int, r long")
            found = self._rows(z for z, _ in rows).join(F.broadcast(targets), ["zone", "pos"])
            found = found.filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("n")))
            held |= {(row["pos"], row["r"]): row["v"] for row in found.select("pos", "r", "v").collect()}
        return held

    def quantiles(self, probabilities: tuple[float, ...] = QUARTILES) -> dict[int, list[float]]:
        """Linearly interpolated quantiles of every column."""
        places = {p: [(n - 1) * q for q in probabilities] for p, (n, _, _) in self.spans().items()}
        value = self.at_ranks({p: [int(f(x)) for x in at for f in (math.floor, math.ceil)] for p, at in places.items()})
        out: dict[int, list[float]] = {}
        for p, at in places.items():
            pairs = [(value[p, math.floor(x)], value[p, math.ceil(x)], x - math.floor(x)) for x in at]
            out[p] = [low + (high - low) * part for low, high, part in pairs]
        return out

    def count_where(self, tests: dict[int, list]) -> dict[int, list[int]]:
        """How many values of a column pass each of its tests, functions of a value that change once or never in its order.

        A test takes a float or a Column. A zone whose two ends agree counts whole; the others are read.
        """
        out = {p: [0] * len(some) for p, some in tests.items()}
        rows, sums = [], []
        for p, some in tests.items():
            for i, test in enumerate(some):
                for z in self.zones[p]:
                    low, high = test(z.low), test(z.high)
                    if low and high:
                        out[p][i] += z.n
                    elif low != high:
                        rows.append(z)
                        here = (F.col("zone") == z.zone) & (F.col("pos") == p) & test(F.col("v"))
                        sums.append((p, i, F.sum(F.when(here, F.col("n")))))
        if sums:
            found = self._rows(rows).agg(*(s for *_, s in sums)).first()
            for (p, i, _), n in zip(sums, found):
                out[p][i] += n or 0
        return out

    def summaries(self) -> dict[int, numeric.NumericSummary]:
        """:func:`tallygrid.operators.numeric.summarize` from the index."""
        spans, quartiles = self.spans(), self.quantiles()
        value, n = F.col("v"), F.col("n")
        scale = {p: max(abs(low), abs(high)) or 1.0 for p, (_, low, high) in spans.items()}
        if not spans:
            return {}
        table = F.create_map(*(F.lit(x) for p, s in scale.items() for x in (p, s)))
        scaled = value / F.element_at(table, F.col("pos"))
        sums = self.frame.groupBy("pos").agg(F.sum(value * n).alias("s"), F.sum(scaled * n).alias("t")).collect()
        mean = {}
        for r in sums:
            count = spans[r["pos"]][0]
            mean[r["pos"]] = r["s"] / count if math.isfinite(r["s"]) else r["t"] / count * scale[r["pos"]]
        parts = [
            self.frame.filter(F.col("pos") == p).select("pos", "n", numeric._in_ranges(value, low, high, mean[p]).alias("d"))
            for p, (_, low, high) in spans.items()
            if low < high
        ]
        powers: dict[int, tuple] = {}
        if parts:
            d = F.col("d")
            rows = union(parts).groupBy("pos").agg(*(F.sum(n * x).alias(k) for k, x in (("a", d * d), ("b", d * d * d), ("c", d * d * d * d))))
            powers = {r["pos"]: (r["a"], r["b"], r["c"]) for r in rows.collect()}
        out = {}
        for p, (count, low, high) in spans.items():
            std, skew, kurt = numeric._shape(count, *powers[p]) if p in powers else (0.0, 0.0, 0.0)
            size = std * (high / 2 - low / 2) * 2 if math.isinf(high - low) else std * (high - low)
            out[p] = numeric.NumericSummary(p, count, mean[p], size, low, *quartiles[p], high, skew, kurt)
        return out

    def numeric_profile(self) -> DataFrame:
        """Like :func:`tallygrid.operators.numeric.numeric_profile`; outliers are counted by zones."""
        summaries = self.summaries()
        tests = {}
        for p, s in summaries.items():
            low, high = s.fences
            far = numeric.Z_LIMIT * s.std
            tests[p] = [lambda v, low=low: v < low, lambda v, high=high: v > high]
            if s.std > 0:  # the distance rises on either side of the mean
                tests[p] += [
                    lambda v, m=s.mean, far=far: (m - v > far), lambda v, m=s.mean, far=far: (v - m > far),
                ]
        counts = self.count_where(tests)
        fields = ("count", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurt")
        rows = [
            (p, self.names[p], *(getattr(s, f) for f in fields), sum(counts[p][:2]), sum(counts[p][2:])) for p, s in sorted(summaries.items())
        ]
        schema = "pos int, name string, count bigint, mean double, std double, min double, q1 double, median double"
        rest = "q3 double, max double, skew double, kurt double, iqr_outliers bigint, z_outliers bigint"
        return self.frame.sparkSession.createDataFrame([(r[0], r[1], int(r[2]), *map(float, r[3:12]), *map(int, r[12:])) for r in rows], f"{schema}, {rest}")

    def histogram(self, pos: int, bins: float | None = None) -> DataFrame:
        """Like :func:`tallygrid.operators.histogram.histogram` of one column: zones inside a bin are not read."""
        if pos not in self.zones:
            plan = histogram.Bins(pos, 0.0, 1.0, 1)
        else:
            n, low, high = self.spans()[pos]
            if bins is not None and bins >= 1:
                count = max(1, min(int(bins), histogram.MAX_BINS))
            else:
                q1, _, q3 = self.quantiles()[pos]
                count = histogram.auto_bin_count(n, low, high, q1, q3)
            plan = histogram._bins(pos, low, high, count)

        def place(v: float) -> int:
            return int(min(max(math.floor((v - plan.low) / plan.width), 0), plan.count - 1))

        counts, open_zones = [0] * plan.count, []
        for z in self.zones.get(pos, []):
            if place(z.low) == place(z.high):
                counts[place(z.low)] += z.n
            else:
                open_zones.append(z)
        if open_zones:
            at = F.floor((F.col("v") - F.lit(plan.low)) / F.lit(plan.width))
            at = F.least(F.greatest(at, F.lit(0)), F.lit(plan.count - 1)).cast("int")
            for r in self._rows(open_zones).groupBy(at.alias("bin")).agg(F.sum("n").alias("n")).collect():
                counts[r["bin"]] += r["n"]
        rows = []
        for i, n in enumerate(counts):
            hi = plan.high if i == plan.count - 1 else plan.low + (i + 1) * plan.width
            rows.append((pos, self.names[pos], i, plan.low + i * plan.width, hi, n))
        out = self.frame.sparkSession.createDataFrame(rows, "pos int, name string, bin int, lo double, hi double, n long")
        return out.select("*", range_label(F.col("lo"), F.col("hi")).alias("label"))

    def average_ranks(self, pos: int) -> DataFrame:
        """(v, n, rank) of a column's distinct values: equal values share the mean of their 1-based positions."""
        return self._rows(self.zones.get(pos, [])).select("v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def value_index(g: Grid, positions: Iterable[int] | None = None, options: ProfileOptions = DEFAULT) -> ValueIndex:
    """An index of the numbers of ``positions``, missing tokens left out."""
    return ValueIndex.build(g, positions, options.tokens)
