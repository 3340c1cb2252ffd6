"""Distinct counts, value frequencies and most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.display import BLANK_VALUE
from tallygrid.grid import STRING, TIMESTAMP, Cell, Grid, union
from tallygrid.options import DEFAULT, LOW_CARDINALITY, ProfileOptions
from tallygrid.session import store

# Fixed value: rows of a category table.
TABLE_ROWS = 30

#: Columns with cells of more bytes are grouped by digest, so that whole texts stay in place.
LONG_TEXT = 512
_EVERY = 2**31 - 1


def _present(g: Grid, positions, options: ProfileOptions, digest: bool = False):
    """Per storage kind: ``pos, key``, one row per cell, with NULL for a missing one.

    NULLs go through the grouping instead of a filter: Spark would push a filter below the
    projections and evaluate the trimming once more. ``digest`` stands in for the text.
    """

    def key(c: Cell) -> Column:
        return F.when(~c.missing(options.tokens), F.sha2(c.text, 256) if digest else c.key)

    yield from g.long_parts(positions, {"key": key})


def split_long(g: Grid, positions, limit: int = LONG_TEXT) -> tuple[list[int], list[int]]:
    """``positions`` without and with cells of more than ``limit`` bytes."""
    text = [p for p in positions if g.storage[p] == STRING]
    long: set[int] = set()
    for start in range(0, len(text), 50):
        group = text[start : start + 50]
        row = g.frame.agg(*(F.max(F.octet_length(f"c{p}")) for p in group)).first()
        long |= {p for p, size in zip(group, row) if (size or 0) > limit}
    return [p for p in positions if p not in long], [p for p in positions if p in long]


def _distinct(parts: list[DataFrame]) -> DataFrame:
    """``pos, distinct``. Grouping by value first leaves one row per value and task to move."""
    return union([p.distinct().groupBy("pos").agg(F.count("key").alias("distinct")) for p in parts])


def unique_counts(g: Grid, positions=None, options: ProfileOptions = DEFAULT, *, long_text: int = LONG_TEXT) -> DataFrame:
    """``pos, name, unique, unique_truncated``: distinct present values, exact.

    With ``options.unique_cap`` a column with more values reports ``cap + 1`` and the flag.
    """
    positions = list(range(g.width) if positions is None else positions)
    short, long = split_long(g, positions, long_text)
    parts = [p for _, p in _present(g, short, options)] + [p for _, p in _present(g, long, options, digest=True)]
    # One row per column on both sides.
    counted = _columns(g, positions).join(F.broadcast(_distinct(parts)), "pos", "left")
    shown, cut = capped(F.coalesce("distinct", F.lit(0).cast("bigint")), options.unique_cap)
    return counted.select("pos", "name", shown.alias("unique"), cut.alias("unique_truncated"))


def capped(count: Column, cap: int | None) -> tuple[Column, Column]:
    """A count as reported under a cap, and whether it exceeds it."""
    if cap is None:
        return count, F.lit(False)
    return F.least(count, F.lit(cap + 1).cast("bigint")), count > cap


def _columns(g: Grid, positions) -> DataFrame:
    listed = g.frame.sparkSession.range(len(positions), numPartitions=1)
    pos = F.get(F.array(*map(F.lit, positions)), F.col("id").cast("int"))
    return listed.select(pos.alias("pos")).select("pos", g.name_of(F.col("pos")).alias("name"))


def frequencies(g: Grid, positions, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``pos, value, n``: how often each trimmed, case-sensitive value occurs."""
    parts = []
    for storage, part in _present(g, positions, options):
        counted = part.groupBy("pos", "key").agg(F.count("key").alias("n")).filter("n > 0")
        # Typed values are counted as they are and spelled once per distinct value.
        value = F.col("key") if storage in (STRING, TIMESTAMP) else Cell(F.col("key"), storage).text
        parts.append(counted.select("pos", value.alias("value"), "n"))
    return union(parts)


def _first_by_count(freq: DataFrame, tie: str, top: int) -> DataFrame:
    """``pos, rank, value, n``. The rank filter keeps ``top`` rows per column and task before
    the final exchange."""
    value = F.col("value") if tie == "binary" else F.collate("value", "UNICODE")
    order = [F.desc("n"), value.asc(), F.col("value").asc()]
    ranked = freq.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("pos", "rank", "value", "n")


class Frequencies:
    """Value counts of some columns, with the texts of long cells left where they are.

    Short values are counted as they are. Columns with long cells are counted by SHA-256
    digest; texts are then read for the few values that a result shows.
    """

    def __init__(self, g: Grid, positions, options: ProfileOptions = DEFAULT, long_text: int = LONG_TEXT):
        self.grid, self.options = g, options
        self.short, self.long = split_long(g, positions, long_text)
        self._values = frequencies(g, self.short, options) if self.short else None
        self._digests = None
        if self.long:
            parts = [p.groupBy("pos", "key").agg(F.count("key").alias("n")) for _, p in _present(g, self.long, options, True)]
            # Read several times below; the texts are hashed once.
            self._digests = store(union(parts).filter("n > 0"))

    def totals(self) -> DataFrame:
        """``pos, distinct, valid``."""
        counted = [c.select("pos", "n") for c in (self._values, self._digests) if c is not None]
        return union(counted).groupBy("pos").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("valid"))

    def top(self, top: int) -> DataFrame:
        """``pos, rank, value, n`` of the most frequent values per column."""
        if not self.short and not self.long:
            return self.grid.frame.sparkSession.createDataFrame([], "pos int, rank int, value string, n long")
        parts = [] if self._values is None else [_first_by_count(self._values, self.options.tie, top)]
        if self._digests is not None:
            parts.append(_first_by_count(self._texts(top), self.options.tie, top))
        return union(parts)

    def _texts(self, top: int) -> DataFrame:
        """``pos, value, n`` of every long text that can be among the first ``top``.

        Those are the texts counted more often than the ``top``-th one, fewer than ``top``
        per column, and the ones counted just as often, of which text order decides.
        """
        counts = self._digests
        place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n")))
        leaders = counts.withColumn("place", place).filter(F.col("place") <= top)
        cut = {r["pos"]: r["t"] if r["k"] == top else 0 for r in leaders.groupBy("pos").agg(F.min("n").alias("t"), F.count(F.lit(1)).alias("k")).collect()}
        limit = F.element_at(F.create_map(*(F.lit(x) for pair in cut.items() for x in pair)), F.col("pos")) if cut else F.lit(0)
        fields = {
            "value": lambda c: F.when(~c.missing(self.options.tokens), c.text),
            "key": lambda c: F.when(~c.missing(self.options.tokens), F.sha2(c.text, 256)),
        }
        cells = self.grid.long(self.long, fields)
        above = F.broadcast(counts.filter(F.col("n") > limit))
        parts = [cells.join(above, ["pos", "key"]).select("pos", "value", "n").distinct()]
        single = [p for p, t in cut.items() if t == 1]
        shared = [p for p, t in cut.items() if t > 1]
        if single:
            # All other texts occur once: no join, no grouping, only the first ones by text.
            repeated = F.broadcast(counts.filter(F.col("pos").isin(*single) & (F.col("n") > 1)))
            once = cells.filter(F.col("pos").isin(*single) & F.col("key").isNotNull())
            once = once.join(repeated, ["pos", "key"], "left_anti")
            parts.append(once.select("pos", "value", F.lit(1).cast("bigint").alias("n")))
        if shared:
            tied = counts.filter(F.col("pos").isin(*shared) & (F.col("n") == limit))
            parts.append(cells.join(tied, ["pos", "key"]).select("pos", "value", "n").distinct())
        return union(parts)


def top_categories(
    g: Grid, positions, options: ProfileOptions = DEFAULT, top: int | None = None, freq: Frequencies | None = None
) -> DataFrame:
    """``pos, name, rank, value, n``: the ``top`` most frequent values of each column."""
    freq = Frequencies(g, positions, options) if freq is None else freq
    top = options.top_categories if top is None else top
    return freq.top(_EVERY if top is None else top).select("pos", g.name_of(F.col("pos")).alias("name"), "rank", "value", "n")


def category_summary(
    g: Grid, positions, options: ProfileOptions = DEFAULT, top: int | None = None, freq: Frequencies | None = None
) -> DataFrame:
    """``pos, name, valid, distinct, cardinality, truncated, top_value, top_n, top_share``.

    Counts are exact for any number of values; ``options.category_cap`` bounds the reported
    cardinality only. ``truncated`` tells that the ``top`` list leaves values out. The share
    divides by the present cells.
    """
    top = options.top_categories if top is None else top
    listed = min((x for x in (top, options.category_cap) if x is not None), default=None)
    cardinality = F.col("distinct")
    if options.category_cap is not None:
        cardinality = F.least("distinct", F.lit(options.category_cap).cast("bigint"))
    freq = Frequencies(g, positions, options) if freq is None else freq
    first = freq.top(1).select("pos", F.col("value").alias("top_value"), F.col("n").alias("top_n"))
    # One row per column on both sides.
    both = freq.totals().join(F.broadcast(first), "pos")
    return both.select(
        "pos",
        g.name_of(F.col("pos")).alias("name"),
        "valid",
        "distinct",
        cardinality.alias("cardinality"),
        (F.lit(False) if listed is None else F.col("distinct") > listed).alias("truncated"),
        "top_value",
        "top_n",
        (F.col("top_n") / F.col("valid")).alias("top_share"),
    )


def category_table(g: Grid, positions, options: ProfileOptions = DEFAULT, rows: int = TABLE_ROWS) -> DataFrame:
    """``pos, name, rank, value, n, share`` of the first ``rows`` values of each column."""
    freq = Frequencies(g, positions, options)
    valid = freq.totals().select("pos", "valid")
    shown = top_categories(g, positions, options, rows, freq)
    share = F.col("n") / F.greatest(F.col("valid"), F.lit(1))
    value = F.when(F.col("value") == "", BLANK_VALUE).otherwise(F.col("value"))
    return shown.join(F.broadcast(valid), "pos").select("pos", "name", "rank", value.alias("value"), "n", share.alias("share"))


def low_cardinality(uniques: dict[int, int], numeric: list[int]) -> list[int]:
    """Numeric columns with so few values that they are also profiled as categories."""
    return [p for p in numeric if uniques[p] <= LOW_CARDINALITY]
