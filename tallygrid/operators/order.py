"""Row positions and running totals over a global order, without one global window.

A sort range-partitions the keys; each partition knows its own running total, and a frame
with one row per partition supplies what lies before it. Only keys are sorted: the few
rows that an operator needs are then fetched from the table by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.grid import Grid
from tallygrid.session import freeze

#: Lower bits of ``monotonically_increasing_id``: the row number inside the partition.
_IN_PARTITION = (1 << 33) - 1
#: Wanted rows up to this many are broadcast.
MAX_BROADCAST = 50_000


def running_total(
    df: DataFrame, group: list[str], keys: list[str], weight: str, name: str = "before", part: str | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over earlier rows of the same ``group`` in ``keys`` order.

    ``(group, keys)`` must be distinct rows, as after a group-by, so a value that fills a
    third of the table is one row here and no partition is hot. ``part`` names a column for the
    number of the piece of the order that a row is in.
    """
    # Range partitioning cuts between rows, so pieces are even whatever the group sizes are.
    ordered = freeze(df.sort(*group, *keys).withColumn("_part", F.spark_partition_id()))
    sums = ordered.groupBy("_part", *group).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition and group.
    base = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    out = (
        ordered.withColumn("_local", local)
        .join(F.broadcast(base), ["_part", *group])
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop("_base", "_local")
    )
    return out.withColumnRenamed("_part", part) if part else out.drop("_part")


def keyed(g: Grid) -> tuple[DataFrame, list[str]]:
    """The table and the keys that order it.

    Rows that may share an order key are told apart by a hash of their cells, so a key that
    holds a third of all rows still spreads; only exact copies stay together, as counts.
    """
    keys = g.require_order()
    if g.distinct_order or g.keys_cover_cells:
        return g.frame, keys
    tie = F.xxhash64(*(f"c{p}" for p in range(g.width)))
    return g.frame.withColumn("_tie", tie), [*keys, "_tie"]


def _row_keys(g: Grid) -> DataFrame:
    """Distinct keys with ``start``, the position of their first row, and ``copies``."""
    frame, keys = keyed(g)
    if not g.distinct_order:
        counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        return running_total(counted, [], keys, "copies", "start")
    ordered = freeze(
        frame.select(*keys)
        .sort(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    )
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition, so this window is small.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return ordered.join(F.broadcast(base), "_part").select(
        *keys, (F.col("_base") + F.col("_local")).alias("start"), F.lit(1).cast("bigint").alias("copies")
    )


def _fetch(g: Grid, wanted: DataFrame, whole_files: bool, limit: int) -> DataFrame:
    """Rows of the grid for ``wanted`` keys, one per entry of their array ``rids``.

    ``wanted`` holds at most ``limit`` rows. Up to MAX_BROADCAST they are broadcast and the
    table is read once without moving; more are joined by a shuffle.
    """
    if whole_files:
        return _fetch_from_files(g, wanted, limit)
    frame, keys = keyed(g)
    cells = [f"c{p}" for p in range(g.width)]
    small = wanted.select(*(F.col(k).alias(f"w_{k}") for k in keys), "start", "rids")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    hits = frame.join(_sized(small, limit), match)
    if g.distinct_order:
        return hits.select(F.explode("rids").alias("rid"), *g.order, *cells)
    # Copies collapse on the map side; more than one row per key is left only where two
    # different rows have the same hash, and those are ordered by content.
    groups = hits.groupBy("start", "rids", *g.order, *cells).agg(F.count(F.lit(1)).alias("_copies"))
    among = Window.partitionBy("start").orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("_copies").over(among), F.lit(0))
    return (
        groups.withColumn("_first", first)
        .select(F.explode("rids").alias("rid"), "_first", "_copies", *g.order, *cells)
        .filter((F.col("rid") >= F.col("_first")) & (F.col("rid") < F.col("_first") + F.col("_copies")))
        .drop("_first", "_copies")
    )


def spaced_rows(g: Grid, rows: int, spacing: tuple[int, int], limit: int) -> DataFrame:
    """The rows at positions ``floor(i * a / b)``, ``i = 0..limit-1``, where ``spacing = (a, b)``.

    Adds ``rid`` (the position). Returns at most ``limit`` rows, whatever the table size.
    """
    a, b = spacing
    if rows <= limit and a == b:
        # Every row is wanted: a table this small is numbered by one bounded window.
        return _number_small(g)
    keys, whole_files = _positions(g)

    def first_index(position: Column) -> Column:
        """Smallest i with floor(i * a / b) >= position."""
        return _div(position * F.lit(b) + F.lit(a - 1), a)

    low = first_index(F.col("start"))
    high = F.least(first_index(F.col("start") + F.col("copies")), F.lit(limit).cast("bigint")) - 1
    rids = F.transform(_ascending(low, high), lambda i: _div(i * F.lit(a), b))
    return _fetch(g, keys.filter(low <= high).select("*", rids.alias("rids")), whole_files, limit)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _positions(g: Grid) -> tuple[DataFrame, bool]:
    """Keys with ``start`` and ``copies``, and whether they are whole files.

    Places in a file are positions only while no row of the file is filtered out; otherwise
    the rows that are left are numbered by their keys.
    """
    if g.by_file:
        sizes = g.frame.groupBy("k0").agg(F.count(F.lit(1)).alias("copies"), F.max("k1").alias("last"))
        if sizes.filter("copies <> last + 1").isEmpty():
            return _file_starts(sizes.drop("last")), True
    return _row_keys(g), False


def _file_starts(sizes: DataFrame) -> DataFrame:
    """One row per file: ``k0``, ``start`` and ``copies``, here the rows of the file."""
    earlier = Window.orderBy("k0").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    return sizes.withColumn("start", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))


def _fetch_from_files(g: Grid, wanted: DataFrame, limit: int) -> DataFrame:
    """Rows by file and place; only the files that hold a wanted row are opened."""
    places = freeze(
        wanted.select("k0", "start", F.explode("rids").alias("rid")).select(
            F.col("k0").alias("w_k0"), (F.col("rid") - F.col("start")).alias("w_k1"), "rid"
        )
    )
    files = [r[0] for r in places.select("w_k0").distinct().collect()]
    match = (F.col("k0") == F.col("w_k0")) & (F.col("k1") == F.col("w_k1"))
    hits = g.frame.filter(F.col("k0").isin(*files)).join(_sized(places, limit), match)
    return hits.select("rid", *g.order, *(f"c{p}" for p in range(g.width)))


def row_range(g: Grid, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` with their ``rid``, for pages deep inside a table."""
    keys, whole_files = _positions(g)
    low = F.greatest(F.col("start"), F.lit(offset).cast("bigint"))
    high = F.least(F.col("start") + F.col("copies"), F.lit(offset + limit).cast("bigint")) - 1
    return _fetch(g, keys.filter(low <= high).select("*", _ascending(low, high).alias("rids")), whole_files, limit)


def _ascending(low: Column, high: Column) -> Column:
    """``low..high``, empty if there is nothing between; a bare sequence would count down."""
    return F.when(low <= high, F.sequence(low, high))


def _number_small(g: Grid) -> DataFrame:
    frame, keys = keyed(g)
    position = F.row_number().over(Window.orderBy(*keys)) - 1
    cells = [f"c{p}" for p in range(g.width)]
    return frame.select(position.cast("bigint").alias("rid"), *g.order, *cells)


def _div(value: Column, divisor: int) -> Column:
    """Whole-number division without a detour through doubles."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))
