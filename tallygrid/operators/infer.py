"""Column types from an evenly spaced sample of at most 2 000 present cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.grid import Grid
from tallygrid.operators.order import spaced_rows
from tallygrid.options import DEFAULT, TYPE_SAMPLE, TYPE_THRESHOLD, ProfileOptions
from tallygrid.session import freeze

NUMERIC = ("integer", "number")
#: Labels of columns whose values are counted as they stand.
OTHER = ("text", "boolean")
_TESTS = (("is_bool", "bools"), ("is_int", "ints"), ("is_num", "nums"), ("is_date", "dates"))


def _tests(options: ProfileOptions) -> dict:
    return {
        "absent": lambda c: c.missing(options.tokens),
        "is_bool": lambda c: c.is_boolean,
        "is_int": lambda c: c.is_integer,
        "is_num": lambda c: c.number.isNotNull(),
        "is_date": lambda c: c.instant.isNotNull(),
    }


def _label() -> Column:
    """The type from the counts of present cells that pass the tests."""
    share = {name: F.col(name) / F.col("sampled") >= TYPE_THRESHOLD for _, name in _TESTS}
    label = F.when(F.coalesce(F.col("sampled"), F.lit(0)) == 0, "text")
    for name, kind in (("bools", "boolean"), ("ints", "integer"), ("nums", "number"), ("dates", "date")):
        label = label.when(share[name], kind)
    return label.otherwise("text")


def infer_types(g: Grid, options: ProfileOptions = DEFAULT, rows: int | None = None) -> DataFrame:
    """``pos, name, sampled, bools, ints, nums, dates, type`` per column.

    The sample steps through the table by ``floor(rows / 2000)`` and keeps the first 2 000
    present cells of each column. A type needs 90 % of them; boolean is tried first, then
    integer, number and date.
    """
    g.require_order()
    rows = g.frame.count() if rows is None else rows
    step = max(1, rows // TYPE_SAMPLE)
    # step = floor(rows / 2000) leaves fewer than 4 000 candidate rows.
    candidates = freeze(spaced_rows(g, rows, (step, 1), 2 * TYPE_SAMPLE))
    sample = Grid(candidates, g.names, g.storage, ("rid",), True)
    cells = sample.long(range(g.width), _tests(options), keep=("rid",))
    turn = F.row_number().over(Window.partitionBy("pos").orderBy("rid"))
    counted = (
        cells.filter(~F.col("absent"))
        .withColumn("turn", turn)
        .filter(F.col("turn") <= TYPE_SAMPLE)
        .groupBy("pos")
        .agg(
            F.count(F.lit(1)).alias("sampled"),
            *(F.count_if(F.col(flag)).alias(name) for flag, name in _TESTS),
        )
    )
    columns = _one_row_per_column(g)
    zero = F.lit(0).cast("bigint")
    return columns.join(F.broadcast(counted), "pos", "left").select(
        "pos",
        "name",
        *(F.coalesce(F.col(c), zero).alias(c) for c in ("sampled", "bools", "ints", "nums", "dates")),
        _label().alias("type"),
    )


def _one_row_per_column(g: Grid) -> DataFrame:
    columns = g.frame.sparkSession.range(g.width, numPartitions=1)
    return columns.select(F.col("id").cast("int").alias("pos"), g.name_of(F.col("id").cast("int")).alias("name"))


def column_types(g: Grid, options: ProfileOptions = DEFAULT, rows: int | None = None) -> list[str]:
    """The labels on the driver (one string per column)."""
    found = {r["pos"]: r["type"] for r in infer_types(g, options, rows).select("pos", "type").collect()}
    return [found[p] for p in range(g.width)]


def whole_types(g: Grid, positions: Sequence[int], options: ProfileOptions = DEFAULT) -> dict[int, str]:
    """The types of columns by all their present cells, in one scan: for those in which the sample finds no numbers or dates.

    Missing or malformed cells at equal distances can fall on every sampled row.
    """
    counted = (
        g.long(positions, _tests(options))
        .filter(~F.col("absent"))
        .groupBy("pos")
        .agg(F.count(F.lit(1)).alias("sampled"), *(F.count_if(F.col(flag)).alias(name) for flag, name in _TESTS))
    )
    found = {r["pos"]: r["type"] for r in counted.select("pos", _label().alias("type")).collect()}
    return {p: found.get(p, "text") for p in positions}


def numeric_positions(types: list[str]) -> list[int]:
    return [p for p, t in enumerate(types) if t in NUMERIC]
