"""Date columns: range, unparseable cells and counts per day or month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallygrid.grid import Grid
from tallygrid.options import DEFAULT, ProfileOptions

# The span up to which buckets are days, and bucket formats.
DAY_SPAN = 180
FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
_DAY_SECONDS = 86_400


def _instants(g: Grid, positions, options: ProfileOptions) -> DataFrame:
    return g.long(
        positions,
        {"ts": lambda c: c.instant_unless(options.tokens), "absent": lambda c: c.missing(options.tokens)},
    )


def date_profile(g: Grid, positions, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``pos, name, count, min, max, unparseable, unit``; columns without any date are left out."""
    stats = (
        _instants(g, positions, options)
        .groupBy("pos")
        .agg(
            F.count("ts").alias("count"),
            F.min("ts").alias("min"),
            F.max("ts").alias("max"),
            F.count_if(F.col("ts").isNull() & ~F.col("absent")).alias("unparseable"),
        )
        .filter(F.col("count") > 0)
    )
    seconds = F.timestamp_diff("SECOND", F.col("min"), F.col("max"))
    return stats.select(
        "pos",
        g.name_of(F.col("pos")).alias("name"),
        "count",
        "min",
        "max",
        "unparseable",
        F.when(seconds <= DAY_SPAN * _DAY_SECONDS, "day").otherwise("month").alias("unit"),
    )


def date_units(g: Grid, positions, options: ProfileOptions = DEFAULT) -> dict[int, str]:
    """The bucket unit per date column, on the driver."""
    rows = date_profile(g, positions, options).select("pos", "unit").collect()
    return {r["pos"]: r["unit"] for r in rows}


def date_buckets(
    g: Grid, positions, options: ProfileOptions = DEFAULT, units: dict[int, str] | None = None
) -> DataFrame:
    """``pos, name, unit, label, n`` of the non-empty buckets; sort by label to draw them."""
    units = date_units(g, positions, options) if units is None else units
    daily = [p for p, unit in units.items() if unit == "day"]
    unit = F.when(F.col("pos").isin(*daily), "day").otherwise("month") if daily else F.lit("month")
    ts = F.col("ts")
    label = F.when(unit == "day", F.date_format(ts, FORMATS["day"])).otherwise(F.date_format(ts, FORMATS["month"]))
    # Formatting one text per cell is slow; group by the truncated instant and format last.
    bucket = F.when(unit == "day", F.date_trunc("day", ts)).otherwise(F.date_trunc("month", ts))
    counted = (
        _instants(g, positions, options)
        .select("pos", bucket.alias("ts"))
        .groupBy("pos", "ts")
        # Cells without a date form a group of their own; filtering them first would parse twice.
        .agg(F.count("ts").alias("n"))
        .filter("n > 0")
    )
    return counted.select("pos", g.name_of(F.col("pos")).alias("name"), unit.alias("unit"), label.alias("label"), "n")
