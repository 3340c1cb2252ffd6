"""Report tables and the column statistics export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.functions.display import (
    BLANK_VALUE,
    NO_VALUE,
    fmt_datetime,
    fmt_fixed,
    fmt_int,
    fmt_number,
    fmt_pct,
    fmt_precision,
    range_label,
    type_label,
)
from tallygrid.functions.text import csv_quote, shorten
from tallygrid.operators import correlation, infer, missing
from tallygrid.plans.profile import Profile

# The export header and the limits of the report.
STATS_HEADER = (
    "#", "欄位", "型別", "缺失數", "缺失率%", "不重複值", "平均數",
    "中位數", "標準差", "最小值", "最大值", "類別數", "最高類別",
)
CHART_CATEGORIES = 15
TABLE_CATEGORIES = 5
CHART_LABEL = 14
OVERVIEW_LABEL = 16


def _shapes(p: Profile) -> dict[int, str]:
    """What each column's distribution is drawn as, by position; columns without one are left out."""
    shapes = {pos: "category" for pos in p.category_columns}
    shapes |= {pos: "date" for pos in p.date_units}
    shapes |= {pos: "numeric" for pos in p.summaries}
    return dict(sorted(shapes.items()))


def distributions(p: Profile) -> DataFrame:
    """``pos, name, type, shape``: the columns that have a distribution to show, with the shape of their type's label."""
    # The label is the sample's, whatever the column is drawn as.
    shapes = {pos: "category" if p.types[pos] in infer.OTHER else shape for pos, shape in _shapes(p).items()}
    listed = p.grid.frame.sparkSession.range(p.grid.width, numPartitions=1).select(F.col("id").cast("int").alias("pos"))
    pos = F.col("pos")
    return listed.filter(pos.isin(*shapes)).select(
        "pos",
        p.grid.name_of(pos).alias("name"),
        F.get(F.array(*map(F.lit, p.types)), pos).alias("type"),
        F.get(F.array(*(F.lit(shapes.get(i, "")) for i in range(p.grid.width))), pos).alias("shape"),
    )


def column_overview(p: Profile) -> DataFrame:
    """One display row per column, with a one-line summary."""
    unit = F.when(F.col("unit") == "day", "日").otherwise("月")
    summary = (
        F.when(
            F.col("count").isNotNull(),
            F.concat(F.lit("平均 "), fmt_number(F.col("mean")), F.lit("、中位數 "), fmt_number(F.col("median"))),
        )
        .when(F.col("date_count").isNotNull(), F.concat(F.col("buckets").cast("string"), F.lit(" 個"), unit, F.lit("區間")))
        .when(
            F.col("top_n").isNotNull(),
            F.concat(F.lit("最多：「"), shorten(F.col("top_value"), OVERVIEW_LABEL), F.lit("」("), fmt_int(F.col("top_n")), F.lit(")")),
        )
        .otherwise(NO_VALUE)
    )
    bound = F.when(F.col("unique_truncated"), "≥").otherwise("")
    return p.columns.select(
        (F.col("pos") + 1).alias("no"),
        "name",
        type_label(F.col("type")).alias("type"),
        fmt_int(F.col("missing")).alias("missing"),
        fmt_pct(F.col("missing_pct")).alias("missing_pct"),
        F.concat(bound, fmt_int(F.col("unique"))).alias("unique"),
        summary.alias("summary"),
    )


def column_stats(p: Profile) -> DataFrame:
    """The export, one row of text fields per column, in column order."""

    def number(name: str) -> Column:
        return F.coalesce(fmt_precision(F.col(name)), F.lit(""))

    fields = (
        (F.col("pos") + 1).cast("string"),
        csv_quote(F.col("name")),
        F.col("type"),
        F.col("missing").cast("string"),
        fmt_fixed(F.col("missing_pct") * 100.0, 2),
        F.col("unique").cast("string"),
        number("mean"),
        number("median"),
        number("std"),
        number("min"),
        number("max"),
        F.coalesce(F.col("cardinality").cast("string"), F.lit("")),
        F.coalesce(csv_quote(F.col("top_value")), F.lit("")),
    )
    return p.columns.orderBy("pos").select(*(f.alias(n) for f, n in zip(fields, STATS_HEADER)))


def column_stats_lines(p: Profile) -> DataFrame:
    """``value``: the export's lines, header first, the first one with a byte order mark."""
    rows = column_stats(p)
    line = F.concat_ws(",", *(F.col(f"`{n}`") for n in STATS_HEADER))
    body = rows.select(F.col("`#`").cast("int").alias("no"), line.alias("value"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("no"), F.lit("﻿" + ",".join(STATS_HEADER)).alias("value"))
    return head.unionByName(body).orderBy("no").select("value")


def write_column_stats(p: Profile, path: str) -> None:
    """Write the export as one CRLF text file; it has one line per column of the table."""
    column_stats_lines(p).coalesce(1).write.option("lineSep", "\r\n").text(path)


def _picked(p: Profile, frame: DataFrame | None, shape: str | None = None) -> DataFrame | None:
    """Rows of ``frame`` for the first columns that have a distribution, of one shape if given."""
    if frame is None:
        return None
    shown = list(_shapes(p).items())[: p.options.report_distributions]
    named = frame.withColumn("name", p.grid.name_of(F.col("pos")))
    return named.filter(F.col("pos").isin(*(pos for pos, s in shown if shape in (None, s))))


def _distributions(p: Profile) -> DataFrame:
    return _picked(p, distributions(p))


def _summary(p: Profile) -> DataFrame:
    counts = ("total_cells", "missing_cells", "complete_rows", "any_missing_rows")
    return p.missing_summary.select(
        fmt_int(F.col("n_rows")).alias("rows"),
        fmt_int(F.lit(p.grid.width)).alias("columns"),
        *(fmt_int(F.col(c)).alias(c) for c in counts),
        fmt_pct(F.col("missing_pct")).alias("missing_pct"),
    )


def _columns(p: Profile) -> DataFrame:
    return p.columns.select(
        (F.col("pos") + 1).alias("no"),
        "name",
        type_label(F.col("type")).alias("type"),
        fmt_int(F.col("missing")).alias("missing"),
        fmt_pct(F.col("missing_pct")).alias("missing_pct"),
        fmt_int(F.col("unique")).alias("unique"),
    )


def _missing_rates(p: Profile) -> DataFrame:
    return missing.missing_rank(p.grid, p.options, p.options.missing_rank_columns).select("rank", "name", "pct")


def _missing_map(p: Profile) -> DataFrame | None:
    return None if p.missing_map is None else p.missing_map.filter("is_missing").select("rid", "col_pos", "name")


def _patterns(p: Profile) -> DataFrame:
    names = F.concat_ws("、", "columns").alias("columns")
    return p.patterns.select("rank", names, fmt_int(F.col("n")).alias("n"), fmt_pct(F.col("pct")).alias("pct"))


def _numeric(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.numeric, "numeric")
    if shown is None:
        return None
    stats = ("mean", "std", "median", "min", "q1", "q3", "max", "skew", "kurt")
    counts = ("count", "iqr_outliers", "z_outliers")
    return shown.select(
        "pos", "name", *(fmt_int(F.col(c)).alias(c) for c in counts), *(fmt_number(F.col(c)).alias(c) for c in stats)
    )


def _histograms(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.histograms, "numeric")
    label = range_label(F.col("lo"), F.col("hi")).alias("label")
    return None if shown is None else shown.select("pos", "name", "bin", label, "n")


def _dates(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.dates, "date")
    if shown is None:
        return None
    counts = ("count", "unparseable")
    return shown.select(
        "pos",
        "name",
        *(fmt_int(F.col(c)).alias(c) for c in counts),
        fmt_datetime(F.col("min")).alias("first"),
        fmt_datetime(F.col("max")).alias("last"),
        "unit",
    )


def _date_series(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.date_buckets, "date")
    return None if shown is None else shown.select("pos", "name", "label", "n")


def _category_series(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.top_categories, "category")
    label = shorten(F.col("value"), CHART_LABEL).alias("label")
    return None if shown is None else shown.filter(F.col("rank") <= CHART_CATEGORIES).select("pos", "name", "rank", label, "n")


def _category_tables(p: Profile) -> DataFrame | None:
    shown = _picked(p, p.top_categories, "category")
    if shown is None:
        return None
    top = shown.filter(F.col("rank") <= TABLE_CATEGORIES)
    value = F.when(F.col("value") == "", BLANK_VALUE).otherwise(F.col("value")).alias("value")
    return top.select("pos", "name", "rank", value, fmt_int(F.col("n")).alias("n"))


def _pearson(p: Profile) -> DataFrame | None:
    if p.pearson is None:
        return None
    cells = correlation.full_matrix(p.grid, p.candidates.positions, p.pearson)
    return cells.filter(F.col("r").isNotNull()).select("a", "b", F.col("shown").alias("r"))


#: Tables and chart series by section. A numeric column shows its histogram, not its values.
SECTIONS = {
    "summary": _summary,
    "columns": _columns,
    "missing_rates": _missing_rates,
    "missing_map": _missing_map,
    "patterns": _patterns,
    "distributions": _distributions,
    "numeric": _numeric,
    "histograms": _histograms,
    "dates": _dates,
    "date_series": _date_series,
    "category_series": _category_series,
    "category_tables": _category_tables,
    "pearson": _pearson,
}


def report_section(p: Profile, name: str) -> DataFrame | None:
    """One section of the report; None if the table has nothing to show in it."""
    return SECTIONS[name](p)


def report_sections(p: Profile) -> dict[str, DataFrame]:
    """All sections of the report that the table has something to show in."""
    made = {name: make(p) for name, make in SECTIONS.items()}
    return {name: frame for name, frame in made.items() if frame is not None}


def write_report(p: Profile, path: str) -> None:
    """Write each section below ``path`` as parquet."""
    for name, frame in report_sections(p).items():
        frame.write.parquet(f"{path}/{name}")
