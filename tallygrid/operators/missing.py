"""Missing cells: counts, rates, row patterns and the sampled missingness map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.display import MISSING_MARK
from tallygrid.grid import Grid, union
from tallygrid.operators.order import spaced_rows
from tallygrid.options import DEFAULT, ProfileOptions
from tallygrid.session import freeze

# Bounds of the severity bands and of the warning, in percent.
SEVERE_PCT, ELEVATED_PCT, WARN_TOTAL_PCT = 50, 10, 20

_COLUMNS_PER_AGG = 60


def missing_by_column(g: Grid, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``pos, name, n_rows, missing, missing_pct`` (a fraction; 0 without rows)."""
    parts = []
    for start in range(0, g.width, _COLUMNS_PER_AGG):
        group = range(start, min(start + _COLUMNS_PER_AGG, g.width))
        counts = [F.count_if(f"m{p}").alias(f"m{p}") for p in group]
        wide = g.missing_flags(options.tokens, group).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
        pairs = [x for p in group for x in (F.lit(p), F.col(f"m{p}"))]
        parts.append(wide.select("n_rows", F.stack(F.lit(len(group)), *pairs).alias("pos", "missing")))
    return union(parts).select(
        "pos", g.name_of(F.col("pos")).alias("name"), "n_rows", "missing", _fraction("missing", "n_rows").alias("missing_pct")
    )


def _fraction(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def missing_summary(g: Grid, options: ProfileOptions = DEFAULT) -> DataFrame:
    """One row: cells, missing cells and rate, complete rows, rows with any missing cell."""
    words = []
    for start in range(0, g.width, _COLUMNS_PER_AGG):
        word = F.lit(0).cast("bigint")
        for p in range(start, min(start + _COLUMNS_PER_AGG, g.width)):
            word = word + F.col(f"m{p}").cast("bigint")
        words.append(word)
    per_row = sum(words, F.lit(0).cast("bigint"))
    counted = g.missing_flags(options.tokens, range(g.width)).select(per_row.alias("m")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing_cells"),
        F.count_if(F.col("m") == 0).alias("complete_rows"),
    )
    return counted.select(
        "n_rows",
        (F.col("n_rows") * g.width).alias("total_cells"),
        "missing_cells",
        F.coalesce(F.try_divide(F.col("missing_cells").cast("double"), F.col("n_rows") * g.width), F.lit(0.0)).alias("missing_pct"),
        "complete_rows",
        (F.col("n_rows") - F.col("complete_rows")).alias("any_missing_rows"),
    )


def missing_rank(g: Grid, options: ProfileOptions = DEFAULT, top: int | None = None) -> DataFrame:
    """Columns by missing rate, highest first; ties keep column order. All columns unless ``top`` is given."""
    counts = missing_by_column(g, options)
    # One row per column, so this window is small.
    order = Window.orderBy(F.desc("missing_pct"), "pos")
    ranked = counts.select(
        F.row_number().over(order).alias("rank"),
        "pos",
        "name",
        "missing",
        "missing_pct",
        F.round(F.col("missing_pct") * 100, 2).alias("pct"),
    )
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def severity(pct: Column) -> Column:
    """Band of a column's missing percentage."""
    return F.when(pct > SEVERE_PCT, "severe").when(pct > ELEVATED_PCT, "elevated").otherwise("normal")


def warns(fraction: Column) -> Column:
    """Whether a table's overall missing rate deserves a warning."""
    return fraction > WARN_TOTAL_PCT / 100


def missing_patterns(
    g: Grid, options: ProfileOptions = DEFAULT, top: int | None = None, rows: int | None = None
) -> DataFrame:
    """Which columns are missing together, most frequent first: ``rank, columns, n, pct``.

    Complete rows are left out; equal counts are ordered by the first row that shows the
    pattern. Rows group by bit masks (one bigint per 60 columns), so the shuffle carries one
    small row per task and pattern, and only ``top`` rows are ever sorted together.
    """
    keys = g.require_order()
    rows = g.frame.count() if rows is None else rows
    # The minimum of a number aggregates by hash, that of text or of several keys by sort. So
    # where files and blocks lead the order, rows meet per block first.
    outer = keys[:-1] if g.nested_order else []
    inner = [k for k in keys if k not in outer]
    at = F.col(inner[0]) if len(inner) == 1 else F.struct(*inner)
    words, names = [], []
    for start in range(0, g.width, _COLUMNS_PER_AGG):
        word = F.lit(0).cast("bigint")
        for bit, p in enumerate(range(start, min(start + _COLUMNS_PER_AGG, g.width))):
            word = word.bitwiseOR(F.when(F.col(f"m{p}"), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
        names.append(f"w{len(words)}")
        words.append(word.alias(names[-1]))
    absent = [
        F.when(F.col(names[p // _COLUMNS_PER_AGG]).bitwiseAND(F.lit(1 << (p % _COLUMNS_PER_AGG))) != 0, F.lit(name))
        for p, name in enumerate(g.names)
    ]
    flags = g.missing_flags(options.tokens, range(g.width), [at, *map(F.col, outer)])
    kept = [F.col(f"_keep{i}").alias(k) for i, k in enumerate(["at", *outer])]
    grouped = flags.select(*kept, *words).groupBy(*names, *outer).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    if outer:
        first = F.min(F.struct(*outer, "at"))
        grouped = grouped.groupBy(*names).agg(F.sum("n").alias("n"), first.alias("at"))
    # A filter on the masks would be pushed below the grouping and compute them twice.
    missing_somewhere = F.when(F.col("n") > 0, sum(map(F.col, names), F.lit(0))) > 0
    top = options.top_patterns if top is None else top
    found = (
        grouped.withColumnRenamed("at", "first_at")
        .filter(missing_somewhere)
        .orderBy(F.desc("n"), "first_at", *names)
    )
    best = found if top is None else found.limit(top)
    place = Window.orderBy(F.desc("n"), "first_at", *names)
    return best.select(
        F.row_number().over(place).alias("rank"),
        F.array_compact(F.array(*absent)).alias("columns"),
        "n",
        (F.col("n") / F.lit(float(rows or 1))).alias("pct"),
    )


def missing_map(g: Grid, options: ProfileOptions = DEFAULT, rows: int | None = None) -> DataFrame:
    """Missing or not for up to ``options.heatmap_rows`` evenly spaced rows.

    ``sample_pos, rid, col_pos, pos, name, is_missing, sampled``; columns come in order of
    their missing rate, highest first.
    """
    g.require_order()
    rows = g.frame.count() if rows is None else rows
    wanted = options.heatmap_rows
    sampled = rows > wanted
    if rows == 0 or g.width == 0:
        rows, wanted = 1, 1
    sample = freeze(spaced_rows(g, rows, (rows, wanted) if sampled else (1, 1), wanted if sampled else rows))
    pairs = []
    for p in range(g.width):
        pairs += [F.lit(p), g.cell(p).missing(options.tokens)]
    cells = sample.select("rid", F.stack(F.lit(g.width), *pairs).alias("pos", "is_missing"))
    ranks = missing_rank(g, options).select("pos", "name", (F.col("rank") - 1).alias("col_pos"))
    # At most heatmap_rows distinct positions, so numbering them is small work.
    numbered = sample.select("rid", (F.row_number().over(Window.orderBy("rid")) - 1).alias("sample_pos"))
    return (
        cells.join(F.broadcast(ranks), "pos")
        .join(F.broadcast(numbered), "rid")
        .select("sample_pos", "rid", "col_pos", "pos", "name", "is_missing", F.lit(sampled).alias("sampled"))
    )


def mask_missing(g: Grid, rows: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """Cells as text, missing ones replaced by a mark."""
    keep = [c for c in rows.columns if not (c.startswith("c") and c[1:].isdigit())]
    shown = [
        F.when(g.cell(p).missing(options.tokens), MISSING_MARK).otherwise(g.cell(p).shown).alias(f"c{p}")
        for p in range(g.width)
    ]
    return rows.select(*keep, *shown)
