"""Row previews and pages in the declared row order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.grid import Grid
from tallygrid.operators.missing import mask_missing
from tallygrid.operators.order import keyed, row_range
from tallygrid.options import DEFAULT, PAGE_SIZE, ProfileOptions

#: Pages ending beyond this row are found by key position instead of a top-n heap.
DEEP_PAGE = 20_000


def preview(g: Grid, options: ProfileOptions = DEFAULT) -> DataFrame:
    """The first ``options.preview_rows`` rows as stored."""
    frame, keys = keyed(g)
    first = frame.orderBy(*keys).limit(max(0, options.preview_rows))
    return first.select(*(g.cell(p).shown.alias(f"c{p}") for p in range(g.width)))


def rows(g: Grid, offset: int, limit: int, deep: int = DEEP_PAGE) -> DataFrame:
    """``rid, c0..cn`` for the rows at ``offset .. offset+limit-1``; empty past the end.

    A page near the start is a top-n over the table. For one deep inside, only the order keys
    are sorted and the page's rows are fetched by key. Both come in row order.
    """
    frame, keys = keyed(g)
    cells = [f"c{p}" for p in range(g.width)]
    if limit <= 0:
        return g.frame.limit(0).select(F.lit(0).cast("bigint").alias("rid"), *cells)
    if offset + limit > deep:
        return row_range(g, offset, limit).select("rid", *cells).orderBy("rid")
    shown = frame.orderBy(*keys).offset(offset).limit(limit)
    # At most ``limit`` rows are numbered.
    rid = F.row_number().over(Window.orderBy(*keys)) - 1 + F.lit(offset)
    return shown.select(rid.cast("bigint").alias("rid"), *cells)


def page(g: Grid, number: int, options: ProfileOptions = DEFAULT, masked: bool = True) -> DataFrame:
    """Page ``number`` (from 0) of 50 rows, missing cells marked."""
    shown = rows(g, number * PAGE_SIZE, PAGE_SIZE)
    return mask_missing(g, shown, options) if masked else shown


def page_info(total_rows: int, number: int) -> dict[str, int]:
    last = max(0, math.ceil(total_rows / PAGE_SIZE) - 1)
    current = min(max(0, number), last)
    return {"page": current, "last_page": last, "offset": current * PAGE_SIZE, "total_rows": total_rows}
