"""What a source reports about itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallygrid.grid import Grid


@dataclass(frozen=True)
class Source:
    """A grid together with where it came from. ``kind`` is csv, excel, text or database."""

    grid: Grid
    name: str
    kind: str
    encoding: str | None = None
    sheets: tuple[str, ...] | None = None
    active_sheet: str | None = None

    def info(self) -> DataFrame:
        """One row of metadata with row and column counts."""
        schema = (
            "name string, kind string, encoding string, sheets array<string>, active_sheet string, "
            "row_count bigint, column_count int"
        )
        sheets = None if self.sheets is None else list(self.sheets)
        row = (self.name, self.kind, self.encoding, sheets, self.active_sheet, self.grid.frame.count(), self.grid.width)
        return self.grid.frame.sparkSession.createDataFrame([row], schema)


def from_frame(g: Grid, name: str) -> Source:
    """A table that is already loaded."""
    return Source(g, name, "database")
