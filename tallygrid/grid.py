"""The table every operator works on: positional cells, display names and a row order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallygrid.functions.parse import finite, parse_boolean, parse_date, parse_integer, parse_number
from tallygrid.functions.text import last_char, number_text, render_cell, timestamp_text, trim_cell

#: How a column is stored. Typed columns skip the string grammars.
STRING, INTEGRAL, DOUBLE, BOOLEAN, DATE, TIMESTAMP = "string", "integral", "double", "boolean", "date", "timestamp"


def _storage(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return INTEGRAL
    if isinstance(dtype, T.NumericType):
        return DOUBLE
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return STRING


@dataclass(frozen=True)
class Cell:
    """One cell as column expressions. ``raw`` is a stored column of kind ``storage``."""

    raw: Column
    storage: str
    #: Whether a string was trimmed in an earlier projection.
    trimmed: bool = False

    @property
    def text(self) -> Column:
        """Trimmed cell text; NULL stays NULL."""
        if self.storage == STRING:
            return self.raw if self.trimmed else trim_cell(self.raw)
        if self.storage == INTEGRAL:
            return self.raw.cast("string")
        if self.storage == DOUBLE:
            return number_text(self.raw)
        if self.storage == BOOLEAN:
            return F.when(self.raw, "TRUE").when(~self.raw, "FALSE")
        if self.storage == DATE:
            return F.date_format(self.raw, "yyyy-MM-dd")
        return timestamp_text(self.raw)

    @property
    def shown(self) -> Column:
        """Cell text as displayed: not trimmed, NULL as empty."""
        return F.coalesce(self.raw if self.storage == STRING else self.text, F.lit(""))

    @property
    def key(self) -> Column:
        """A value that is equal exactly when the cell texts are equal, cheap to group by."""
        if self.storage in (STRING, TIMESTAMP):
            return self.text
        return self.raw

    def missing(self, tokens: frozenset[str]) -> Column:
        if self.storage == STRING:
            text = F.coalesce(self.text, F.lit(""))
            # No case mapping shrinks text to less than a third of its bytes.
            longest = 3 * max((len(t.encode()) for t in tokens), default=0)
            return (F.octet_length(text) <= longest) & F.lower(text).isin("", *sorted(tokens))
        absent = self.raw.isNull()
        if self.storage == DOUBLE and "nan" in tokens:
            absent = absent | F.isnan(self.raw)
        alike = self._alike(tokens)
        return absent | F.lower(self.text).isin(*alike) if alike else absent

    def _alike(self, tokens) -> list[str]:
        """The tokens that a number, date or boolean of this storage kind could spell."""
        if self.storage == BOOLEAN:
            return sorted(t for t in tokens if t in ("true", "false"))
        endless = ("infinity", "-infinity") if self.storage == DOUBLE else ()
        return sorted(t for t in tokens if t in endless or any(ch.isdigit() for ch in t))

    def _unless(self, value: Column, tokens) -> Column:
        """``value`` with token cells set to NULL, at no cost if no token has a digit."""
        alike = self._alike(tokens)
        return F.when(~F.lower(self.text).isin(*alike), value) if alike else value

    def number_unless(self, tokens) -> Column:
        return self._unless(self.number, tokens)

    def instant_unless(self, tokens) -> Column:
        return self._unless(self.instant, tokens)

    @property
    def number(self) -> Column:
        """The finite double in the cell, or NULL. Missing tokens are not consulted."""
        if self.storage == STRING:
            return parse_number(self.raw, self.trimmed)
        if self.storage == INTEGRAL:
            return self.raw.cast("double")
        if self.storage == DOUBLE:
            return finite(self.raw)
        return F.lit(None).cast("double")

    @property
    def instant(self) -> Column:
        """The date or date-time in the cell to the second, or NULL."""
        if self.storage == STRING:
            return parse_date(self.raw, self.trimmed)
        if self.storage in (DATE, TIMESTAMP):
            value = self.raw.cast("timestamp_ntz")
            value = F.date_trunc("second", value).cast("timestamp_ntz")
            return F.when(F.year(value).between(100, 9999), value)
        return F.lit(None).cast("timestamp_ntz")

    @property
    def is_boolean(self) -> Column:
        if self.storage == STRING:
            return parse_boolean(self.raw, self.trimmed).isNotNull()
        return F.lit(self.storage == BOOLEAN)

    @property
    def is_integer(self) -> Column:
        if self.storage == STRING:
            return parse_integer(self.raw, self.trimmed).isNotNull()
        if self.storage == DOUBLE:
            # Doubles from 1e21 on print with an exponent, which is not an integer.
            return F.coalesce((F.abs(self.raw) < 1e21) & (self.raw == F.rint(self.raw)), F.lit(False))
        return F.lit(self.storage == INTEGRAL)


@dataclass(frozen=True)
class Grid:
    """Cells ``c0..cn`` plus order keys ``k0..km`` in ``frame``.

    Internal names are positional because display names may repeat or differ only in case.
    ``distinct_order`` says that no two rows share an order key. ``by_file`` says that the
    keys are a file path and the row's place in that file, so positions need no sort.
    """

    frame: DataFrame
    names: tuple[str, ...]
    storage: tuple[str, ...]
    order: tuple[str, ...] = ()
    distinct_order: bool = False
    by_file: bool = False
    #: Whether the order keys hold every cell, so that rows with equal keys are copies.
    keys_cover_cells: bool = False
    #: Whether all keys but the last take few values, as files and their blocks do, and the
    #: last one is a number.
    nested_order: bool = False

    @property
    def width(self) -> int:
        return len(self.names)

    def cell(self, pos: int) -> Cell:
        return Cell(F.col(f"c{pos}"), self.storage[pos])

    def cells(self) -> list[Cell]:
        return [self.cell(p) for p in range(self.width)]

    def require_order(self) -> list[str]:
        if not self.order:
            raise ValueError("this operation depends on row order: pass order_by=")
        return list(self.order)

    def name_of(self, pos: Column) -> Column:
        """Display name of a position column: a lookup in a literal array."""
        if not self.names:
            return F.lit(None).cast("string")
        return F.get(F.array(*map(F.lit, self.names)), pos)

    def with_frame(self, frame: DataFrame) -> Grid:
        return replace(self, frame=frame)

    def _trimmed(self, positions: Sequence[int], keep: Sequence[Column] = ()) -> tuple[DataFrame, dict[int, Cell]]:
        """The cells with strings trimmed, in a projection of its own: expressions on a cell
        read it several times, and this way they all share one trimming."""
        kept = [f"_keep{i}" for i in range(len(keep))]
        keep = [k.alias(n) for k, n in zip(keep, kept)]
        text = [p for p in positions if self.storage[p] == STRING]
        cells = [f"c{p}" for p in positions]
        frame = self.frame.select(*keep, *cells, *(last_char(F.col(f"c{p}")).alias(f"e{p}") for p in text))
        trimmed = {p: trim_cell(F.col(f"c{p}"), F.col(f"e{p}")).alias(f"c{p}") for p in text}
        frame = frame.select(*kept, *(trimmed.get(p, F.col(f"c{p}")) for p in positions))
        return frame, {p: Cell(F.col(f"c{p}"), self.storage[p], True) for p in positions}

    def numbers(self, positions: Sequence[int], tokens: frozenset[str] | None) -> DataFrame:
        """Finite doubles ``n<pos>``; NULL where missing or not a number.

        ``tokens=None`` leaves the missing-value tokens out of it.
        """
        frame, cells = self._trimmed(positions)
        return frame.select(*(c.number_unless(tokens or ()).alias(f"n{p}") for p, c in cells.items()))

    def missing_flags(self, tokens: frozenset[str], positions: Sequence[int], keep: Sequence[Column] = ()) -> DataFrame:
        """Booleans ``m<pos>``, after the columns ``keep`` as ``_keep0``, ``_keep1`` and so on."""
        frame, cells = self._trimmed(positions, keep)
        return frame.select(*frame.columns[: len(keep)], *(c.missing(tokens).alias(f"m{p}") for p, c in cells.items()))

    def long(self, positions: Sequence[int], fields: dict, keep: Sequence[str] = ()) -> DataFrame:
        """One row per cell: ``pos`` plus each of ``fields`` (name -> function of a Cell)."""
        return union([part for _, part in self.long_parts(positions, fields, keep)])

    def long_parts(self, positions: Sequence[int], fields: dict, keep: Sequence[str] = ()):
        """The parts of :meth:`long`, as ``(storage, frame)`` per storage kind.

        Cells of one kind are unpivoted raw and the expressions applied afterwards, so the
        generated code does not grow with the number of columns, and each part scans only
        its own columns.
        """
        for storage, group in self._by_storage(positions).items():
            pairs = []
            for p in group:
                raw = F.col(f"c{p}")
                pairs += [F.lit(p), raw.cast("bigint") if storage == INTEGRAL else raw]
            raw = self.frame.select(*keep, F.stack(F.lit(len(group)), *pairs).alias("pos", "raw"))
            kind = storage.split(":")[0]
            if kind == STRING:
                raw = raw.select(*keep, "pos", "raw", last_char(F.col("raw")).alias("last"))
                raw = raw.select(*keep, "pos", trim_cell(F.col("raw"), F.col("last")).alias("raw"))
            cell = Cell(F.col("raw"), kind, True)
            yield kind, raw.select(*keep, "pos", *(make(cell).alias(name) for name, make in fields.items()))

    def _by_storage(self, positions: Sequence[int]) -> dict[str, list[int]]:
        groups: dict[str, list[int]] = {}
        for p in positions:
            key = self.storage[p]
            if key == TIMESTAMP:
                # NTZ and zoned timestamps do not mix in one unpivot.
                key = f"{key}:{self.frame.schema[f'c{p}'].dataType.simpleString()}"
            groups.setdefault(key, []).append(p)
        return groups


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out, *rest = parts
    for part in rest:
        out = out.unionByName(part)
    return out


def grid(
    df: DataFrame,
    order_by: Sequence[str] = (),
    *,
    distinct_order: bool = False,
    by_file: bool = False,
    columns: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> Grid:
    """View any DataFrame as a grid.

    ``order_by`` names the columns that define row order; rows with equal keys are ordered
    by nothing else, so use a unique key where order matters and pass ``distinct_order=True``
    if it is known to be one (saves a shuffle). ``by_file=True`` takes the rows of a parquet
    table in stored order instead: files by path, rows by their place in the file.
    """
    # Names may repeat or differ only in case, so the input is addressed by position.
    fields = df.schema.fields
    if by_file:
        place = [F.col("_metadata.file_path").alias("k0"), F.col("_metadata.row_index").alias("k1")]
        plain = df.select(*place, "*").toDF("k0", "k1", *(f"u{i}" for i in range(len(fields))))
    else:
        plain = df.toDF(*(f"u{i}" for i in range(len(fields))))
    index = {f.name: i for i, f in reversed(list(enumerate(fields)))}
    picked = range(len(fields)) if columns is None else [index[c] for c in columns]
    cells, storage = [], []
    for p, i in enumerate(picked):
        dtype = fields[i].dataType
        kind = _storage(dtype)
        raw = F.col(f"u{i}")
        if kind == STRING and not isinstance(dtype, T.StringType):
            raw = render_cell(raw, dtype)
        elif kind == DOUBLE:
            raw = raw.cast("double")
        cells.append(raw.alias(f"c{p}"))
        storage.append(kind)
    if by_file:
        keys = [F.col("k0"), F.col("k1")]
    else:
        keys = [F.col(f"u{index[name]}").alias(f"k{i}") for i, name in enumerate(order_by)]
    return Grid(
        plain.select(*keys, *cells),
        tuple(names if names is not None else (fields[i].name for i in picked)),
        tuple(storage),
        tuple(f"k{i}" for i in range(len(keys))),
        distinct_order or by_file,
        by_file,
        set(picked) <= {index[name] for name in order_by},
        by_file,
    )

