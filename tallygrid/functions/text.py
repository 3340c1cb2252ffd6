"""Cell trimming, rendering of typed cells as text, quoting and shortening."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tallygrid.options import BLANKS


def last_char(cell: Column) -> Column:
    return F.right(cell, F.lit(1))


def _no_blank(text: Column) -> Column:
    """Whether text surely starts with no blank: from ``!`` to ``~``, or beyond U+3000 and
    before U+FEFF. Comparing whole strings compares their first characters first."""
    return ((text >= "!") & (text < "\x7f")) | ((text >= "\u3001") & (text < "\ufeff"))


def trim_cell(cell: Column, last: Column | None = None) -> Column:
    """Strip all Unicode blanks of the profiler (SQL ``trim`` strips U+0020 only).

    Searching a set of blanks at both ends is slow, so cells that start and end with an
    ordinary character are passed through. ``last`` is the cell's last character where an
    earlier projection holds it.
    """
    clean = _no_blank(cell) & _no_blank(last_char(cell) if last is None else last)
    return F.when(clean, cell).otherwise(F.btrim(cell, F.lit(BLANKS)))


def number_text(value: Column) -> Column:
    """A double the way a spreadsheet user sees it: ``23``, ``0.05``, ``12345678.5``, ``1e+21``.

    Spark prints ``23.0``, ``1.23456785E7`` and ``5.0E-4`` for such values.
    """
    raw = value.cast("string")
    size = F.abs(value)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(raw, r"E.*$|[-.]", ""), r"0+$", "")
    large = F.concat(sign, F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(\d)", "e+$1")
    return (
        F.when(F.isnan(value), "NaN")
        .when(size == float("inf"), F.concat(sign, F.lit("Infinity")))
        .when((size < 2.0**53) & (value == F.floor(value)), F.floor(value).cast("string"))
        .when((size >= 2.0**53) & (size < 1e21), F.format_string("%.0f", value))
        .when(~F.contains(raw, F.lit("E")), raw)
        .when((size >= 1e7) & (size < 1e21), large)
        .when((size >= 1e-6) & (size < 1e-3), small)
        .otherwise(F.replace(scientific, F.lit("E"), F.lit("e")))
    )


def timestamp_text(value: Column) -> Column:
    """Midnight prints as a date, other instants to the second."""
    midnight = value.cast("timestamp_ntz") == F.date_trunc("day", value).cast("timestamp_ntz")
    to_second = F.date_trunc("second", value)
    return F.when(
        midnight | (F.date_format(to_second, "HH:mm:ss") == "00:00:00"), F.date_format(value, "yyyy-MM-dd")
    ).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))


def render_cell(cell: Column, dtype: T.DataType) -> Column:
    """Any typed cell as text. NULL becomes the empty string."""
    if isinstance(dtype, T.StringType):
        text = cell
    elif isinstance(dtype, T.BooleanType):
        text = F.when(cell, "TRUE").otherwise(F.when(~cell, "FALSE"))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("<BLOB "), F.octet_length(cell).cast("string"), F.lit(" bytes>"))
    elif isinstance(dtype, T.DateType):
        text = F.date_format(cell, "yyyy-MM-dd")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = timestamp_text(cell)
    elif isinstance(dtype, T.IntegralType):
        text = cell.cast("string")
    elif isinstance(dtype, T.NumericType):
        text = number_text(cell.cast("double"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(cell)
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(""))


def shorten(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("…"))).otherwise(text)


def csv_quote(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)
