"""String grammars for numbers, dates and booleans as gated built-in casts.

Every function takes cell text and returns NULL where the text is outside the grammar.
``trimmed`` says that the text has been trimmed before.
A regular expression guards each cast, since Spark's own casts accept more (``1d``,
``NaN``, ``2026-01-05 10:00:00.5``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallygrid.functions.text import trim_cell

# Accepted spellings. ``\z`` rather than ``$``, which in Java also matches
# before a trailing line break.
GROUPED = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?([eE][+-]?\d+)?\z"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
INTEGER = r"^[+-]?\d+\z"
# The same without an exponent and with too few digits to overflow a double.
PLAIN_DECIMAL = r"^[+-]?(\d{1,300}(\.\d*)?|\.\d+)\z"
PLAIN_GROUPED = r"^[+-]?\d{1,3}(,\d{3}){1,90}(\.\d+)?\z"
NUMERIC_START = r"^[+-]?[.\d]"
PLAIN_INTEGER = r"^[+-]?\d{1,300}\z"
HEXADECIMAL = r"^0[xX]0*([0-9a-fA-F]{1,15})\z"
OCTAL = r"^0[oO]0*([0-7]{1,20})\z"
BINARY = r"^0[bB]0*([01]{1,60})\z"
YEAR_FIRST = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?\z"
YEAR_LAST = r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}\z"
YEAR_LAST_PARTS = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})\z"


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities, which would otherwise poison every aggregate."""
    return F.when(F.abs(value) < float("inf"), value)


def parse_number(cell: Column, trimmed: bool = False) -> Column:
    s = cell if trimmed else trim_cell(cell)
    plain = s.try_cast("double")
    joined = F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    # The check for overflow reads its value twice, so the usual spellings skip it.
    parsed = (
        F.when(s.rlike(PLAIN_DECIMAL), plain)
        .when(~s.rlike(NUMERIC_START), None)
        .when(s.rlike(PLAIN_GROUPED), joined)
        .when(s.rlike(DECIMAL), finite(plain))
        .when(s.rlike(GROUPED), finite(joined))
    )
    for pattern, base in ((HEXADECIMAL, 16), (OCTAL, 8), (BINARY, 2)):
        parsed = parsed.when(s.rlike(pattern), F.conv(F.regexp_extract(s, pattern, 1), base, 10).try_cast("double"))
    return parsed


def parse_integer(cell: Column, trimmed: bool = False) -> Column:
    s = cell if trimmed else trim_cell(cell)
    value = s.try_cast("double")
    return F.when(s.rlike(PLAIN_INTEGER), value).when(s.rlike(INTEGER), finite(value))


def parse_date(cell: Column, trimmed: bool = False) -> Column:
    """Year first with an optional clock; otherwise month first, then day first.

    The pattern fixes the shape and the cast checks the calendar. Years before 100 are not
    dates.
    """
    s = cell if trimmed else trim_cell(cell)

    def reordered(order: str) -> Column:
        return F.regexp_replace(s, YEAR_LAST_PARTS, order)

    def instant(text: Column) -> Column:
        return F.when(text >= "0100", text.try_cast("timestamp_ntz"))

    return F.when(s.rlike(YEAR_FIRST), instant(F.translate(s, "/", "-"))).when(
        s.rlike(YEAR_LAST), F.coalesce(instant(reordered("$3-$1-$2")), instant(reordered("$3-$2-$1")))
    )


def parse_boolean(cell: Column, trimmed: bool = False) -> Column:
    s = F.lower(cell if trimmed else trim_cell(cell))
    return F.when(s == "true", True).when(s == "false", False)
