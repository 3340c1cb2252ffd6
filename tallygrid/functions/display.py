"""Number, percentage and date formats of the report tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels of the inferred types and of correlation strength.
TYPE_LABELS = {"integer": "整數", "number": "數值", "date": "日期", "boolean": "布林", "text": "文字"}
STRENGTHS = ((0.8, "極強"), (0.6, "強"), (0.4, "中等"), (0.2, "弱"))
WEAKEST = "極弱"
NO_VALUE = "—"
MISSING_MARK = "∅"
BLANK_VALUE = "(空白)"


def _exponent_text(text: Column) -> Column:
    """``1.5e-07`` as ``1.5e-7``."""
    return F.regexp_replace(text, r"e([+-])0(\d)$", "e$1$2")


def fmt_int(value: Column) -> Column:
    return F.format_number(F.floor(value + F.lit(0.5)), 0)


def fmt_pct(fraction: Column, digits: int = 1) -> Column:
    return F.when(fraction.isNotNull(), F.format_string(f"%.{digits}f%%", fraction * 100.0))


def fmt_fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def fmt_number(value: Column) -> Column:
    """Grouped digits; fewer decimals the larger the value; exponents at both extremes."""

    def decimals(digits: int) -> Column:
        return F.regexp_replace(F.format_number(F.round(value, digits), digits), r"\.?0+$", "")

    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value) | (size == float("inf")), NO_VALUE)
        .when(value == 0, "0")
        .when((size >= 1e12) | (size < 1e-4), _exponent_text(F.format_string("%.3e", value)))
        .when(value == F.floor(value), F.format_number(value, 0))
        .when(size >= 1000, decimals(2))
        .when(size >= 1, decimals(4))
        .otherwise(decimals(6))
    )


def fmt_precision(value: Column, digits: int = 8) -> Column:
    """``digits`` significant digits, plain between 1e-6 and 1e``digits``."""
    scientific = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.lit(None).cast("string")
    for e in range(-6, digits):
        plain = F.when(exponent == e, F.format_string(f"%.{digits - 1 - e}f", value)).otherwise(plain)
    text = F.when(value == 0, "0." + "0" * (digits - 1)).otherwise(F.coalesce(plain, _exponent_text(scientific)))
    # format_string prints NULL as a word.
    return F.when(value.isNotNull(), text)


def fmt_datetime(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm")


def type_label(kind: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in TYPE_LABELS.items():
        label = F.when(kind == name, text).otherwise(label)
    return label


def strength(r: Column) -> Column:
    label = F.when(F.abs(r) >= STRENGTHS[0][0], STRENGTHS[0][1])
    for bound, text in STRENGTHS[1:]:
        label = label.when(F.abs(r) >= bound, text)
    return label.otherwise(WEAKEST)


def range_label(low: Column, high: Column) -> Column:
    return F.concat(fmt_number(low), F.lit(" ~ "), fmt_number(high))
