"""Profile options and missing-value tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The default missing-value tokens and the default sizes.
DEFAULT_MISSING_TOKENS = (
    "",
    "NA",
    "N/A",
    "NULL",
    "NaN",
    "nan",
    "None",
    "missing",
    "unknown",
    "-",
    "?",
    "未知",
    "缺",
    "缺失",
    "無",
)
HEATMAP_ROWS = 300
PREVIEW_ROWS = 200
PAGE_SIZE = 50
TOP_CATEGORIES = 500
TOP_PATTERNS = 12
TYPE_SAMPLE = 2_000
TYPE_THRESHOLD = 0.9
LOW_CARDINALITY = 50
# Code points treated as white space by cell trimming.
BLANKS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def token_set(tokens) -> frozenset[str]:
    """Tokens as they are compared with cells: trimmed, lower case, none blank."""
    cleaned = (t.strip(BLANKS).lower() for t in tokens)
    return frozenset(t for t in cleaned if t)


def parse_tokens(text: str) -> list[str]:
    """A user's token list, one per line or separated by commas. Blank is always a token."""
    parts = (p.strip(BLANKS) for p in re.split("[\n,，]", text))
    return ["", *(p for p in parts if p)]


@dataclass(frozen=True)
class ProfileOptions:
    missing_tokens: tuple[str, ...] = DEFAULT_MISSING_TOKENS
    heatmap_rows: int = HEATMAP_ROWS
    preview_rows: int = PREVIEW_ROWS
    #: "unicode" orders equal counts by the Unicode collation, "binary" by code point.
    tie: str = "unicode"
    #: Rows of results that list the first ones only; None lists all.
    top_patterns: int | None = TOP_PATTERNS
    top_categories: int | None = TOP_CATEGORIES
    missing_rank_columns: int | None = 40
    report_distributions: int | None = 24
    #: Limits of what is computed or reported; None, the default, is no limit. A distinct count
    #: above ``unique_cap`` is reported as one more than it, with a flag.
    max_correlation_columns: int | None = None
    unique_cap: int | None = None
    category_cap: int | None = None
    tokens: frozenset[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "missing_tokens", tuple(self.missing_tokens))
        object.__setattr__(self, "tokens", token_set(self.missing_tokens))


DEFAULT = ProfileOptions()
