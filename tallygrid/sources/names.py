"""Column names read from a header row."""

from __future__ import annotations

from collections import Counter

from tallygrid.options import BLANKS

# Names given to columns without one.
UNNAMED = "(未命名)"


def extra_name(number: int) -> str:
    return f"(欄 {number})"


def dedupe_names(names) -> list[str]:
    """Trimmed names; repeats get `` (2)``, `` (3)`` in order of appearance."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        base = (name or "").strip(BLANKS) or UNNAMED
        seen[base] += 1
        out.append(base if seen[base] == 1 else f"{base} ({seen[base]})")
    return out
