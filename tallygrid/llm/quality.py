"""Quality rules by repetition coverage.

Per whole text, rolling hashes of several n-gram lengths measure, in numpy, how many of its
characters lie inside n-grams or lines that the text repeats. A text is kept if it passes
two base rules (at least 50 words; at most half of its words in a repeated window of three)
and if no coverage exceeds its limit.

Words are runs of characters outside U+0020 and U+0009..U+000D. Defined results: a null or
blank text has no words, fails the base rule and is not kept; a text shorter than an n-gram
covers nothing for it; null ids pass through; repeated rows are judged one by one; an empty
table gives an empty table. Only the named id and text columns are read, so other columns
cannot clash. A text of any length is judged whole; a task holds one block of about
1 MB of texts, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks, of_text, prefix_hash, rolling, runs, spaces, span_hash

# Published limits (0.20 to 0.16, 0.15 to 0.10) reject short clean texts that hold one license
# line twice, so these are wider; texts made of repetition reach 0.8 and more.
#: Largest share of characters inside the most frequent n-gram (if it occurs twice), by n.
TOP_LIMITS = {2: 0.30, 3: 0.27, 4: 0.24}
#: Largest share of characters inside any repeated n-gram, by n.
REPEAT_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of characters in lines that equal an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_chars long, "
    + ", ".join([f"top_{n}_chars long" for n in TOP_LIMITS] + [f"repeat_{n}_chars long" for n in REPEAT_LIMITS])
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts, values, minlength=n).astype(np.int64)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each key, counts of the groups, and one place of each group."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return group, np.diff(np.append(heads, len(keys))), order[heads]


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram that begins at one of ``at``."""
    edge = np.zeros(words + 1, np.int8)
    edge[at] = 1  # n-grams begin at different words
    edge[at + n] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of each text of a block."""
    n = len(offsets) - 1
    blank = spaces(data)
    starts, ends, texts = runs(~blank, offsets)
    prefix = prefix_hash(data)
    words = span_hash(prefix, starts, ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out = {
        "n_words": np.bincount(texts, minlength=n),
        "word_chars": _sums(chars, texts, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }

    line_starts, line_ends, line_texts = runs(data != 10, offsets)
    filled = np.concatenate(([0], np.cumsum(~blank)))
    has_word = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, line_texts = line_starts[has_word], line_ends[has_word], line_texts[has_word]
    _, _, some = _repeats(of_text(span_hash(prefix, line_starts, line_ends), line_texts))
    later = np.ones(len(line_starts), bool)
    later[some] = False  # equal lines count alike, whichever is taken as the first
    line_chars = points[line_ends] - points[line_starts]
    out["n_dup_lines"] = np.bincount(line_texts[later], minlength=n)
    out["dup_line_chars"] = _sums(line_chars[later], line_texts[later], n)

    total = np.concatenate(([0], np.cumsum(chars)))
    repeated = np.ones(len(words) + 1, bool)
    for size in sorted({3, *TOP_LIMITS, *REPEAT_LIMITS}):
        grams, at = rolling(words, texts, size)
        likely = repeated[at]  # a repeated n-gram begins with a repeated shorter one
        grams, at = grams[likely], at[likely]
        group, counts, some = _repeats(of_text(grams, texts[at]))
        at_repeats = at[counts[group] > 1]
        if size == 3:
            inside = _covered(at_repeats, size, len(words))
            out["n_repeat_words"] = np.bincount(texts[inside], minlength=n)
        if size in TOP_LIMITS:
            worth = np.where(counts > 1, counts * (total[at[some] + size] - total[at[some]]), 0)
            best = np.zeros(n, np.int64)
            np.maximum.at(best, texts[at[some]], worth)
            out[f"top_{size}_chars"] = best
        if size in REPEAT_LIMITS:
            inside = _covered(at_repeats, size, len(words))
            out[f"repeat_{size}_chars"] = _sums(chars[inside], texts[inside], n)
        repeated[:] = False
        repeated[at_repeats] = True

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    whole = out["word_chars"]
    bad = out["dup_line_chars"] > LINE_LIMIT * whole
    for size, limit in TOP_LIMITS.items():
        bad |= out[f"top_{size}_chars"] > limit * whole
    for size, limit in REPEAT_LIMITS.items():
        bad |= out[f"repeat_{size}_chars"] > limit * whole
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def repetition_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the metrics and the verdict ``kept``."""
    names = [field.split()[0] for field in METRICS.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            found = measure(data, offsets)
            columns = [
                pa.array(found[m]) if found[m].dtype == bool else pa.array(found[m].astype(np.int64)) for m in names
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(score, f"id {kind}, {METRICS}").withColumnRenamed("id", id_col)


def keep_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns, in one narrow pass."""
    at = df.columns.index(text_col)
    places = [f"c{i}" for i in range(len(df.columns))]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, f"c{at}"):
            kept = batch.filter(pa.array(measure(data, offsets)["kept"]))
            if kept.num_rows:
                yield kept

    plain = df.toDF(*places)
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)
