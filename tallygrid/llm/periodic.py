"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
of at least ``shortest`` words and ``exponent`` periods that no neighbouring word extends.

1. *Frequency splitting.* Every word of a run occurs at least ``exponent`` times in any segment
   that holds the run whole. So words that occur more rarely within their segment split it, as
   do pieces below ``shortest`` words. The pieces are split again by their own counts, until a
   round takes less than one word in SETTLED from a segment. Ordinary prose is gone by then.
2. *Lag scan* of the segments that survive, for lags in (L/2, L] with L = 1, 2, 4, ... at a
   time: each gram of L words is compared with its previous occurrence in the segment. Inside a
   run of period q <= L no gram of L >= q words recurs sooner than after q words, so positions
   whose gram recurs at just that lag form one stretch per run, which gives its two ends. Texts
   are therefore scanned in n log n steps, however long they or their runs are.

Words are runs of characters outside U+0020 and U+0009..U+000D; 64-bit hashes stand for them.
All work is per text inside Arrow tasks; nothing is shuffled.

Defined results: a null, empty or blank text has no words and no runs, and an empty collapsed
text; null ids are kept; repeated rows are answered separately; a very long text is one block
of its task; an empty table gives an empty table. Only the named id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks, mix, of_text, prefix_hash, runs, spaces, span_hash

SHORTEST = 6
EXPONENT = 4
#: A segment is stable when a splitting round takes less than one in so many of its words.
SETTLED = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_segments(words: np.ndarray, texts: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST):
    """First words and lengths of the segments that may hold runs; none crosses texts."""
    at, segment = np.arange(len(words)), texts
    first, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        _, inverse, counts = np.unique(of_text(words[at], segment), return_inverse=True, return_counts=True)
        often = counts[inverse] >= exponent
        _, segment = np.unique(segment, return_inverse=True)
        before = np.bincount(segment)
        taken = np.bincount(segment[~often], minlength=len(before))
        stable = taken * SETTLED < before
        at, old = at[often], segment[often]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        done = stable[old[heads]] & (sizes >= shortest)
        first.append(at[heads[done]])
        length.append(sizes[done])
        again = np.repeat(~stable[old[heads]] & (sizes >= shortest), sizes)
        segment = np.repeat(np.arange(len(heads)), sizes)[again]
        at = at[again]
    first, length = np.concatenate(first), np.concatenate(length)
    order = np.argsort(first)
    return first[order], length[order]


def lag_scan(words: np.ndarray, first: np.ndarray, length: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST):
    """Starts, lengths and periods of the runs inside segments, by start, then period."""
    piece = np.repeat(np.arange(len(first)), length)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(length) - length, length) + first[piece]
    ends = (first + length)[piece]
    gram, scale = words[at], 1
    found = [np.zeros((0, 3), np.int64)]
    while True:
        fits = length[piece] >= max(shortest, exponent * (scale // 2 + 1))
        if not fits.all():
            at, piece, ends, gram = at[fits], piece[fits], ends[fits], gram[fits]
        if not len(at):
            break
        whole = np.flatnonzero(at + scale <= ends)
        key = of_text(gram[whole], piece[whole])
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        places = at[whole]
        lag = np.zeros(len(whole), np.int64)
        lag[order[same + 1]] = places[order[same + 1]] - places[order[same]]
        hit = (lag > scale // 2) & (lag <= scale)
        places, lag, owner = places[hit], lag[hit], piece[whole][hit]
        if len(places):
            new = np.ones(len(places), bool)
            new[1:] = (places[1:] != places[:-1] + 1) | (lag[1:] != lag[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(places)) - 1
            period = lag[heads]
            start = places[heads] - period
            size = places[tails] + scale - start
            long = size >= np.maximum(shortest, exponent * period)
            found.append(np.stack([start, size, period], axis=1)[long])
        wider = np.zeros(len(gram), np.uint64)  # grams that leave their segment are never used
        wider[:-scale] = mix(gram[:-scale] * _BASE + gram[scale:])
        gram, scale = wider, 2 * scale
    got = np.concatenate(found)
    return tuple(got[np.lexsort((got[:, 2], got[:, 0]))].T)


def runs_of_block(data: np.ndarray, offsets: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST):
    """(word starts, ends and texts, run starts, lengths and periods) of a block; starts count its words."""
    starts, ends, texts = runs(~spaces(data), offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    first, length = split_segments(words, texts, exponent, shortest)
    return (starts, ends, texts), lag_scan(words, first, length, exponent, shortest)


def _collapsed(data: np.ndarray, offsets: np.ndarray, word: tuple, found: tuple, sizes: np.ndarray) -> list[bytes]:
    """Each text's words, joined by one space, without those that repeat a run's first period."""
    starts, ends, texts = word
    begin, length, period = found
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, begin + period, 1)
    np.add.at(covered, begin + length, -1)
    kept = np.cumsum(covered[:-1]) == 0
    shorter = set(texts[~kept].tolist())
    raw, heads, out = data.tobytes(), np.cumsum(sizes) - sizes, []
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if i not in shorter:
            out.append(b" ".join(raw[low:high].split()))
        else:
            some = heads[i] + np.flatnonzero(kept[heads[i] : heads[i] + sizes[i]])
            out.append(b" ".join([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]))
    return out


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST
) -> DataFrame:
    """One row per row of ``df``: id, n_words, runs (start, length, period, by start) and collapsed.

    ``collapsed`` is the text's words joined by one space, without words that any run contains
    after its first period.
    """
    if exponent < 3:
        raise ValueError("the lag scan needs an exponent of 3 or more")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks(batches, "text"):
            word, found = runs_of_block(data, offsets, exponent, shortest)
            sizes = np.bincount(word[2], minlength=block.num_rows)
            heads = np.cumsum(sizes) - sizes
            owner = word[2][found[0]]
            fields = [pa.array(x) for x in (found[0] - heads[owner], found[1], found[2])]
            at = np.searchsorted(owner, np.arange(block.num_rows + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            joined = pa.array(_collapsed(data, offsets, word, found, sizes), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(sizes.astype(np.int64)), listed, joined], names=["id", "n_words", "runs", "collapsed"]
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = "array<struct<start:long,length:long,period:long>>"
    return rows.mapInArrow(work, f"id {kind}, n_words long, runs {run}, collapsed string").withColumnRenamed("id", id_col)


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each row of :func:`periodic_runs` and digests of all runs and the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.col3")
    return top.select(
        found.columns[0],
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
