"""Blocks of whole texts as flat UTF-8 byte arrays, for numpy inside Arrow tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, if it is not a single longer text.
BLOCK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and its n+1 offsets. Null: empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.any(np.diff(offsets)[np.asarray(column.is_null())] > 0):
        return text_bytes(column.fill_null(""))
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with about BLOCK_BYTES of text each: slice, bytes, offsets."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offsets = text_bytes(column)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last
        del column, data, batch
        release()


_libc = ctypes.CDLL(None) if sys.platform == "linux" else None


def release() -> None:
    """Give free memory back to the system: a worker lives on after its task, with what it once held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space: U+0020, U+0009 to U+000D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of ``inside``; no run crosses texts."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    last[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 running polynomial hashes; :func:`span_hash` takes the hash of any span from them."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans by content and length."""
    _, inverse = powers(len(prefix))
    value = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(words: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of word hashes that stay in one text, and the word each begins at."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = words[:size].copy()
    for k in range(1, n):
        value *= _BASE
        value += words[k : k + size]
    at = np.flatnonzero(texts[:size] == texts[n - 1 :])
    return mix(value[at]), at


def of_text(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Hashes that also tell texts of a block apart."""
    return mix(hashes ^ mix(texts.astype(np.uint64) * _BASE + np.uint64(1)))
