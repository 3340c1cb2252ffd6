"""Packing documents into training sequences with bounded space.

Each task encodes the documents of its partition and keeps a fixed number of open windows of
``capacity`` tokens. A document longer than a window fills whole windows first. The rest goes
to the open window where it fits best. If it fits none, a new window is opened; if all are
open, the fullest is emitted, and a gap there of more than SLACK tokens is first filled with
the head of the document. So a sequence emitted by a task has at most SLACK padding. Windows
still open at the end are leftovers: they are written down, and the leftovers of MERGE tasks
at a time are packed again, longest piece first, each where it fits best.

Defined results: a null or empty text has only the end token; null ids are kept; repeated rows
are packed as separate documents; an empty table gives an empty table. Only the named id
and text columns are read, so other columns cannot clash. A task holds a block of texts and
its open windows, however long the texts are.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks
from tallygrid.llm.tokens import END_ID, encoder, vocabulary_path
from tallygrid.session import store

CAPACITY = 4096
#: Windows that a task keeps open.
OPEN_WINDOWS = 64
#: Padding that an emitted window may have before a document is cut to fill it.
SLACK = 16
#: Tasks whose leftovers are merged together.
MERGE = 16
_ROWS = 20_000
_PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, open boolean, ids binary"
)


class Packer:
    """Open windows of one task. A piece is (id, start, ids, document's length)."""

    def __init__(self, capacity: int, limit: int, slack: int):
        self.capacity, self.limit, self.slack = capacity, limit, slack
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.pieces: dict[int, list] = {}
        self.made = 0

    def _put(self, window: int, free: int, piece: tuple) -> int:
        self.pieces[window].append((piece, self.capacity - free))
        return free - len(piece[2])

    def add(self, key, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Place a document; yields the windows that this closes, with their pieces and offsets."""
        total, start = len(ids), 0
        while total - start > self.capacity:
            yield self._new(), [((key, start, ids[start : start + self.capacity], total), 0)]
            start += self.capacity
        need = total - start
        at = bisect.bisect_left(self.free, (need, -1))
        if at == len(self.free) and len(self.free) == self.limit:
            gap, fullest = self.free.pop(0)
            if gap > self.slack:
                self._put(fullest, gap, (key, start, ids[start : start + gap], total))
                start += gap
                need -= gap
            yield fullest, self.pieces.pop(fullest)
            at = bisect.bisect_left(self.free, (need, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            free, window = self.capacity, self._new()
            self.pieces[window] = []
        free = self._put(window, free, (key, start, ids[start:], total))
        if free <= self.slack:
            yield window, self.pieces.pop(window)
        else:
            bisect.insort(self.free, (free, window))

    def _new(self) -> int:
        self.made += 1
        return self.made - 1


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece: longest first, each to the window with the least room for it."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = bisect.bisect_left(free, (need, -1))
        room, place = free.pop(at) if at < len(free) else (capacity, made)
        made += place == made
        window[i], offset[i] = place, capacity - room
        if room > need:
            bisect.insort(free, (room - need, place))
    return window, offset


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    slack: int = SLACK,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids.

    ``ids`` are the piece's token ids, little-endian unsigned 32-bit (null unless ``keep_ids``);
    a sequence is the pieces of one sequence_id by offset. ``vocabulary`` is the path of a
    vocabulary file on every worker.
    """
    path = vocabulary or vocabulary_path()
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pairs.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, rows, id_type = Packer(capacity, open_windows, slack), [], None

        def take(window: int, pieces: list, is_open: bool) -> None:
            for (key, start, ids, total), offset in pieces:
                data = ids.astype("<u4").tobytes()
                crc = zlib.crc32(data)
                rows.append((key, start, len(ids), crc, total, task, window, offset, is_open, data if keep_ids else None))

        def batch() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            types = [id_type] + [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            rows.clear()
            names = ["id", *(f.split()[0] for f in _PIECES.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for block, data, offsets in blocks(batches, "text"):
            id_type = block.column(0).type
            ids, at = encoder(path).encode(data, offsets, END_ID)
            at = at.tolist()
            for i, key in enumerate(block.column(0).to_pylist()):
                for window, pieces in packer.add(key, ids[at[i] : at[i + 1]]):
                    take(window, pieces, False)
            for pieces in packer.pieces.values():  # open windows keep copies, not views of the block
                pieces[:] = [((k, s, np.array(x), n), o) for (k, s, x, n), o in pieces]
            if len(rows) >= _ROWS or keep_ids:
                if rows:
                    yield batch()
        for window, pieces in packer.pieces.items():
            take(window, pieces, True)
        if rows:
            yield batch()

    packed = store(pairs.mapInArrow(pack, f"id {kind}, {_PIECES}"))
    done = packed.filter("NOT open").select(
        "id", "start", "length", "ids_crc32", "doc_tokens", F.expr("shiftleft(task, 32) + window").alias("sequence_id"),
        "offset", "ids",
    )

    def merge(group: pa.Table) -> pa.Table:
        window, offset = best_fit(group["length"].to_numpy(), capacity)
        first = min(group["task"].to_pylist())
        # Above the windows of any task: bit 31 is never reached by a task's own numbers.
        sequence = (np.int64(first) << np.int64(32)) + (np.int64(1) << np.int64(31)) + window
        columns = {n: group[n] for n in ("id", "start", "length", "ids_crc32", "doc_tokens")}
        return pa.table(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "ids": group["ids"]})

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    merged = packed.filter("open").groupBy(F.floor(F.col("task") / MERGE).alias("g")).applyInArrow(merge, schema)
    out = done.unionByName(merged)
    return out.withColumnRenamed("id", id_col)
