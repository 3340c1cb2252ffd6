"""Delimited files with quoted line breaks, cut into records by many tasks.

Whether a line break ends a record depends on all text before it, so a task that holds one range
of a file cannot tell. Each range is therefore scanned under both states it may begin in, at
the start of a record and inside quotes, and answers with the state each of them ends in. There
is one small answer per range; putting them together in file order fixes the state in
which every range begins. In a second pass the ranges are cut into records in parallel, and
the parts of a record that lies across ranges are joined by the range it began in.

A quote opens only at the start of a cell; the next single quote closes it; what follows up to the
separator belongs to the cell, as in Spark's reader. A file that ends inside quotes, or has
carriage returns that no line feed follows, is left to that reader as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.session import store

#: Lines that a task joins at once.
BATCH_LINES = 20_000
_RANGES = "path string, block long, from_start boolean, from_inside boolean, closes boolean, returns boolean"
_PIECES = "k0 string, k1 long, k2 long, part long, whole boolean, record string"


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether quotes are open after ``line``, which begins inside quotes or at a record's start."""
    opening, at = sep + '"', 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(opening) + len(opening)
            if at < len(opening):
                return False
    while True:
        at = line.find('"', at)
        while at >= 0 and line.startswith('""', at):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(opening, at + 1) + len(opening)
        if at < len(opening):
            return False


def _quoted_lines(column: pa.Array) -> list[int]:
    """Positions of the lines with a quote; all other lines keep the state they begin in."""
    return np.flatnonzero(pc.match_substring(column, '"').to_numpy(zero_copy_only=False)).tolist()


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Stretches of a batch's lines that come from one range of one file."""
    paths, blocks = batch.column(0), batch.column(1).to_numpy()
    codes = paths.dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    cuts = [0, *new.tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield paths[low].as_py(), int(blocks[low]), batch.column(2).slice(low, high - low)


def _lines(spark: SparkSession, paths: Sequence[str], charset: str) -> DataFrame:
    """Decoded lines, each with its file and the start of its range, in file order within a range."""
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), charset).alias("line"),
    )


def quote_states(lines: DataFrame, sep: str) -> DataFrame:
    """Per range: whether quotes are open at its end, if they are closed or open at its start; whether open ones are closed inside; whether a line has a bare carriage return."""

    bare = r"\r[\s\S]"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # path, block, state from the start, state from inside, whether that was ever closed
        for batch in batches:
            done = []
            for path, block, column in _ranges(batch) if batch.num_rows else ():
                if held is None or held[:2] != [path, block]:
                    done += [held] if held else []
                    held = [path, block, False, True, False, False]
                held[5] |= bool(pc.any(pc.match_substring_regex(column, bare)).as_py())
                for i in _quoted_lines(column):
                    line = column[i].as_py()
                    one, two = held[2:4]
                    held[2] = ends_inside(line, sep, one)
                    held[3] = held[2] if one == two else ends_inside(line, sep, two)
                    held[4] |= not held[3]
            if done:
                yield _batch(done, _RANGES)
        if held:
            yield _batch([held], _RANGES)

    return lines.mapInArrow(scan, _RANGES)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [field.split() for field in schema.split(", ")]
    columns = [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def starting_states(found: list[tuple]) -> tuple[dict[tuple[str, int], int | None], set[str]]:
    """For each range the start of the range whose last record is open where it begins, or None; files left open."""
    owners: dict[tuple[str, int], int | None] = {}
    last: dict[str, int | None] = {}
    for path, block, from_start, from_inside, closes, _ in sorted(found):
        owner = last.get(path)
        owners[path, block] = owner
        inside = from_start if owner is None else from_inside
        last[path] = None if not inside else block if owner is None or closes else owner
    return owners, {path for path, owner in last.items() if owner is not None}


def read_quoted(spark: SparkSession, paths: Sequence[str], charset: str, sep: str) -> tuple[DataFrame | None, list[str]]:
    """(k0 path, k1 range, k2 line, record) of every record, and the files that are left.

    The driver holds one row per range of 128 MB or so, never lines. The records are stored.
    """
    states = store(quote_states(_lines(spark, paths, charset), sep))
    rows = [tuple(r) for r in states.collect()]
    owners, left = starting_states(rows)
    left |= {path for path, *_, returns in rows if returns}
    owners = {place: owner for place, owner in owners.items() if place[0] not in left}
    if not owners:
        return None, sorted(left)
    shared = spark.sparkContext.broadcast(owners)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, out = None, []
        for batch in batches:
            for path, block, column in _ranges(batch) if batch.num_rows else ():
                if (path, block) not in shared.value:  # a file that is left; without it ranges would be cut elsewhere
                    continue
                if cutter is None or cutter.place != (path, block):
                    out += cutter.finish() if cutter else []
                    cutter = _Cutter(path, block, shared.value[path, block], sep)
                for low in range(0, len(column), BATCH_LINES):
                    out += cutter.add(column.slice(low, BATCH_LINES))
                    if out:
                        yield _batch(out, _PIECES)
                        out = []
        out += cutter.finish() if cutter else []
        if out:
            yield _batch(out, _PIECES)

    pieces = store(_lines(spark, paths, charset).mapInArrow(cut, _PIECES))
    # At most two pieces of a range are not whole: what it begins in, and what it leaves open.
    parts = pieces.filter("NOT whole").groupBy("k0", "k1").agg(
        F.min("k2").alias("k2"), F.array_sort(F.collect_list(F.struct("part", "record"))).alias("parts")
    )
    joined = parts.select("k0", "k1", "k2", F.array_join("parts.record", "\n").alias("record"))
    records = pieces.filter("whole").select("k0", "k1", "k2", "record").unionByName(joined)
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")), sorted(left)


class _Cutter:
    """Cuts the lines of one range into records.

    A piece is (file, range the record began in, its first line's number there, own range, whole, text). Pieces
    of a record that began in an earlier range carry the greatest line number, so the first one's counts.
    """

    def __init__(self, path: str, block: int, owner: int | None, sep: str):
        self.place, self.owner, self.sep = (path, block), owner, sep
        self.open: list[str] = []  # lines of the record that is open
        self.inside = owner is not None
        self.first = 0  # number of its first line
        self.count = 0

    def _piece(self, whole: bool) -> tuple:
        path, block = self.place
        text = "\n".join(self.open)
        if self.owner is not None:
            return path, self.owner, np.iinfo(np.int64).max, block, False, text
        return path, block, self.first, block, whole, text

    def add(self, column: pa.Array) -> list[tuple]:
        (path, block), out, done = self.place, [], 0
        lines = column.to_pylist()
        for i in [*_quoted_lines(column), len(lines)]:
            if not self.inside:  # lines without a quote are records
                out += [(path, block, self.count + k, block, True, lines[k]) for k in range(done, i)]
                self.first = self.count + i
            else:
                self.open += lines[done:i]
            if i == len(lines):
                break
            self.open.append(lines[i])
            self.inside = ends_inside(lines[i], self.sep, self.inside)
            if not self.inside:
                out.append(self._piece(True))
                self.open, self.owner = [], None
            done = i + 1
        self.count += len(lines)
        return out

    def finish(self) -> list[tuple]:
        return [self._piece(False)] if self.inside else []
