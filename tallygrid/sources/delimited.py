"""Delimited text: files in mixed encodings, pasted text and text columns."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallygrid.functions.text import trim_cell
from tallygrid.grid import STRING, Grid, union
from tallygrid.options import BLANKS
from tallygrid.session import prepare, store
from tallygrid.sources import encoding as enc
from tallygrid.sources.info import Source
from tallygrid.sources.names import dedupe_names
from tallygrid.sources.quoted import read_quoted

# Messages and labels.
EMPTY = "檔案內容為空"
PASTED = "剪貼簿"

#: Cell separators that are looked for, the more usual first.
SEPARATORS = (",", "\t", ";", "|")
#: Filled lines of each file that the separator is judged on.
HEAD_LINES = 12
_BAD = "_bad"


def _blank(row) -> bool:
    return not any(cell.strip(BLANKS) for cell in row)


def _head_rows(text: str, sep: str, limit: int | None = None) -> list[list[str]]:
    return list(itertools.islice(csv.reader(io.StringIO(text, newline=""), delimiter=sep), limit))


def guess_delimiter(head: str) -> str:
    """The separator under which most rows have the same number of cells, two or more.

    Each separator is scored by the share of filled rows that have its most frequent width;
    equal shares go to the greater width, then to the more usual separator. Comma if none fits.
    """

    def score(sep: str) -> tuple[float, int]:
        widths = Counter(len(row) for row in _head_rows(head, sep, HEAD_LINES) if not _blank(row))
        width, times = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return (times / widths.total(), width) if width > 1 else (0.0, 0)

    return max(SEPARATORS, key=score)  # the first of equals


def _first_line(text: Column) -> Column:
    """Whether a line has anything but blanks, separators and quotes."""
    return trim_cell(F.translate(text, "".join(SEPARATORS) + '"', "")) != ""


def _range_heads(lines: DataFrame) -> DataFrame:
    """The first HEAD_LINES lines of each range of a file (``path, block, row, line``).

    A task reads its ranges in file order, so it passes on the first lines of each and holds none.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, blocks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                at = (batch.column(0)[low].as_py(), blocks[low])
                place, seen = at, seen if at == place else 0
                kept = min(high - low, HEAD_LINES - seen)
                if kept > 0:
                    yield batch.slice(low, kept)
                    seen += kept

    return lines.mapInArrow(first, "path string, block long, row long, line binary")


def _heads(spark: SparkSession, files: Sequence[enc.TextFile]) -> dict[str, str]:
    """Text of the first filled lines of each file, found in one distributed pass.

    A file of two-byte text cannot be split into lines before it is decoded; its head is read
    directly, in growing pieces until it has the lines.
    """
    out = {}
    plain = [f for f in files if not f.charset.startswith("UTF-16")]
    if plain:
        lines = spark.read.text([f.path for f in plain]).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
        filled = lines.filter(_first_line(F.col("value"))).select("path", "block", "row", F.col("value").cast("binary").alias("line"))
        # At most HEAD_LINES rows per range are ordered.
        place = F.row_number().over(Window.partitionBy("path").orderBy("block", "row"))
        first = _range_heads(filled).withColumn("place", place).filter(F.col("place") <= HEAD_LINES)
        found: dict[str, list] = {}
        for r in first.select("path", "place", "line").collect():
            found.setdefault(r["path"], []).append((r["place"], bytes(r["line"])))
        for f in plain:
            lines_of = b"\n".join(line for _, line in sorted(found.get(f.path, [])))
            out[f.path] = enc.decode(spark, lines_of, f.charset)
    for f in files:
        if f.path in out:
            continue
        size = 1 << 16
        while True:
            data = enc.head_bytes(spark, f.path, size)
            text = enc.decode(spark, data, f.charset)
            filled = [r for r in _head_rows(text, "\0") if r and r[0].strip(BLANKS + '"' + "".join(SEPARATORS))]
            if len(data) < size or len(filled) > HEAD_LINES:
                break
            size *= 4
        out[f.path] = text
    return out


def _schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*(f"c{p}" for p in range(width)), _BAD)])


def _not_blank(width: int, sep: str) -> Column:
    """Rows with text in any cell, also in a cell beyond the header's width."""
    filled = F.lit(False)
    for p in range(width):
        filled = filled | (trim_cell(F.coalesce(F.col(f"c{p}"), F.lit(""))) != "")
    rest = F.translate(F.coalesce(F.col(_BAD), F.lit("")), sep + '"\r\n', "")
    return filled | (trim_cell(rest) != "")


def _line_break(head: str) -> str | None:
    return next((b for b in ("\r\n", "\n", "\r") if b in head), None)


def _read(spark: SparkSession, files: Sequence[enc.TextFile], sep: str, width: int, head: str) -> DataFrame:
    """Rows after the header of files that share an encoding, a separator and the kind of splitting."""
    first = files[0]
    options = {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _BAD, "multiLine": first.open_quotes, "maxColumns": max(20480, width + 1),
    }
    schema, parts, whole = _schema(width), [], [f.path for f in files]
    if first.open_quotes and not first.charset.startswith("UTF-16"):
        records, whole = read_quoted(spark, whole, first.charset, sep)
        if records is not None:
            cells = F.from_csv("record", ", ".join(f"{c} string" for c in schema.names), {k: str(v) for k, v in options.items()})
            parts.append(records.select("k0", "k1", "k2", cells.alias("cells")).select("k0", "k1", "k2", "cells.*"))
    if whole:
        options |= {"encoding": first.charset, "header": False}
        if not first.open_quotes and first.charset.startswith("UTF-16") and _line_break(head):
            options["lineSep"] = _line_break(head)
        rows = spark.read.options(**options).schema(schema).csv(whole)
        parts.append(
            rows.select(
                F.col("_metadata.file_path").alias("k0"),
                F.col("_metadata.file_block_start").alias("k1"),
                # Rows of one split are numbered in order by one task.
                F.monotonically_increasing_id().alias("k2"),
                *rows.columns,
            )
        )
    keyed = union(parts).filter(_not_blank(width, sep))
    # The first filled row of each file is its header, whatever precedes it.
    top = keyed.groupBy("k0").agg(F.min(F.struct("k1", "k2")).alias("top"))
    # One row per file: a shuffle by file would give each file's rows to one task.
    return keyed.join(F.broadcast(top), "k0").filter(F.struct("k1", "k2") > F.col("top")).drop("top")


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    encoding: str | None = None,
    sep: str | None = None,
    name: str | None = None,
) -> Source:
    """Read CSV, TSV or TXT files that share one header row, every cell as text.

    Encoding and separator are found file by file unless forced. Files with another header
    than the first one are refused. Short rows are padded, cells beyond the header are
    dropped, blank rows are skipped, files without any row are left out. Files are split among
    tasks, those with quoted line breaks too (:mod:`tallygrid.sources.quoted`). The parsed rows are stored once as a columnar table.
    """
    prepare(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = enc.inspect(spark, enc.list_files(spark, paths), encoding)
    with enc.java_charsets(spark):
        heads = _heads(spark, files)
    seps, headers = {}, {}
    for f in files:
        seps[f.path] = sep or guess_delimiter(heads[f.path])
        header = next((row for row in _head_rows(heads[f.path], seps[f.path]) if not _blank(row)), None)
        if header is not None:
            headers[f.path] = [cell.strip(BLANKS) for cell in header]
    files = [f for f in files if f.path in headers]
    if not files:
        raise ValueError(EMPTY)
    common = headers[files[0].path]
    others = [f.path for f in files if headers[f.path] != common]
    if others:
        raise ValueError(f"files with another header than {files[0].path}: {', '.join(others)}")
    names = dedupe_names(common)
    groups: dict[tuple, list[enc.TextFile]] = {}
    for f in files:
        groups.setdefault((f.charset, f.open_quotes, seps[f.path]), []).append(f)
    with enc.java_charsets(spark):
        parts = [_read(spark, group, key[2], len(names), heads[group[0].path]) for key, group in groups.items()]
        parsed = union([p.drop(_BAD) for p in parts])
        frame = store(parsed)
    labels = sorted({f.label for f in files})
    shown = name or (paths[0].rstrip("/").rsplit("/", 1)[-1])
    g = Grid(frame, tuple(names), (STRING,) * len(names), ("k0", "k1", "k2"), True, nested_order=True)
    return Source(g, shown, "csv", ", ".join(labels))


def redecode(spark: SparkSession, paths: str | Sequence[str], encoding: str, **options) -> Source:
    """Read the original bytes again in another encoding."""
    return read_delimited(spark, paths, encoding=encoding, **options)


def parse_records(df: DataFrame, column: str, order_by: Sequence[str], *, sep: str | None = None, name: str = "text") -> Source:
    """A text column with one delimited record per row; the first filled row is the header."""
    prepare(df.sparkSession)
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(order_by)]
    # Records with equal keys follow each other by their text.
    keys.append(F.coalesce(F.col(column), F.lit("")).alias(f"k{len(keys)}"))
    key_names = [f"k{i}" for i in range(len(keys))]
    records = df.select(*keys, F.col(column).alias("record"))
    first = [r["record"] or "" for r in records.orderBy(*key_names).limit(HEAD_LINES * 2).collect()]
    sep = sep or guess_delimiter("\n".join(first))
    filled = trim_cell(F.translate(F.coalesce("record", F.lit("")), sep + '"', "")) != ""
    top = records.filter(filled).orderBy(*key_names).limit(1).collect()
    if not top:
        raise ValueError(EMPTY)
    names = dedupe_names(_head_rows(top[0]["record"], sep, 1)[0])
    fields = ", ".join(f"c{p} string" for p in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    position = F.struct(*key_names)
    header = F.struct(*(F.lit(top[0][k]).cast(records.schema[k].dataType).alias(k) for k in key_names))
    later = records.filter(filled & (position > header))
    # Exact copies of the header row are records.
    copies = records.filter(filled & (position == header)).groupBy(*key_names, "record").count()
    again = copies.select(*key_names, "record", F.explode(F.expr("sequence(1, greatest(1, int(count)))")).alias("i"))
    later = later.union(again.filter("i > 1").drop("i"))
    cells = later.select(*key_names, F.from_csv("record", fields, options).alias("cells")).select(*key_names, "cells.*")
    g = Grid(cells, tuple(names), (STRING,) * len(names), tuple(key_names))
    return Source(g, name, "text", PASTED)


def read_text(spark: SparkSession, text: str, *, name: str = "pasted", sep: str | None = None) -> Source:
    """Delimited text typed or pasted by a user."""
    # A record ends at a line break outside quotes.
    records = re.findall(r'(?:[^"\r\n]|"(?:[^"]|"")*"|")+', text)
    if not any(r.strip(BLANKS) for r in records):
        raise ValueError(EMPTY)
    frame = spark.createDataFrame(list(enumerate(records)), "rid bigint, record string")
    return parse_records(frame, "record", ["rid"], sep=sep or guess_delimiter(text), name=name)
