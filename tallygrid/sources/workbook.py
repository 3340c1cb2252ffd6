"""Workbooks: one task per file reads the sheet's rows, Spark does the rest."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from tallygrid.grid import STRING, Grid
from tallygrid.options import BLANKS
from tallygrid.session import prepare, store
from tallygrid.sources.info import Source
from tallygrid.sources.names import dedupe_names, extra_name

# Built-in number formats that show a date, and messages.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
NO_SHEETS = "活頁簿中沒有任何工作表"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = dt.datetime(1899, 12, 30)
_SCHEMA = "path string, sheets array<string>, row bigint, cells array<string>"


def no_sheet(name: str) -> str:
    return f"找不到工作表「{name}」"


def empty_sheet(name: str) -> str:
    return f"工作表「{name}」內容為空"


def _xml(book: zipfile.ZipFile, path: str):
    return ElementTree.fromstring(book.read(path)) if path in book.namelist() else None


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    listed = _xml(book, "xl/workbook.xml").iter(f"{_MAIN}sheet")
    found = {s.get("name"): targets[s.get(f"{_REL}id")] for s in listed}
    return {name: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for name, t in found.items()}


def _strings(book: zipfile.ZipFile) -> list[str]:
    root = _xml(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    # Phonetic hints (rPh) are not part of the text.
    return ["".join(t.text or "" for t in _texts(si)) for si in root.iter(f"{_MAIN}si")]


def _texts(item) -> Iterator:
    for child in item:
        if child.tag == f"{_MAIN}t":
            yield child
        elif child.tag == f"{_MAIN}r":
            yield from child.iter(f"{_MAIN}t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        custom[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", code, re.I))
    formats = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (formats if formats is not None else ())]
    return {i for i, n in enumerate(ids) if custom.get(n, n in DATE_FORMATS)}


def _number(text: str, is_date: bool, base: dt.datetime) -> str:
    value = float(text)
    if is_date:
        moment = base + dt.timedelta(seconds=round(value * 86400))
        return moment.strftime("%Y-%m-%d" if moment.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
    shortest = Decimal(repr(value))
    if value == 0:
        return "0"
    if 1e-6 <= abs(value) < 1e21:
        plain = format(shortest, "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    return re.sub(r"e([+-])0(\d)$", r"e\1\2", repr(value))


def _cell(c, strings: list[str], dates: set[int], base: dt.datetime) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    text = c.findtext(f"{_MAIN}v")
    if text is None:
        return ""
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return "TRUE" if text.strip() == "1" else "FALSE"
    if kind == "d":
        moment = dt.datetime.fromisoformat(text)
        return moment.strftime("%Y-%m-%d" if moment.time() == dt.time() else "%Y-%m-%d %H:%M:%S")
    return _number(text, int(c.get("s", 0)) in dates, base) if kind == "n" else text


def _column(reference: str) -> int:
    place = 0
    for letter in re.match("[A-Z]+", reference).group():
        place = place * 26 + ord(letter) - 64
    return place - 1


def _rows(data: bytes, sheet: str | None) -> Iterator[tuple[list[str], int, list[str]]]:
    """``(sheet names, row number, cells)``; one row numbered -1 stands for a missing sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        sheets = _sheets(book)
        names = list(sheets)
        wanted = sheet if sheet is not None else next(iter(names), None)
        yield names, -1, []
        if wanted not in sheets:
            return
        strings, dates = _strings(book), _date_styles(book)
        settings = _xml(book, "xl/workbook.xml").find(f"{_MAIN}workbookPr")
        later = settings is not None and settings.get("date1904") in ("1", "true")
        base = dt.datetime(1904, 1, 1) if later else _EPOCH
        with book.open(sheets[wanted]) as part:
            number = 0
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell(c, strings, dates, base)]
                row.clear()
                if any(x.strip(BLANKS) for x in cells):
                    yield names, number, cells
                    number += 1


def read_workbooks(spark: SparkSession, paths: str | Sequence[str], sheet: str | None = None) -> Source:
    """One sheet of each ``.xlsx`` file below ``paths``, every cell as text.

    Blank rows are dropped and the first row left is the header. The table is as wide as its
    widest row; columns beyond the header are named by number. Files of one call share the
    sheet name (the first sheet of each by default) and the header; a file without the sheet or
    with another header is refused.
    """
    prepare(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = _rows(data, sheet)
                # A sheet can be larger than a batch should be.
                while chunk := [(path, *r) for _, r in zip(range(5000), rows)]:
                    yield pd.DataFrame(chunk, columns=["path", "sheets", "row", "cells"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    parsed = store(files.mapInPandas(read, _SCHEMA))
    # One row per file describes it.
    first = parsed.filter("row = -1").orderBy("path").limit(1).collect()
    names = tuple(first[0]["sheets"]) if first else ()
    if not names:
        raise ValueError(NO_SHEETS)
    active = names[0] if sheet is None else sheet
    if active not in names:
        raise ValueError(no_sheet(active))
    filled = parsed.filter("row >= 0")
    described = parsed.filter("row = -1")
    if sheet is not None and not (lacking := described.filter(~F.array_contains("sheets", sheet)).select("path").limit(20)).isEmpty():
        raise ValueError(f"{no_sheet(sheet)}: {', '.join(r['path'] for r in lacking.collect())}")
    header = filled.orderBy("path", "row").limit(1).collect()
    if not header:
        raise ValueError(empty_sheet(active))
    trimmed = lambda c: F.transform(c, lambda x: F.trim(x))
    same = trimmed(F.col("cells")) == trimmed(F.array(*map(F.lit, header[0]["cells"])))
    others = filled.filter(F.col("row") == 0).filter(~same).select("path").limit(20).collect()
    if others:
        raise ValueError(f"files with another header than {header[0]['path']}: {', '.join(r['path'] for r in others)}")
    width = filled.agg(F.max(F.size("cells"))).first()[0]
    columns = dedupe_names(header[0]["cells"])
    columns += [extra_name(i + 1) for i in range(len(columns), width)]
    cells = [F.coalesce(F.get("cells", F.lit(p)), F.lit("")).alias(f"c{p}") for p in range(width)]
    frame = filled.filter("row > 0").select(F.col("path").alias("k0"), F.col("row").alias("k1"), *cells)
    g = Grid(frame, tuple(columns), (STRING,) * width, ("k0", "k1"), True)
    base = header[0]["path"].rsplit("/", 1)[-1]
    return Source(g, f"{base} [{active}]", "excel", None, names, active)
