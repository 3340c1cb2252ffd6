"""Text encodings of many files: marks at the start of each file, validity over all bytes."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession, functions as F

# Reported labels and the charsets behind them. Web decoders read the label
# Big5 with the Hong Kong supplement.
UTF8, UTF8_MARK, UTF16, BIG5, FALLBACK = "UTF-8", "UTF-8 (BOM)", "UTF-16LE", "Big5", "UTF-8 (fallback)"
CHARSETS = {UTF8: "UTF-8", UTF8_MARK: "UTF-8", UTF16: "UTF-16LE", BIG5: "Big5-HKSCS", FALLBACK: "UTF-8"}
MARKS = ((b"\xef\xbb\xbf", UTF8_MARK), (b"\xff\xfe", UTF16))


@dataclass(frozen=True)
class TextFile:
    path: str
    label: str
    charset: str
    #: Whether some line has an odd number of quotes, as a quoted line break leaves behind.
    open_quotes: bool


def head_bytes(spark: SparkSession, path: str, size: int) -> bytes:
    """The first ``size`` bytes of one file, through Hadoop's file system API."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(hadoop)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def decode(spark: SparkSession, data: bytes, charset: str) -> str:
    """Decode with the JVM's charset, the one the distributed read uses."""
    text = spark._jvm.java.lang.String(bytearray(data), charset)
    return text.removeprefix("﻿")


def forced(name: str) -> tuple[str, str]:
    """Label and charset of an encoding chosen by the user."""
    label = name.upper()
    return label, next((c for known, c in CHARSETS.items() if known.upper() == label), name)


def list_files(spark: SparkSession, paths) -> list[str]:
    """Paths of the files below ``paths``; their contents are not read."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect())


def inspect(spark: SparkSession, files: list[str], encoding: str | None = None) -> list[TextFile]:
    """Encoding and quote balance per file.

    A byte order mark needs three bytes of each file. Strict UTF-8 and quote balance need
    all of them: one distributed pass with one small result row per file.
    """
    marked = {} if encoding else {f: _mark(head_bytes(spark, f, 3)) for f in files}
    wide = [f for f in files if marked.get(f) == UTF16]
    plain = [f for f in files if f not in set(wide)]
    scanned = {}
    if plain:
        value = F.col("value")
        quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
        lines = spark.read.text(plain).select(F.col("_metadata.file_path").alias("path"), "value")
        rows = lines.groupBy("path").agg(
            F.bool_and(F.is_valid_utf8(value)).alias("valid"), F.bool_or(quotes % 2 == 1).alias("open_quotes")
        )
        scanned = {r["path"]: r for r in rows.collect()}
    big5 = spark._jvm.java.nio.charset.Charset.isSupported(CHARSETS[BIG5])
    out = []
    for f in files:
        seen = scanned.get(f)
        if encoding:
            label, charset = forced(encoding)
        else:
            valid = seen is None or seen["valid"]
            label = marked[f] or (UTF8 if valid else BIG5 if big5 else FALLBACK)
            charset = CHARSETS[label]
        # Two-byte text cannot be checked line by line: read such files in one piece.
        balanced = f in scanned and not seen["open_quotes"] or seen is None and f not in wide
        out.append(TextFile(f, label, charset, not balanced))
    return out


def _mark(head: bytes) -> str | None:
    return next((label for mark, label in MARKS if head.startswith(mark)), None)


@contextmanager
def java_charsets(spark: SparkSession):
    """Allow every JVM charset while a read runs; Spark refuses Big5 otherwise."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
