"""Secret scans with an incremental ledger of blobs.

Every version of every text is addressed by its content (SHA-256). The ledger holds, per
blob and rule version, what a scan found. A run scans only the pairs of blob and rule
version that the ledger lacks, appends them, and joins the findings back to all paths.

Rules look for assignments to names like ``password``, access keys, long hexadecimal runs,
and, beyond those base kinds, key headers, repository and chat tokens and signed web tokens.
A change of any rule changes the rule version, so all blobs are scanned anew under it.

Defined results: a null text is an empty one and holds nothing; null ids are kept; rows that
repeat an id or a text are each reported, the blob being scanned once; an empty table gives
an empty table. Only the named id and text columns are read, so other columns cannot clash.
Matches are found in whole texts, in time proportional to their length; offsets count code points, ends exclusive. A copy that a
third of all rows share is scanned once and its findings are broadcast.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.links import join_sized
from tallygrid.llm.textblock import BLOCK_BYTES, blocks
from tallygrid.session import prepare

# The base kinds, their patterns and least lengths.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Kinds beyond the base: pattern, measured group, its least length.
MORE = {
    "keyfile": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "repo": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "web": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
}
RULES = BASE | MORE
MASK = "[SECRET]"
_FOUND = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: Text without which no assignment can match, to spare most texts the slow pattern.
_NAMES = ("passw", "secret", "token", "api_key", "apikey")
_EMPTY = hashlib.sha256(b"").hexdigest()


def rule_version(rules: dict = RULES) -> str:
    """Name of a rule set: a digest of all it says."""
    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


_DOTTED = re.compile(r"[A-Za-z0-9_-]++(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?", re.ASCII)


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the pattern of kind ``web``, by whole runs of its alphabet: each character is read three times at most.

    The pattern alone would read on from every ``eyJ`` to the end of its run.
    """
    at = text.find("eyJ")
    if at < 0:
        return
    while m := _DOTTED.search(text, at):
        last = m.start(1) if m[1] else m.end()
        start = text.find("eyJ", m.start(), last)
        if m[1] and 0 <= start < last - 3:
            yield start, m.end()
            at = m.end()
        else:
            at = last


class Scanner:
    """The rules, compiled."""

    def __init__(self, rules: dict = RULES):
        self.rules = []
        for rank, (kind, (pattern, group, least)) in enumerate(rules.items()):
            if kind == "hex":  # a run is taken whole, so shorter runs need no match
                pattern = pattern[:-1] + f"{{{least},}}"
            self.rules.append((rank, kind, re.compile(pattern, re.ASCII), group, least))

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, rank of kind, end, kind), in order."""
        out = []
        lower = text.lower()
        for rank, kind, pattern, group, least in self.rules:
            if kind == "assign" and not any(name in lower for name in _NAMES):
                continue
            if kind == "web" and pattern.pattern == MORE["web"][0]:
                out += [(start, rank, end, kind) for start, end in _web_tokens(text) if end - start >= least]
                continue
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out.append((m.start(), rank, m.end(), kind))
        return sorted(out)


def _written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def _scan(version: str, rules: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch, _, _ in blocks(batches, "text"):
            rows, held = [], 0
            for blob, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                spans = scanner.spans(text)
                count = {k: sum(s[3] == k for s in spans) for k in BASE}
                base = _written([s for s in spans if s[3] in BASE])
                rows.append(
                    (blob.as_py(), version, count["assign"], count["access"], count["hex"],
                     hashlib.sha256(base.encode()).hexdigest(), _written(spans))
                )
                held += len(rows[-1][-1])
                if held > BLOCK_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)


def scan_blobs(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES):
    """(paths, found): id and blob of every row with ``n``, and the ledger's findings for the blobs.

    ``ledger`` names a folder that later runs pass again; without it a new one is made in the
    checkpoint folder. Only pairs of blob and rule version that it lacks are scanned.
    """
    spark = prepare(df.sparkSession)
    version = rule_version(rules)
    ledger = ledger or f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = rows.groupBy("blob").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    seen = _read(spark, ledger).filter(F.col("rules") == version).select("blob")
    unseen = blobs.join(seen, "blob", "left_anti").select("blob", "rep")
    # Keyed by blob and id, so that copies of one blob do not meet in one task.
    new = rows.join(
        unseen.select(F.col("blob").alias("b"), "rep").hint("merge"),
        (rows["blob"] == F.col("b")) & rows["id"].eqNullSafe(F.col("rep")),
    ).select("blob", "text")
    new.mapInArrow(_scan(version, rules), _FOUND).write.mode("append").parquet(ledger)
    found = _read(spark, ledger).filter(F.col("rules") == version).drop("rules")
    found = found.filter("spans <> ''").dropDuplicates(["blob"]).join(blobs.select("blob", "n"), "blob")
    return rows.select("id", "blob"), found


def _read(spark, ledger: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(_FOUND).parquet(ledger) if there else spark.createDataFrame([], _FOUND)


def find_secrets(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, counts of the base kinds, base_sha256, all spans and the blob."""
    paths, found = scan_blobs(df, ledger, id_col, text_col)
    joined = join_sized(paths, found, ["blob"], "n", paths.count())
    counts = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("n_assign", "n_access", "n_hex")]
    return joined.select(
        F.col("id").alias(id_col), *counts,
        F.coalesce("base_sha256", F.lit(_EMPTY)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob",
    )


def mask(text: str, spans: str) -> str:
    """``text`` with each maximal covered stretch of ``spans`` replaced by MASK."""
    out, done = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join(out) + text[done:]


def mask_secrets(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, with every secret in the text replaced by MASK."""
    paths, found = scan_blobs(df, ledger, id_col, text_col)
    places = [f"c{i}" for i in range(len(df.columns))]
    name = places[df.columns.index(text_col)]
    text = F.col(name).cast("string")
    plain = df.toDF(*places).withColumn("blob", F.sha2(F.coalesce(text, F.lit("")), 256))
    joined = join_sized(plain, found.select("blob", "spans", "n"), ["blob"], "n", paths.count())
    masked = F.when(F.col("spans").isNull(), text).otherwise(_masked(text, F.split("spans", ",")))
    return joined.withColumn(name, masked).select(*places).toDF(*df.columns)


def _masked(text: Column, spans: Column) -> Column:
    """:func:`mask` as an expression: ``spans`` are ordered by their starts."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

    def step(so_far: Column, span: Column) -> Column:
        first, last = (F.split_part(span, F.lit(":"), F.lit(k)).cast("int") for k in (2, 3))
        before = F.substring(text, so_far["done"] + 1, first - so_far["done"])
        out = F.when(first >= so_far["done"], F.concat(so_far["out"], before, F.lit(MASK))).otherwise(so_far["out"])
        return F.struct(out.alias("out"), F.greatest(so_far["done"], last).alias("done"))

    finish = lambda x: F.concat(x["out"], F.substring(text, x["done"] + 1, F.length(text)))
    return F.aggregate(spans, begin, step, finish)
