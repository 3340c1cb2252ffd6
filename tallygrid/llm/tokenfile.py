"""Token files: flat unsigned integers and 64-bit document offsets, read by memory mapping.

A dataset is a folder of parts in ascending id order. Part ``x`` has ``x.ids``, its token ids
one after the other as little-endian unsigned integers of 16 bits (32 for a vocabulary of
more than 65,536), and ``x.offsets``, n+1 little-endian unsigned 64-bit integers: where each
of its n documents begins, and the end. ``index`` is a parquet table with, per document, its
id, part number, file name and row in the part. The first id of a part within the dataset,
its base, is the prefix sum of the sizes of the parts before it.

A task writes files whose names carry its attempt, and names them in the index rows it
returns; the index is committed by Spark, so files of lost or repeated attempts are never read.
Files go through Arrow's file systems, so the shared folder may be any that Arrow opens; local
ones are memory-mapped.

Defined results: a null or empty text has only the end token; null ids come first; rows that
repeat an id stay separate documents, in the order of their texts' hashes; an id that many
rows share is spread over parts; an empty table gives no part and no row; a very long
text is encoded as one block. Only the named id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallygrid.llm.textblock import blocks
from tallygrid.llm.tokens import END_ID, encoder, vocabulary_path
from tallygrid.session import prepare


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path there."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def write_tokens(
    df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> str:
    """Encode every text, append the end token, and write the dataset; returns its folder."""
    spark = prepare(df.sparkSession)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    path = vocabulary or vocabulary_path()
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row")
    )
    keys = ["id", "tie", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    kind = ordered.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:08d}-{context.taskAttemptId()}"
        files, root = _open(folder)
        code = encoder(path)
        width = "<u2" if code.size <= 1 << 16 else "<u4"
        ids_out, offsets_out, written, row = None, None, 0, 0
        try:
            for block, data, offsets in blocks(batches, "text"):
                if ids_out is None:
                    files.create_dir(root, recursive=True)
                    ids_out = files.open_output_stream(f"{root}/{name}.ids")
                    offsets_out = files.open_output_stream(f"{root}/{name}.offsets")
                ids, at = code.encode(data, offsets, END_ID)
                ids_out.write(ids.astype(width).tobytes())
                offsets_out.write((at[:-1] + written).astype("<u8").tobytes())
                n = block.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0),
                        pa.array(np.full(n, part, np.int64)),
                        pa.array([name] * n),
                        pa.array([width] * n),
                        pa.array(np.arange(row, row + n)),
                        pa.array(np.diff(at).astype(np.int64)),
                    ],
                    names=["id", "part", "name", "width", "row", "size"],
                )
                written += int(at[-1])
                row += n
            if offsets_out is not None:
                offsets_out.write(np.array([written], "<u8").tobytes())
        finally:
            for out in (ids_out, offsets_out):
                if out is not None:
                    out.close()

    index = ordered.mapInArrow(write, f"id {kind}, part long, name string, width string, row long, size long")
    index.write.parquet(f"{folder}/index")
    return folder


def _mapped(folder: str, name: str, width: str) -> np.ndarray:
    files, root = _open(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", width, "r")
    with files.open_input_file(f"{root}/{name}") as data:  # a remote store: the part is read
        return np.frombuffer(data.read(), width)


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, ids_crc32 and, if asked, ids (binary)."""
    index = spark.read.parquet(f"{folder}/index")
    kind = index.schema["id"].dataType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("size").alias("n"))  # a row per part, not per document
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = index.join(F.broadcast(bases), "part").select("id", "name", "width", "row", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, offsets = None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            for name, width, row, base in zip(*columns):
                if name != held:
                    held = name
                    ids, offsets = _mapped(folder, f"{name}.ids", width), _mapped(folder, f"{name}.offsets", "<u8")
                first, last = int(offsets[row]), int(offsets[row + 1])
                data = np.asarray(ids[first:last], "<u4").tobytes()
                out.append((base + first, last - first, zlib.crc32(data), data if keep_ids else None))
            for at in range(0, len(out), 2_000):
                some = [list(c) for c in zip(*out[at : at + 2_000])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 2_000), *(pa.array(c, pa.int64()) for c in some[:3]), pa.array(some[3], pa.binary())],
                    names=["id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    got = rows.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
    return (got if keep_ids else got.drop("ids")).withColumnRenamed("id", id_col)
