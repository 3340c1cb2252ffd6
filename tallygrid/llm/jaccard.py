"""Similarity join on word n-gram sets, by MinHash bands.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or
more. Words are runs of characters outside U+0020 and U+0009..U+000D; a text of one to four
words has one shingle of all its words.

1. One pass over the texts makes each set's 128-bit hash and MinHash band keys. Band and row
   counts follow from the target recall. Texts with equal sets are copies: one *class* each.
2. Classes are shuffled on band keys. A bucket of m classes gives m - 1 edges to its least
   class, never all pairs; connected components of these edges hold every candidate pair.
3. The texts of each component meet once, in blocks of bounded size (a component of k blocks
   in k(k+1)/2 pairs of blocks), and all pairs there are verified on full sets. Links are
   counted, not emitted: a block returns a row per class.
4. Components of the verified links are the groups of near duplicates.

Defined results: a null or blank text has no shingle and no link; it is its own group. Two
rows with equal sets are copies, whatever their ids. A null id is kept; if all ids of a group
are null its group id is null. Repeated rows count as copies. An empty table gives an empty
table. A very long text is one block of its task, and of the pair of blocks that verifies it. Only the
named id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.links import components, join_sized
from tallygrid.llm.textblock import blocks, mix, of_text, prefix_hash, release, rolling, runs, spaces, span_hash, text_bytes
from tallygrid.session import store

WORDS = 5
THRESHOLD = 0.8
#: Wanted chance that a pair right at the threshold shares a band.
RECALL = 0.9999
MAX_BANDS = 32
#: Shingles and texts in one block of a component; a task holds two blocks.
BLOCK_SHINGLES = 500_000
BLOCK_TEXTS = 1_000
#: Shingles in more texts than this are counted by matrix products, the others pair by pair.
DENSE_ABOVE = 12
_ROWS = 256


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows whose band count for the recall stays within ``max_bands``."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= max_bands:
            return bands, rows
    return max_bands, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, and the text each belongs to, by text."""
    blank = spaces(data)
    starts, ends, texts = runs(~blank, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    found, owner = [], []
    grams, at = rolling(words, texts, size)
    found.append(grams)
    owner.append(texts[at])
    counts = np.bincount(texts, minlength=len(offsets) - 1)
    for n in range(1, size):
        short = np.flatnonzero(counts[texts] == n)
        if len(short):
            grams, at = rolling(words[short], texts[short], n)
            found.append(grams)
            owner.append(texts[short][at])
    hashes, texts = np.concatenate(found), np.concatenate(owner)
    _, first = np.unique(of_text(hashes, texts), return_index=True)
    order = first[np.argsort(texts[first], kind="stable")]
    return hashes[order], texts[order]


def _signatures(data: np.ndarray, offsets: np.ndarray, size: int, bands: int, rows: int) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    hashes, texts = shingle_sets(data, offsets, size)
    count = np.bincount(texts, minlength=n)
    full = np.flatnonzero(count)
    out = {"n": count, "h1": np.zeros(n, np.uint64), "h2": np.zeros(n, np.uint64), "full": full}
    keys = np.zeros((len(full), bands), np.uint64)
    if len(full):
        heads = np.concatenate(([0], np.cumsum(count[full])[:-1]))
        out["h1"][full] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5)), heads)
        out["h2"][full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5A5A5A)), heads)
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for band in range(bands):
            key = np.full(len(full), band + 1, np.uint64)
            for row in range(rows):
                k = 2 * (band * rows + row)
                least = np.minimum.reduceat(hashes * seeds[k] + seeds[k + 1], heads)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[:, band] = key
    out["keys"] = keys
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, thash, h1, h2, n, keys of every row; h1, h2, keys are null for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            got = _signatures(data, offsets, size, bands, rows)
            empty = pa.array(got["n"] == 0)
            at = np.concatenate(([0], np.cumsum(got["n"] > 0))).astype(np.int32) * bands
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(got["keys"].ravel().view(np.int64)))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(got["h1"].view(np.int64), mask=np.asarray(empty)),
                pa.array(got["h2"].view(np.int64), mask=np.asarray(empty)),
                pa.array(got["n"].astype(np.int64)),
                keys,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "thash", "h1", "h2", "n", "keys"])

    text = F.col(text_col).cast("string")
    rows_in = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("thash"), text.alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    return rows_in.mapInArrow(work, f"id {kind}, thash long, h1 long, h2 long, n long, keys array<long>")


def shared_counts(hashes: np.ndarray, texts: np.ndarray, n: int, split: int) -> np.ndarray:
    """How many shingles texts i < split and j >= split share; with split = n, all i < j. Other entries may be 0."""
    order = np.argsort(hashes, kind="stable")
    ranked, owner = hashes[order], texts[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(ranked)))
    shared = np.zeros((n, n), np.int32)  # the upper triangle
    for size in range(2, DENSE_ABOVE + 1):
        at = heads[sizes == size]
        if len(at):
            members = owner[at[:, None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    low, high = np.minimum(members[:, i], members[:, j]), np.maximum(members[:, i], members[:, j])
                    pairs, times = np.unique(low * n + high, return_counts=True)
                    shared.ravel()[pairs] += times.astype(np.int32)
    many = np.flatnonzero(sizes > DENSE_ABOVE)
    step = max(1, 4_000_000 // max(n, 1))
    for k in range(0, len(many), step):
        part = many[k : k + step]
        table = np.zeros((n, len(part)), np.float32)
        columns = np.repeat(np.arange(len(part)), sizes[part])
        places = np.repeat(heads[part], sizes[part]) + np.arange(len(columns))
        places -= np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        table[owner[places], columns] = 1
        if split < n:
            shared[:split, split:] += (table[:split] @ table[split:].T).astype(np.int32)
        else:
            shared += np.triu(table @ table.T, 1).astype(np.int32)
    return shared


def verify_block(data: np.ndarray, offsets: np.ndarray, block: np.ndarray, copies: np.ndarray, size: int, threshold: float):
    """Links of each text to the others, as rows, and the least text it is joined to.

    ``block`` tells the two blocks apart; if both occur only pairs across them count. The sum
    for a text counts the copies of its partners.
    """
    order = np.argsort(block, kind="stable")
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hashes, texts = shingle_sets(data, offsets, size)
    texts = rank[texts]
    count = np.bincount(texts, minlength=n)
    split = int(np.sum(block == block.min())) if n else 0
    shared = shared_counts(hashes, texts, n, split)
    del hashes, texts
    linked = np.zeros((n, n), bool)
    for low in range(0, n, _ROWS):  # a few rows of the table at a time, as numbers of eight bytes
        some = slice(low, low + _ROWS)
        either = count[some, None] + count[None, :] - shared[some]
        linked[some] = shared[some] >= threshold * either - 1e-9
    del shared
    linked = np.triu(linked, 1)
    if split < n:
        linked[:split, :split] = False
        linked[split:, split:] = False
    linked |= linked.T
    weight = copies[order].astype(np.int64)
    links = np.concatenate([linked[low : low + _ROWS] @ weight for low in range(0, n, _ROWS)] or [np.zeros(0, np.int64)])
    root = np.arange(n)
    while True:  # least label among neighbours, then of labels, until nothing changes
        near = [np.where(linked[low : low + _ROWS], root[None, :], n).min(axis=1, initial=n) for low in range(0, n, _ROWS)]
        new = np.minimum(root, np.concatenate(near)) if near else root
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return links[rank], order[root[rank]]


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``df``: id, thash, class_id, n_links and n_copies.

    class_id is the least id of the group; n_links counts the other rows whose set is similar
    enough, copies included; n_copies counts the rows with the same set, the row included;
    thash is ``xxhash64`` of the text, which tells rows with one id apart.
    """
    bands, rows = banding(threshold, recall)
    signed = store(signatures(df, id_col, text_col, size, bands, rows))
    total = signed.count()
    classes = store(
        signed.filter("n > 0")
        .groupBy("h1", "h2")
        .agg(
            F.count("*").alias("n_copies"), F.min("id").alias("least_id"), F.min(F.struct("id", "thash")).alias("rep"),
            F.first("n").alias("n"), F.first("keys").alias("keys"),  # equal for equal sets
        )
    )
    banded = store(classes.select(F.col("h1").alias("node"), F.posexplode("keys").alias("band", "key")))
    classes = classes.drop("keys")
    hubs = banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    edges = banded.join(hubs, ["band", "key"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    candidates = components(edges)

    members = candidates.join(classes, candidates["node"] == classes["h1"])
    blocked = candidates.join(classes.select("h1", "n"), F.col("node") == F.col("h1")).groupBy("root")
    blocked = blocked.agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("k"), F.count("*").alias("size"))
    members = join_sized(members, blocked, ["root"], "size", total, "inner").select(
        "root", "h1", "h2", "n_copies", "k", F.col("rep.id").alias("id"), F.col("rep.thash").alias("thash"),
        F.pmod(F.xxhash64("h2", "h1"), "k").alias("block"),
    )
    members = store(members)

    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("thash"), text.alias("text"))
    # The plan must not turn on how many members there are: their number grows with the table.
    held = texts.join(
        members.hint("merge"), texts["id"].eqNullSafe(members["id"]) & (texts["thash"] == members["thash"])
    ).select("root", "h1", "h2", "n_copies", "k", "block", "text")
    paired = held.withColumn(
        "other", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    ).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "h1", "h2", "n_copies", "block", "text",
    )

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        _, i, j = (x.as_py() for x in key)
        if i != j and len(group["block"].unique()) == 1:  # the other block is empty; (i, i) counts the pairs inside
            group = group.slice(0, 0).combine_chunks()
            return pa.table({"h1": group["h1"], "h2": group["h2"], "links": pa.array([], pa.int64()), "to": group["h1"]})
        keys = np.stack([group["h1"].to_numpy(), group["h2"].to_numpy()], axis=1)
        _, one = np.unique(keys, axis=0, return_index=True)  # a repeated row gives its text twice
        group = group.take(pa.array(np.sort(one))).combine_chunks()
        data, offsets = text_bytes(group["text"].chunk(0))
        links, root = verify_block(
            data, offsets, group["block"].to_numpy(), group["n_copies"].to_numpy(), size, threshold
        )
        h1 = group["h1"].to_numpy()
        del data, offsets
        release()
        return pa.table({"h1": group["h1"], "h2": group["h2"], "links": pa.array(links.astype(np.int64)), "to": pa.array(h1[root])})

    verified = paired.groupBy("root", "i", "j").applyInArrow(verify, "h1 long, h2 long, links long, to long")
    verified = store(verified)
    groups = components(verified.select(F.col("h1").alias("a"), F.col("to").alias("b")))
    linked = verified.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    linked = classes.join(linked, ["h1", "h2"], "left").join(groups, F.col("h1") == F.col("node"), "left")
    linked = store(
        linked.select(
            "h1", "h2", "n_copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("root", "h1").alias("root"),
        )
    )
    named = linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("size"))
    linked = join_sized(linked, named, ["root"], "size", total, "inner").select(
        "h1", "h2", "n_copies", "class_id", (F.col("links") + F.col("n_copies") - 1).alias("n_links")
    )
    full = join_sized(signed.filter("n > 0").select("id", "thash", "h1", "h2"), linked, ["h1", "h2"], "n_copies", total, "inner")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    empty = signed.filter("n = 0").select("id", "thash", F.col("id").alias("class_id"), zero.alias("n_links"), one.alias("n_copies"))
    out = full.select("id", "thash", "class_id", "n_links", "n_copies").unionByName(empty)
    return out.withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without near duplicates: of each group the row with the least id stays.

    Rows that repeat both id and text are one document, of which one row stays. Texts
    without words are no duplicates of each other and stay. Rows without an id stay too, of
    rows equal in all columns one.
    """
    found = near_duplicates(df, id_col, text_col)
    key = F.xxhash64(F.col(text_col).cast("string"))
    out = df.filter(f"`{id_col}` IS NULL").dropDuplicates()
    known = df.filter(f"`{id_col}` IS NOT NULL")
    dropped = found.filter(f"`{id_col}` <> class_id").select(F.col(id_col).alias("__id"), F.col("thash").alias("__thash"))
    kept = known.join(dropped, (known[id_col] == F.col("__id")) & (key == F.col("__thash")), "left_anti")
    again = found.groupBy(id_col).count().filter(f"`{id_col}` IS NOT NULL AND count > 1").select(F.col(id_col).alias("__id"))
    again = store(again)
    if not again.isEmpty():
        many = kept.join(again, kept[id_col] == F.col("__id"), "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, kept[id_col] == F.col("__id"), "left_anti").unionByName(many)
    return kept.unionByName(out)
