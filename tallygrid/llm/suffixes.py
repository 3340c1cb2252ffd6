"""Removal of repeated byte strings by suffix sorting in blocks, with a difference cover.

Every byte of a text is removed that lies in a string of ``length`` bytes (50) which also starts in a
document with a smaller id. Strings are judged on the whole input and never cross documents.

Sorting every suffix of a corpus would shuffle many times its size, so suffixes that cannot
matter leave first, without loss:

1. Of the 31 starts of 20-byte strings inside a 50-byte string, the one with the least hash is
   its *anchor*. It depends on the string alone, so equal strings have equal anchors, and one
   start in 16 is one. Tasks send 4-byte hashes of their anchors to buckets, once per
   document set they hold; anchors that only one document has go no further.
2. The other anchors come back to their texts, which send the 80 bytes around each to the
   bucket of its full hash: they hold all suffixes, at least 50 bytes long, that begin up to 30
   bytes before it. Within a task equal surroundings are sent once, with the least id and all
   their positions in its texts.
3. A bucket is sorted one block of suffixes at a time. Equal surroundings settle all their
   suffixes at once. Where surroundings of one anchor differ, all their suffixes are sorted
   together, by anchor, start, first bytes and then by ranks of the positions in a difference cover
   modulo 7, which are computed once for a block: every suffix reaches a cover position within
   three bytes, so it needs two integers, however long the tie. (Equal strings have equal
   anchors and so the same start; suffixes of other starts need no comparing.) Repeats are
   read from neighbours in that order, whose bytes are compared.
4. Runs to remove go to their documents' range packed in blobs, are merged there, and meet the
   texts by key. Whole copies of a text with a smaller id are found by a 128-bit hash before step 2
   and go as one run.

Defined results: a null text is empty; a text under ``length`` bytes keeps all; a null id counts as the greatest
64-bit id; rows with one id do not precede each other, and a text that repeats within itself or
under its own id keeps it; an empty table gives an empty table. Only the
named columns are read, so other columns cannot clash. Repeated rows are each reported. A very long text is one block of
its task. Where an id stands for several texts (a null id, say), 64-bit hashes tell these apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.links import join_sized
from tallygrid.llm.textblock import blocks, mix, prefix_hash, span_hash, text_bytes
from tallygrid.session import store

LENGTH = 50
GRAM = 20
#: A difference cover modulo 7: every difference is one of two of its members.
COVER, PERIOD = (0, 1, 3), 7
#: Anchors that a task gathers before it sends them, and about how many a bucket gets.
SENT = 1_000_000
BUCKET = 1_500_000
#: Surroundings sorted at a time, and about how many a bucket gets.
BLOCK = 20_000
CONTEXTS = 150_000
#: Ids that stand for several texts, up to which their list is broadcast.
MAX_SHARED_IDS = 200_000
#: Bytes of runs that a range of documents gets.
RANGE_BYTES = 16_000_000
_NULL = np.iinfo(np.int64).max


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Hashes, positions and texts of the anchors of a block."""
    width = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    starts = np.arange(len(data) - gram + 1)
    hashes = span_hash(prefix_hash(data), starts, starts + gram) | np.uint64(1)
    least = _sliding(hashes, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(chosen[: len(hashes)] == hashes)
    return hashes[at], at, np.searchsorted(offsets, at, "right") - 1


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and where each group begins in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins, in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every size, one after the other."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - sizes), sizes)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of values by significance: high bytes, mostly zero, stand together and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _send_anchors(buckets: int, length: int, gram: int):
    """Pass 1: per bucket, a blob of (4-byte hash, position) by document."""

    def out(found: list) -> Iterator[pa.RecordBatch]:
        hashes, at, ids, tags = (np.concatenate(c) for c in zip(*found))
        bucket = ((hashes >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, tags, ids, bucket))
        bucket, ids, tags = bucket[order], ids[order], tags[order]
        short, at = hashes[order].astype(np.uint32), at[order].astype(np.uint32)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        stops = np.append(edges[1:], len(bucket))
        rows = []
        for i, j in zip(edges.tolist(), stops.tolist()):
            heads = _heads(ids[i:j], tags[i:j])
            counts = np.diff(np.append(heads, j - i)).astype(np.uint32)
            docs = np.stack([ids[i:j][heads], tags[i:j][heads]])
            rows.append((int(bucket[i]), _planes(docs.ravel()), _planes(counts), short[i:j].tobytes(), _planes(at[i:j])))
        columns = [pa.array(list(c)) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "docs", "counts", "hashes", "places"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch, data, offsets in blocks(batches, "text"):
            hashes, at, texts = anchors(data, offsets, length, gram)
            if len(at):
                found.append((hashes, at - offsets[texts], _ids(batch.column(0))[texts], _ids(batch.column(1))[texts]))
                held += len(at)
            if held >= SENT:
                yield from out(found)
                found, held = [], 0
        if held:
            yield from out(found)

    return work


def _joined(column: pa.ChunkedArray, kind, planes: bool = True) -> np.ndarray:
    read = _unplanes if planes else np.frombuffer
    return np.concatenate([read(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _docs(column: pa.ChunkedArray) -> np.ndarray:
    """Ids and tags of the documents of blobs, two columns."""
    return np.concatenate([_unplanes(x.as_buffer(), np.int64).reshape(2, -1).T for x in column] or [np.zeros((0, 2), np.int64)])


def _shared_anchors(group: pa.Table, ranges: int) -> pa.Table:
    """Of a bucket's anchors, those that more than one id has: positions, packed by range of documents."""
    docs = np.repeat(_docs(group["docs"]), _joined(group["counts"], np.uint32), axis=0)
    hashes, at = _joined(group["hashes"], np.uint32, False), _joined(group["places"], np.uint32)
    order, heads = _grouped(hashes)
    ids = docs[order, 0]
    least, most = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
    sizes = np.diff(np.append(heads, len(order)))
    taken = order[np.repeat(least != most, sizes)]
    return _packed(_by_range(docs[taken, 0], docs[taken, 1], at[taken].astype("<u4"), ranges))


def _numbered(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each document and, by number, one of its places."""
    order = np.lexsort((tags, ids))
    heads = _heads(ids[order], tags[order])
    number = np.empty(len(ids), np.int64)
    number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    return number, order[heads]


def _merged(number: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of each document as maximal runs."""
    shift = number << 33  # no run reaches into the next document's range
    whole = merged_runs(runs.astype(np.int64) + shift[:, None])
    number = whole[:, 0] >> 33
    return number, (whole - (number << 33)[:, None]).astype("<u4")


def _by_doc(ids: np.ndarray, tags: np.ndarray, values: np.ndarray) -> pa.Table:
    if not len(ids):
        return pa.table({"key": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
    number, place = _numbered(ids, tags)
    if values.ndim == 2:
        number, values = _merged(number, values)
    order, heads = _grouped(number)
    values, names = values[order], place[number[order][heads]]
    stops = np.append(heads[1:], len(order))
    found = [values[i:j].tobytes() for i, j in zip(heads.tolist(), stops.tolist())]
    return pa.table({"key": pa.array(ids[names]), "tag": pa.array(tags[names]), "found": pa.array(found, pa.binary())})


def _by_range(ids: np.ndarray, tags: np.ndarray, values: np.ndarray, ranges: int) -> list[tuple]:
    """Positions, or runs as maximal runs, packed for ranges of documents: (range, ids with tags and counts, values)."""
    if not len(ids):
        return []
    number, place = _numbered(ids, tags)
    if values.ndim == 2:
        number, values = _merged(number, values)
    else:
        order = np.argsort(number, kind="stable")
        number, values = number[order], values[order]
    heads = _heads(number)
    counts = np.diff(np.append(heads, len(number)))
    names = place[number[heads]]
    target = (mix(ids[names].astype(np.uint64) * np.uint64(3) + tags[names].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order, edges = _grouped(target)
    out = []
    for i, j in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        some = order[i:j]
        docs = np.stack([ids[names[some]], tags[names[some]], counts[some]])
        part = values[_spread(heads[some], counts[some])]
        out.append((int(target[some[0]]), _planes(docs.ravel()), _planes(part.ravel())))
    return out


def _packed(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
    return pa.table(columns, names=["target", "docs", "runs"])


def _gather(width: int):
    """All values of each document of a range, of ``width`` integers each: (key, tag, found)."""

    def work(group: pa.Table) -> pa.Table:
        heads = [_unplanes(x.as_buffer(), np.int64).reshape(3, -1) for x in group["docs"]]
        ids, tags, counts = np.concatenate(heads, axis=1)
        values = np.concatenate([_unplanes(x.as_buffer(), "<u4") for x in group["runs"]])
        return _by_doc(np.repeat(ids, counts), np.repeat(tags, counts), values.reshape(-1, 2) if width == 2 else values)

    return work


def _send_contexts(buckets: int, ranges: int, length: int, gram: int):
    """Pass 2: the surroundings of shared anchors, per bucket, and runs already settled (``docs``, ``runs``), anywhere."""
    side, width = length - gram, 2 * (length - gram) + gram

    def out(found: list) -> Iterator[pa.RecordBatch]:
        around, before, after, ids, tags, at, hashes = (np.concatenate(c) for c in zip(*found))
        key = _context_key(around, before, after, hashes)
        order = np.lexsort((tags, ids, key))
        same = _same(key, around, order)
        heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        settled = ids[order] > ids[order][heads]  # a smaller id here has the same surroundings
        gone, left = order[settled], np.flatnonzero(~settled)
        runs = np.stack([at[gone] - before[gone], at[gone] + gram + after[gone]], axis=1).astype("<u4")
        packed = _by_range(ids[gone], tags[gone], runs, ranges)
        if packed:
            target, docs, runs = zip(*packed)
            blank = pa.array([None] * len(packed), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t % buckets for t in target]), pa.array(target), pa.array(docs), pa.array(runs), blank, blank, blank],
                names=["bucket", "target", "docs", "runs", "heads", "places", "around"],
            )
        # One row for each text of the least id, with all positions that have these surroundings.
        new = ~same[left]
        for doc in (ids, tags):
            new[1:] |= doc[order[left[1:]]] != doc[order[left[:-1]]]
        left, first = order[left], np.flatnonzero(new)
        sent, times = left[first], np.diff(np.append(first, len(left)))
        bucket = ((hashes[sent] >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        sent, times, first, bucket = sent[by], times[by], first[by], bucket[by]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        stops = np.append(edges[1:], len(bucket))
        rows = []
        for i, j in zip(edges.tolist(), stops.tolist()):
            some = sent[i:j]
            head = np.stack([hashes[some].view(np.int64), ids[some], tags[some], times[i:j], before[some] << 8 | after[some]])
            places = at[left[_spread(first[i:j], times[i:j])]].astype(np.uint32)
            rows.append((int(bucket[i]), None, None, None, _planes(head.ravel()), _planes(places), zlib.compress(around[some].tobytes(), 1)))
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "target", "docs", "runs", "heads", "places", "around"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch, data, offsets in blocks(batches, "text"):
            padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side + gram, np.uint8)])
            ids, tags = _ids(batch.column(0)), _ids(batch.column(1))
            lists = batch.column(batch.schema.get_field_index("found")).to_pylist()
            at = [np.unique(np.frombuffer(x, "<u4")).astype(np.int64) for x in lists]
            texts = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            sizes = np.diff(offsets)
            fits = at + gram <= sizes[texts]  # an id may stand for several texts
            at, texts = at[fits], texts[fits]
            if len(at):
                place = offsets[texts] + at
                before, after = np.minimum(at, side), np.minimum(sizes[texts] - at - gram, side)
                around = padded[place[:, None] + np.arange(width)]
                column = np.arange(width)
                around[(column < side - before[:, None]) | (column >= side + gram + after[:, None])] = 0
                prefix = prefix_hash(data)
                hashes = span_hash(prefix, place, place + gram)
                found.append((around, before, after, ids[texts], tags[texts], at, hashes))
                held += len(at)
            if held >= SENT // 8:
                yield from out(found)
                found, held = [], 0
        if held:
            yield from out(found)

    return work


def _context_key(around: np.ndarray, before: np.ndarray, after: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64-bit key of surroundings: equal for equal anchors with equal bytes on both sides."""
    width = around.shape[1]
    padded = np.zeros((len(around), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = around
    words = padded.view(np.uint64)
    key = mix(hashes ^ (before * 256 + after).astype(np.uint64))
    for k in range(words.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ words[:, k])
    return key


def _same(key: np.ndarray, around: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows, in an order by key, have the surroundings of the row before; bytes are compared where keys agree."""
    same = np.zeros(len(order), bool)
    at = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    for low in range(0, len(at), BLOCK):
        some = at[low : low + BLOCK]
        same[some + 1] = (around[order[some + 1]] == around[order[some]]).all(axis=1)
    return same


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks from 0 of values, equal for equal ones."""
    return np.unique(values, return_inverse=True)[1].reshape(values.shape)


def cover_ranks(words: np.ndarray, places: list[int]) -> dict[int, np.ndarray]:
    """For each of the places, the ranks of all rows by their bytes from there on.

    ``words`` has the eight bytes from every position of a row as a number. A rank pairs the word at
    its place with the rank eight bytes on, so places that are a multiple of eight apart share theirs.
    """
    n, width = words.shape
    ranks: dict[int, np.ndarray] = {}
    for p in sorted({q for p in places for q in range(p, width, 8)}, reverse=True):
        rank = _dense(words[:, p])
        ranks[p] = _dense(rank * (n + 1) + ranks[p + 8]) if p + 8 in ranks else rank
    return {p: ranks[p] for p in places}


def sort_suffixes(around: np.ndarray, anchor: np.ndarray, valid: np.ndarray, length: int):
    """(rows, starts, new): the valid suffixes in order, and which of them begin a group of equal strings.

    ``valid`` tells for every row and start whether a string of ``length`` bytes may begin there. Suffixes
    are ordered by anchor, start, first bytes, and the rank of the next cover position.
    """
    n, width = around.shape
    padded = np.zeros((n, width + 8), np.uint8)
    padded[:, :width] = around
    words = np.zeros((n, width), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[:, k : k + width].astype(np.uint64)
    shift = [next(s for s in range(PERIOD) if (i + s) % PERIOD in COVER) for i in range(valid.shape[1])]
    ranks = cover_ranks(words, sorted({i + s for i, s in enumerate(shift)}))
    order = np.empty(valid.shape, np.int64)
    for start, s in enumerate(shift):
        first = (words[:, start] >> np.uint64(64 - 8 * s)).astype(np.int64) if s else 0
        order[:, start] = first * (n + 1) + ranks[start + s]
    rows, starts = np.nonzero(valid)
    group = anchor[rows] * valid.shape[1] + starts
    by = np.lexsort((order[rows, starts], group))
    rows, starts, group = rows[by], starts[by], group[by]
    new = np.ones(len(rows), bool)
    head = words[rows, starts]
    alike = np.flatnonzero((group[1:] == group[:-1]) & (head[1:] == head[:-1]))
    column = np.arange(length)
    for low in range(0, len(alike), BLOCK):
        some = alike[low : low + BLOCK]
        one, two = (around[rows[k][:, None], starts[k][:, None] + column] for k in (some, some + 1))
        new[some + 1] = (one != two).any(axis=1)
    return rows, starts, new


def _repeated(ranges: int, length: int, gram: int):
    side, width = length - gram, 2 * (length - gram) + gram

    def work(group: pa.Table) -> pa.Table:
        past = group.filter(pc.is_valid(group["docs"])).select(["target", "docs", "runs"])
        group = group.filter(pc.is_null(group["docs"]))
        if not group.num_rows:
            return past
        head = np.concatenate([_unplanes(x.as_buffer(), np.int64).reshape(5, -1).T for x in group["heads"]])
        around = np.concatenate([np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8).reshape(-1, width) for x in group["around"]])
        hashes, ids, tags, times = head[:, 0].copy().view(np.uint64), head[:, 1], head[:, 2], head[:, 3]
        before, after = head[:, 4] >> 8, head[:, 4] & 255
        at, placed = _joined(group["places"], np.uint32).astype(np.int64), np.cumsum(times) - times
        runs, owners = [], []

        def remove(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            """Runs relative to the anchor, at every position of the rows."""
            places, n = at[_spread(placed[rows], times[rows])], times[rows]
            runs.append(np.stack([places + np.repeat(first, n), places + np.repeat(last, n)], axis=1))
            owners.append(np.repeat(rows, n))

        key = _context_key(around, before, after, hashes)
        order = np.lexsort((tags, ids, key))
        new = ~_same(key, around, order)
        heads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        settled = ids[order] > ids[order][heads]
        gone = order[settled]
        remove(gone, -before[gone], gram + after[gone])

        # One row for each kind of surroundings, of the least id, where an anchor has several kinds.
        # Of what differs only in part, each of them stands for all rows of its kind and id, which follow it.
        kinds = np.flatnonzero(new)
        alike = np.add.reduceat(~settled, kinds, dtype=np.int64)
        by = np.argsort(hashes[order[kinds]], kind="stable")
        kinds, alike = kinds[by], alike[by]
        _, heads = _grouped(hashes[order[kinds]])
        sizes = np.diff(np.append(heads, len(kinds)))
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):  # one block of suffixes at a time, whole anchors in each
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right")))
            anchor = np.repeat(np.arange(i, j), sizes[i:j])
            several = np.repeat(sizes[i:j] > 1, sizes[i:j])
            block = slice(ends[i - 1] if i else 0, ends[j - 1])
            kind, like, anchor = kinds[block][several], alike[block][several], anchor[several]
            rows = order[kind]
            i = j
            if not len(rows):
                continue
            # The suffix begins `side - start` bytes before the anchor, and must lie in the text.
            start = np.arange(side + 1)
            valid = (side - start <= before[rows][:, None]) & (length - gram - (side - start) <= after[rows][:, None])
            place, start, new = sort_suffixes(around[rows], anchor, valid, length)
            if not len(place):
                continue
            first = np.flatnonzero(new)
            owner = ids[rows[place]]
            least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(place))))
            hit = owner > least
            least_start, last_start = np.full(len(rows), side + 1), np.full(len(rows), -1)
            np.minimum.at(least_start, place[hit], start[hit])
            np.maximum.at(last_start, place[hit], start[hit])
            # All starts lie within ``side`` < ``length`` bytes, so their strings overlap: one run.
            hit = np.flatnonzero(last_start >= 0)
            begin, end = least_start[hit] - side, last_start[hit] - side + length
            remove(order[_spread(kind[hit], like[hit])], np.repeat(begin, like[hit]), np.repeat(end, like[hit]))
        owners = np.concatenate(owners)
        packed = _packed(_by_range(ids[owners], tags[owners], np.concatenate(runs).astype("<u4"), ranges))
        return pa.concat_tables([past, packed])

    return work


def merged_runs(pairs: np.ndarray) -> np.ndarray:
    """Union of runs (first, last), as maximal runs."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    return np.stack([pairs[heads, 0], np.maximum.reduceat(pairs[:, 1], heads)], axis=1)


def _apply(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "text"):
            raw = data.tobytes()
            rows = []
            for i, found in enumerate(batch.column(batch.schema.get_field_index("found")).to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                runs = merged_runs(np.frombuffer(b"".join(found or []), "<u4").astype(np.int64).reshape(-1, 2))
                kept, done = [], 0
                for first, last in runs.tolist():
                    kept.append(text[done:first])
                    done = last
                kept = b"".join(kept) + text[done:]
                rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [pa.array(list(c)) for c in zip(*rows)]
            columns[4] = columns[4].cast(pa.binary())
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return work


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True
) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked.

    Kept bytes need not be valid UTF-8: a removed run may end inside a character.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    hashes = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]
    key = F.coalesce("id", F.lit(int(_NULL)))
    rows = store(docs.select(key.alias("key"), *hashes, F.octet_length("text").alias("n")))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tagged = _tags(rows)
    docs = tagged(docs.select("id", key.alias("key"), hashes[0], "text")).select("key", "tag", "id", "text")

    # Whole texts that a smaller id has too go as one run, and need no sorting.
    first = rows.groupBy("t1", "t2").agg(F.min("key").alias("first"), F.count("*").alias("m")).filter("m > 1")
    copies = join_sized(tagged(rows.filter(F.col("n") >= length)), first, ["t1", "t2"], "m", count, "inner")
    copies = store(copies.filter("key > first").select("key", "tag").distinct())

    density = 2 / (length - gram + 2)
    buckets = max(1, round(total * density / BUCKET))
    schema = "bucket long, docs binary, counts binary, hashes binary, places binary"
    sent = docs.select("key", "tag", "text").mapInArrow(_send_anchors(buckets, length, gram), schema)
    ranges = max(1, round(total * density * 4 / RANGE_BYTES))
    packed = "target long, docs binary, runs binary"
    shared = sent.groupBy("bucket").applyInArrow(lambda group: _shared_anchors(group, ranges), packed)
    # Lists of one document are no longer than its text.
    by_doc = store(shared.groupBy("target").applyInArrow(_gather(1), "key long, tag long, found binary"))
    anchors_left = by_doc.agg(F.coalesce(F.sum(F.octet_length("found")) / 4, F.lit(0))).first()[0]
    by_doc = by_doc.join(copies, ["key", "tag"], "left_anti")
    held = docs.join(by_doc.hint("merge"), ["key", "tag"]).select("key", "tag", "text", "found")
    buckets = max(1, round(anchors_left / CONTEXTS))
    ranges = max(1, round(anchors_left * 8 / RANGE_BYTES))
    schema = "bucket long, target long, docs binary, runs binary, heads binary, places binary, around binary"
    around = held.mapInArrow(_send_contexts(buckets, ranges, length, gram), schema)
    runs = around.groupBy("bucket").applyInArrow(_repeated(ranges, length, gram), packed)
    runs = runs.groupBy("target").applyInArrow(_gather(2), "key long, tag long, found binary")
    runs = runs.unionByName(copies.select("key", "tag", F.unhex(F.lit("00000000FFFFFFFF")).alias("found")))
    runs = runs.groupBy("key", "tag").agg(F.collect_list("found").alias("found"))
    joined = docs.join(runs.hint("merge"), ["key", "tag"], "left").select("id", "text", "found")
    out = joined.mapInArrow(_apply(keep_bytes), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if keep_bytes else out.drop("kept")).withColumnRenamed("id", id_col)


def _tags(rows: DataFrame):
    """A function that adds ``tag`` to rows of key and t1: 0, or the text's hash where an id stands for several texts.

    The list of these ids is broadcast up to MAX_SHARED_IDS of them; beyond that all texts are tagged.
    """
    several = rows.groupBy("key").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).filter("a <> b")
    several = store(several.select("key", F.lit(True).alias("several")))
    n = several.count()
    if not n:
        return lambda df: df.withColumn("tag", F.lit(0).cast("long"))
    if n > MAX_SHARED_IDS:
        return lambda df: df.withColumn("tag", F.col("t1"))
    return lambda df: df.join(F.broadcast(several), "key", "left").withColumn("tag", F.when(F.col("several"), F.col("t1")).otherwise(0)).drop("several")
