"""Hard negatives by segment summaries of vectors.

For an anchor, the rows of its label with the greatest inner products are its positives. For an
anchor and a positive, the best rows of other labels are its negatives, as long as their score
is within a band of shares of the positive's score: similar, but not so that the label is doubted.

Each vector is cut into equal segments of its components, and the mean and deviation of every
segment are stored beside it. For one segment of L components the inner product of two
vectors is L * mean * mean, plus or minus at most L * deviation * deviation. So a few numbers a
vector bound a score from both sides. The bounds are refined hierarchically, from one segment
over the whole vector to FINEST segments, coarser summaries being pooled from the stored ones.
Only pairs whose bounds still reach a place among the best so far, and the band, are scored
exactly, in integers.

The anchors are a stated query set, searched against all rows. They are dealt into rounds of at
most ANCHOR_BYTES, whatever their number. A round broadcasts its anchors, scans the rows once
for positives and once for negatives, and shuffles nothing but the few best rows that each
task found for an anchor. The results of a round are written before the next one begins.

Rows without an id, label or vector, or with a null or non-finite component, take no part; nor
do vectors so long that a score might not fit 64 bits. Vectors of fewer components count as
ending in zeros. Repeated rows are rows of their own: a row is never its own positive, but a
copy of it can be. Ties go to the smaller id, then to the row's content. Fewer rows than asked
give fewer results; an empty table or one without anchors gives an empty table. Only the named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.session import prepare, store

POSITIVES, NEGATIVES = 5, 10
#: The band of negative scores, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Components become floor(SCALE * x).
SCALE = 256
#: Segments of the levels, coarse to fine; the summaries of the last one are stored.
LEVELS = (1, 4, 16)
FINEST = LEVELS[-1]
#: Bytes of anchor vectors that one round broadcasts; bounds memory, not results.
ANCHOR_BYTES = 32_000_000
#: Anchors and rows that are scored at once.
TILE_ANCHORS, TILE_ROWS = 256, 4_096
#: Beyond this share of pairs left by a level a whole product is cheaper than single pairs.
DENSE = 0.1
_NEVER = np.iinfo(np.int64).min


def summarise(vectors: np.ndarray, segments: int = FINEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row, and the segments' lengths."""
    width = vectors.shape[1]
    cuts = np.linspace(0, width, segments + 1).astype(np.int64)
    sizes = np.diff(cuts)
    mean, spread = np.zeros((len(vectors), segments)), np.zeros((len(vectors), segments))
    for s in np.flatnonzero(sizes):
        part = vectors[:, cuts[s] : cuts[s + 1]]
        mean[:, s], spread[:, s] = part.mean(axis=1), part.std(axis=1)
    return mean, spread, sizes


def pool(mean: np.ndarray, spread: np.ndarray, sizes: np.ndarray, segments: int):
    """The summaries of fewer segments, from those of more: squares of deviations and of means add up."""
    share = len(sizes) // segments
    some = sizes.reshape(segments, share)
    total = np.maximum(some.sum(axis=1), 1)
    weight = some / total[:, None]
    mean, spread = (x.reshape(len(x), segments, share) for x in (mean, spread))
    whole = (mean * weight).sum(axis=2)
    square = ((spread**2 + (mean - whole[:, :, None]) ** 2) * weight).sum(axis=2)
    return whole, np.sqrt(square), some.sum(axis=1)


class Summed:
    """Vectors as whole numbers with the levels' summaries, scaled by the roots of segment lengths."""

    def __init__(self, vectors: np.ndarray, stored: tuple[np.ndarray, np.ndarray] | None = None):
        self.vectors = vectors
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        cuts = np.linspace(0, vectors.shape[1], FINEST + 1).astype(np.int64)
        mean, spread = stored or summarise(vectors.astype(np.float64))[:2]
        self.levels = []
        for segments in LEVELS:
            m, d, sizes = pool(mean, spread, np.diff(cuts), segments)
            root = np.sqrt(sizes)
            self.levels.append((m * root, d * root))

    def part(self, some: slice) -> "Summed":
        out = object.__new__(Summed)
        out.vectors, out.norm = self.vectors[some], self.norm[some]
        out.levels = [(m[some], d[some]) for m, d in self.levels]
        return out


def exact_type(longest: float):
    """A number type whose products and sums are exact for vectors whose squares sum to ``longest``."""
    return np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else np.int64


def candidate_scores(anchors: Summed, rows: Summed, wanted: np.ndarray, least: np.ndarray, most: np.ndarray, kind):
    """(anchor, row, score) of all ``wanted`` pairs that may score from ``least`` to ``most`` of their anchor."""
    slack = 1e-6 * np.outer(anchors.norm, rows.norm) + 1e-3  # rounding of the bounds
    alive = wanted
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels):
        left = int(alive.sum())
        if left > DENSE * alive.size:
            middle, around = am @ rm.T, ad @ rd.T + slack
            alive = alive & (middle + around >= least[:, None]) & (middle - around <= most[:, None])
        elif left:
            a, r = np.nonzero(alive)
            middle = np.einsum("ij,ij->i", am[a], rm[r])
            around = np.einsum("ij,ij->i", ad[a], rd[r]) + slack[a, r]
            keep = (middle + around >= least[a]) & (middle - around <= most[a])
            alive = np.zeros_like(alive)
            alive[a[keep], r[keep]] = True
    a, r = np.nonzero(alive)
    if len(a) > DENSE * alive.size:
        score = (anchors.vectors.astype(kind) @ rows.vectors.astype(kind).T)[a, r]
    else:
        score = np.einsum("ij,ij->i", anchors.vectors[a].astype(kind), rows.vectors[r].astype(kind))
    return a, r, score.astype(np.int64)


class Best:
    """The ``size`` best rows of each of ``n`` groups: by score, then the smaller id, tie and row number."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.rows = np.zeros((5, 0), np.int64)  # group, -score, id, tie, row
        self.last = np.full(n, _NEVER, np.int64)  # score of the last place, if all are taken
        self.last_id = np.full(n, np.iinfo(np.int64).max, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        fits = (score > self.last[group]) | ((score == self.last[group]) & (ids <= self.last_id[group]))
        if not fits.any():
            return
        new = np.stack([x[fits] for x in (group, -score, ids, tie, row)])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        heads = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.size else np.zeros(0, np.int64)
        rank = np.arange(rows.shape[1]) - np.repeat(heads, np.diff(np.append(heads, rows.shape[1])))
        self.rows = rows[:, rank < self.size]
        full = rows[:, rank == self.size - 1]
        self.last[full[0]], self.last_id[full[0]] = -full[1], full[2]


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column as a table, rows filled up with zeros."""
    column = batch.column(batch.schema.get_field_index(name))
    at, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return flat[at[0] : at[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(owner)) - np.repeat(at[:-1] - at[0], sizes)] = flat[at[0] : at[-1]]
    return out


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, q (floor(scale * x) of each component) and tie of the rows that take part."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & finite)
    q = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), q.alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("square", square).filter(F.col("square") < float(1 << 62)).withColumn("tie", F.xxhash64("label", "q"))


def index_vectors(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """The stored index: rows with a number and segment summaries; the greatest width and square."""
    width, longest = rows.agg(F.max(F.size("q")), F.max("square")).first()
    width = width or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, spread, _ = summarise(_vectors(batch, "q", width).astype(np.float64))
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * FINEST)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (mean, spread)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "mean", "deviation"])

    label = rows.schema["label"].dataType.simpleString()
    numbered = rows.select("id", "label", "tie", F.monotonically_increasing_id().alias("row"), "q")
    schema = f"id long, label {label}, tie long, row long, q array<long>, mean array<double>, deviation array<double>"
    return store(numbered.mapInArrow(work, schema)), width, longest or 0.0


def _codes(values: list, known: dict) -> np.ndarray:
    """Labels as the numbers of the anchors' labels; others -1."""
    return np.fromiter((known.get(v, -1) for v in values), np.int64, len(values))


def _search(index: DataFrame, width: int, longest: float, anchors: dict, slots: int, limits, size: int) -> DataFrame:
    """The ``size`` best rows of every anchor and slot that each task finds.

    ``limits`` is None (rows of the anchor's label, one slot) or (least, most), tables of scores by anchor and
    slot, for rows of other labels.
    """
    kind = exact_type(longest)
    shared = index.sparkSession.sparkContext.broadcast((anchors, limits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, band = shared.value
        summed = Summed(held["q"])
        n = len(held["row"])
        chunks = [slice(first, min(first + TILE_ANCHORS, n)) for first in range(0, n, TILE_ANCHORS)]
        asked = [summed.part(one) for one in chunks]
        bests = [Best((one.stop - one.start) * slots, size) for one in chunks]
        for batch in batches:
            labels = _codes(batch.column(1).to_pylist(), held["labels"])
            ids, tie, row = (batch.column(k).to_numpy() for k in (0, 2, 3))
            every = Summed(_vectors(batch, "q", width), (_vectors(batch, "mean", FINEST), _vectors(batch, "deviation", FINEST)))
            for low in range(0, batch.num_rows, TILE_ROWS):
                some = slice(low, low + TILE_ROWS)
                tile = every.part(some)
                for one, some_asked, best in zip(chunks, asked, bests):
                    same = held["label"][one][:, None] == labels[some][None, :]
                    last = best.last.reshape(-1, slots)
                    if band is None:
                        wanted = same & (held["row"][one][:, None] != row[some][None, :])
                        least, most = last[:, 0], np.full(len(last), np.iinfo(np.int64).max)
                    else:
                        wanted = ~same
                        least = np.maximum(band[0][one], last).min(axis=1)
                        most = band[1][one].max(axis=1)
                    a, r, score = candidate_scores(some_asked, tile, wanted, least, most, kind)
                    for slot in range(slots):
                        if band is None:
                            fits = slice(None)
                        else:
                            fits = (score >= band[0][one][a, slot]) & (score <= band[1][one][a, slot])
                        at = low + r[fits]
                        best.add(a[fits] * slots + slot, score[fits], ids[at], tie[at], row[at])
        for one, best in zip(chunks, bests):
            group, score, ids, tie, row = best.rows
            columns = [held["row"][one][group // slots], group % slots, -score, ids, tie, row]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "score", "id", "tie", "row"])

    found = index.mapInArrow(work, "anchor long, slot long, score long, id long, tie long, row long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "tie", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = (LOW, HIGH),
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``.
    """
    spark = prepare(df.sparkSession)
    index, width, longest = index_vectors(whole_vectors(df, id_col, vector_col, label_col, scale))
    asked = store(index.filter(is_anchor).withColumn("hash", F.xxhash64("row")))
    count = asked.count()
    rounds = math.ceil(count * max(1, 8 * width + 16 * FINEST) / ANCHOR_BYTES)
    parts = []
    for k in range(rounds):
        some = asked.filter(F.pmod("hash", F.lit(rounds)) == k).select("row", "id", "label", "q").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        batch = some.to_batches()[0]
        known = {v: i for i, v in enumerate(dict.fromkeys(batch.column(2).to_pylist()))}
        held = {
            "row": batch.column(0).to_numpy(), "label": _codes(batch.column(2).to_pylist(), known), "labels": known,
            "q": _vectors(batch, "q", width),
        }
        near = store(_search(index, width, longest, held, 1, None, positives).select("anchor", "rank", "score", "id"))
        rank = near.select("anchor", "rank", "score").toPandas()  # at most ``positives`` rows an anchor of this round
        places = np.argsort(held["row"])
        place = places[np.searchsorted(held["row"], rank["anchor"].to_numpy(), sorter=places)]
        least = np.full((len(places), positives), np.iinfo(np.int64).max)
        most = np.full((len(places), positives), _NEVER)
        score = rank["score"].to_numpy().astype(object)  # times 100 may not fit 64 bits
        slot = rank["rank"].to_numpy() - 1
        least[place, slot] = (-(-band[0] * score // 100)).astype(np.int64)
        most[place, slot] = (band[1] * score // 100).astype(np.int64)
        far = _search(index, width, longest, held, positives, (least, most), negatives)
        far = far.select("anchor", "slot", F.col("rank").alias("place"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
        names = asked.filter(F.pmod("hash", F.lit(rounds)) == k).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = near.join(names, "anchor").select(
            "anchor", (F.col("rank") - 1).cast("long").alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        parts.append(
            store(
                far.join(pairs, ["anchor", "slot"]).select(
                    "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
                )
            )
        )
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
