"""Correlations of very many columns from blocked Gram matrices.

Over pairwise complete rows a coefficient needs a count, two sums, two sums of squares and a sum of
products. With missing values as zeros in X and presence as ones in M, these are the entries of
M'M, X'M, (X*X)'M and X'X. A task multiplies blocks of its rows and adds the products up in tiles of
TILE columns by TILE columns. Tiles are summed by tile pair in two steps, so that no merge holds more
than a bounded number of them, and coefficients are computed where a tile pair ends up. All pairs
of about a thousand columns take one scan; more columns take several, each over its own columns.

Values are shifted by the mean of a task's first rows, which removes common offsets, so that nothing
is read before the scan. Sums are moved to one shift where they meet; any shift gives the same
coefficients but for rounding. A column without values has pairs of count 0 and no
coefficient; a table without rows may give no pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallygrid.grid import union

#: Columns of a tile, tile pairs of one scan (0.8 MB each in a task), and rows that give a task's shift.
TILE = 128
PAIRS_PER_SCAN = 48
HEAD = 1_000
#: Tiles of so many groups of tasks are summed apart before the last sum.
GROUPS = 256
#: Numbers of a block of rows.
_BLOCK = 2_000_000
#: Sums of a tile pair, and two rows per column of either tile: its shift, and its values in the task that gave it.
_PARTIAL = "a int, b int, part int, sums binary, left binary, right binary"


def _tile_sums(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """n, Sx, Sy, Sxx, Syy, Sxy of each column of one tile with each of another."""
    return np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y])


def coefficients(sums: np.ndarray) -> np.ndarray:
    """Coefficients from the six sums; NaN below three rows or without variance."""
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(all="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx) / np.sqrt(vy)
        # Below the rounding error of the sums a variance is zero.
        known = (n >= 3) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy) & np.isfinite(r)
    return np.where(known, np.clip(r, -1.0, 1.0), np.nan)


def _shift(x: np.ndarray) -> np.ndarray:
    """Means of the columns' values; a column with one value has exactly that, one without any 0."""
    present = ~np.isnan(x)
    low, high = np.where(present, x, np.inf).min(axis=0), np.where(present, x, -np.inf).max(axis=0)
    with np.errstate(all="ignore"):
        mean = np.where(low == high, low, np.where(present, x, 0).sum(axis=0) / present.sum(axis=0))
    return np.where(np.isfinite(mean), mean, 0.0)


def _moved(sums: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The six sums with ``dx`` and ``dy`` added to the values of the left and right columns."""
    n, sx, sy, sxx, syy, sxy = sums
    dx, dy = dx[:, None], dy[None, :]
    return np.stack(
        [n, sx + n * dx, sy + n * dy, sxx + dx * (2 * sx + n * dx), syy + dy * (2 * sy + n * dy), sxy + dy * sx + dx * (sy + n * dy)]
    )


def _scan(frame: DataFrame, names: Sequence[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Partial sums of tile pairs, one row per task and pair."""
    used = sorted({t for pair in pairs for t in pair})
    columns = [c for t in used for c in names[t * TILE : (t + 1) * TILE]]
    place = {t: sum(len(names[u * TILE : (u + 1) * TILE]) for u in used[:i]) for i, t in enumerate(used)}
    width = {t: len(names[t * TILE : (t + 1) * TILE]) for t in used}
    step = max(256, _BLOCK // max(1, len(columns)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(a, b): np.zeros((6, width[a], width[b])) for a, b in pairs}
        shift, values = None, np.zeros(len(columns))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in some.columns], axis=1).astype(np.float64)
                shift = _shift(x[:HEAD]) if shift is None else shift
                x -= shift
                m = (~np.isnan(x)).astype(np.float64)
                values += m.sum(axis=0)
                x[m == 0] = 0
                part = {t: (x[:, place[t] : place[t] + width[t]], m[:, place[t] : place[t] + width[t]]) for t in used}
                for a, b in pairs:
                    sums[a, b] += _tile_sums(*part[a], *part[b])
        base = np.stack([np.zeros(len(columns)) if shift is None else shift, values])
        task = TaskContext.get().partitionId() % GROUPS
        for (a, b), value in sums.items():
            yield _partial(a, b, task, value, *(base[:, place[t] : place[t] + width[t]] for t in (a, b)))

    return frame.select(*columns).mapInArrow(work, _PARTIAL)


def _partial(a: int, b: int, part: int, sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    keys = [pa.array([v], pa.int32()) for v in (a, b, part)]
    blobs = [pa.array([v.tobytes()], pa.binary()) for v in (sums, left, right)]
    return pa.RecordBatch.from_arrays([*keys, *blobs], names=["a", "b", "part", "sums", "left", "right"])


def _base(blobs: pa.ChunkedArray) -> np.ndarray:
    """For each column the shift of the task with the most values of it, and how many these were."""
    best = None
    for blob in blobs:
        base = np.frombuffer(blob.as_buffer(), np.float64).reshape(2, -1)
        # Equal counts go to the smaller shift, whatever the order of the rows.
        best = base if best is None else np.where((base[1] > best[1]) | ((base[1] == best[1]) & (base[0] < best[0])), base, best)
    return best


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of a group's sums about one shift, and that shift of the left and right columns."""
    left, right = _base(group["left"]), _base(group["right"])
    total = np.zeros((6, left.shape[1], right.shape[1]))
    for sums, x, y in zip(group["sums"], group["left"], group["right"]):
        x, y = (np.frombuffer(v.as_buffer(), np.float64).reshape(2, -1)[0] for v in (x, y))
        total += _moved(np.frombuffer(sums.as_buffer(), np.float64).reshape(total.shape), x - left[0], y - right[0])
    return total, left, right


def pair_coefficients(frame: DataFrame, positions: Sequence[int], prefix: str = "n") -> DataFrame:
    """``i, j, r, n`` for i before j in ``positions``, from the doubles ``<prefix><pos>`` of ``frame``; NULL is missing."""
    positions = list(positions)
    names = [f"{prefix}{p}" for p in positions]
    tiles = range(-(-len(names) // TILE))
    pairs = [(a, b) for a in tiles for b in tiles if a <= b]
    scans = [_scan(frame, names, pairs[k : k + PAIRS_PER_SCAN]) for k in range(0, len(pairs), PAIRS_PER_SCAN)]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        a, b, part = (k.as_py() for k in key)
        return pa.Table.from_batches([_partial(a, b, part, *_added(group))])

    place = np.array(positions, np.int32)

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        left, right = place[a * TILE : (a + 1) * TILE], place[b * TILE : (b + 1) * TILE]
        sums, _, _ = _added(group)
        r = coefficients(sums)
        i, j = np.nonzero(np.ones(r.shape, bool) if a < b else np.triu(np.ones(r.shape, bool), 1))
        r, n = r[i, j], sums[0, i, j]
        return pa.table(
            {"i": pa.array(left[i]), "j": pa.array(right[j]), "r": pa.array(r, mask=np.isnan(r)), "n": pa.array(n.astype(np.int64))}
        )

    summed = union(scans).groupBy("a", "b", "part").applyInArrow(merge, _PARTIAL)
    return summed.groupBy("a", "b").applyInArrow(finish, "i int, j int, r double, n bigint")
