"""Blocked Gram matrices against numpy, over several tiles, tasks and scans."""

import math

import numpy as np
import pytest

import tallygrid as tg
from tallygrid.operators import correlation, gram


def frame(spark, table, partitions=4):
    rows = [[None if math.isnan(x) else float(x) for x in row] for row in table]
    return spark.createDataFrame(rows, ", ".join(f"n{i} double" for i in range(table.shape[1]))).repartition(partitions)


def brute(table):
    out = {}
    for i in range(table.shape[1]):
        for j in range(i + 1, table.shape[1]):
            both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
            x, y = table[both, i], table[both, j]
            flat = len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0
            out[i, j] = (None if flat else np.corrcoef(x, y)[0, 1], int(both.sum()))
    return out


def found(df):
    return {(r["i"], r["j"]): (r["r"], r["n"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (r is None), (k, got[k], r, n)
        assert r is None or math.isclose(got[k][0], r, rel_tol=1e-8, abs_tol=1e-9)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    out = rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) + 1e6 * rng.normal(size=40)
    out[rng.random(out.shape) < 0.2] = np.nan
    out[:, 3] = np.nan
    out[:, 5] = 17.25
    out[2:, 7] = np.nan
    out[:, 9] = -2 * out[:, 8]
    return out


def test_tiles_equal_numpy(spark, table, monkeypatch):
    want = brute(table)
    same(found(gram.pair_coefficients(frame(spark, table), range(40))), want)
    monkeypatch.setattr(gram, "TILE", 16)
    monkeypatch.setattr(gram, "PAIRS_PER_SCAN", 4)
    monkeypatch.setattr(gram, "GROUPS", 2)
    monkeypatch.setattr(gram, "_BLOCK", 100)
    same(found(gram.pair_coefficients(frame(spark, table), range(40))), want)


def test_three_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(120, 300)).round(3)
    pairs = gram.pair_coefficients(frame(spark, table, 3), range(300))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = np.corrcoef(table.T)
    rows = pairs.toPandas()
    assert len(rows) == 300 * 299 // 2 and (rows["n"] == 120).all()
    assert np.allclose(rows["r"], want[rows["i"], rows["j"]], atol=1e-10)


def test_both_ways_agree(spark, table, monkeypatch):
    df = frame(spark, table[:, :12])
    want = correlation._upper_triangle(df, list(range(12)), "n")
    same(found(gram.pair_coefficients(df, range(12))), want)


def test_tables_without_rows(spark):
    empty = frame(spark, np.zeros((1, 3))).limit(0)
    assert set(found(gram.pair_coefficients(empty, range(3))).values()) <= {(None, 0)}


def test_seventeen_columns_are_read_once(spark, table):
    """A frame that shuffles to be made is made once; tasks of very different offsets meet in one shift."""
    reads = spark.sparkContext.accumulator(0)
    rows = np.where(np.arange(400)[:, None] < 40, table[:, :17] + 5e7, table[:, :17])

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    plain = frame(spark, rows, 4).repartitionByRange(4, "n0")
    names = [f"n{i}" for i in range(17)]
    watched = plain.mapInArrow(counted, plain.schema)
    g = tg.grid(watched, names=names)
    pairs = correlation.pair_table(g, range(17), numbers=watched)
    got = found(pairs)
    assert found(pairs) == got and reads.value == 400
    same(got, brute(rows))
