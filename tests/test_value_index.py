"""The ordered index of values against plain Python, over many zones."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import tallygrid as tg
from tallygrid.operators import histogram, numeric
from tallygrid.operators.value_index import value_index

rng = random.Random(6)
N = 3_000
COLUMNS = {
    0: [rng.gauss(0, 1) for _ in range(N)],
    1: [float(rng.choice([1, 1, 1, 1, 2, 9])) for _ in range(N)],  # one value fills most of the column
    2: [math.inf if i % 5 == 0 else -math.inf if i % 5 == 1 else float(i % 40) for i in range(N)],
    3: [None] * N,
    4: [-7.5] * N,
    5: [10.0 ** rng.randint(-200, 200) * rng.choice([1, -1]) for _ in range(N)],
    6: [-0.0 if i % 2 else 0.0 for i in range(N)],
}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, *values) for i, values in enumerate(zip(*COLUMNS.values()))]
    df = spark.createDataFrame(rows, "rid long, " + ", ".join(f"a{i} double" for i in COLUMNS)).repartition(6)
    return tg.grid(df, ["rid"], distinct_order=True, columns=[f"a{i}" for i in COLUMNS])


@pytest.fixture(scope="module")
def index(spark, grid):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        return value_index(grid)
    finally:
        spark.conf.unset(key)


def finite(p):
    return sorted(x + 0.0 for x in COLUMNS[p] if x is not None and math.isfinite(x))


def test_zones_answer_spans(index):
    assert index.spans() == {p: (len(v), v[0], v[-1]) for p in COLUMNS if (v := finite(p))}
    assert len(index.zones[0]) > 2 and all(a.high < b.low for a, b in zip(index.zones[0], index.zones[0][1:]))


def test_every_position(index):
    wanted = {p: [0, 1, len(v) // 3, len(v) - 1, *rng.sample(range(len(v)), 15)] for p in COLUMNS if (v := finite(p))}
    found = index.at_ranks(wanted)
    assert found == {(p, r): finite(p)[r] for p, ranks in wanted.items() for r in ranks}
    assert index.at_ranks({}) == {}


def test_profile_equals_the_scanning_one(grid, index):
    want = {r["pos"]: r for r in numeric.numeric_profile(grid).collect()}
    got = {r["pos"]: r for r in index.numeric_profile().collect()}
    assert got.keys() == want.keys()
    for p, row in got.items():
        for k, v in row.asDict().items():
            other = want[p][k]
            assert v == other or math.isclose(v, other, rel_tol=1e-9, abs_tol=1e-9), (p, k, v, other)
    v = finite(0)
    q1, _, q3 = statistics.quantiles(v, n=4, method="inclusive")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got[0]["iqr_outliers"] == sum(not low <= x <= high for x in v) > 0


@pytest.mark.parametrize("bins", [None, 1, 7, 200, 9_999, 0.5])
def test_bins_equal_the_scanning_ones(grid, index, bins):
    for p in (0, 1, 2, 3, 4):
        want = histogram.histogram(grid, p, bins).orderBy("bin").collect()
        assert index.histogram(p, bins).orderBy("bin").collect() == want


def test_average_ranks(index):
    v = finite(1)
    got = {r["v"]: (r["n"], r["rank"]) for r in index.average_ranks(1).collect()}
    assert got == {x: (v.count(x), statistics.fmean(i + 1 for i, y in enumerate(v) if x == y)) for x in set(v)}
    assert index.average_ranks(3).collect() == []


def test_counts_by_any_threshold(index):
    v = finite(0)
    cuts = [v[0], v[700] + 1e-12, 0.3, v[-1], 99.0]
    tests = {0: [lambda x, c=c: x < c for c in cuts] + [lambda x, c=c: x >= c for c in cuts]}
    assert index.count_where(tests)[0] == [sum(x < c for x in v) for c in cuts] + [sum(x >= c for x in v) for c in cuts]


def test_lookups_open_only_their_zones(index):
    """No look-up goes back to the cells, and one position opens one zone's folder."""
    some = index._rows([index.zones[0][1]])
    assert all("/table-" in f for f in index.frame.inputFiles())
    scanned = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "zone" in scanned.split("PartitionFilters: [")[1].split("]")[0]
    assert some.agg(F.countDistinct("zone")).first()[0] == 1


def test_tables_without_numbers(spark):
    df = spark.createDataFrame([(1, "x", None)], "rid long, a string, b double")
    empty = value_index(tg.grid(df, ["rid"], distinct_order=True, columns=["a", "b"]))
    assert empty.spans() == {} and empty.numeric_profile().collect() == []
    row = empty.histogram(1, 5).first()
    assert (row["lo"], row["hi"], row["n"]) == (0.0, 1.0, 0)
