import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import tallygrid as tg
from tallygrid.operators import categories, correlation, dates, histogram, infer, missing, numeric, order, paging, quantiles
from tallygrid.options import ProfileOptions

TOKENS = ProfileOptions(missing_tokens=("void", "n.d.", "Leer", "無值"))


def rows(df, *sort):
    return [tuple(r) for r in (df.orderBy(*sort) if sort else df).collect()]


# Missing values


def test_missing_cells(table):
    absent = ["", " \t ", "void", " VOID", "n.D. ", "leer", "無值", None, "\u3000"]
    present = ["avoid", "n.d", "0", "-", "leer!"]
    g = table({"a": [*present, *absent]})
    found = g.frame.select("k0", g.cell(0).missing(TOKENS.tokens)).orderBy("k0").collect()
    assert [r[1] for r in found] == [False] * len(present) + [True] * len(absent)


def test_missing_counts(table):
    cells = ["8", "leer", "", "15", "void", "4", "n.d.", "16"]
    r = missing.missing_by_column(table({"a": cells}), TOKENS).first()
    gone = sum(not c.isdigit() for c in cells)
    assert (r["n_rows"], r["missing"], r["missing_pct"]) == (len(cells), gone, gone / len(cells))


def test_no_rows(table):
    g = table({"a": [], "b": []})
    assert [r["missing_pct"] for r in missing.missing_by_column(g).collect()] == [0.0, 0.0]
    assert missing.missing_summary(g).first()["missing_pct"] == 0.0
    assert infer.column_types(g) == ["text", "text"]
    assert missing.missing_patterns(g).collect() == []


def test_patterns_break_ties_by_first_row(table):
    flags = [(0, 0, 0), (0, 1, 0), (1, 0, 1), (0, 1, 0), (1, 1, 0), (1, 0, 1), (0, 0, 1)]
    g = table({name: ["void" if row[i] else "v" for row in flags] for i, name in enumerate("xyz")})
    counts, firsts = {}, {}
    for at, row in enumerate(flags):
        key = tuple(n for n, f in zip("xyz", row) if f)
        counts[key] = counts.get(key, 0) + 1
        firsts.setdefault(key, at)
    want = sorted((k for k in counts if k), key=lambda k: (-counts[k], firsts[k]))
    found = rows(missing.missing_patterns(g, TOKENS).select("columns", "n"))
    assert found == [(list(k), counts[k]) for k in want]
    s = missing.missing_summary(g, TOKENS).first()
    complete = counts[()]
    assert (s["complete_rows"], s["any_missing_rows"], s["missing_cells"]) == (complete, len(flags) - complete, sum(map(sum, flags)))


def test_patterns_in_stored_order(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(0, 900, 1, 4).selectExpr(
        "CASE WHEN id = 899 OR id % 9 = 4 THEN '' ELSE 'x' END AS a", "CASE WHEN id % 9 = 2 OR id = 899 THEN 'NA' ELSE 'y' END AS b", "id"
    ).write.parquet(path)
    g = tg.grid(spark.read.parquet(path), by_file=True)
    assert rows(missing.missing_patterns(g).select("columns", "n")) == [(["b"], 100), (["a"], 100), (["a", "b"], 1)]


def test_patterns_of_a_wide_table(table):
    g = table({f"c{i}": ["", "1", ""] for i in range(130)} | {"last": ["1", "", "1"]})
    found = rows(missing.missing_patterns(g).select("columns", "n"))
    assert found == [([f"c{i}" for i in range(130)], 2), (["last"], 1)]
    assert missing.missing_summary(g).first()["missing_cells"] == 261


def test_rank_is_stable_and_bounded(table):
    g = table({f"c{i}": ["", "x" if i % 2 else ""] for i in range(50)})
    assert missing.missing_rank(g).count() == 50
    ranked = rows(missing.missing_rank(g, top=40).select("rank", "name"), "rank")
    assert len(ranked) == 40 and ranked[0] == (1, "c0") and ranked[25] == (26, "c1")


def test_map_keeps_small_tables_whole(table):
    g = table({"a": ["1", "", "3"], "b": ["", "", "x"]})
    found = rows(missing.missing_map(g).select("sample_pos", "rid", "col_pos", "name", "is_missing", "sampled"), "rid", "col_pos")
    assert found == [
        (0, 0, 0, "b", True, False), (0, 0, 1, "a", False, False), (1, 1, 0, "b", True, False),
        (1, 1, 1, "a", True, False), (2, 2, 0, "b", False, False), (2, 2, 1, "a", False, False),
    ]


def test_map_samples_evenly(table):
    n = 1000
    g = table({"a": [str(i) for i in range(n)]})
    found = [r["rid"] for r in missing.missing_map(g).orderBy("sample_pos").collect()]
    assert found == [i * n // 300 for i in range(300)]


def test_mask(table):
    g = table({"a": [" x ", "NA"]})
    assert rows(missing.mask_missing(g, paging.rows(g, 0, 5)).select("c0")) == [(" x ",), ("∅",)]


# Types


@pytest.mark.parametrize(
    "cells, kind",
    [
        (["1", "2", "3", "4"], "integer"),
        (["1.5", "2.25", "3.75", "-4"], "number"),
        (["1,234", "5"], "number"),
        (["2026-01-01", "2026-01-02", "2026-01-03"], "date"),
        (["TRUE", "FALSE", "true", "FALSE"], "boolean"),
        (["蘋果", "香蕉", "橘子"], "text"),
        (["問號", *map(str, range(2, 21))], "integer"),
        (["問號", "x", "y", *map(str, range(2, 19))], "text"),
        (["", "NA"], "text"),
    ],
)
def test_infer(table, cells, kind):
    assert infer.column_types(table({"a": cells})) == [kind]


def test_stride_sample(table):
    # Step 3: every third row is missing, so the sample of the first column is empty.
    n = 6000
    g = table({"a": ["" if i % 3 == 0 else str(i) for i in range(n)], "b": [str(i) if i % 3 == 0 else "x" for i in range(n)]})
    found = rows(infer.infer_types(g).select("name", "sampled", "type"), "pos")
    assert found == [("a", 0, "text"), ("b", 2000, "integer")]


def test_sample_takes_the_first_present_cells(table):
    # 3 999 rows, step 1: the first 2 000 present cells are all that counts.
    g = table({"a": [*("7" for _ in range(2000)), *("x" for _ in range(1999))]})
    assert rows(infer.infer_types(g).select("sampled", "ints", "type")) == [(2000, 2000, "integer")]


def test_typed_columns(spark):
    df = spark.sql(
        """SELECT id, cast(id AS double) AS whole, id / 7 AS part, id % 2 = 0 AS flag, date'2026-01-01' AS d,
        timestamp_ntz'2026-01-01 10:00:00.123' AS t, cast('nan' AS double) AS bad, cast(NULL AS int) AS none FROM range(100)"""
    )
    g = tg.grid(df, ["id"], distinct_order=True)
    assert infer.column_types(g) == ["integer", "integer", "number", "boolean", "date", "date", "text", "text"]
    assert missing.missing_by_column(g).orderBy("pos").collect()[6]["missing"] == 100
    keep = ProfileOptions(missing_tokens=("7", "true"))
    counts = [r["missing"] for r in missing.missing_by_column(g, keep).orderBy("pos").collect()]
    assert counts == [1, 1, 1, 50, 0, 0, 0, 100]


# Row positions


def expected_rows(g, positions):
    everything = [r for r in rows(g.frame.select(*g.order, *(f"c{p}" for p in range(g.width))))]
    everything.sort(key=lambda r: r[0])
    return [everything[i][1:] for i in positions]


@pytest.mark.parametrize("n, a, b, limit", [(1000, 1000, 300, 300), (777, 3, 1, 4000), (500, 1, 1, 4000), (301, 301, 300, 300)])
def test_spaced_rows(table, n, a, b, limit):
    g = table({"a": [str(i) for i in range(n)]}, partitions=7)
    found = rows(order.spaced_rows(g, n, (a, b), limit).select("rid", "c0"), "rid")
    want = [i * a // b for i in range(limit) if i * a // b < n]
    assert found == [(i, str(i)) for i in want]


def test_positions_with_repeated_keys(spark):
    # One key holds half of the rows, and a third of all rows are copies of one row.
    data = [(5, "copy")] * 400 + [(5, f"v{i}") for i in range(200)] + [(i % 3, f"w{i}") for i in range(600)]
    random.Random(1).shuffle(data)
    found = []
    for parts in (1, 9):
        g = tg.grid(spark.createDataFrame(data, "k int, v string").repartition(parts), ["k"], columns=["v"])
        found.append(rows(order.spaced_rows(g, 1200, (7, 1), 4000).select("rid", "k0", "c0"), "rid"))
    assert found[0] == found[1]
    assert [r[0] for r in found[0]] == list(range(0, 1200, 7))
    by_key = sorted(k for k, _ in data)
    assert [r[1] for r in found[0]] == [by_key[r[0]] for r in found[0]]
    g = tg.grid(spark.createDataFrame(data, "k int, v string").repartition(5), ["k"], columns=["v"])
    whole = order.spaced_rows(g, 1200, (1, 1), 1199)
    assert sum(1 for r in whole.collect() if r["c0"] == "copy") in (399, 400)


def test_stored_order(spark, tmp_path):
    n = 5000
    path = str(tmp_path / "table")
    spark.range(0, n, 1, 7).selectExpr("cast(id * 31 % 5000 AS string) AS v", "id").write.parquet(path)
    g = tg.grid(spark.read.parquet(path), by_file=True)
    stored = [r["v"] for r in spark.read.parquet(path).orderBy("id").collect()]
    found = rows(order.spaced_rows(g, n, (n, 300), 300).select("rid", "c0"), "rid")
    assert found == [(i * n // 300, stored[i * n // 300]) for i in range(300)]
    assert rows(paging.rows(g, 1425, 10, deep=10).select("c0"), "rid") == [(v,) for v in stored[1425:1435]]
    assert rows(paging.rows(g, 3, 4).select("c0"), "rid") == [(v,) for v in stored[3:7]]
    assert infer.column_types(g) == ["integer", "integer"]


def test_filtered_files_keep_all_positions(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(0, 900, 1, 4).selectExpr("id", "id % 7 AS k").write.parquet(path)
    g = tg.grid(spark.read.parquet(path).filter("k > 2"), by_file=True)
    left = [i for i in range(900) if i % 7 > 2]
    found = rows(order.spaced_rows(g, len(left), (len(left), 100), 100).select("rid", "c0"), "rid")
    assert found == [(i * len(left) // 100, left[i * len(left) // 100]) for i in range(100)]
    assert rows(paging.rows(g, 300, 20, deep=10).select("c0"), "rid") == [(v,) for v in left[300:320]]


def test_running_total(spark):
    data = [(g, k, (g * 7 + k * 3) % 5 + 1) for g in range(3) for k in range(200)]
    df = spark.createDataFrame(data, "g int, k int, n bigint").repartition(6)
    got = {(r["g"], r["k"]): r["before"] for r in order.running_total(df, ["g"], ["k"], "n").collect()}
    for g in range(3):
        total = 0
        for _, k, n in sorted(d for d in data if d[0] == g):
            assert got[g, k] == total
            total += n


# Numbers


def stats(table, cells, **limits):
    g = table({"a": [str(c) for c in cells]})
    return numeric.numeric_profile(g, [0]).first()


def test_basic_statistics(table):
    data = [41, 7, 19, 3, 88, 26, 54, 12, 65]
    r = stats(table, data)
    q1, median, q3 = statistics.quantiles(data, n=4, method="inclusive")
    found = (r["count"], r["mean"], r["min"], r["q1"], r["median"], r["q3"], r["max"])
    assert found == (len(data), statistics.fmean(data), min(data), q1, median, q3, max(data))
    assert math.isclose(r["std"], statistics.stdev(data), rel_tol=1e-10)


def test_statistics_ignore_what_is_not_a_number(table):
    r = stats(table, [1, "NaN", 3, "x"])
    assert (r["count"], r["mean"]) == (2, 2.0)
    assert numeric.numeric_profile(table({"a": ["NaN", "x"]}), [0]).collect() == []


def test_outliers_and_shape(table):
    data = [22, 25, 24, 27, 23, 26, 25, 24, -90, 400]
    q1, _, q3 = statistics.quantiles(data, n=4, method="inclusive")
    fences = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert stats(table, data)["iqr_outliers"] == sum(not fences[0] <= x <= fences[1] for x in data)
    assert abs(stats(table, [-9, -4, -1, 0, 1, 4, 9])["skew"]) < 1e-9
    r = stats(table, [2.7] * 9)
    assert (r["std"], r["skew"], r["kurt"], r["z_outliers"]) == (0.0, 0.0, 0.0, 0)
    single = stats(table, [-3.5])
    assert (single["std"], single["median"], single["skew"]) == (0.0, -3.5, 0.0)
    spiked = [6, 7] * 20 + [90]
    far = 3 * statistics.stdev(spiked)
    assert stats(table, spiked)["z_outliers"] == sum(abs(x - statistics.fmean(spiked)) > far for x in spiked)
    two = stats(table, [5, 9])
    assert (two["skew"], two["kurt"]) == (0.0, -2.0)


def test_shape_matches_the_definition(table):
    rng = random.Random(4)
    data = [rng.lognormvariate(0, 1) for _ in range(500)]
    r = stats(table, data)
    n, mean = len(data), statistics.fmean(data)
    m2, m3, m4 = (sum((x - mean) ** k for x in data) / n for k in (2, 3, 4))
    assert math.isclose(r["skew"], math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, rel_tol=1e-9)
    assert math.isclose(r["kurt"], m4 / m2**2 - 3, rel_tol=1e-9)
    assert math.isclose(r["std"], statistics.stdev(data), rel_tol=1e-9)


@pytest.mark.parametrize("small, zooms", [(10**6, 5), (5, 5), (5, 1), (5, 0)])
def test_quantiles_by_every_route(spark, small, zooms):
    rng = random.Random(3)
    columns = {
        0: [rng.random() for _ in range(997)],
        1: [10.0 ** rng.randint(-300, 300) for _ in range(997)],
        2: [7.0] * 400 + [float(rng.randint(0, 9)) for _ in range(597)],
        3: [3.0] * 997,
        4: [-1.7e308, 1.7e308] + [rng.gauss(0, 1) for _ in range(995)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"n{i} double" for i in columns)).repartition(5)
    spans = {p: (997, min(v), max(v)) for p, v in columns.items()}
    probabilities = (0.0, 0.25, 0.5, 0.777, 1.0)
    got = quantiles.quantiles(df, spans, probabilities, small=small, zooms=zooms)
    for p, v in columns.items():
        v = sorted(v)
        for q, found in zip(probabilities, got[p]):
            at = 996 * q
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert found == low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("small", [20_000, 3])
@pytest.mark.parametrize("shift", [None, "low", "high"])
def test_quantiles_from_sketches(spark, small, shift):
    """Brackets from sketches, read by a window or a running total; wrong ones are noticed and searched on."""
    rng = random.Random(9)
    columns = {
        0: [rng.random() for _ in range(4_001)],
        1: [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(4_001)],  # ties
        2: [10.0 ** rng.randint(-300, 300) for _ in range(4_001)],
        3: [-2.5] * 4_001,
        4: [None] * 4_001,
        5: [float(i) if i % 7 == 0 else None for i in range(4_001)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"n{i} double" for i in columns)).repartition(6)
    span, cuts = numeric.sketched_spans(df, columns)
    assert set(span) == set(cuts) == {0, 1, 2, 3, 5}
    if shift:
        at = {"low": 1, "high": 2}[shift]
        cuts = {p: [span[p][at]] * 6 for p in cuts}
    got = quantiles.quantiles(df, {p: s[:3] for p, s in span.items()}, cuts=cuts, small=small)
    for p in span:
        v = sorted(x for x in columns[p] if x is not None)
        for q, found in zip((0.25, 0.5, 0.75), got[p]):
            at = (len(v) - 1) * q
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert found == low + (high - low) * (at - math.floor(at))


def test_two_scans_find_the_quartiles(spark, monkeypatch):
    """The bins are never needed where sketches keep their promise."""
    monkeypatch.setattr(quantiles, "_zoom", None)
    df = spark.range(30_000).select(F.sqrt(F.col("id") + 0.5).alias("n0"), (F.col("id") % 3).cast("double").alias("n1"))
    span, cuts = numeric.sketched_spans(df, [0, 1])
    found = quantiles.quantiles(df, {p: s[:3] for p, s in span.items()}, cuts=cuts, small=100)
    assert found[1] == [0.0, 1.0, 2.0] and found[0][1] == (math.sqrt(14_999.5) + math.sqrt(15_000.5)) / 2


# Histograms


def bins(df):
    return [(r["lo"], r["hi"], r["n"]) for r in df.orderBy("bin").collect()]


def test_histogram(table):
    data = [(7 * i) % 83 + 0.5 for i in range(140)]
    h = bins(histogram.histogram(table({"a": [str(x) for x in data]}), 0, 8))
    width = (max(data) - min(data)) / 8
    want = [0] * 8
    for x in data:
        want[min(7, int((x - min(data)) / width))] += 1
    assert [n for *_, n in h] == want and h[0][0] == min(data) and h[-1][1] == max(data)
    assert bins(histogram.histogram(table({"a": ["-2"] * 6}), 0)) == [(-2.0, -1.0, 6)]
    assert len(bins(histogram.histogram(table({"a": [str(i) for i in range(61)]}), 0, 10**6))) == 200
    assert bins(histogram.histogram(table({"a": ["none"]}), 0)) == [(0.0, 1.0, 0)]


def test_rebin_ignores_tokens(table):
    g = table({"value": ["12", "30", "18", "24", "void", "", "wrong", "6"], "label": list("stuvwxyz")})
    assert bins(histogram.histogram(g, 0, 3, None)) == [(6.0, 14.0, 2), (14.0, 22.0, 1), (22.0, 30.0, 2)]
    keep = ProfileOptions(missing_tokens=("30",))
    assert sum(n for *_, n in bins(histogram.histogram(g, 0, 3, None))) == 5
    assert sum(n for *_, n in bins(histogram.histogram(g, 0, 3, keep))) == 4
    with pytest.raises(ValueError, match="欄位不存在"):
        histogram.histogram(g, 20, 2)


def test_empty_bins_are_kept_and_automatic_counts(table):
    h = bins(histogram.histogram(table({"a": ["0", "0", "0", "0", "0", "0", "0", "10"]}), 0))
    assert len(h) == 4 and [n for *_, n in h] == [7, 0, 0, 1]
    assert histogram.auto_bin_count(1000, 0, 100, 25, 75) == 10
    assert histogram.auto_bin_count(10, 0, 1e300, 1, 2) == 80


# Categories


def test_unique_counts_values_not_missing(table):
    g = table({"a": ["a", "b", "a", "NA", "", "b", " a "]})
    assert rows(categories.unique_counts(g).select("unique", "unique_truncated")) == [(2, False)]


def test_unique_cap(table):
    g = table({"a": [str(i) for i in range(900)], "b": [str(i % 250) for i in range(900)], "c": [str(i % 300) for i in range(900)]})
    exact = rows(categories.unique_counts(g).select("unique", "unique_truncated"), "pos")
    assert exact == [(900, False), (250, False), (300, False)]
    capped = categories.unique_counts(g, options=ProfileOptions(unique_cap=250))
    assert rows(capped.select("unique", "unique_truncated"), "pos") == [(251, True), (250, False), (251, True)]


def test_top_categories(table):
    g = table({"a": ["b", "B", "a", "A", "a", "z", "", "NA"]})
    assert [r["value"] for r in categories.top_categories(g, [0]).orderBy("rank").collect()] == ["a", "A", "b", "B", "z"]
    plain = ProfileOptions(tie="binary")
    assert [r["value"] for r in categories.top_categories(g, [0], plain).orderBy("rank").collect()] == ["a", "A", "B", "b", "z"]
    s = categories.category_summary(g, [0]).first()
    assert (s["valid"], s["cardinality"], s["truncated"], s["top_value"], s["top_n"]) == (6, 5, False, "a", 2)
    assert categories.category_summary(g, [0], top=4).first()["truncated"]


@pytest.mark.parametrize("top", [1, 2, 3, 5, 100])
def test_long_texts_are_counted_by_digest(table, top):
    rng = random.Random(8)
    long = [f"{rng.choice('abcdef')}{i % 37} " + "x" * 40 for i in range(90)] + ["NA", ""] * 5
    once = [f"{rng.random()} " + "y" * 40 for _ in range(97)] + ["again " + "z" * 40] * 3
    short = [str(i % 7) for i in range(100)]
    g = table({"long": long, "once": once, "short": short})
    plain = ProfileOptions(tie="binary")
    by_digest = categories.Frequencies(g, [0, 1, 2], plain, long_text=20)
    by_value = categories.Frequencies(g, [0, 1, 2], plain)
    assert (by_digest.long, by_value.long) == ([0, 1], [])
    assert rows(by_digest.totals(), "pos") == rows(by_value.totals(), "pos")
    assert rows(by_digest.top(top), "pos", "rank") == rows(by_value.top(top), "pos", "rank")
    uniques = [rows(categories.unique_counts(g, long_text=n), "pos") for n in (20, 10**6)]
    assert uniques[0] == uniques[1]


def test_share_table(table):
    g = table({"a": ["x"] * 3 + ["y"]})
    assert rows(categories.category_table(g, [0]).select("value", "n", "share"), "rank") == [("x", 3, 0.75), ("y", 1, 0.25)]


def test_typed_categories(spark):
    df = spark.sql("SELECT id, cast(id % 3 AS double) / 2 AS v, id % 2 = 0 AS f FROM range(10)")
    g = tg.grid(df, ["id"], distinct_order=True, columns=["v", "f"])
    got = rows(categories.top_categories(g, [0, 1]).select("name", "value", "n"), "pos", "rank")
    assert got == [("v", "0", 4), ("v", "0.5", 3), ("v", "1", 3), ("f", "FALSE", 5), ("f", "TRUE", 5)]


# Dates


def test_dates(table):
    g = table({"d": ["2026-01-03", "2026-01-01", "2026/1/1 10:00", "junk", "", "7/1/2025"]})
    r = dates.date_profile(g, [0]).first()
    assert (r["count"], str(r["min"]), str(r["max"]), r["unparseable"], r["unit"]) == (
        4, "2025-07-01 00:00:00", "2026-01-03 00:00:00", 1, "month",
    )
    assert rows(dates.date_buckets(g, [0]).select("label", "n"), "label") == [("2025-07", 1), ("2026-01", 3)]


def test_day_span_boundary(table):
    near = table({"d": ["2026-01-01", "2026-06-30"]})
    far = table({"d": ["2026-01-01", "2026-06-30 00:00:01"]})
    assert dates.date_units(near, [0]) == {0: "day"} and dates.date_units(far, [0]) == {0: "month"}
    assert dates.date_profile(table({"d": ["x"]}), [0]).collect() == []


# Correlation


def coefficient(table, x, y, method):
    g = table({"x": x, "y": y})
    r = correlation.pair_table(g, [0, 1], method).first()
    return r["r"]


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_perfect_correlation(table, method):
    xs = [14, -3, 22, 8, 0, 31]
    x = [str(v) for v in xs]
    assert math.isclose(coefficient(table, x, [str(3 * v + 11) for v in xs], method), 1)
    assert math.isclose(coefficient(table, x, [str(5 - v / 4) for v in xs], method), -1)
    assert coefficient(table, ["6", "9"], ["2", "7"], method) is None
    assert coefficient(table, ["0.3"] * 5, ["9", "1", "4", "4", "8"], method) is None


def test_pairs_with_gaps(table):
    x, y = ["5", "", "17", "9", "2", "x"], ["11", "800", "35", "", "5", "44"]
    assert math.isclose(coefficient(table, x, y, "pearson"), 1)  # y = 2x + 1 wherever both are present
    assert math.isclose(coefficient(table, ["2", "7", "4", "9"], [str(v**3) for v in (2, 7, 4, 9)], "spearman"), 1)


def test_pairs_with_gaps_over_many_columns(table):
    rng = random.Random(12)
    data = {f"n{i}": [rng.choice(["", f"{rng.gauss(i, 2):.4f}", f"{rng.gauss(0, 5):.4f}"]) for _ in range(160)] for i in range(11)}
    found = {(r["i"], r["j"]): (r["r"], r["n"]) for r in correlation.pair_table(table(data), range(11), "pearson").collect()}
    columns = list(data.values())
    for (i, j), (r, n) in found.items():
        both = [(float(a), float(b)) for a, b in zip(columns[i], columns[j]) if a and b]
        assert n == len(both) and math.isclose(r, statistics.correlation(*map(list, zip(*both))), abs_tol=1e-9)
    assert len(found) == 55


def test_average_ranks(spark):
    values = [4.0, -1.0, 4.0, 9.0, 0.5, 4.0, 0.5]
    df = spark.createDataFrame([(0, v) for v in values], "pos int, v double")
    want = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    assert rows(correlation.average_ranks(df).select("v", "rank"), "v") == sorted(want.items())


@pytest.mark.parametrize("small, hot_share", [(10**5, 1000), (0, 3), (0, 10**6), (40, 3)])
def test_ranks_by_every_route(spark, small, hot_share):
    # One value fills a third of the second column.
    rng = random.Random(2)
    data = [(rng.choice([None, rng.random()]), 1.0 if i % 3 == 0 else float(rng.randint(0, 30)), float(i)) for i in range(300)]
    # The third column is the row itself, so every rank is held against its own row.
    df = spark.createDataFrame(data, "n0 double, n1 double, n2 double").repartition(4)
    got = correlation.rank_frame(df, [0, 1, 2], small=small, hot_share=hot_share)
    assert got.count() == 300
    for p in range(3):
        column = [r[p] for r in data if r[p] is not None]
        want = {
            i: None if r[p] is None else sum(v < r[p] for v in column) + (sum(v == r[p] for v in column) + 1) / 2
            for i, r in enumerate(data)
        }
        assert {int(r[0]) - 1: r[1] for r in got.select("r2", f"r{p}").collect()} == want


def test_spearman_ranks_columns_before_dropping_pairs(table):
    x = ["1", "2", "3", "4", "", "100", "7"]
    y = ["5", "3", "", "2", "1", "9", "8"]
    def ranks(v):
        present = [float(c) for c in v if c]
        return [None if not c else sum(p < float(c) for p in present) + 1 for c in v]
    pairs = [(a, b) for a, b in zip(ranks(x), ranks(y)) if a is not None and b is not None]
    want = statistics.correlation([a for a, _ in pairs], [b for _, b in pairs])
    assert math.isclose(coefficient(table, x, y, "spearman"), want)


def test_matrix_and_strongest(table):
    g = table({"a": list("12345"), "b": list("54321"), "c": ["1", "1", "2", "9", "3"], "k": ["7"] * 5})
    pairs = correlation.pair_table(g, range(4))
    cells = {(r["i"], r["j"]): r["shown"] for r in correlation.full_matrix(g, range(4), pairs).collect()}
    assert len(cells) == 16 and cells[3, 3] == 1.0 and cells[0, 3] is None and cells[0, 1] == cells[1, 0] == -1.0
    best = rows(correlation.strongest_pairs(pairs).select("a", "b", "strength"))
    assert best[0] == ("a", "b", "極強") and len(best) == 3
    assert correlation.candidates([3]) is None
    assert correlation.candidates(list(range(20))) == correlation.Candidates(tuple(range(20)), False)
    assert correlation.candidates(list(range(20)), 15) == correlation.Candidates(tuple(range(15)), True)


# Pages


def test_pages(table):
    g = table({"a": [str(i) for i in range(120)]})
    assert [r["c0"] for r in paging.preview(g, ProfileOptions(preview_rows=2)).collect()] == ["0", "1"]
    assert paging.preview(g, ProfileOptions(preview_rows=0)).collect() == []
    for deep in (10, 10**6):
        assert rows(paging.rows(g, 118, 10, deep), "rid") == [(118, "118"), (119, "119")]
        assert rows(paging.rows(g, 120, 10, deep)) == []
    assert [r["rid"] for r in paging.page(g, 2).orderBy("rid").collect()] == list(range(100, 120))
    assert paging.page_info(120, 9) == {"page": 2, "last_page": 2, "offset": 100, "total_rows": 120}


def test_order_is_required(spark):
    g = tg.grid(spark.range(3))
    with pytest.raises(ValueError, match="order_by"):
        infer.infer_types(g)


def test_rows_stay_whole_while_ranks_are_looked_up(spark):
    """No unpivot and no grouping by row; rows without a value or with a hot one spread over the tasks."""
    df = spark.createDataFrame([(None if i % 4 else float(i), float(i % 2)) for i in range(200)], "n0 double, n1 double")
    got = correlation.rank_frame(df, [0, 1], small=0, hot_share=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("Join") == 4
    assert sorted(r["r1"] for r in got.collect()) == [50.5] * 100 + [150.5] * 100
    assert sorted(r["r0"] for r in got.collect() if r["r0"] is not None) == list(range(1, 51))
