"""Profiles that grow file by file against profiles of whole tables."""

import math

import pytest
from pyspark.sql import functions as F

import tallygrid as tg
from tallygrid.operators import categories, missing, numeric
from tallygrid.options import ProfileOptions
from tallygrid.plans.state import ProfileState

NAMES = ["code", "amount", "flag", "day", "score"]
WATCHED = ("", "NA", "-", "none", "7", "NaN")
BINARY = ProfileOptions(missing_tokens=("", "NA"), tie="binary", top_patterns=None)


def rows_of(k):
    out = []
    for i in range(k * 100, k * 100 + 100):
        code = ["A", " na ", "B", "", None, "none", "  A"][i % 7]
        amount = ["7", "-", "1,234.5", "x", "NA", str(i), " "][i % 7]
        out.append((code, amount, i % 3 == 0 if i % 5 else None, None if i % 4 else f"2024-01-{i % 28 + 1:02d}", [math.nan, 0.5, -0.0, float(i), None][i % 5]))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    for k in range(3):
        df = spark.createDataFrame(rows_of(k), "code string, amount string, flag boolean, day string, score double")
        df.withColumn("day", F.to_date("day")).coalesce(1).write.parquet(str(base / f"f{k}"))
    return base


def grid_of(spark, *paths):
    return tg.grid(spark.read.parquet(*map(str, paths)), ["code"], columns=NAMES)


def label():
    return F.regexp_extract(F.input_file_name(), "/(f[0-9])/", 1)


@pytest.fixture(scope="module")
def states(spark, folder, tmp_path_factory):
    base, files = tmp_path_factory.mktemp("states"), [folder / f"f{k}" for k in range(3)]
    grown = ProfileState.create(grid_of(spark, files[0]), str(base / "grown"), WATCHED)
    assert grown.update(grid_of(spark, *files[:2]), label()) == ["f0", "f1"]
    assert grown.update(grid_of(spark, *files), label()) == ["f2"] and grown.update(grid_of(spark, *files), label()) == []
    whole = ProfileState.create(grid_of(spark, files[0]), str(base / "whole"), WATCHED)
    whole.update(grid_of(spark, *files), label())
    return ProfileState(spark, str(base / "grown")), whole, grid_of(spark, *files)


def table(df):
    return sorted((tuple(sorted(r.asDict().items(), key=lambda kv: kv[0])) for r in df.collect()), key=str)


@pytest.mark.parametrize("tokens", [("", "NA"), ("",), ("-", "none", "7"), ("nan", "NA", "-")])
def test_grown_equals_whole_and_the_scanning_profile(states, tokens):
    grown, whole, g = states
    options = ProfileOptions(missing_tokens=tokens, tie="binary", top_patterns=None)
    a, b = grown.profile(options), whole.profile(options)
    for name in ("missing", "unique", "numeric", "patterns", "summary"):
        assert table(getattr(a, name)) == table(getattr(b, name)), name
    assert a.rows == 300
    assert table(a.missing) == table(missing.missing_by_column(g, options))
    want = categories.unique_counts(g, options=options).drop("unique_truncated")
    assert table(a.unique) == table(want)
    assert table(a.top_categories(5)) == table(categories.top_categories(g, range(5), options, 5))
    got, scanned = ({r["pos"]: r for r in df.collect()} for df in (a.numeric, numeric.numeric_profile(g, range(5), options)))
    assert got.keys() == scanned.keys()
    for p, row in got.items():
        for k, v in row.asDict().items():
            assert v == scanned[p][k] or math.isclose(v, scanned[p][k], rel_tol=1e-9, abs_tol=1e-12), (p, k)
    found = {tuple(r["columns"]): (r["n"], r["pct"]) for r in a.patterns.collect()}
    assert found == {tuple(r["columns"]): (r["n"], r["pct"]) for r in missing.missing_patterns(g, options).collect()}
    summary, want = a.summary.first(), missing.missing_summary(g, options).first()
    assert all(summary[k] == want[k] for k in ("n_rows", "missing_cells", "complete_rows"))


def test_other_tokens_read_only_the_state(states):
    grown, _, _ = states
    p = grown.profile(BINARY)
    for df in (p.missing, p.unique, p.top_categories(3), p.patterns, p.summary):
        assert all("/states" in f for f in df.inputFiles())


def test_only_new_files_are_read(spark, folder, tmp_path):
    files = [str(folder / f"f{k}") for k in range(3)]
    state = ProfileState.create(grid_of(spark, files[0]), str(tmp_path / "s"), WATCHED)
    assert len(state.update(grid_of(spark, *files[:2]))) == 2
    new = state.pending(spark.read.parquet(*files))
    assert len(new) == 1 and "/f2/" in new[0]
    assert state.update(grid_of(spark, *new)) == new and state.pending(spark.read.parquet(*files)) == []
    assert state.profile(BINARY).rows == 300


def test_unfinished_runs_do_not_count(spark, states, folder, tmp_path):
    g = grid_of(spark, folder / "f0")
    state = ProfileState.create(g, str(tmp_path / "s"), WATCHED)
    state.update(g, label())
    before = table(state.profile(BINARY).missing)
    lost = state._table("values", "run string, file string, pos int, value string, v double, n long").withColumn("run", F.lit("lost"))
    lost.write.mode("append").parquet(f"{state.folder}/values")
    assert table(state.profile(BINARY).missing) == before


def test_refusals_and_empty_tables(spark, states, folder, tmp_path):
    grown, _, g = states
    with pytest.raises(ValueError, match="not watched: other"):
        grown.profile(ProfileOptions(missing_tokens=("other",)))
    with pytest.raises(ValueError, match="other columns"):
        grown.update(tg.grid(g.frame.select("c0"), ["c0"], columns=["c0"]))
    empty = ProfileState.create(g, str(tmp_path / "e"), WATCHED)
    assert empty.update(g.with_frame(g.frame.limit(0)), F.lit("f")) == []
    p = empty.profile(BINARY)
    assert p.rows == 0 and p.numeric.collect() == [] and p.patterns.collect() == []
    assert [(r["n_rows"], r["missing"], r["missing_pct"]) for r in p.missing.collect()] == [(0, 0, 0.0)] * 5
