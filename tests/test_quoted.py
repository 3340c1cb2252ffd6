"""Quoted line breaks: records cut by many tasks against a character machine and against whole-file reads."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from tallygrid.sources import delimited, quoted
from tallygrid.sources.delimited import read_delimited


def machine(text, sep=","):
    """Records by one look at every character, and whether the text ends inside quotes."""
    out, held, state, i = [], "", "start", 0
    while i < len(text):
        c = text[i]
        if state == "quoted":
            if c == '"' and text[i + 1 : i + 2] == '"':
                held, i = held + '""', i + 2
                continue
            state = "cell" if c == '"' else "quoted"
            held += c
        elif c == "\n":
            out.append(held)
            held, state = "", "start"
        else:
            state = "quoted" if c == '"' and state == "start" else "start" if c == sep else "cell"
            held += c
        i += 1
    return out + [held] * (state != "start" or bool(held)), state == "quoted"


def cut(ranges, sep=","):
    found = []
    for block, lines in ranges:
        one, two, closes = False, True, False
        for line in lines:
            one, two = quoted.ends_inside(line, sep, one), quoted.ends_inside(line, sep, two)
            closes |= not two
        found.append(("f", block, one, two, closes, False))
    owners, left = quoted.starting_states(found)
    pieces = []
    for block, lines in ranges:
        cutter = quoted._Cutter("f", block, owners["f", block], sep)
        column = pa.array(lines, pa.string())
        for low in range(0, len(lines), 2):
            pieces += cutter.add(column.slice(low, 2))
        pieces += cutter.finish()
    out, parts = [(b, k, text) for _, b, k, _, whole, text in pieces if whole], defaultdict(list)
    for _, b, k, own, whole, text in pieces:
        if not whole:
            parts[b].append((own, k, text))
    out += [(b, min(k for _, k, _ in some), "\n".join(t for _, _, t in sorted(some))) for b, some in parts.items()]
    return [text for *_, text in sorted(out)], bool(left)


def test_ranges_cut_as_one_text():
    rng = random.Random(11)
    for _ in range(4_000):
        text = "".join(rng.choice(['"', '"', ",", "\n", "a", "b\n", '"",', '"a']) for _ in range(rng.randrange(1, 40)))
        want, opened = machine(text)
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        at = sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(3))})
        got, left = cut([(a, lines[a:b]) for a, b in zip(at, at[1:])])
        assert left == opened and (opened or got == want)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(source):
    g = source.grid
    rows = g.frame.orderBy(*g.order).select(*(f"c{p}" for p in range(g.width)))
    return [tuple(x or "" for x in r) for r in rows.collect()]


@pytest.mark.parametrize("charset", ["utf-8", "big5"])
def test_quoted_breaks_over_many_ranges(spark, tmp_path, small_ranges, charset):
    rng, rows = random.Random(7), []
    for i in range(300):
        cell = rng.choice(["plain", 'two\nlines "quoted"', "\n", "a;b\r\nc", '"', "", "中文\n|", "x\n" * 400 if i == 150 else "y"])
        rows.append((str(i), cell, str(i * i)))
    text = "id,名稱,n\n" + "".join(f'{a},"{b.replace(chr(34), chr(34) * 2)}",{c}\n' for a, b, c in rows)
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(charset))
    source = read_delimited(spark, str(tmp_path))
    assert source.grid.names == ("id", "名稱", "n")
    assert [(a, b, c) for a, b, c in rows_of(source)] == rows + rows
    assert source.grid.frame.select("k1").distinct().count() > 10  # many ranges began records


def test_files_that_one_task_must_read(spark, tmp_path, small_ranges):
    body = 'a,b\n"x\ny",1\n' + "".join(f"{i},{i}\n" for i in range(100))
    (tmp_path / "open.csv").write_text(body + '"never closed,5\n6,7\n')
    (tmp_path / "return.csv").write_bytes((body + '"p\rq",8\n').encode())
    (tmp_path / "good.csv").write_text(body + '"\n",9\r\n')
    counts = read_delimited(spark, str(tmp_path)).grid.frame.groupBy("k0").count().collect()
    found = {r["k0"].rsplit("/", 1)[-1]: r["count"] for r in counts}
    assert found["good.csv"] == found["return.csv"] == 102 and found["open.csv"] >= 101


def test_no_task_sorts_a_file(spark, tmp_path):
    """Heads are the first lines of each range, and the header's place is broadcast."""
    path = tmp_path / "a.csv"
    path.write_text("k,note\n" + "".join(f'{i},"x\ny"\n' for i in range(50)))
    lines = spark.createDataFrame([("a", 0, i, b"l%d" % i) for i in range(40)] + [("a", 64, 40, b"m"), ("b", 0, 41, b"n")], "path string, block long, row long, line binary")
    heads = delimited._range_heads(lines.coalesce(1))
    assert [r["row"] for r in heads.collect()] == [*range(delimited.HEAD_LINES), 40, 41]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = delimited.enc.inspect(spark, delimited.enc.list_files(spark, [str(path)]), None)
        rows = delimited._read(spark, files, ",", 2, "k,note")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert rows.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
