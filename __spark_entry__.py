"""

``queries()`` runs over the whole given tables. Where a query needs missing or malformed
cells, which the tables lack, it reads ``dirty_orders``: one text row per order, derived
from every row of ``orders`` by the same SQL on both engines.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tallygrid as tg
from tallygrid.functions.display import fmt_datetime, fmt_number, strength
from tallygrid.functions.parse import parse_boolean, parse_date, parse_integer, parse_number
from tallygrid.functions.text import render_cell
from tallygrid.operators import categories, correlation, dates, histogram, infer, missing, numeric, paging
from tallygrid.grid import union
from tallygrid.operators.value_index import value_index
from tallygrid.options import BLANKS, DEFAULT_MISSING_TOKENS, ProfileOptions, token_set
from tallygrid.plans import report
from tallygrid.plans.state import ProfileState
from tallygrid.session import prepare
from tallygrid.sources.delimited import parse_records, read_delimited
from tallygrid.sources.encoding import java_charsets
from tallygrid.sources.query import Param, query

#: Counts tied by code point, which DuckDB can reproduce.
OPTIONS = ProfileOptions(tie="binary")

# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------

DIRTY_ORDERS = """
SELECT k AS rid,
  'O' || cast(k AS string) AS order_code,
  CASE WHEN k % 20 = 0 THEN 'N/A' WHEN k % 20 = 1 THEN ' na ' WHEN k % 33 = 2 THEN '未知' ELSE st END AS status,
  CASE WHEN k % 9 = 0 THEN ''
       WHEN w >= 1000 AND w < 1000000 AND k % 3 = 0
         THEN cast(cast(floor(w / 1000) AS bigint) AS string) || ',' || lpad(cast(w % 1000 AS string), 3, '0')
              || '.' || lpad(cast(c % 100 AS string), 2, '0')
       ELSE cast(w AS string) || '.' || lpad(cast(c % 100 AS string), 2, '0') END AS price,
  CASE WHEN k % 9 = 0 OR k % 6 = 5 THEN '-' WHEN k % 50 = 3 THEN 'abc' ELSE cast(k % 50 AS string) END AS qty,
  CASE WHEN k % 11 = 0 THEN 'missing'
       WHEN k % 4 = 1 THEN cast(y AS string) || '/' || cast(m AS string) || '/' || cast(d AS string)
       WHEN k % 4 = 2 THEN cast(m AS string) || '/' || cast(d AS string) || '/' || cast(y AS string)
       WHEN k % 4 = 3 AND k % 25 = 3 THEN '2026-02-30'
       ELSE cast(y AS string) || '-' || lpad(cast(m AS string), 2, '0') || '-' || lpad(cast(d AS string), 2, '0') END AS odate,
  CASE WHEN k % 13 = 0 THEN '?' WHEN k % 2 = 0 THEN 'TRUE' ELSE 'false' END AS urgent
FROM (SELECT o_orderkey AS k, o_orderstatus AS st,
             cast(round(o_totalprice * 100) AS bigint) AS c,
             cast(floor(cast(round(o_totalprice * 100) AS bigint) / 100) AS bigint) AS w,
             cast(year(o_orderdate) AS int) AS y, cast(month(o_orderdate) AS int) AS m, cast(day(o_orderdate) AS int) AS d
      FROM orders) t
"""
DIRTY_COLUMNS = ["order_code", "status", "price", "qty", "odate", "urgent"]
LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _views(spark: SparkSession, sf_dir: str) -> SparkSession:
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark


def _dirty(spark: SparkSession, sf_dir: str) -> tg.Grid:
    prepare(spark)
    text = DIRTY_ORDERS.replace("FROM orders)", "FROM {orders})")
    rows = spark.sql(text, orders=_table(spark, sf_dir, "orders"))
    return tg.grid(rows, ["rid"], distinct_order=True, columns=DIRTY_COLUMNS)


def _grid(spark: SparkSession, sf_dir: str, name: str, order_by=None, **options) -> tg.Grid:
    prepare(spark)
    df = _table(spark, sf_dir, name)
    if order_by is None and not options.get("by_file"):
        order_by = df.columns
    return tg.grid(df, order_by or (), **options)


def _col(name: str) -> int:
    return DIRTY_COLUMNS.index(name)


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------

_WITH_DIRTY = f"WITH dirty AS ({DIRTY_ORDERS})"


def _text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _trim(column: str) -> str:
    return f"trim({column}, '{BLANKS}')"


def _missing(column: str, tokens=DEFAULT_MISSING_TOKENS) -> str:
    return f"(lower({_trim(f'coalesce({column}, {chr(39) * 2})')}) IN ({_text_list(['', *sorted(token_set(tokens))])}))"


def _number(column: str) -> str:
    t = _trim(column)
    return (
        f"(CASE WHEN regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast({t} AS DOUBLE) "
        f"WHEN regexp_full_match({t}, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?([eE][+-]?\\d+)?') "
        f"THEN try_cast(replace({t}, ',', '') AS DOUBLE) END)"
    )


def _integer(column: str) -> str:
    t = _trim(column)
    return f"(CASE WHEN regexp_full_match({t}, '[+-]?\\d+') THEN try_cast({t} AS DOUBLE) END)"


def _date(column: str) -> str:
    t = _trim(column)
    first, last = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"

    def day(pattern: str, y: int, m: int, d: int) -> str:
        part = [f"regexp_extract({t}, '{pattern}', {i})" for i in (y, m, d)]
        return f"try_cast({part[0]} || '-' || lpad({part[1]}, 2, '0') || '-' || lpad({part[2]}, 2, '0') AS TIMESTAMP)"

    return (
        f"(CASE WHEN regexp_matches({t}, '{first}') THEN {day(first, 1, 2, 3)} "
        f"WHEN regexp_matches({t}, '{last}') THEN coalesce({day(last, 3, 1, 2)}, {day(last, 3, 2, 1)}) END)"
    )


def _boolean(column: str) -> str:
    t = f"lower({_trim(column)})"
    return f"(CASE {t} WHEN 'true' THEN true WHEN 'false' THEN false END)"


def _present(column: str, value: str) -> str:
    return f"(CASE WHEN NOT {_missing(column)} THEN {value} END)"


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _fmt_number(x: str) -> str:
    def decimals(digits: int) -> str:
        return f"regexp_replace(format('{{:,.{digits}f}}', round({x}, {digits})), '\\.?0+$', '')"

    return (
        f"(CASE WHEN {x} IS NULL THEN '—' WHEN {x} = 0 THEN '0' "
        f"WHEN abs({x}) >= 1e12 OR abs({x}) < 1e-4 "
        f"THEN regexp_replace(printf('%.3e', {x}), 'e([+-])0(\\d)$', 'e\\1\\2') "
        f"WHEN {x} = floor({x}) THEN format('{{:,.0f}}', {x}) "
        f"WHEN abs({x}) >= 1000 THEN {decimals(2)} WHEN abs({x}) >= 1 THEN {decimals(4)} ELSE {decimals(6)} END)"
    )


def _fmt_int(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _fmt_pct(x: str) -> str:
    return f"(printf('%.1f', ({x}) * 100) || '%')"


def _precision(x: str) -> str:
    exponent = f"CAST(floor(log10(abs({x}))) AS INTEGER)"
    cases = " ".join(f"WHEN {e} THEN printf('%.{7 - e}f', {x})" for e in range(-6, 8))
    return f"(CASE WHEN {x} IS NULL THEN '' WHEN {x} = 0 THEN '0.0000000' ELSE CASE {exponent} {cases} END END)"


def _stats(value: str, relation: str) -> str:
    """One-row statistics of a nullable double expression."""
    return f"""
  SELECT count(x) AS n, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, min(x) AS mn, max(x) AS mx,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3,
         coalesce(skewness(x), 0) AS skew, coalesce(kurtosis_pop(x), 0) AS kurt
  FROM (SELECT {value} AS x FROM {relation}) v"""


def _profile_rows(columns: dict[str, tuple[int, str, str]]) -> str:
    """``name -> (pos, value expression, relation)`` to rows of the numeric profile."""
    parts = []
    for name, (pos, value, relation) in columns.items():
        parts.append(f"""SELECT {pos} AS pos, '{name}' AS name, s.n AS count, s.mean, s.std, s.mn AS min, s.q1, s.median,
  s.q3, s.mx AS max, s.skew, s.kurt,
  (SELECT count(*) FROM {relation} WHERE {value} < s.q1 - 1.5 * (s.q3 - s.q1) OR {value} > s.q3 + 1.5 * (s.q3 - s.q1))
    AS iqr_outliers,
  (SELECT count(*) FROM {relation} WHERE s.std > 0 AND abs({value} - s.mean) > 3 * s.std) AS z_outliers
FROM ({_stats(value, relation)}) s WHERE s.n > 0""")
    return f"""SELECT pos, name, count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min,
  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max, 6) AS max,
  round(skew, 4) AS skew, round(kurt, 4) AS kurt, iqr_outliers, z_outliers FROM ({_union(parts)}) p"""


def _numeric_result(df: DataFrame) -> DataFrame:
    six = ("mean", "std", "min", "q1", "median", "q3", "max")
    return df.select(
        "pos", "name", "count", *(_r(c) for c in six), _r("skew", 4), _r("kurt", 4), "iqr_outliers", "z_outliers"
    )


def _histogram_rows(columns: dict[str, tuple[int, str, str]], bins: str | None) -> str:
    parts = []
    for name, (pos, value, relation) in columns.items():
        k = bins or (
            "greatest(1, least(80, CASE WHEN s.q3 > s.q1 THEN ceil((s.mx - s.mn) / (2 * (s.q3 - s.q1) / cbrt(s.n))) "
            "ELSE ceil(log2(s.n)) + 1 END))"
        )
        parts.append(f"""SELECT {pos} AS pos, '{name}' AS name, b.bin, b.lo, b.hi, count(v.x) AS n
FROM (SELECT CAST(i AS INTEGER) AS bin, mn, w, k, mn + i * w AS lo, CASE WHEN i = k - 1 THEN mx ELSE mn + (i + 1) * w END AS hi
      FROM (SELECT mn, mx, k, (mx - mn) / k AS w FROM (SELECT s.mn, s.mx, CAST({k} AS BIGINT) AS k FROM ({_stats(value, relation)}) s) a) e,
           generate_series(0, e.k - 1) t(i)) b
LEFT JOIN (SELECT {value} AS x FROM {relation}) v
  ON v.x IS NOT NULL AND b.bin = least(greatest(floor((v.x - b.mn) / b.w), 0), b.k - 1)
GROUP BY ALL""")
    label = f"{_fmt_number('lo')} || ' ~ ' || {_fmt_number('hi')}"
    return f"SELECT pos, name, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, {label} AS label FROM ({_union(parts)}) h"


def _histogram_result(df: DataFrame) -> DataFrame:
    return df.select("pos", "name", "bin", _r("lo"), _r("hi"), "n", "label")


def _numbers_of(relation: str, columns: list[str], value=lambda c: f"CAST({c} AS DOUBLE)", positions=None):
    positions = range(len(columns)) if positions is None else positions
    return {c: (p, value(c), relation) for p, c in zip(positions, columns)}


def _dirty_numbers() -> dict[str, tuple[int, str, str]]:
    return {c: (_col(c), _present(c, _number(c)), "dirty") for c in ("price", "qty")}


def _pairs(columns: dict[str, tuple[int, str, str]], ranked: bool, key: str) -> str:
    """Coefficients of all pairs of one relation; ``key`` orders nothing, it only names rows."""
    relation = next(iter(columns.values()))[2]
    values = ", ".join(f"{v} AS n{p}" for p, v, _ in columns.values())
    base = f"SELECT {values} FROM {relation}"
    if ranked:
        ranks = ", ".join(
            f"CASE WHEN n{p} IS NOT NULL THEN rank() OVER (ORDER BY n{p} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY n{p}) - 1) / 2.0 END AS n{p}"
            for p, _, _ in columns.values()
        )
        base = f"SELECT {ranks} FROM ({base}) raw"
    names = list(columns)
    parts = []
    for a, x in enumerate(names):
        for y in names[a + 1 :]:
            i, j = columns[x][0], columns[y][0]
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{x}' AS a, '{y}' AS b, CASE WHEN regr_count(n{i}, n{j}) >= 3 AND "
                f"regr_sxx(n{i}, n{j}) > 0 AND regr_syy(n{i}, n{j}) > 0 THEN "
                f"regr_sxy(n{i}, n{j}) / sqrt(regr_sxx(n{i}, n{j}) * regr_syy(n{i}, n{j})) END AS r, "
                f"CAST(regr_count(n{i}, n{j}) AS BIGINT) AS n FROM base"
            )
    return f"base AS MATERIALIZED ({base}), pairs AS ({_union(parts)})"


_STRENGTH = (
    "CASE WHEN abs(r) >= 0.8 THEN '極強' WHEN abs(r) >= 0.6 THEN '強' WHEN abs(r) >= 0.4 THEN '中等' "
    "WHEN abs(r) >= 0.2 THEN '弱' ELSE '極弱' END"
)


def _types(columns: list[str], relation: str, tests: dict[str, dict[str, str]], absent: dict[str, str], rid: str) -> str:
    """Sampled type tests per column. ``tests[column]`` has SQL conditions for the four types."""
    parts = []
    for p, c in enumerate(columns):
        t = tests[c]
        parts.append(f"""SELECT {p} AS pos, '{c}' AS name, count(*) AS sampled, count(*) FILTER (WHERE b) AS bools,
  count(*) FILTER (WHERE i) AS ints, count(*) FILTER (WHERE n) AS nums, count(*) FILTER (WHERE d) AS dates
FROM (SELECT {t['b']} AS b, {t['i']} AS i, {t['n']} AS n, {t['d']} AS d, row_number() OVER (ORDER BY {rid}) AS turn
      FROM {relation}, (SELECT greatest(1, CAST(floor(count(*) / 2000) AS BIGINT)) AS step FROM {relation}) z
      WHERE {rid} % step = 0 AND NOT ({absent[c]})) s WHERE turn <= 2000""")
    return f"""SELECT *, CASE WHEN sampled = 0 THEN 'text' WHEN bools / sampled >= 0.9 THEN 'boolean'
  WHEN ints / sampled >= 0.9 THEN 'integer' WHEN nums / sampled >= 0.9 THEN 'number'
  WHEN dates / sampled >= 0.9 THEN 'date' ELSE 'text' END AS type FROM ({_union(parts)}) u"""


def _dirty_types() -> str:
    tests = {
        c: {
            "b": f"{_boolean(c)} IS NOT NULL",
            "i": f"{_integer(c)} IS NOT NULL",
            "n": f"{_number(c)} IS NOT NULL",
            "d": f"{_date(c)} IS NOT NULL",
        }
        for c in DIRTY_COLUMNS
    }
    return _types(DIRTY_COLUMNS, "dirty", tests, {c: _missing(c) for c in DIRTY_COLUMNS}, "rid")


def _frequency(columns: list[tuple[int, str]], relation: str, value=_trim, absent=_missing) -> str:
    """``pos, name, value, n`` of text columns."""
    return _union(
        f"SELECT {p} AS pos, '{c}' AS name, {value(c)} AS value, count(*) AS n FROM {relation} "
        f"WHERE NOT {absent(c)} GROUP BY {value(c)}"
        for p, c in columns
    )


_RANKED = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, value) AS rank, "
    "sum(n) OVER (PARTITION BY pos) AS valid, count(*) OVER (PARTITION BY pos) AS distinct_values FROM freq)"
)


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


# Missing values


def _missing_rows(tokens=DEFAULT_MISSING_TOKENS, columns=DIRTY_COLUMNS, relation="dirty") -> str:
    return _union(
        f"SELECT {p} AS pos, '{c}' AS name, count(*) AS n_rows, count(*) FILTER (WHERE {_missing(c, tokens)}) AS missing FROM {relation}"
        for p, c in enumerate(columns)
    )


@_register(
    "missing_by_column",
    f"{_WITH_DIRTY} SELECT pos, name, n_rows, missing, round(missing / n_rows, 6) AS missing_pct FROM ({_missing_rows()}) m",
)
def _(spark, sf_dir):
    return missing.missing_by_column(_dirty(spark, sf_dir)).withColumn("missing_pct", F.round("missing_pct", 6))


CUSTOM_TOKENS = "abc，NA\n O \n"


@_register(
    "missing_custom_tokens",
    f"{_WITH_DIRTY} SELECT pos, name, n_rows, missing, round(missing / n_rows, 6) AS missing_pct "
    f"FROM ({_missing_rows(tg.parse_tokens(CUSTOM_TOKENS))}) m",
)
def _(spark, sf_dir):
    options = ProfileOptions(missing_tokens=tg.parse_tokens(CUSTOM_TOKENS))
    return missing.missing_by_column(_dirty(spark, sf_dir), options).withColumn("missing_pct", F.round("missing_pct", 6))


_ROW_MISSING = " + ".join(f"CAST({_missing(c)} AS INTEGER)" for c in DIRTY_COLUMNS)


@_register(
    "missing_summary",
    f"""{_WITH_DIRTY} SELECT n_rows, n_rows * 6 AS total_cells, missing_cells, round(missing_cells / (n_rows * 6), 6) AS missing_pct,
  complete_rows, n_rows - complete_rows AS any_missing_rows
FROM (SELECT count(*) AS n_rows, CAST(sum(m) AS BIGINT) AS missing_cells, count(*) FILTER (WHERE m = 0) AS complete_rows
      FROM (SELECT {_ROW_MISSING} AS m FROM dirty) c) s""",
)
def _(spark, sf_dir):
    return missing.missing_summary(_dirty(spark, sf_dir)).withColumn("missing_pct", F.round("missing_pct", 6))


@_register(
    "missing_rate_rank",
    f"""{_WITH_DIRTY} SELECT CAST(row_number() OVER (ORDER BY missing / n_rows DESC, pos) AS INTEGER) AS rank, pos, name, missing,
  round(missing / n_rows * 100, 2) AS pct FROM ({_missing_rows()}) m QUALIFY rank <= 40""",
)
def _(spark, sf_dir):
    return missing.missing_rank(_dirty(spark, sf_dir)).drop("missing_pct")


@_register(
    "missing_severity",
    f"""{_WITH_DIRTY}, m AS ({_missing_rows()}) SELECT name, round(missing / n_rows * 100, 2) AS pct,
  CASE WHEN missing / n_rows > 0.5 THEN 'severe' WHEN missing / n_rows > 0.1 THEN 'elevated' ELSE 'normal' END AS band,
  sum(missing) OVER () / sum(n_rows) OVER () > 0.2 AS table_warns FROM m""",
)
def _(spark, sf_dir):
    g = _dirty(spark, sf_dir)
    total = missing.missing_summary(g).select(missing.warns(F.col("missing_pct")).alias("table_warns")).first()[0]
    ranked = missing.missing_rank(g)
    return ranked.select("name", "pct", missing.severity(F.col("pct")).alias("band"), F.lit(total).alias("table_warns"))


_PATTERN = "concat_ws('、', " + ", ".join(f"CASE WHEN {_missing(c)} THEN '{c}' END" for c in DIRTY_COLUMNS) + ")"


@_register(
    "missing_patterns",
    f"""{_WITH_DIRTY} SELECT CAST(row_number() OVER (ORDER BY n DESC, first_rid) AS INTEGER) AS rank, columns, n, round(n / total, 6) AS pct
FROM (SELECT {_PATTERN} AS columns, count(*) AS n, min(rid) AS first_rid FROM dirty GROUP BY 1) p,
     (SELECT count(*) AS total FROM dirty) t WHERE columns <> '' QUALIFY rank <= 12""",
)
def _(spark, sf_dir):
    found = missing.missing_patterns(_dirty(spark, sf_dir))
    return found.select("rank", F.concat_ws("、", "columns").alias("columns"), "n", _r("pct"))


@_register(
    "missing_map",
    f"""{_WITH_DIRTY}, rates AS (SELECT pos, name, CAST(row_number() OVER (ORDER BY missing / n_rows DESC, pos) - 1 AS INTEGER) AS col_pos
                 FROM ({_missing_rows()}) m),
  picked AS (SELECT CAST(i AS INTEGER) AS sample_pos, CAST(floor(i * n / 300) AS BIGINT) AS rid
             FROM (SELECT count(*) AS n FROM dirty) t, generate_series(0, 299) g(i))
SELECT p.sample_pos, d.rid, r.col_pos, r.pos, r.name,
  CASE r.pos {" ".join(f"WHEN {i} THEN {_missing(c)}" for i, c in enumerate(DIRTY_COLUMNS))} END AS is_missing, true AS sampled
FROM dirty d JOIN picked p ON d.rid = p.rid, rates r""",
)
def _(spark, sf_dir):
    return missing.missing_map(_dirty(spark, sf_dir))


# Parsing and types


@_register(
    "parse_numbers",
    f"{_WITH_DIRTY} SELECT rid, {_number('price')} AS price, {_number('qty')} AS qty, {_number('status')} AS status FROM dirty",
)
def _(spark, sf_dir):
    g = _dirty(spark, sf_dir)
    wanted = {c: parse_number(F.col(f"c{_col(c)}")).alias(c) for c in ("price", "qty", "status")}
    return g.frame.select(F.col("k0").alias("rid"), *wanted.values())


@_register(
    "parse_integers", f"{_WITH_DIRTY} SELECT rid, {_integer('price')} AS price, {_integer('qty')} AS qty FROM dirty"
)
def _(spark, sf_dir):
    g = _dirty(spark, sf_dir)
    wanted = [parse_integer(F.col(f"c{_col(c)}")).alias(c) for c in ("price", "qty")]
    return g.frame.select(F.col("k0").alias("rid"), *wanted)


@_register("parse_dates", f"{_WITH_DIRTY} SELECT rid, strftime({_date('odate')}, '%Y-%m-%d %H:%M') AS odate FROM dirty")
def _(spark, sf_dir):
    g = _dirty(spark, sf_dir)
    return g.frame.select(F.col("k0").alias("rid"), fmt_datetime(parse_date(F.col(f"c{_col('odate')}"))).alias("odate"))


@_register("parse_booleans", f"{_WITH_DIRTY} SELECT rid, {_boolean('urgent')} AS urgent FROM dirty")
def _(spark, sf_dir):
    g = _dirty(spark, sf_dir)
    return g.frame.select(F.col("k0").alias("rid"), parse_boolean(F.col(f"c{_col('urgent')}")).alias("urgent"))


@_register("infer_types", f"{_WITH_DIRTY} {_dirty_types()}")
def _(spark, sf_dir):
    return infer.infer_types(_dirty(spark, sf_dir))


_LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
_WHOLE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _lineitem_types() -> str:
    tests = {}
    for c in _LINEITEM:
        number = c in LINEITEM_NUMBERS
        tests[c] = {
            "b": "false",
            "i": "true" if c in _WHOLE else f"{c} = floor({c})" if number else "false",
            "n": "true" if number else "false",
            "d": "true" if c == "l_shipdate" else "false",
        }
    order = ", ".join(_LINEITEM)
    rows = f"WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rid FROM lineitem)"
    return f"{rows} {_types(_LINEITEM, 'numbered', tests, {c: f'{c} IS NULL' for c in _LINEITEM}, 'rid')}"


@_register("typed_infer", _lineitem_types())
def _(spark, sf_dir):
    return infer.infer_types(_grid(spark, sf_dir, "lineitem"))


# Numeric columns


@_register("numeric_profile", _profile_rows(_numbers_of("lineitem", LINEITEM_NUMBERS)))
def _(spark, sf_dir):
    return _numeric_result(numeric.numeric_profile(_grid(spark, sf_dir, "lineitem"), range(8)))


@_register("numeric_profile_text", f"{_WITH_DIRTY} {_profile_rows(_dirty_numbers())}")
def _(spark, sf_dir):
    return _numeric_result(numeric.numeric_profile(_dirty(spark, sf_dir), [_col("price"), _col("qty")]))


_EVENT_VALUES = {"user_id": (2, "CAST(user_id AS DOUBLE)", "events"), "value": (4, "value", "events")}


@_register("numeric_profile_events", _profile_rows(_EVENT_VALUES))
def _(spark, sf_dir):
    g = _grid(spark, sf_dir, "events", ["event_id"], distinct_order=True)
    return _numeric_result(numeric.numeric_profile(g, [2, 4]))


@_register("histogram_auto", _histogram_rows(_numbers_of("lineitem", LINEITEM_NUMBERS), None))
def _(spark, sf_dir):
    return _histogram_result(histogram.histogram(_grid(spark, sf_dir, "lineitem"), range(8)))


@_register(
    "histogram_bins",
    _histogram_rows({"l_extendedprice": (5, "l_extendedprice", "lineitem")}, "25"),
)
def _(spark, sf_dir):
    return _histogram_result(histogram.histogram(_grid(spark, sf_dir, "lineitem"), 5, 25.9, None))


@_register("histogram_text", f"{_WITH_DIRTY} {_histogram_rows(_dirty_numbers(), None)}")
def _(spark, sf_dir):
    return _histogram_result(histogram.histogram(_dirty(spark, sf_dir), [_col("price"), _col("qty")]))


@_register("numeric_profile_sketched", _profile_rows(_numbers_of("lineitem", LINEITEM_NUMBERS)))
def _(spark, sf_dir):
    return _numeric_result(numeric.numeric_profile(_grid(spark, sf_dir, "lineitem"), range(8), sketches=True))


# The same from a state that grew file by file


def _grown(spark, sf_dir: str, tokens=DEFAULT_MISSING_TOKENS):
    """What a state knows of the orders as text, of which a third was added after the rest."""
    g = _dirty(spark, sf_dir)
    folder = f"{spark.sparkContext.getCheckpointDir()}/state-{uuid.uuid4().hex}"
    g.frame.withColumn("part", F.col(g.order[0]) % 3).write.partitionBy("part").parquet(f"{folder}/files")
    state = ProfileState.create(g, f"{folder}/state")
    for files in ([f"{folder}/files/part=0", f"{folder}/files/part=1"], [f"{folder}/files/part=2"]):
        state.update(g.with_frame(spark.read.parquet(*files)))
    return state.profile(ProfileOptions(missing_tokens=tokens, tie="binary"))


@_register(
    "state_missing",
    f"{_WITH_DIRTY} SELECT pos, name, n_rows, missing, round(missing / n_rows, 6) AS missing_pct FROM ({_missing_rows()}) m",
)
def _(spark, sf_dir):
    return _grown(spark, sf_dir).missing.withColumn("missing_pct", F.round("missing_pct", 6))


@_register(
    "state_missing_other_tokens",
    f"{_WITH_DIRTY} SELECT pos, name, n_rows, missing, round(missing / n_rows, 6) AS missing_pct FROM ({_missing_rows(('', '?', 'NA'))}) m",
)
def _(spark, sf_dir):
    return _grown(spark, sf_dir, ("", "?", "NA")).missing.withColumn("missing_pct", F.round("missing_pct", 6))


@_register("state_numeric", f"{_WITH_DIRTY} {_profile_rows(_dirty_numbers())}")
def _(spark, sf_dir):
    return _numeric_result(_grown(spark, sf_dir).numeric).filter(F.col("pos").isin(_col("price"), _col("qty")))


# The same from one ordered index of the values


# Sums over counted values round otherwise in the last place, so means have four digits here.
@_register(
    "value_index_profile",
    f"SELECT * REPLACE (round(mean, 4) AS mean) FROM ({_profile_rows(_numbers_of('lineitem', LINEITEM_NUMBERS))}) p",
)
def _(spark, sf_dir):
    index = value_index(_grid(spark, sf_dir, "lineitem"), range(8))
    return _numeric_result(index.numeric_profile()).withColumn("mean", F.round("mean", 4))


_REBINS = (7, 25, 80)


@_register(
    "value_index_rebins",
    _union(
        f"SELECT {k} AS bins, * FROM ({_histogram_rows({'l_extendedprice': (5, 'l_extendedprice', 'lineitem')}, str(k))}) h{k}"
        for k in _REBINS
    ),
)
def _(spark, sf_dir):
    index = value_index(_grid(spark, sf_dir, "lineitem"), [5])
    return union([_histogram_result(index.histogram(5, k)).withColumn("bins", F.lit(k)) for k in _REBINS])


@_register(
    "value_index_ranks",
    """SELECT CAST(c AS INTEGER) AS pos, v, count(*) AS n, avg(r) AS rank FROM (
  SELECT 4 AS c, l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem
  UNION ALL SELECT 6, l_discount, row_number() OVER (ORDER BY l_discount) FROM lineitem) t GROUP BY c, v""",
)
def _(spark, sf_dir):
    index = value_index(_grid(spark, sf_dir, "lineitem"), [4, 6])
    return union([index.average_ranks(p).select(F.lit(p).alias("pos"), "v", "n", "rank") for p in (4, 6)])


# Distinct values and categories


def _unique_rows(table: str, columns: list[str]) -> str:
    return _union(
        f"SELECT {p} AS pos, '{c}' AS name, count(DISTINCT {c}) AS unique_values, "
        f"false AS unique_truncated FROM {table}"
        for p, c in enumerate(columns)
    )


def _unique_result(g: tg.Grid) -> DataFrame:
    return categories.unique_counts(g).withColumnRenamed("unique", "unique_values")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@_register("unique_counts", _unique_rows("orders", _ORDERS))
def _(spark, sf_dir):
    return _unique_result(_grid(spark, sf_dir, "orders", ["o_orderkey"], distinct_order=True))


@_register("unique_counts_lineitem", _unique_rows("lineitem", _LINEITEM))
def _(spark, sf_dir):
    return _unique_result(_grid(spark, sf_dir, "lineitem"))


@_register(
    "unique_counts_text",
    f"{_WITH_DIRTY} "
    + _union(
        f"SELECT {p} AS pos, '{c}' AS name, count(DISTINCT {_trim(c)}) FILTER (WHERE NOT {_missing(c)}) AS unique_values, "
        f"false AS unique_truncated FROM dirty"
        for p, c in enumerate(DIRTY_COLUMNS)
    ),
)
def _(spark, sf_dir):
    return _unique_result(_dirty(spark, sf_dir))


_ORDER_TEXT = [(2, "o_orderstatus"), (5, "o_orderpriority")]


@_register(
    "category_top",
    f"WITH freq AS ({_frequency(_ORDER_TEXT, 'orders')}), {_RANKED} "
    "SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, n FROM ranked WHERE rank <= 500",
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir, "orders", ["o_orderkey"], distinct_order=True)
    return categories.top_categories(g, [2, 5], OPTIONS)


_PART_TEXT = [(1, "p_name"), (2, "p_brand"), (3, "p_type")]


@_register(
    "category_summary",
    f"WITH freq AS ({_frequency(_PART_TEXT, 'part')}), {_RANKED} "
    "SELECT pos, name, CAST(valid AS BIGINT) AS valid, distinct_values, distinct_values AS cardinality, "
    "distinct_values > 500 AS truncated, value AS top_value, n AS top_n, round(n / valid, 6) AS top_share "
    "FROM ranked WHERE rank = 1",
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir, "part", ["p_partkey"], distinct_order=True)
    found = categories.category_summary(g, [1, 2, 3], OPTIONS).withColumnRenamed("distinct", "distinct_values")
    return found.withColumn("top_share", F.round("top_share", 6))


@_register(
    "category_whole_texts",
    f"WITH freq AS ({_frequency([(1, 'text'), (2, 'lang'), (3, 'source')], 'documents')}), {_RANKED} "
    "SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, n FROM ranked WHERE rank <= 500",
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir, "documents", ["doc_id"], distinct_order=True)
    return categories.top_categories(g, [1, 2, 3], OPTIONS)


@_register(
    "low_card_numeric",
    f"{_WITH_DIRTY}, freq AS ({_frequency([(_col('qty'), 'qty')], 'dirty')}), {_RANKED} "
    "SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, n FROM ranked WHERE rank <= 500 AND distinct_values <= 50",
)
def _(spark, sf_dir):
    p = tg.profile(_dirty(spark, sf_dir), OPTIONS)
    few = [c for c in p.category_columns if c in p.numeric_columns]
    return categories.top_categories(p.grid, few, OPTIONS)


@_register(
    "low_card_typed",
    "WITH freq AS ("
    + _frequency(
        list(enumerate(LINEITEM_NUMBERS)),
        "lineitem",
        lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')",
        lambda c: f"({c} IS NULL)",
    )
    + f"), {_RANKED} SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, n FROM ranked "
    "WHERE rank <= 500 AND distinct_values <= 50",
)
def _(spark, sf_dir):
    p = tg.profile(_grid(spark, sf_dir, "lineitem"), OPTIONS)
    few = [c for c in p.category_columns if c in p.numeric_columns]
    return categories.top_categories(p.grid, few, OPTIONS)


@_register(
    "category_share",
    f"{_WITH_DIRTY}, freq AS ({_frequency([(_col(c), c) for c in ('status', 'qty', 'urgent')], 'dirty')}), {_RANKED} "
    "SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, n, round(n / valid, 6) AS share FROM ranked WHERE rank <= 30",
)
def _(spark, sf_dir):
    wanted = [_col(c) for c in ("status", "qty", "urgent")]
    return categories.category_table(_dirty(spark, sf_dir), wanted, OPTIONS).withColumn("share", F.round("share", 6))


# Dates


def _date_rows(pos: int, name: str, value: str, relation: str, absent: str = "false") -> str:
    return f"""SELECT {pos} AS pos, '{name}' AS name, count, strftime(mn, '%Y-%m-%d %H:%M') AS first, strftime(mx, '%Y-%m-%d %H:%M') AS last,
  unparseable, CASE WHEN epoch(mx) - epoch(mn) <= 180 * 86400 THEN 'day' ELSE 'month' END AS unit
FROM (SELECT count(t) AS count, min(t) AS mn, max(t) AS mx, count(*) FILTER (WHERE t IS NULL AND NOT a) AS unparseable
      FROM (SELECT date_trunc('second', {value}) AS t, {absent} AS a FROM {relation}) v) s"""


def _date_result(df: DataFrame) -> DataFrame:
    return df.select(
        "pos", "name", "count", fmt_datetime(F.col("min")).alias("first"), fmt_datetime(F.col("max")).alias("last"),
        "unparseable", "unit",
    )


_DIRTY_DATE = _present("odate", _date("odate"))


@_register("date_profile", _date_rows(1, "ts", "ts", "events"))
def _(spark, sf_dir):
    g = _grid(spark, sf_dir, "events", ["event_id"], distinct_order=True)
    return _date_result(dates.date_profile(g, [1]))


@_register("date_profile_text", f"{_WITH_DIRTY} {_date_rows(_col('odate'), 'odate', _DIRTY_DATE, 'dirty', _missing('odate'))}")
def _(spark, sf_dir):
    return _date_result(dates.date_profile(_dirty(spark, sf_dir), [_col("odate")]))


def _bucket_rows(pos: int, name: str, value: str, relation: str, unit: str) -> str:
    form = {"day": "%Y-%m-%d", "month": "%Y-%m"}[unit]
    return (
        f"SELECT {pos} AS pos, '{name}' AS name, '{unit}' AS unit, strftime({value}, '{form}') AS label, count(*) AS n "
        f"FROM {relation} WHERE {value} IS NOT NULL GROUP BY ALL"
    )


@_register("date_buckets_day", _bucket_rows(1, "ts", "ts", "events", "day"))
def _(spark, sf_dir):
    return dates.date_buckets(_grid(spark, sf_dir, "events", ["event_id"], distinct_order=True), [1])


@_register("date_buckets_month", _bucket_rows(4, "o_orderdate", "o_orderdate", "orders", "month"))
def _(spark, sf_dir):
    return dates.date_buckets(_grid(spark, sf_dir, "orders", ["o_orderkey"], distinct_order=True), [4])


@_register("date_buckets_text", f"{_WITH_DIRTY} {_bucket_rows(_col('odate'), 'odate', _DIRTY_DATE, 'dirty', 'month')}")
def _(spark, sf_dir):
    return dates.date_buckets(_dirty(spark, sf_dir), [_col("odate")])


# Correlation


_LINEITEM_PAIRS = _numbers_of("lineitem", LINEITEM_NUMBERS)


def _pair_result(df: DataFrame) -> DataFrame:
    return df.select("i", "j", "a", "b", _r("r"), "n")


@_register(
    "pearson_pairs", f"WITH {_pairs(_LINEITEM_PAIRS, False, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs"
)
def _(spark, sf_dir):
    return _pair_result(correlation.pair_table(_grid(spark, sf_dir, "lineitem"), range(8), "pearson"))


@_register(
    "spearman_pairs", f"WITH {_pairs(_LINEITEM_PAIRS, True, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs"
)
def _(spark, sf_dir):
    return _pair_result(correlation.pair_table(_grid(spark, sf_dir, "lineitem"), range(8), "spearman"))


@_register(
    "pearson_pairs_text",
    f"{_WITH_DIRTY}, {_pairs(_dirty_numbers(), False, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs",
)
def _(spark, sf_dir):
    return _pair_result(correlation.pair_table(_dirty(spark, sf_dir), [_col("price"), _col("qty")], "pearson"))


@_register(
    "spearman_pairs_text",
    f"{_WITH_DIRTY}, {_pairs(_dirty_numbers(), True, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs",
)
def _(spark, sf_dir):
    return _pair_result(correlation.pair_table(_dirty(spark, sf_dir), [_col("price"), _col("qty")], "spearman"))


@_register(
    "strongest_pairs",
    f"WITH {_pairs(_LINEITEM_PAIRS, False, '')} SELECT a, b, round(r, 6) AS r, {_STRENGTH} AS strength "
    "FROM (SELECT * FROM pairs WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 15) t",
)
def _(spark, sf_dir):
    pairs = correlation.pair_table(_grid(spark, sf_dir, "lineitem"), range(8), "pearson")
    return correlation.strongest_pairs(pairs).select("a", "b", _r("r"), "strength")


_PART_NUMBERS = {
    "p_partkey": (0, "CAST(p_partkey AS DOUBLE)", "part"),
    "p_size": (4, "CAST(p_size AS DOUBLE)", "part"),
    "p_retailprice": (5, "p_retailprice", "part"),
}


@_register(
    "correlation_matrix",
    f"WITH {_pairs(_PART_NUMBERS, False, '')} SELECT i, j, a, b, round(r, 3) AS shown FROM "
    "(SELECT i, j, a, b, r FROM pairs UNION ALL SELECT j, i, b, a, r FROM pairs UNION ALL "
    + _union(f"SELECT {p}, {p}, '{c}', '{c}', 1.0" for c, (p, _, _) in _PART_NUMBERS.items())
    + ") m",
)
def _(spark, sf_dir):
    p = tg.profile(_grid(spark, sf_dir, "part", ["p_partkey"], distinct_order=True))
    return correlation.full_matrix(p.grid, p.candidates.positions, p.pearson).select("i", "j", "a", "b", "shown")


# Row pages


@_register("preview", f"{_WITH_DIRTY} SELECT {', '.join(DIRTY_COLUMNS)} FROM dirty ORDER BY rid LIMIT 200")
def _(spark, sf_dir):
    return paging.preview(_dirty(spark, sf_dir)).toDF(*DIRTY_COLUMNS)


@_register("page_rows", f"{_WITH_DIRTY} SELECT rid, {', '.join(DIRTY_COLUMNS)} FROM dirty ORDER BY rid LIMIT 40 OFFSET 125")
def _(spark, sf_dir):
    return paging.rows(_dirty(spark, sf_dir), 125, 40).toDF("rid", *DIRTY_COLUMNS)


@_register("page_rows_deep", f"{_WITH_DIRTY} SELECT rid, {', '.join(DIRTY_COLUMNS)} FROM dirty ORDER BY rid LIMIT 40 OFFSET 9990")
def _(spark, sf_dir):
    return paging.rows(_dirty(spark, sf_dir), 9990, 40, deep=1000).toDF("rid", *DIRTY_COLUMNS)


_MASKED = ", ".join(f"CASE WHEN {_missing(c)} THEN '∅' ELSE {c} END AS {c}" for c in DIRTY_COLUMNS)


@_register("page_masked", f"{_WITH_DIRTY} SELECT rid, {_MASKED} FROM dirty ORDER BY rid LIMIT 50 OFFSET 150")
def _(spark, sf_dir):
    return paging.page(_dirty(spark, sf_dir), 3).toDF("rid", *DIRTY_COLUMNS)


# Queries as sources


def _source(spark: SparkSession, sf_dir: str, sql: str, params=()) -> DataFrame:
    return query(_views(prepare(spark), sf_dir), sql, params).rows


_JOIN = """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice >= {floor} AND o_orderstatus = {status} GROUP BY n_name"""


@_register("sql_source_join", _JOIN.format(floor="1000", status="'F'"))
def _(spark, sf_dir):
    params = [Param("floor", "1000", "number"), Param(":status", "F"), Param(" ", "unused")]
    return _source(spark, sf_dir, _JOIN.format(floor=":floor", status=":status"), params)


_WINDOW = """SELECT o_custkey, o_orderkey, place FROM (
  SELECT o_custkey, o_orderkey,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
  FROM orders) t WHERE place <= 2"""


@_register("sql_source_window", _WINDOW)
def _(spark, sf_dir):
    return _source(spark, sf_dir, _WINDOW)


_SETOP = """WITH busy AS (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity = 50)
SELECT s_suppkey AS k FROM supplier EXCEPT SELECT k FROM busy
UNION ALL SELECT k FROM (SELECT s_suppkey AS k FROM supplier INTERSECT SELECT k FROM busy) b"""


@_register("sql_source_setop", _SETOP)
def _(spark, sf_dir):
    return _source(spark, sf_dir, _SETOP)


_ROLLUP = """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""


@_register("sql_source_rollup", _ROLLUP)
def _(spark, sf_dir):
    return _source(spark, sf_dir, _ROLLUP)


_CAPPED = "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > {low} ORDER BY c_custkey"


@_register(
    "sql_source_capped",
    f"SELECT *, (SELECT count(*) FROM customer WHERE c_acctbal > 0) > 100 AS truncated "
    f"FROM ({_CAPPED.format(low='0')} LIMIT 100) t",
)
def _(spark, sf_dir):
    result = query(_views(prepare(spark), sf_dir), _CAPPED.format(low=":low"), [Param("low", "0", "number")], 100)
    return result.rows.withColumn("truncated", F.lit(result.truncated()))


# Rendering, profiles and report tables


@_register(
    "render_cells",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS id_text,
  CASE WHEN date_trunc('second', ts) = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
  CASE WHEN value > 50 THEN 'TRUE' ELSE 'FALSE' END AS flag_text, event_type AS type_text,
  '<BLOB ' || octet_length(encode(props)) || ' bytes>' AS blob_text, strftime(ts, '%Y-%m-%d') AS date_text FROM events""",
)
def _(spark, sf_dir):
    df = _table(prepare(spark), sf_dir, "events").select(
        "event_id",
        F.col("event_id").alias("id_text"),
        F.col("ts").alias("ts_text"),
        (F.col("value") > 50).alias("flag_text"),
        F.col("event_type").alias("type_text"),
        F.col("props").cast("binary").alias("blob_text"),
        F.col("ts").cast("date").alias("date_text"),
    )
    return df.select("event_id", *(render_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields[1:]))


def _dirty_profile_ctes() -> str:
    """Scalars of the dirty table for the profile, export and overview queries."""
    counts = _missing_rows()
    cat_columns = [(_col(c), c) for c in ("order_code", "status", "qty", "urgent")]
    return f"""{_WITH_DIRTY}, types AS ({_dirty_types()}), counts AS ({counts}),
uniques AS ({_union(f"SELECT {p} AS pos, count(DISTINCT {_trim(c)}) FILTER (WHERE NOT {_missing(c)}) AS uniq FROM dirty" for p, c in enumerate(DIRTY_COLUMNS))}),
freq AS ({_frequency(cat_columns, 'dirty')}), {_RANKED},
cats AS (SELECT pos, distinct_values AS cardinality, value AS top_value, n AS top_n FROM ranked WHERE rank = 1),
stats AS ({_union(f"SELECT {p} AS pos, s.* FROM ({_stats(v, r)}) s" for p, v, r in _dirty_numbers().values())}),
buckets AS (SELECT {_col('odate')} AS pos, count(DISTINCT strftime({_DIRTY_DATE}, '%Y-%m')) AS n_buckets,
            count({_DIRTY_DATE}) AS date_count FROM dirty),
joined AS (SELECT t.pos, t.name, t.type, c.n_rows, c.missing, c.missing / c.n_rows AS missing_pct, u.uniq, s.n, s.mean, s.median, s.std, s.mn, s.mx,
                  k.cardinality, k.top_value, k.top_n, b.n_buckets, b.date_count
           FROM types t JOIN counts c USING (pos) JOIN uniques u USING (pos) LEFT JOIN stats s USING (pos)
           LEFT JOIN cats k USING (pos) LEFT JOIN buckets b USING (pos))"""


_TYPE_LABEL = (
    "CASE type WHEN 'integer' THEN '整數' WHEN 'number' THEN '數值' WHEN 'date' THEN '日期' WHEN 'boolean' THEN '布林' ELSE '文字' END"
)


@_register(
    "column_profile",
    f"""{_dirty_profile_ctes()} SELECT pos, name, type, n_rows, missing, round(missing_pct, 6) AS missing_pct, uniq AS unique_values,
  n AS count, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, cardinality, top_value, top_n, date_count,
  n_buckets AS buckets FROM joined""",
)
def _(spark, sf_dir):
    p = tg.profile(_dirty(spark, sf_dir), OPTIONS)
    return p.columns.select(
        "pos", "name", "type", "n_rows", "missing", _r("missing_pct"), F.col("unique").alias("unique_values"), "count",
        _r("mean"), _r("median"), _r("std"), "cardinality", "top_value", "top_n", "date_count", "buckets",
    )


@_register(
    "column_overview",
    f"""{_dirty_profile_ctes()} SELECT pos + 1 AS no, name, {_TYPE_LABEL} AS type, {_fmt_int('missing')} AS missing,
  {_fmt_pct('missing_pct')} AS missing_pct, {_fmt_int('uniq')} AS unique_values,
  CASE WHEN n IS NOT NULL THEN '平均 ' || {_fmt_number('mean')} || '、中位數 ' || {_fmt_number('median')}
       WHEN date_count > 0 THEN n_buckets || ' 個月區間'
       WHEN top_n IS NOT NULL THEN '最多：「' || CASE WHEN length(top_value) > 16 THEN top_value[:16] || '…' ELSE top_value END
            || '」(' || {_fmt_int('top_n')} || ')'
       ELSE '—' END AS summary FROM joined""",
)
def _(spark, sf_dir):
    p = tg.profile(_dirty(spark, sf_dir), OPTIONS)
    return report.column_overview(p).withColumnRenamed("unique", "unique_values")


_STATS_ALIASES = [
    "no", "name", "type", "missing", "missing_pct", "unique_values", "mean", "median", "std", "min", "max",
    "cardinality", "top_value",
]


@_register(
    "column_stats_export",
    f"""{_dirty_profile_ctes()} SELECT CAST(pos + 1 AS VARCHAR) AS no, name, type, CAST(missing AS VARCHAR) AS missing,
  printf('%.2f', missing_pct * 100) AS missing_pct, CAST(uniq AS VARCHAR) AS unique_values, {_precision('mean')} AS mean,
  {_precision('median')} AS median, {_precision('std')} AS std, {_precision('mn')} AS min, {_precision('mx')} AS max,
  coalesce(CAST(cardinality AS VARCHAR), '') AS cardinality, coalesce(top_value, '') AS top_value FROM joined""",
)
def _(spark, sf_dir):
    return report.column_stats(tg.profile(_dirty(spark, sf_dir), OPTIONS)).toDF(*_STATS_ALIASES)


@_register(
    "report_summary",
    f"""{_WITH_DIRTY} SELECT {_fmt_int('n')} AS "rows", '6' AS columns, {_fmt_int('n * 6')} AS total_cells, {_fmt_int('m')} AS missing_cells,
  {_fmt_pct('m / (n * 6)')} AS missing_pct, {_fmt_int('f')} AS complete_rows, {_fmt_int('n - f')} AS any_missing_rows
FROM (SELECT count(*) AS n, sum(m) AS m, count(*) FILTER (WHERE m = 0) AS f FROM (SELECT {_ROW_MISSING} AS m FROM dirty) c) s""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "summary")


@_register(
    "report_category_tables",
    f"""{_WITH_DIRTY}, freq AS ({_frequency([(_col(c), c) for c in ('order_code', 'status', 'urgent')], 'dirty')}), {_RANKED}
SELECT pos, name, CAST(rank AS INTEGER) AS rank, value, {_fmt_int('n')} AS n FROM ranked WHERE rank <= 5""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "category_tables")


@_register(
    "report_patterns",
    f"""{_WITH_DIRTY} SELECT CAST(row_number() OVER (ORDER BY n DESC, first_rid) AS INTEGER) AS rank, columns, {_fmt_int('n')} AS n,
  {_fmt_pct('n / total')} AS pct
FROM (SELECT {_PATTERN} AS columns, count(*) AS n, min(rid) AS first_rid FROM dirty GROUP BY 1) p,
     (SELECT count(*) AS total FROM dirty) t WHERE columns <> '' QUALIFY rank <= 12""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "patterns")


@_register(
    "report_histograms",
    f"{_WITH_DIRTY} SELECT pos, name, bin, label, n FROM ({_histogram_rows(_dirty_numbers(), None)}) r",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "histograms")


@_register(
    "report_date_series",
    f"{_WITH_DIRTY} SELECT pos, name, label, n FROM ({_bucket_rows(_col('odate'), 'odate', _DIRTY_DATE, 'dirty', 'month')}) b",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "date_series")


@_register(
    "report_pearson",
    f"{_WITH_DIRTY}, {_pairs(_dirty_numbers(), False, '')} SELECT a, b, round(r, 3) AS r FROM "
    "(SELECT a, b, r FROM pairs UNION ALL SELECT b, a, r FROM pairs UNION ALL SELECT 'price', 'price', 1.0 "
    "UNION ALL SELECT 'qty', 'qty', 1.0) m",
)
def _(spark, sf_dir):
    found = report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "pearson")
    return spark.createDataFrame([], "a string, b string, r double") if found is None else found


@_register(
    "report_distributions",
    f"{_WITH_DIRTY} SELECT pos, name, type, CASE WHEN type IN ('integer', 'number') THEN 'numeric' WHEN type = 'date' THEN 'date' "
    f"ELSE 'category' END AS shape FROM ({_dirty_types()}) t",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "distributions")


def _lineitem_profile() -> str:
    """Every scalar of every column. The types come from the share of whole numbers in all rows."""
    at = {c: p for p, c in enumerate(_LINEITEM)}
    types = _union(
        f"SELECT {p} AS pos, '{c}' AS name, "
        + (f"CASE WHEN avg(CAST({c} = floor({c}) AS INTEGER)) >= 0.9 THEN 'integer' ELSE 'number' END" if c in LINEITEM_NUMBERS else f"'{'date' if c == 'l_shipdate' else 'text'}'")
        + f" AS type, count(*) AS n_rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS uniq FROM lineitem"
        for c, p in at.items()
    )
    freq = _frequency(
        [(p, c) for c, p in at.items() if c != "l_shipdate"], "lineitem",
        lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')", lambda c: f"({c} IS NULL)",
    )
    numbers = _profile_rows(_numbers_of("lineitem", LINEITEM_NUMBERS))
    return f"""WITH types AS ({types}), freq AS ({freq}), {_RANKED}, nums AS ({numbers}),
cats AS (SELECT pos, distinct_values AS cardinality, distinct_values > 500 AS truncated, value AS top_value, n AS top_n,
                round(n / valid, 6) AS top_share FROM ranked WHERE rank = 1 AND (distinct_values <= 50 OR pos >= 8)),
days AS ({_date_rows(at['l_shipdate'], 'l_shipdate', 'l_shipdate', 'lineitem')}),
buckets AS (SELECT pos, count(*) AS buckets FROM ({_bucket_rows(at['l_shipdate'], 'l_shipdate', 'l_shipdate', 'lineitem', 'month')}) b GROUP BY pos)
SELECT t.pos, t.name, t.type, t.n_rows, t.missing, round(t.missing / t.n_rows, 6) AS missing_pct, t.uniq AS unique_values,
  n.count, n.mean, n.std, n.min, n.q1, n.median, n.q3, n.max, n.skew, n.kurt, n.iqr_outliers, n.z_outliers,
  c.cardinality, c.truncated, c.top_value, c.top_n, c.top_share,
  d.count AS date_count, d.first AS date_first, d.last AS date_last, d.unparseable, d.unit, k.buckets
FROM types t LEFT JOIN nums n USING (pos) LEFT JOIN cats c USING (pos) LEFT JOIN days d USING (pos) LEFT JOIN buckets k USING (pos)"""


@_register("lineitem_profile", _lineitem_profile())
def _(spark, sf_dir):
    # Rows in stored order: the table has no key of its own.
    found = tg.profile(_grid(spark, sf_dir, "lineitem", by_file=True), OPTIONS).columns
    six = ("mean", "std", "min", "q1", "median", "q3", "max", "top_share", "missing_pct")
    for name in six:
        found = found.withColumn(name, F.round(name, 6))
    found = found.withColumns({n: F.round(n, 4) for n in ("skew", "kurt")})
    return found.select(
        "pos", "name", "type", "n_rows", "missing", "missing_pct", F.col("unique").alias("unique_values"), "count", "mean", "std",
        "min", "q1", "median", "q3", "max", "skew", "kurt", "iqr_outliers", "z_outliers", "cardinality", "truncated", "top_value",
        "top_n", "top_share", "date_count", fmt_datetime(F.col("date_min")).alias("date_first"),
        fmt_datetime(F.col("date_max")).alias("date_last"), "unparseable", "unit", "buckets",
    )


# A SELECT as the profiled table


_SELECTED = """SELECT o_orderkey, o_totalprice, c_acctbal, c_nationkey, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= {low} AND o_orderstatus <> {status}"""
_SELECTED_NUMBERS = ["o_orderkey", "o_totalprice", "c_acctbal", "c_nationkey"]


@_register(
    "select_profile",
    f"WITH picked AS ({_SELECTED.format(low='50000', status=chr(39) + 'P' + chr(39))}), "
    f"nums AS ({_profile_rows(_numbers_of('picked', _SELECTED_NUMBERS))}), "
    + "uniq AS ("
    + _union(
        f"SELECT {p} AS pos, '{c}' AS name, count(DISTINCT {c}) AS unique_values, count(*) AS n_rows FROM picked"
        for p, c in enumerate([*_SELECTED_NUMBERS, "c_mktsegment"])
    )
    + ") SELECT u.pos, u.name, u.n_rows, u.unique_values, n.count, n.mean, n.std, n.median, n.iqr_outliers FROM uniq u LEFT JOIN nums n USING (pos)",
)
def _(spark, sf_dir):
    params = [Param("low", "50000", "number"), Param("status", "P")]
    result = query(_views(prepare(spark), sf_dir), _SELECTED.format(low=":low", status=":status"), params)
    p = tg.profile(result.grid(["o_orderkey"]), OPTIONS)
    return p.columns.select(
        "pos", "name", "n_rows", F.col("unique").alias("unique_values"), "count", _r("mean"), _r("std"), _r("median"), "iqr_outliers"
    )


_WIDE = """SELECT CAST(l_orderkey AS DOUBLE) AS a0, CAST(l_partkey AS DOUBLE) AS a1, CAST(l_suppkey AS DOUBLE) AS a2,
  CAST(l_linenumber AS DOUBLE) AS a3, l_quantity AS a4, l_extendedprice AS a5, l_discount AS a6, l_tax AS a7,
  CAST(o_custkey AS DOUBLE) AS a8, o_totalprice AS a9, CAST(p_size AS DOUBLE) AS a10, p_retailprice AS a11,
  CAST(s_nationkey AS DOUBLE) AS a12, s_acctbal AS a13, l_quantity * l_tax AS a14, l_extendedprice * l_discount AS a15,
  o_totalprice - l_extendedprice AS a16
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
_WIDE_NUMBERS = [f"a{i}" for i in range(17)]


@_register(
    "correlation_wide",
    f"WITH wide AS ({_WIDE}), {_pairs(_numbers_of('wide', _WIDE_NUMBERS, lambda c: c), False, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs",
)
def _(spark, sf_dir):
    g = query(_views(prepare(spark), sf_dir), _WIDE).grid()
    return _pair_result(correlation.pair_table(g, range(17), "pearson"))


_MANY = "SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + {k}) % {7 + k} = 0 THEN NULL ELSE CAST((l_orderkey * {2 * k + 1} + l_partkey * {k % 7} + l_linenumber * {k}) % {31 + 3 * k} AS DOUBLE) END AS a{k}"
    for k in range(40)
) + " FROM lineitem"
_MANY_NUMBERS = [f"a{k}" for k in range(40)]


@_register(
    "correlation_many",
    f"WITH many AS ({_MANY}), {_pairs(_numbers_of('many', _MANY_NUMBERS, lambda c: c), False, '')} SELECT i, j, a, b, round(r, 6) AS r, n FROM pairs",
)
def _(spark, sf_dir):
    g = query(_views(prepare(spark), sf_dir), _MANY).grid()
    return _pair_result(correlation.pair_table(g, range(40), "pearson"))


# Delimited records and files, written from every row of orders


_RECORDS = """SELECT o_orderkey AS k, o_orderkey || ',"' || o_orderpriority || '",' || o_orderstatus AS line FROM orders
UNION ALL SELECT -1, ' id , priority,state,state' UNION ALL SELECT -2, ' , ,' UNION ALL SELECT o_orderkey, ',,' FROM orders WHERE o_orderkey % 5 = 0"""
_PARSED = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, o_orderstatus AS state, '' AS \"state (2)\" FROM orders"


def _cells(source) -> DataFrame:
    g = source.grid
    return g.frame.select(*(g.cell(p).shown.alias(name) for p, name in enumerate(g.names)))


@_register("records_parsed", _PARSED)
def _(spark, sf_dir):
    rows = spark.sql(_RECORDS.replace("FROM orders", "FROM {orders}"), orders=_table(prepare(spark), sf_dir, "orders"))
    return _cells(parse_records(rows, "line", ["k"]))


def _written(spark, sf_dir: str, encoding: str) -> str:
    """Orders as delimited files in one encoding below the checkpoint folder, one header in each file."""
    orders = _table(prepare(spark), sf_dir, "orders")
    text = orders.select("o_orderkey", F.concat(F.lit("訂單"), F.col("o_orderpriority")).alias("名稱"), "o_totalprice")
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    with java_charsets(spark):
        text.repartition(3, "o_orderkey").write.options(header=True, sep=";", encoding=encoding, quote='"').csv(path)
    return path


_FILED = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '訂單' || o_orderpriority AS \"名稱\", CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders"


@_register("delimited_roundtrip", _FILED)
def _(spark, sf_dir):
    return _cells(read_delimited(spark, _written(spark, sf_dir, "UTF-8")))


@_register("encoding_roundtrip", _FILED)
def _(spark, sf_dir):
    return _cells(read_delimited(spark, _written(spark, sf_dir, "Big5-HKSCS")))


def _broken_lines(spark, sf_dir: str) -> str:
    """Orders as files whose texts hold line breaks, separators and quotes."""
    orders = _table(prepare(spark), sf_dir, "orders")
    note = F.concat(
        F.col("o_orderpriority"), F.lit('\nsaid "'), F.col("o_orderstatus"), F.lit('", twice\r\n\n'), F.col("o_custkey"), F.lit("\n,")
    )
    path = f"{spark.sparkContext.getCheckpointDir()}/broken-{uuid.uuid4().hex}"
    orders.select("o_orderkey", note.alias("note"), "o_totalprice").repartition(3, "o_orderkey").write.options(
        header=True, quote='"', escape='"'
    ).csv(path)
    return path


@_register(
    "delimited_quoted_breaks",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority || chr(10) || 'said "' || o_orderstatus || '", twice' || chr(13) || chr(10)
  || chr(10) || o_custkey || chr(10) || ',' AS note, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders""",
)
def _(spark, sf_dir):
    return _cells(read_delimited(spark, _broken_lines(spark, sf_dir)))


@_register(
    "source_info",
    "SELECT 'csv' AS kind, 'Big5' AS encoding, count(*) AS row_count, CAST(3 AS INTEGER) AS column_count FROM orders",
)
def _(spark, sf_dir):
    return read_delimited(spark, _written(spark, sf_dir, "Big5-HKSCS")).info().select("kind", "encoding", "row_count", "column_count")


# More report sections


@_register(
    "report_columns",
    f"""{_dirty_profile_ctes()} SELECT pos + 1 AS no, name, {_TYPE_LABEL} AS type, {_fmt_int('missing')} AS missing,
  {_fmt_pct('missing_pct')} AS missing_pct, {_fmt_int('uniq')} AS unique_values FROM joined""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "columns").withColumnRenamed("unique", "unique_values")


@_register(
    "report_missing_rates",
    f"""{_WITH_DIRTY} SELECT CAST(row_number() OVER (ORDER BY missing / n_rows DESC, pos) AS INTEGER) AS rank, name,
  round(missing / n_rows * 100, 2) AS pct FROM ({_missing_rows()}) m""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "missing_rates")


@_register("report_missing_map", f"SELECT rid, col_pos, name FROM ({_SQL['missing_map']}) m WHERE is_missing")
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "missing_map")


@_register(
    "report_category_series",
    f"""{_WITH_DIRTY}, freq AS ({_frequency([(_col(c), c) for c in ('order_code', 'status', 'qty', 'urgent')], 'dirty')}), {_RANKED}
SELECT pos, name, CAST(rank AS INTEGER) AS rank, CASE WHEN length(value) > 14 THEN value[:14] || '…' ELSE value END AS label, n
FROM ranked WHERE rank <= 15 AND name <> 'qty'""",
)
def _(spark, sf_dir):
    return report.report_section(tg.profile(_dirty(spark, sf_dir), OPTIONS), "category_series")


# ---------------------------------------------------------------------------
# Training-data operators, present only with their own folders
# ---------------------------------------------------------------------------

try:
    import tallygrid.llm.registry as _llm
except ModuleNotFoundError as gone:
    if gone.name not in ("tallygrid.llm", "tallygrid.llm.registry"):
        raise
else:
    _QUERIES.update(_llm.queries())
    _SQL.update(_llm.oracle_sql())
try:
    import corpus_pipeline as _pipeline
except ModuleNotFoundError as gone:
    if gone.name not in ("corpus_pipeline", "tallygrid.llm"):
        raise
else:
    _QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        _SQL["pipeline"] = _pipeline.ORACLE_SQL

# ---------------------------------------------------------------------------
# Contract
# ---------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The column profile of lineitem: one row per column."""
    return _QUERIES["lineitem_profile"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
