"""Profiles that grow with their files, and that change their missing tokens without the cells.

A state is a folder of partial aggregates per input file: how often each cell text occurs in each column, with
the number it spells, and how often each row *signature* occurs. A signature has one character per
column: other, blank, or which of the watched tokens the cell is. Nothing in it depends on the
tokens that a profile treats as missing, so any set of watched tokens can be applied later, and the
files are never read again. Counts of files add up, so a state of two files that a third is
added to equals the state of all three, whatever the order.

:meth:`ProfileState.pending` names the files that the state lacks, and :meth:`ProfileState.update` adds them. Each run writes its rows under a name of
its own and is entered in the list of files last; rows of a run that did not finish are never
read, and the run can simply be made again.

Statistics of text columns are those of the numbers that their cells spell; which type a column
has is the profile's question, for it depends on the order of rows. A table without rows adds
its files with no counts. Files that no longer exist stay counted. Equal pattern counts are ordered by their signatures.
"""

from __future__ import annotations

import string
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrid.grid import Cell, Grid
from tallygrid.operators import categories
from tallygrid.operators.value_index import ValueIndex
from tallygrid.options import DEFAULT, ProfileOptions, token_set
from tallygrid.session import prepare

#: Characters of a signature: other, blank, then one per watched token.
_CODES = string.digits + string.ascii_letters + "!#$%&()*+,-./:;<=>?@[]^_{|}~"
_VALUES = "run string, file string, pos int, value string, v double, n long"
_ROWS = "run string, file string, signature string, n long"
_FILES = "run string, file string, rows long"
_META = "pos int, name string, storage string, watched array<string>"


class ProfileState:
    """The state in a folder; see the module."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        meta = sorted(spark.read.schema(_META).parquet(f"{self.folder}/meta").collect(), key=lambda r: r["pos"])
        self.names = tuple(r["name"] for r in meta)
        self.storage = tuple(r["storage"] for r in meta)
        self.watched = tuple(meta[0]["watched"])

    @classmethod
    def create(cls, g: Grid, folder: str, watched: tuple[str, ...] = DEFAULT.missing_tokens) -> ProfileState:
        """An empty state for tables of the grid's columns. Any set of ``watched`` tokens can be applied later."""
        tokens = sorted(token_set(watched))
        if not g.width:
            raise ValueError("a state needs columns")
        if len(tokens) > len(_CODES) - 2:
            raise ValueError(f"at most {len(_CODES) - 2} tokens can be watched")
        spark = prepare(g.frame.sparkSession)
        rows = [(p, name, g.storage[p], tokens) for p, name in enumerate(g.names)]
        spark.createDataFrame(rows, _META).coalesce(1).write.parquet(f"{folder}/meta")
        for table, schema in (("values", _VALUES), ("rows", _ROWS), ("files", _FILES)):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{table}")
        return cls(spark, folder)

    # Adding files

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _code(self, cell: Cell) -> Column:
        """The signature's character of a cell."""
        text = F.coalesce(cell.text, F.lit(""))
        longest = 3 * max((len(t.encode()) for t in self.watched), default=0)
        place = F.array_position(F.array(*map(F.lit, self.watched)), F.lower(text)) if self.watched else F.lit(0)
        code = F.when(text == "", 1).when(F.octet_length(text) > longest, 0).when(place > 0, place + 1).otherwise(0)
        return F.get(F.array(*map(F.lit, _CODES)), code.cast("int"))

    def update(self, g: Grid, file: Column | None = None) -> list[str]:
        """Add the rows of files that the state lacks; returns these files.

        ``file`` names the file of a row, an expression on the grid's frame; by default the file that Spark read it from. The grid's
        columns must be those of the state.
        """
        if g.names != self.names or g.storage != self.storage:
            raise ValueError("a table with other columns")
        label = F.input_file_name() if file is None else file
        frame = g.frame.withColumn("_file", label)
        known = self.spark.read.schema(_FILES).parquet(f"{self.folder}/files").select("file").distinct()
        # One row per file on both sides.
        listed = frame.select(F.col("_file").alias("file")).distinct().join(known, "file", "left_anti")
        new = sorted(r["file"] for r in listed.collect())
        if not new:
            return []
        run = uuid.uuid4().hex
        some = g.with_frame(frame.filter(F.col("_file").isin(new)))
        fields = {"value": lambda c: c.text, "v": lambda c: c.number}
        cells = some.long(range(g.width), fields, ["_file"])
        counted = cells.groupBy("_file", "pos", "value", "v").agg(F.count(F.lit(1)).alias("n"))
        counted.select(F.lit(run).alias("run"), F.col("_file").alias("file"), "pos", "value", "v", "n").write.mode("append").parquet(f"{self.folder}/values")
        trimmed, held = some._trimmed(range(g.width), [F.col("_file")])
        signature = F.concat(*(self._code(c) for c in held.values()))
        rows = trimmed.select(F.col("_keep0").alias("file"), signature.alias("signature"))
        rows = rows.groupBy("file", "signature").agg(F.count(F.lit(1)).alias("n"))
        rows.select(F.lit(run).alias("run"), "file", "signature", "n").write.mode("append").parquet(f"{self.folder}/rows")
        added = self._table("rows", _ROWS).filter(F.col("run") == run).groupBy("run", "file").agg(F.sum("n").alias("rows"))
        added.coalesce(1).write.mode("append").parquet(f"{self.folder}/files")
        return new

    def pending(self, frame: DataFrame) -> list[str]:
        """The files of a frame that the state lacks; to read just these is all that an update needs."""
        known = {r["file"] for r in self._table("files", _FILES).select("file").distinct().collect()}
        return sorted(set(frame.inputFiles()) - known)

    def profile(self, options: ProfileOptions = DEFAULT) -> StateProfile:
        """What is known under some missing tokens, all of them watched."""
        return StateProfile(self, options)


class StateProfile:
    """Results of a state under a set of missing tokens. Only the state's tables are read."""

    def __init__(self, state: ProfileState, options: ProfileOptions):
        lacking = options.tokens - set(state.watched)
        if lacking:
            raise ValueError(f"not watched: {', '.join(sorted(lacking))}")
        self.state, self.options = state, options

    @cached_property
    def _runs(self) -> DataFrame:
        return self.state._table("files", _FILES).select("run", "file").distinct()

    @cached_property
    def rows(self) -> int:
        return self.state._table("files", _FILES).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    @cached_property
    def _counted(self) -> DataFrame:
        """``pos, value, v, n, missing`` over all files."""
        values = self.state._table("values", _VALUES).join(F.broadcast(self._runs), ["run", "file"], "left_semi")
        counted = values.groupBy("pos", "value", "v").agg(F.sum("n").alias("n"))
        text = F.coalesce("value", F.lit(""))
        return counted.withColumn("missing", F.lower(text).isin("", *sorted(self.options.tokens)))

    def _name(self) -> Column:
        return F.get(F.array(*map(F.lit, self.state.names)), F.col("pos")).alias("name")

    def _every(self, df: DataFrame, **zero: str) -> DataFrame:
        """``df`` with a row for each column of the table."""
        every = self.state.spark.range(len(self.state.names), numPartitions=1).select(F.col("id").cast("int").alias("pos"))
        filled = every.join(F.broadcast(df), "pos", "left")
        return filled.select("pos", self._name(), *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in zero.items()))

    @property
    def missing(self) -> DataFrame:
        """``pos, name, n_rows, missing, missing_pct``."""
        counts = self._counted.groupBy("pos").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing"))
        share = F.coalesce(F.try_divide(F.col("missing").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
        return self._every(counts, n_rows="long", missing="long").withColumn("missing_pct", share)

    @property
    def unique(self) -> DataFrame:
        """``pos, name, unique``: distinct present values."""
        counts = self._counted.filter("NOT missing").groupBy("pos").agg(F.count(F.lit(1)).alias("unique"))
        return self._every(counts, unique="long")

    @cached_property
    def values(self) -> ValueIndex:
        """The ordered index of the numbers of all columns."""
        numbers = self._counted.filter("NOT missing AND v IS NOT NULL").groupBy("pos", (F.col("v") + 0.0).alias("v")).agg(F.sum("n").alias("n"))
        return ValueIndex.from_counts(numbers, self.state.names)

    @property
    def numeric(self) -> DataFrame:
        """The rows of :func:`tallygrid.operators.numeric.numeric_profile`."""
        return self.values.numeric_profile()

    def top_categories(self, top: int | None = None) -> DataFrame:
        """``pos, name, rank, value, n``: the most frequent present values of every column."""
        top = self.options.top_categories if top is None else top
        present = self._counted.filter("NOT missing").select("pos", "value", "n")
        best = categories._first_by_count(present, self.options.tie, categories._EVERY if top is None else top)
        return best.select("pos", self._name(), "rank", "value", "n")

    @cached_property
    def _patterns(self) -> DataFrame:
        """``mask, n``: one character per column, 1 where the cell is missing."""
        rows = self.state._table("rows", _ROWS).join(F.broadcast(self._runs), ["run", "file"], "left_semi")
        absent = [1, *(i + 2 for i, t in enumerate(self.state.watched) if t in self.options.tokens)]
        mask = F.translate("signature", _CODES, "".join("1" if i in absent else "0" for i in range(len(_CODES))))
        return rows.groupBy(mask.alias("mask")).agg(F.sum("n").alias("n"))

    @property
    def patterns(self) -> DataFrame:
        """``columns, n, pct``: which columns are missing together, most frequent first."""
        names = [F.when(F.substring("mask", p + 1, 1) == "1", F.lit(name)) for p, name in enumerate(self.state.names)]
        found = self._patterns.filter(F.contains("mask", F.lit("1"))).orderBy(F.desc("n"), "mask")
        found = found if self.options.top_patterns is None else found.limit(self.options.top_patterns)
        return found.select(F.array_compact(F.array(*names)).alias("columns"), "n", (F.col("n") / F.lit(float(self.rows or 1))).alias("pct"))

    @property
    def summary(self) -> DataFrame:
        """``n_rows, missing_cells, complete_rows``."""
        n_missing = F.length(F.replace("mask", F.lit("0"), F.lit("")))
        return self._patterns.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(n_missing * F.col("n")), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum(F.when(n_missing == 0, F.col("n"))), F.lit(0)).alias("complete_rows"),
        )
