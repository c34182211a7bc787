"""Running values and splits over rows that are numbered within a group, none of which makes a group one task.

Rows are dealt to ranges of their numbers. A range is scanned by itself; what it hands on is one row, and these rows, PER times
fewer, are scanned in the same way, until no group has more than one range.
"""

from __future__ import annotations

import functools
import shutil
import sys
import tempfile
import typing

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# The functions on tables travel by value, so that a worker needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers in a range.
PER = 16_384
#: So many ranges' values go to the rows by a broadcast, which leaves the rows where they are; more by a shuffle.
FEW_RANGES = 100_000
#: Groups of so many rows are split by a fold over an array of theirs; larger ones by ranges.
SHORT = 512
#: Ranges whose tables are put together to one.
FAN = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode only, one of our own where it is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import atexit

        there = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def stored(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: they are worked out once, and any executor can read them again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scanned(df: DataFrame, group: list[str], number: str, values: dict[str, Column], *, how: str = "last", before: bool = False, backward: bool = False) -> DataFrame:
    """Adds a running value for each name.

    how: "last" for the last value that is not null; "sum" for the sum of all, null counting nothing, 0 where there is none. They are over
    the rows of the group up to this one, or `before` it; backward: from the group's end on, by falling numbers. Numbers are at
    least 0 and differ within a group; gaps are allowed.
    """
    df = df.withColumns(values | {"_range": (F.col(number) / PER).cast("long")})
    frame = Window.partitionBy(*group, "_range").orderBy(F.desc(number) if backward else F.asc(number)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = df.withColumns({n: F.last(n, ignorenulls=True).over(frame) if how == "last" else F.coalesce(F.sum(n).over(frame), F.lit(0)) for n in values})
    pick = F.min_by if backward else F.max_by
    # What ranges hand on is a row each, and stored: the rows are worked out twice, however many steps follow.
    ends = stored(df.groupBy(*group, "_range").agg(*(pick(n, F.when(F.col(n).isNotNull(), F.col(number))).alias(n) if how == "last" else F.sum(n).alias(n) for n in values)))
    highest, ranges = ends.agg(F.max("_range"), F.count("*")).first()
    if not highest:
        return out.drop("_range")
    came = scanned(ends.withColumnRenamed("_range", "_at"), group, "_at", {n: F.col(n) for n in values}, how=how, before=True, backward=backward)
    came = came.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), F.col("_at").alias("_for"), *(F.col(n).alias(f"_came_{n}") for n in values))
    came = F.broadcast(came) if ranges <= FEW_RANGES else came
    out = out.join(came, both([(F.col(g), F.col(f"_{i}")) for i, g in enumerate(group)]) & (F.col("_range") == F.col("_for")), "left")
    joined = {n: F.coalesce(n, f"_came_{n}") if how == "last" else F.col(n) + F.coalesce(f"_came_{n}", F.lit(0)) for n in values}
    return out.withColumns(joined).drop("_range", "_for", *(f"_{i}" for i in range(len(group))), *(f"_came_{n}" for n in values))


def both(pairs: list[tuple[Column, Column]]) -> Column:
    return functools.reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def split(rows: DataFrame, group: list[str], number: str, most: int, out: str, *, whole: bool, short: int = SHORT) -> DataFrame:
    """rows (group, number, `_size`, `_may`) as (group, number, `_size`, out): the number of the part that a row is in, from 0 in each group.

    Where a row may, and would make its part longer than `most` (whole), or finds it longer already (not whole), it begins the
    next part, unless it is the first of its own. _size: at least 1; _may: whether a row may begin a part. Numbers are at least 0 and differ within
    a group; other columns are dropped.
    """
    rows = stored(rows.select(*group, number, F.col("_size").cast("long").alias("_size"), "_may"))
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min(number).alias("_first"))
    few, many = counts.filter(F.col("_n") <= short).drop("_n"), stored(counts.filter(F.col("_n") > short).drop("_n"))
    of = lambda some: rows.join(some.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), "_first"), both([(F.col(g), F.col(f"_{i}")) for i, g in enumerate(group)])).drop(*(f"_{i}" for i in range(len(group))))
    # What few groups are long is small: their rows stay where they are.
    if many.isEmpty():
        return folded_parts(rows, group, number, most, out, whole)
    return folded_parts(of(few), group, number, most, out, whole).unionByName(ranged_parts(of(many), group, number, most, out, whole))


def folded_parts(rows: DataFrame, group: list[str], number: str, most: int, out: str, whole: bool) -> DataFrame:
    """split() for groups that are short: their rows are an array, and the fold over it is the JVM's."""
    listed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(number, "_size", "_may"))).alias("_rows"))

    def step(state, row):
        reach = state["length"] + (row["_size"] if whole else F.lit(0))
        ends = row["_may"] & (state["length"] > 0) & (reach > most)
        part = state["part"] + F.when(ends, 1).otherwise(0)
        return F.struct(part.cast("long").alias("part"), (row["_size"] + F.when(ends, 0).otherwise(state["length"])).cast("long").alias("length"), F.concat(state["parts"], F.array(part.cast("long"))).alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("length"), F.array().cast("array<bigint>").alias("parts"))
    parts = listed.select(*group, "_rows", F.aggregate("_rows", start, step, lambda s: s["parts"]).alias("_parts"))
    return parts.select(*group, F.explode(F.arrays_zip("_rows", "_parts")).alias("x")).select(*group, F.col(f"x._rows.{number}").alias(number), F.col("x._rows._size").alias("_size"), F.col("x._parts").alias(out))


class Table(typing.NamedTuple):
    """What some consecutive rows do to a part that has any length when it comes to them.

    The i-th row that may begin a part is the first that does, for lengths beyond most - reach[i] (and not beyond that of the one before):
    then the last part has length[i] at the end, and parts[i] were begun. For a length that none of these is for, all rows go on with
    it: `total` is their size. Reaches rise; those that no length asks for are left out.
    """

    reach: np.ndarray
    length: np.ndarray
    parts: np.ndarray
    total: int

    def after(self, length: np.ndarray, part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and numbers of the last parts behind these rows, by those before them."""
        i = np.searchsorted(self.reach, most - length, "right")
        if not len(self.reach):
            return length + self.total, part
        on, i = i == len(self.reach), np.minimum(i, len(self.reach) - 1)
        return np.where(on, length + self.total, self.length[i]), np.where(on, part, part + self.parts[i])

    def then(self, other: Table, most: int) -> Table:
        """The table of these rows and the other's behind them."""
        length, parts = other.after(self.length, self.parts, most)
        if len(self.reach) and self.reach[-1] > most:  # a row begins a part, whatever comes
            return Table(self.reach, length, parts, self.total + other.total)
        reach = other.reach + self.total
        some = slice(0, np.searchsorted(reach, most, "right") + 1)
        return Table(*(np.concatenate(x) for x in ((self.reach, reach[some]), (length, other.length[some]), (parts, other.parts[some]))), self.total + other.total)


def breaks(size: np.ndarray, may: np.ndarray, most: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that may begin a part: place, sizes before, reach, and which of them begins the next part if this one begins one."""
    at = np.flatnonzero(may)
    before = (np.cumsum(size) - size)[at]
    reach = before + size[at] if whole else before
    return at, before, reach, np.maximum(np.searchsorted(reach, before + most, "right"), np.arange(1, len(at) + 1))


def table(size: np.ndarray, may: np.ndarray, most: int, whole: bool) -> Table:
    at, before, reach, next_ = breaks(size, may, most, whole)
    total = int(size.sum())
    length, parts = [total - b for b in before.tolist()], [1] * len(at)
    for i, j in zip(range(len(at) - 1, -1, -1), next_[::-1].tolist()):
        if j < len(at):
            length[i], parts[i] = length[j], parts[j] + 1
    some = slice(0, np.searchsorted(reach, most, "right") + 1)
    return Table(reach[some], np.array(length[some], "int64"), np.array(parts[some], "int64"), total)


def entered(tables: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group, _at, _length, _part): length and number of the part that each range is come to with."""
    import pyarrow as pa

    def rows_of(t: pa.Table) -> tuple[pa.Table, list[Table]]:
        t = t.sort_by("_at")
        return t, [Table(*(np.array(r[c], "int64") for c in ("reach", "length", "parts")), r["total"]) for r in t.select(["reach", "length", "parts", "total"]).to_pylist()]

    def together(t: pa.Table) -> pa.Table:
        t, listed = rows_of(t)
        one = functools.reduce(lambda a, b: a.then(b, most), listed)
        return pa.table({**{g: t[g].slice(0, 1) for g in [*group, "_up"]}, "reach": [one.reach.tolist()], "length": [one.length.tolist()], "parts": [one.parts.tolist()], "total": [one.total]}, schema=to_arrow_schema(upper))

    def through(t: pa.Table) -> pa.Table:
        t, listed = rows_of(t)
        length, part, came = np.array([t["_length"][0].as_py()]), np.array([t["_part"][0].as_py()]), []
        for x in listed:
            came.append((int(length[0]), int(part[0])))
            length, part = x.after(length, part, most)
        return pa.table({**{g: t[g] for g in [*group, "_at"]}, "_length": [x for x, _ in came], "_part": [x for _, x in came]}, schema=to_arrow_schema(down))

    fields = tables.schema
    upper = StructType([*(fields[g] for g in group), StructField("_up", LongType()), *(fields[c] for c in ("reach", "length", "parts", "total"))])
    down = StructType([*(fields[g] for g in group), *(StructField(c, LongType()) for c in ("_at", "_length", "_part"))])
    above = tables.withColumn("_up", (F.col("_at") / FAN).cast("long"))
    if tables.agg(F.max("_at")).first()[0] < FAN:
        above = above.withColumns({"_length": F.lit(0).cast("long"), "_part": F.lit(0).cast("long")})
    else:
        came = entered(stored(above.groupBy(*group, "_up").applyInArrow(together, upper)).withColumnRenamed("_up", "_at"), group, most)
        came = came.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), F.col("_at").alias("_for"), "_length", "_part")
        above = above.join(came, both([(F.col(g), F.col(f"_{i}")) for i, g in enumerate(group)]) & (F.col("_up") == F.col("_for")))
        above = above.drop("_for", *(f"_{i}" for i in range(len(group))))
    return above.groupBy(*group, "_up").applyInArrow(through, down)


def ranged_parts(rows: DataFrame, group: list[str], number: str, most: int, out: str, whole: bool) -> DataFrame:
    """split() for groups of any length, whose rows have the group's `_first` number. Each row is looked at twice: for its range's table, and
    when it is known what the range is come to with."""
    import pyarrow as pa

    rows = rows.select(*group, number, "_size", (F.col("_may") & (F.col(number) != F.col("_first"))).alias("_may"), (F.col(number) / PER).cast("long").alias("_at"))
    numbers = lambda t: (t["_size"].to_numpy(), t["_may"].to_numpy())
    array = ArrayType(LongType())
    made = StructType([*(rows.schema[g] for g in group), StructField("_at", LongType()), *(StructField(c, array) for c in ("reach", "length", "parts")), StructField("total", LongType())])

    def first(t: pa.Table) -> pa.Table:
        one = table(*numbers(t.sort_by(number)), most, whole)
        return pa.table({**{g: t[g].slice(0, 1) for g in [*group, "_at"]}, "reach": [one.reach.tolist()], "length": [one.length.tolist()], "parts": [one.parts.tolist()], "total": [one.total]}, schema=to_arrow_schema(made))

    def second(t: pa.Table) -> pa.Table:
        t = t.sort_by(number)
        at, _, reach, next_ = breaks(*numbers(t), most, whole)
        begins = np.zeros(t.num_rows, "int64")
        i, next_ = int(np.searchsorted(reach, most - t["_length"][0].as_py(), "right")), next_.tolist()
        while i < len(at):
            begins[at[i]] = 1
            i = next_[i]
        return pa.table({**{c: t[c] for c in [*group, number, "_size"]}, out: t["_part"][0].as_py() + np.cumsum(begins)}, schema=to_arrow_schema(done))

    done = StructType([*(rows.schema[c] for c in [*group, number, "_size"]), StructField(out, LongType())])
    came = entered(stored(rows.groupBy(*group, "_at").applyInArrow(first, made)), group, most)
    came = came.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), F.col("_at").alias("_for"), "_length", "_part")
    met = rows.join(came, both([(F.col(g), F.col(f"_{i}")) for i, g in enumerate(group)]) & (F.col("_at") == F.col("_for")))
    return met.drop("_for", *(f"_{i}" for i in range(len(group)))).groupBy(*group, "_at").applyInArrow(second, done)
