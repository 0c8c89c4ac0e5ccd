"""Helpers that the text operators share."""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in local mode where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or own_scratch_dir()


@functools.cache
def own_scratch_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A lost executor costs a reread of the files, not the work that made them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        shared, folders = scratch_dir(spark).rstrip("/"), {f.rpartition("/")[0] for f in table.inputFiles()}
        for folder in folders:
            if f"{shared.rpartition(':')[2].lstrip('/')}/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema text, for functions that build record batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def free_name(name: str, taken) -> str:
    """``name``, with underscores before it as long as a column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def slices(batches, rows: int = 256):
    """Record batches in slices of at most ``rows`` rows, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_memory: dict = {}


def worker_memory(kind: tuple, make):
    """What the tasks of one worker process share, kept from task to task, one kind at a time."""
    if kind not in _memory:
        _memory.clear()
        _memory[kind] = make()
    return _memory[kind]


def run_numbers():
    """Numbers for what this task makes, different from those of all other tasks of the stage and the same when it is done again."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


def narrow(numbers) -> bytes:
    """Non-negative integers as bytes, two or four for each."""
    return numbers.astype("<u2" if numbers.max(initial=0) < 1 << 16 else "<u4").tobytes()


def widen(data: bytes, size: int) -> np.ndarray:
    """The ``size`` integers that ``narrow`` wrote."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * size else "<u4").astype(np.int64)


class AgingMemory:
    """Remembers values by key: the last ``limit`` used at least, twice as many at most.

    What was used since the last turn is young; when ``limit`` keys are young, the others are
    forgotten. So a vocabulary larger than the memory loses rare keys only.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast if a materialized table has at most ``max_rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 in ``order`` over the whole table.

    Rows are sorted in ranges and numbered in each; the counts of the ranges before, one row a
    range, are added. With a last key that differs between equal rows no key fills a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranked").withColumns({"__range": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    counts = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(counts), "__range").withColumn(name, F.col("__before") + F.col("__in")).drop("__at", "__range", "__in", "__before")


def with_earlier(counts: DataFrame, by: list[str], at: str, n: str = "n", earlier: str = "earlier") -> DataFrame:
    """Adds how many rows the smaller values of ``at`` have before each, within ``by``.

    Counted in two levels of 1024, so no task orders all values of ``at``.
    """
    wide = counts.withColumn("__over", F.shiftright(at, 10))
    over = wide.groupBy(*by, "__over").agg(F.sum(n).alias("__sum"))
    over = over.withColumn("__first", F.sum("__sum").over(Window.partitionBy(*by).orderBy("__over")) - F.col("__sum")).drop("__sum")
    inside = F.sum(n).over(Window.partitionBy(*by, "__over").orderBy(at)) - F.col(n)
    return wide.withColumn("__in", inside).join(over, [*by, "__over"]).withColumn(earlier, F.col("__first") + F.col("__in")).drop("__over", "__first", "__in")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """All maximal runs without ASCII white space, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def long_array(values) -> Column:
    """A constant array of longs that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")
