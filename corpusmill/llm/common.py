"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# The ASCII white space of the line and word rules.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *wanted: str, **renamed: str) -> DataFrame:
    """The named columns and no other, found by exact spelling.

    Other columns may have any name, also one that differs in case only: each column is
    renamed by position first, so nothing is ambiguous. ``renamed`` maps new name -> column.
    """
    places = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    pairs = [(c, c) for c in wanted] + list(renamed.items())
    return plain.select([F.col(f"_{places[c]}").alias(new) for new, c in pairs])


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by position, and where each name went (the first of equal names); see restored()."""
    names = [f"_col{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {c: n for c, n in reversed(list(zip(df.columns, names, strict=True)))}


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back to the columns before numbered_columns()."""
    return df.select([F.col(f"_col{i}").alias(c) for i, c in enumerate(columns)])


def with_python_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it is used from a checkout."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables, from spark.checkpoint.dir.

    Only in a local session that leaves it unset (as tests do) a temporary folder is made; on a cluster
    that is an error, for executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = getattr(spark.sparkContext, "_mill_dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="mill-")
            spark.sparkContext._mill_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mill"


BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of about `most` bytes into Python for what is planned inside, so whole texts of any length pass in bounded memory.

    What Python gives back is not cut by Spark (its output limit fails on frames of unequal size); the
    operators bound the frames that they yield.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# Paths stored inside each discarded() that is open, of this thread or task alone.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_discards", default=())


FILE_ROWS = 10_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """A small table of about `rows` narrow rows, dealt to a task for every FILE_ROWS; all others stay as they are.

    For sessions that do not merge small partitions themselves: there each small table would be written in as
    many files as there are shuffle partitions, and a local executor starts a child process for each file's
    permissions, which for a moment counts with all of the executor's memory. `rows` is no limit: more rows
    make larger files.
    """
    conf = df.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{x}enabled") == "true" for x in ("", "coalescePartitions.")):
        return df
    files = max(1, math.ceil(rows / FILE_ROWS))
    return df.repartition(files) if 2 * files <= int(conf.get("spark.sql.shuffle.partitions")) else df


def stash(df: DataFrame, name: str, outer: bool = False, rows: int | None = None, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    Inside discarded() the table goes at its end; with `outer` it outlives it. rows: about how many there
    are, where they are narrow; see few_files().
    """
    spark = df.sparkSession
    if rows is not None:
        df = few_files(df, rows)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    inside = _OPEN.get()
    mine = inside[: len(inside) - outer]
    if mine:
        mine[-1].append(path)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; what is still wanted is stored with `outer` before that."""
    paths: list[str] = []
    mark = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
    finally:
        _OPEN.reset(mark)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for small tables inside loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
