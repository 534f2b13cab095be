"""Fresh folders for files that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in the folder that spark.checkpoint.dir names; in a local session without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="mill-")
    return f"{base.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read again: for a table that several later steps read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def stored_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """stored(), with rows passing to Python in Arrow batches of about BATCH_BYTES, however many rows or however long texts there are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_BYTES))
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
