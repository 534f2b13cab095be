"""Sources: explicit schemas, rejects kept beside the rows, no inference on data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_cases(spark: SparkSession, path: str, schema: str | StructType, split: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One JSON file per case, in file-name order, with optional split filter, offset and limit."""
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    if split is not None:
        rows = rows.where(F.col("split") == split)
    rows = rows.orderBy("_file")
    if offset:
        rows = rows.offset(offset)
    return (rows if limit is None else rows.limit(limit)).drop("_file")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file and its rejects (the raw lines that do not parse); blank lines are skipped."""
    full = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("_corrupt_record", "string")
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record"), parsed.where("_corrupt_record is not null").select("_corrupt_record")


def reject_reasons(traces: DataFrame) -> Column:
    """Why a trace cannot be used: unreadable, not a trace, shape, no candidate call; null if it can."""
    from corpusmill.operators.selection import cascade

    return cascade(
        ("unreadable", F.col("raw").isNull()),
        ("not_a_trace", F.col("case_id").isNull()),
        ("shape_invalid", F.col("calls").isNull()),
        ("no_candidate_call", F.size(F.filter("calls", lambda c: c["role"] == "generator")) == 0),
    )


def candidate_call(calls: Column) -> Column:
    """The last generator call of a trace."""
    return F.try_element_at(F.filter(calls, lambda c: c["role"] == "generator"), F.lit(-1))


def latest_run(paths: DataFrame, tag: str) -> DataFrame:
    """paths(path): the newest run whose name ends in the tag, or else holds it; by name."""
    name = F.regexp_extract("path", r"([^/]+)/?$", 1)
    ranked = paths.select("path", F.when(F.endswith(name, F.lit(tag)), 1).when(F.contains(name, F.lit(tag)), 0).alias("rank")).where("rank is not null")
    return ranked.agg(F.max_by("path", F.struct("rank", "path")).alias("path"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256, records, fields of the JSON-lines files under path, at any depth; each file is hashed where it is read. Empty files are left out."""
    options = {"recursiveFileLookup": "true"}
    place = F.col("_metadata.file_path")
    hashed = spark.read.format("binaryFile").options(**options).load(path).select(place.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.options(**options).text(path).where(F.trim("value") != "").select(place.alias("file"), F.json_object_keys("value").alias("keys"))
    records = lines.groupBy("file").agg(F.count("*").alias("records"))
    fields = lines.select("file", F.explode_outer("keys").alias("key")).groupBy("file").agg(F.array_sort(F.collect_set("key")).alias("fields"))
    return hashed.join(records, "file", "left").join(fields, "file", "left")


def missing_files(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """name: wanted files that no path of the manifest ends in."""
    names = manifest.sparkSession.createDataFrame([(w,) for w in wanted], "name string")
    last = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    files = manifest.select("file", last(F.col("file")).alias("last"))
    return names.join(files, (last(F.col("name")) == F.col("last")) & F.expr("endswith(file, concat('/', name))"), "left_anti")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str | StructType) -> DataFrame:
    """Rows of one SQL query over a SQLite file that every executor can reach; read by one task, as the file is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for where in batch.path:
                with sqlite3.connect(f"file:{where}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(query, db, chunksize=10_000)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, schema)


def numbered(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds part: rows dealt in turn over `parts` by their place in the order."""
    from corpusmill.operators.selection import global_rank

    return global_rank(df, order, "_place").withColumn("part", F.col("_place") % parts).drop("_place")
