"""Manifests of file trees that hash only what has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.places import opened

BLOCK = 4 << 20
LINE_FILES = (".json", ".jsonl")
MEASURED = "file string, bytes long, modified timestamp, sha256 string, records long, fields array<string>"
MANIFEST = f"{MEASURED}, fresh boolean"


def _measured(file: str) -> tuple[str, int | None, list[str]]:
    """SHA-256, JSON objects and their field names of a file, read in blocks; names of other endings have no records, nor has a file with a broken line."""
    digest, rest, records, fields = hashlib.sha256(), b"", 0 if file.endswith(LINE_FILES) else None, set()
    system, at = opened(file)
    with system.open_input_stream(at) as f:
        while block := f.read(BLOCK):
            digest.update(block)
            if records is not None:
                *lines, rest = (rest + block).split(b"\n")
                records = _counted(lines, records, fields)
    if records is not None:
        records = _counted([rest], records, fields)
    return digest.hexdigest(), records, sorted(fields) if records is not None else []


def _counted(lines: list[bytes], records: int, fields: set[str]) -> int | None:
    for line in lines:
        try:
            found = json.loads(line) if line.strip() else None
        except ValueError:
            return None
        if isinstance(found, dict):
            records += 1
            fields.update(found)
    return records


def current_manifest(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """file, bytes, modified, sha256, records, fields, fresh of all files under path, at any depth.

    A file whose path, size and time of change stand in `before` (an earlier result, stored) keeps what it
    says there; the others are fresh and are read in blocks, each by one task. Files that are gone or empty are left out,
    and those whose names begin with _ or a dot, as Spark lists them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stats = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    names = ["sha256", "records", "fields"]
    if before is None:
        known, asked = None, stats
    else:
        old = before.select("file", "bytes", "modified", *names)
        known = stats.join(old, ["file", "bytes", "modified"]).withColumn("fresh", F.lit(False))
        asked = stats.join(old, ["file", "bytes", "modified"], "left_anti")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1].copy()
                digest, records, fields = _measured(row["file"].iloc[0])
                row["sha256"], row["records"], row["fields"] = digest, pd.array([records], dtype="Int64"), [fields]
                yield row

    spread = asked.repartition(spark.sparkContext.defaultParallelism, "file")
    hashed = spread.mapInPandas(measure, MEASURED).withColumn("fresh", F.lit(True))
    return hashed if known is None else known.unionByName(hashed)
