"""Flat little-endian arrays as a Spark data source: read by byte ranges, written a file per task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusmill.sources.places import listed, opened

# Codes of element types, with their width in bytes, name in numpy and name in Spark.
KINDS = {"i": (4, "<i4", "int"), "q": (8, "<i8", "long"), "f": (4, "<f4", "float"), "d": (8, "<f8", "double")}
SPLIT_BYTES = 64 << 20
ROWS_A_BATCH = 100_000


@dataclass
class Span(InputPartition):
    """Elements first to last (not included) of a file."""

    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    file: str


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, code: str, split_bytes: int):
        self.path, self.code, self.step = path, code, max(1, split_bytes // KINDS[code][0])

    def partitions(self) -> list[Span]:
        """Spans of whole elements; the bytes behind a file's last whole element are no element."""
        sizes = [(file, size // KINDS[self.code][0]) for file, size in listed(self.path)]
        return [Span(file, a, min(a + self.step, n)) for file, n in sizes for a in range(0, n, self.step)] or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if span.first == span.last:
            return
        width, kind, _ = KINDS[self.code]
        system = opened(self.path)[0]
        with system.open_input_file(span.file) as f:
            f.seek(span.first * width)
            for a in range(span.first, span.last, ROWS_A_BATCH):
                values = np.frombuffer(f.read(min(ROWS_A_BATCH, span.last - a) * width), dtype=kind)
                yield pa.RecordBatch.from_arrays([pa.array([span.file] * len(values)), pa.array(np.arange(a, a + len(values))), pa.array(values)], names=["file", "pos", "value"])


class ArrayWriter(DataSourceArrowWriter):
    """A file per task under a hidden folder; files of the tasks that count are moved into place at the commit, so a lost task leaves nothing."""

    def __init__(self, path: str, code: str):
        self.path, self.code, self.job = path, code, uuid.uuid4().hex

    def write(self, batches: Iterator) -> Written:
        from pyspark import TaskContext

        system, at = opened(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.bin"
        folder = f"{at}/_{self.job}/{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                values = batch.column("value")
                if values.null_count:
                    raise ValueError("a flat array has no place for nulls")
                out.write(values.to_numpy(zero_copy_only=False).astype(KINDS[self.code][1]).tobytes())
        return Written(f"{folder}/{name}")

    def commit(self, messages: list) -> None:
        system, at = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(m.file, f"{at}/{m.file.rsplit('/', 1)[1]}")
        self._cleared()

    def abort(self, messages: list) -> None:
        self._cleared()

    def _cleared(self) -> None:
        from pyarrow import fs

        system, at = opened(self.path)
        hidden = f"{at}/_{self.job}"
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class FlatArrays(DataSource):
    """Format flat_array. Options: path, code (one of KINDS, q unless given), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "flat_array"

    def _code(self) -> str:
        code = self.options.get("code", "q")
        if code not in KINDS:
            raise ValueError(f"unknown element type {code}; known are {', '.join(KINDS)}")
        return code

    def schema(self) -> str:
        return f"file string, pos long, value {KINDS[self._code()][2]}"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], self._code(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("flat arrays are only appended to")
        if "value" not in schema.names:
            raise ValueError("flat arrays take the column value")
        return ArrayWriter(self.options["path"], self._code())


def read_array(spark: SparkSession, path: str, code: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, pos, value of the flat arrays at a path: code i (int32), q (int64), f (float32), d (float64). A file is read by several tasks."""
    spark.dataSource.register(FlatArrays)
    return spark.read.format("flat_array").option("code", code).option("split_bytes", split_bytes).load(path)


def write_array(values: DataFrame, path: str, code: str) -> None:
    """Appends the column value as flat arrays, a file per task, each in the order of its rows. A null fails the job."""
    values.sparkSession.dataSource.register(FlatArrays)
    kind = KINDS[code][2]
    values.selectExpr(f"cast(value as {kind}) as value").write.format("flat_array").option("code", code).mode("append").save(path)
