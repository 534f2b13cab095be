"""Structured Streaming: windowed counts with late data, running budgets, keyed upserts, file drops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusmill.sources.writers import upsert


def read_drops(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def windowed_counts(events: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """start, key, n, total of tumbling windows; events later than `late` behind the newest are left out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of sessions: events of a key no further apart than the gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_budget(events: DataFrame, cap: float) -> DataFrame:
    """events(scope, call_id, event, usd) as a stream -> scope, call_id, granted: reservations against a running sum per scope.

    The state is the committed sum and the open reservations of a scope; settling replaces a reservation.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, names, sums = state.get if state.exists else (0.0, [], [])
        held = dict(zip(names, sums, strict=True))
        out = []
        for batch in batches:
            for r in batch.itertuples():
                if r.event == "reserved":
                    granted = settled + sum(held.values()) + r.usd <= cap + 1e-12
                    if granted:
                        held[r.call_id] = r.usd
                    out.append((key[0], r.call_id, granted))
                elif r.event in ("completed", "failed_known_zero") and held.pop(r.call_id, None) is not None:
                    settled += 0.0 if pd.isna(r.usd) else r.usd
        state.update((settled, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["scope", "call_id", "granted"])

    return events.groupBy("scope").applyInPandasWithState(step, "scope string, call_id string, granted boolean", "settled double, calls array<string>, usd array<double>", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(updates: DataFrame, path: str, key: list[str], order: str, checkpoint: str):
    """Merges each micro-batch into versioned snapshots path/v=<batch>; a replayed batch writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{path}/v={number - 1}"
        merged = upsert(batch.sparkSession.read.schema(batch.schema).parquet(before), batch, key, order) if number else upsert(batch.limit(0), batch, key, order)
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
