"""Jobs of known length given to slots, longest first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.selection import global_rank

PLAN = "length long, first long, firsts array<long>, slots array<int>, starts array<long>"


def _turns(loads: list[int], length: int, n: int) -> list[int]:
    """How many of n jobs of one length each slot takes if every job goes to the slot that is free first (of equals, the first slot)."""
    counts = [0] * len(loads)
    if length == 0:
        counts[loads.index(min(loads))] = n
    elif n <= 2 * len(loads):
        free = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(free)
        for _ in range(n):
            at, s = free[0]
            counts[s] += 1
            heapq.heapreplace(free, (at + length, s))
    else:
        held = np.array(loads, dtype=object)
        begun = lambda t: [max(0, -((h - t) // length)) for h in held]  # noqa: E731  starts before t
        low, high = min(loads), max(loads) + length * n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(begun(middle)) <= n else (low, middle)
        counts = begun(low)
        left = n - sum(counts)
        for s, load in enumerate(loads):
            if left and load <= low and (low - load) % length == 0:
                counts[s], left = counts[s] + 1, left - 1
    return counts


def turns_of(histogram: list[tuple[int, int]], slots: int) -> Iterator[tuple[int, int, list[int], list[int], list[int]]]:
    """(length, n) from the longest on -> length, its first place, and for the slots that take jobs of it: first rank, slot, first start."""
    loads, place = [0] * slots, 0
    for length, n in histogram:
        taking = sorted((loads[s], s, c) for s, c in enumerate(_turns(loads, length, n)) if c)
        ranks = np.cumsum([0] + [c for _, _, c in taking])[:-1].tolist()
        yield length, place, ranks, [s for _, s, _ in taking], [start for start, _, _ in taking]
        for _, s, c in taking:
            loads[s] += c * length
        place += n


def longest_first(jobs: DataFrame, key: str, length: Column, slots: int, most_lengths: int = 100_000) -> DataFrame:
    """key, length, place, slot, start: jobs in order of falling length, each given to the slot that is free first.

    Only the histogram of lengths is on the driver, and its plan has at most lengths x slots entries; rows get their place
    by ranges and look their slot up. Jobs of one length are alike: those of one slot stand next to each other in key order,
    so slots, starts and loads are those of one job after the other, while equal jobs may have changed places. Null or
    negative lengths count as 0; a null key is a key. More than most_lengths lengths are an error: round them first.
    """
    spark = jobs.sparkSession
    rows = jobs.select(F.col(key).alias("_key"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("length")).limit(most_lengths + 1).collect()
    if len(histogram) > most_lengths:
        raise ValueError(f"more than {most_lengths} lengths")
    plan = spark.createDataFrame(list(turns_of([(r.length, r.n) for r in histogram], slots)), PLAN)
    placed = global_rank(rows.withColumn("_falling", -F.col("length")), ["_falling", "_key"], "place")
    found = placed.join(plan, "length").withColumn("_rank", F.col("place") - F.col("first"))
    i = F.size(F.filter("firsts", lambda f: f <= F.col("_rank"))) - 1
    start = F.get("starts", i) + (F.col("_rank") - F.get("firsts", i)) * F.col("length")
    return found.select(F.col("_key").alias(key), "length", "place", F.get("slots", i).alias("slot"), start.alias("start"))
