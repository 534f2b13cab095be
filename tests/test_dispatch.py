"""Slots for jobs against a heap that takes one job after the other, and reservations as a stream."""

import heapq
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.dispatch import longest_first
from corpusmill.streaming import budgets, ledgers


def one_by_one(lengths, slots):
    free = [(0, s) for s in range(slots)]
    out = []
    for length in sorted(lengths, reverse=True):
        at, s = free[0]
        out.append((length, s, at))
        heapq.heapreplace(free, (at + length, s))
    return out


@pytest.mark.parametrize("slots", [1, 3, 8])
def test_slots_are_those_of_one_job_after_the_other(spark, slots):
    rng = random.Random(slots)
    lengths = [rng.randrange(0, 40) for _ in range(300)] + [7] * 400 + [0] * 5 + [5000, 4999]
    jobs = spark.createDataFrame(list(enumerate(lengths)), "id long, n long").repartition(5)
    got = longest_first(jobs, "id", F.col("n"), slots).collect()
    assert Counter((r.length, r.slot, r.start) for r in got) == Counter(one_by_one(lengths, slots))
    assert sorted(r.id for r in got) == list(range(len(lengths))) and all(lengths[r.id] == r.length for r in got)
    assert sorted(r.place for r in got) == list(range(len(lengths)))
    assert [r.length for r in sorted(got, key=lambda r: r.place)] == sorted(lengths, reverse=True)


def test_odd_jobs(spark):
    rows = [(None, 4), (1, None), (1, 4), (2, -3)]
    got = longest_first(spark.createDataFrame(rows, "id long, n long"), "id", F.col("n"), 2).collect()
    assert Counter((r.id, r.length) for r in got) == Counter([(None, 4), (1, 0), (1, 4), (2, 0)])
    empty = spark.createDataFrame([], "id long, n long")
    assert longest_first(empty, "id", F.col("n"), 2).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        longest_first(spark.range(5), "id", F.col("id"), 2, most_lengths=4)


HOUR = 3600


def run(spark, tmp_path, batches, cap=10.0):
    """Outcomes of batches of (scope, call, event, seq, usd, hours), each a file that comes after the one before."""
    schema = "scope string, call_id string, event string, seq long, usd double, ts timestamp"
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(*r[:5], (r[5] + 1000) * HOUR) for r in rows], schema.replace("ts timestamp", "s long"))
        made.select("scope", "call_id", "event", "seq", "usd", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drops = ledgers.read_drops(spark, str(tmp_path / "in"), schema)
        before = spark.conf.get(budgets.STORE[0])
        spark.conf.set(*budgets.STORE)
        try:
            stream = budgets.reservations(drops, cap, 2 * HOUR * 1000, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        finally:
            spark.conf.set(budgets.STORE[0], before)
    return sorted((r.scope, r.seq, r.call_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_reservations_stay_under_the_cap(spark, tmp_path):
    rows = [
        ("s", "c", "reserved", 3, 1.0, 0),  # rows of a batch come in any order
        ("s", "a", "reserved", 1, 6.0, 0),
        ("s", "b", "reserved", 2, 6.0, 0),
        ("s", "a", "completed", 4, 2.0, 1),
        ("s", "b", "reserved", 5, 6.0, 1),
        ("s", "a", "reserved", 6, 1.0, 1),  # settled: checked, but commits nothing
        ("s", "b", "unknown", 7, 0.0, 1),
        ("s", "d", "reserved", 8, 1.5, 1),
        ("s", "b", "failed_known_zero", 9, None, 1),
        ("s", "d", "reserved", 10, 7.0, 1),
        ("s", "c", "completed", 11, 1.0, 1),
        ("t", "a", "reserved", 1, 10.0, 1),
    ]
    got = run(spark, tmp_path, [rows])
    outcomes = {(s, q): o for s, q, _, o in got}
    assert outcomes == {("s", 1): "granted", ("s", 2): "refused", ("s", 3): "granted", ("s", 5): "granted", ("s", 6): "granted", ("s", 8): "refused", ("s", 10): "granted", ("t", 1): "granted"}


def test_open_calls_are_reported_once_over_batches(spark, tmp_path):
    first = [("s", "a", "reserved", 1, 1.0, 0), ("s", "b", "reserved", 2, 1.0, 0), ("s", "c", "reserved", 3, 1.0, 0)]
    second = [("s", "b", "completed", 4, 1.0, 1), ("s", "c", "completed", 5, 1.0, 3)]
    third = [("t", "x", "reserved", 6, 10.0, 9)]
    fourth = [("s", "a", "completed", 7, 8.0, 9), ("s", "e", "reserved", 8, 0.5, 9), ("t", "x", "completed", 9, 1.0, 10)]
    got = run(spark, tmp_path, [first, second, third, fourth])
    assert [(s, q, c) for s, q, c, o in got if o == "unsettled"] == [("s", 1, "a"), ("s", 3, "c")]
    assert ("s", 8, "e", "refused") in got and ("t", 6, "x", "granted") in got
