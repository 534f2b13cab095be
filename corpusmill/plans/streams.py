"""Streams over the events table: read as files that land in a folder, run until all are read, and looked at as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.catalogue import query, table
from corpusmill.sources.scratch import new_folder
from corpusmill.streaming import budgets, ledgers


def _finished(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The whole result of a stream's last micro-batch."""
    path = new_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number:06d}")

    started = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    started.awaitTermination()
    last = started.lastProgress["batchId"] if started.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{path}/v={last:06d}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.read_drops(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ledgers.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "1 day", "400 days")
    return _finished(counted, spark, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user no more than six hours apart."""
    found = ledgers.sessions(_events(spark, sf_dir), "ts", "user_id", "6 hours", "400 days")
    return _finished(found, spark, "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


RESERVED = """WITH RECURSIVE e AS (SELECT user_id AS scope, CAST(CAST(ts AS DATE) AS VARCHAR) AS call_id, event_id AS seq, epoch_ms(ts) AS ms, event_type AS kind, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS usd,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(c VARCHAR, u BIGINT)[]) AS held, CAST([] AS STRUCT(c VARCHAR, u BIGINT)[]) AS actual, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BOOLEAN) AS fits FROM e
        UNION ALL SELECT scope, n, CASE WHEN fits THEN list_append(list_filter(held, lambda x: x.c <> call_id), {'c': call_id, 'u': usd}) ELSE held END,
            CASE WHEN kind IN ('purchase', 'error') THEN list_append(list_filter(actual, lambda x: x.c <> call_id), {'c': call_id, 'u': usd}) ELSE actual END, call_id, seq, ms, kind, fits
        FROM (SELECT e.*, r.held, r.actual, e.kind = 'view' AND coalesce(list_sum(list_transform(r.actual, lambda x: x.u)), 0)
            + coalesce(list_sum(list_transform(list_filter(r.held, lambda x: NOT list_contains(list_transform(r.actual, lambda y: y.c), x.c)), lambda x: x.u)), 0) + e.usd <= 30000 AS fits FROM r JOIN e ON e.scope = r.scope AND e.n = r.n + 1)),
    o AS (SELECT scope, call_id, seq, ms, kind, fits, ms + 21600000 AS due, coalesce(max(CASE WHEN kind IN ('purchase', 'error') THEN 1 END) OVER p, 0) AS settled, lead(CASE WHEN kind IN ('purchase', 'error') OR fits THEN ms END IGNORE NULLS) OVER w AS next_at FROM r WHERE n > 0
        WINDOW p AS (PARTITION BY scope, call_id ORDER BY seq ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY scope, call_id ORDER BY seq))
    SELECT scope, call_id, seq, CASE WHEN fits THEN 'granted' ELSE 'refused' END AS outcome FROM o WHERE kind = 'view'
    UNION ALL SELECT scope, call_id, seq, 'unsettled' FROM o WHERE fits AND settled = 0 AND coalesce(next_at > due, due <= (SELECT max(ms) FROM o) - 86400000)"""


@query("stream_reservations", RESERVED)
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as calls under a cap of 30,000 cents a user: views reserve, purchases settle, errors settle at nothing; calls open for six hours are reported."""
    kind = F.when(F.col("event_type") == "view", "reserved").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed_known_zero").otherwise("unknown")
    cents = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100))
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("date").cast("string").alias("call_id"), kind.alias("event"), F.col("event_id").cast("long").alias("seq"), cents.alias("usd"), "ts")
    path, before = new_folder(spark, "reservations"), spark.conf.get(budgets.STORE[0])
    stream = budgets.reservations(rows, 30_000.0, 6 * 3_600_000, "1 day")
    spark.conf.set(*budgets.STORE)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(budgets.STORE[0], before)
    return spark.read.schema(stream.schema).parquet(path).withColumn("scope", F.col("scope").cast("long"))
