"""Ledgers, intervals and lifecycles over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import dispatch
from corpusmill.operators import logs as L
from corpusmill.plans.catalogue import query, table


@query(
    "ledger_commit",
    """WITH c AS (SELECT user_id AS scope, event_id // 4 AS call_id, max_by(CASE WHEN event_type = 'purchase' THEN coalesce(value, 0) END, event_id) FILTER (event_type = 'purchase') AS actual,
    max_by(coalesce(value, 0), event_id) FILTER (event_type = 'view') AS reserved FROM events GROUP BY ALL)
    SELECT scope, sum(coalesce(actual, reserved, 0)) AS committed, count(*) AS calls FROM c GROUP BY scope""",
)
def ledger_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views reserve, purchases settle; four events of a user in a row are a call."""
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "reserved").otherwise("unknown")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.expr("event_id div 4").alias("call_id"), kind.alias("event"), F.col("event_id").alias("seq"), F.col("value").alias("usd"))
    return L.committed(rows)


@query(
    "concurrency_hist",
    """WITH e AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS g, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS p FROM events),
    m AS (SELECT t, sum(g) AS dg, sum(p) AS dp FROM e GROUP BY t), s AS (SELECT CAST(sum(dg) OVER o AS BIGINT) AS generating, CAST(sum(dp) OVER o AS BIGINT) AS prefilling, lead(t) OVER o - t AS seconds FROM m WINDOW o AS (ORDER BY t))
    SELECT generating, prefilling, CAST(sum(seconds) AS BIGINT) AS seconds FROM s WHERE seconds IS NOT NULL GROUP BY GROUPING SETS ((generating, prefilling), (generating), (prefilling))""",
)
def concurrency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp(F.date_trunc("second", "ts")).alias("t")
    e = F.col("event_type")
    g = F.when(e == "signup", 1).when(e == "purchase", -1).otherwise(0)
    p = F.when(e == "view", 1).when(e == "click", -1).otherwise(0)
    return L.concurrency(table(spark, sf_dir, "events").select(t, g.alias("generating"), p.alias("prefilling")))


@query(
    "agg15_busy_time",
    """WITH i AS (SELECT l_suppkey, CAST(epoch(l_shipdate) / 86400 AS BIGINT) AS s, CAST(epoch(l_shipdate) / 86400 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
    r AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i)
    SELECT l_suppkey, CAST(sum(greatest(e - greatest(s, coalesce(reached, s)), 0)) AS BIGINT) AS busy, CAST(sum(CASE WHEN s > reached THEN s - reached ELSE 0 END) AS BIGINT) AS gap, count(*) AS spans FROM r GROUP BY l_suppkey""",
)
def busy_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("unix_timestamp(l_shipdate) div 86400")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return L.busy_time(rows, "l_suppkey")


@query(
    "win15_lifecycles",
    """WITH s AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lifecycle FROM events)
    SELECT user_id, CAST(lifecycle AS BIGINT) AS lifecycle, count(*) AS events FROM s GROUP BY ALL""",
)
def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return L.slot_lifecycles(rows, "user_id", ["ts", "event_id"], "event_type", "signup").groupBy("user_id", "lifecycle").agg(F.count("*").alias("events"))


@query(
    "agg13_rates",
    """SELECT event_type, sum(value) / nullif(count(*), 0) AS ratio_of_sums, median(CASE WHEN value >= 10 THEN value END) AS median_long, CAST(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS long_calls FROM events GROUP BY event_type""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.when(F.col("value") >= 10, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum("value") / F.count("*")).alias("ratio_of_sums"), F.median(long).alias("median_long"), F.count(long).alias("long_calls"))


@query("src8_log_lines", "SELECT 'e' || event_id AS task, value AS prompt_ms, user_id AS prompt_n FROM events WHERE event_type = 'view' AND value IS NOT NULL")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as server-log lines and parsed again."""
    rows = table(spark, sf_dir, "events").where("event_type = 'view' and value is not null")
    line = F.concat(F.lit("slot print_timing: id 1 | task "), F.col("event_id").cast("string"), F.lit(" | prompt eval time = "), F.col("value").cast("decimal(20,6)").cast("string"), F.lit(" ms / "), F.col("user_id").cast("string"), F.lit(" tokens"))
    return L.parse_calls(rows.select(line.alias("value"))).select(F.concat(F.lit("e"), "task").alias("task"), "prompt_ms", "prompt_n")


@query("mth4_clock", "SELECT DISTINCT user_id, (user_id % 60) * 60 + user_id % 59 + (user_id % 1000) / 1000.0 + (user_id % 97) / 1000000.0 AS seconds FROM events")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    text = F.concat_ws(".", *[p.cast("string") for p in (u % 60, u % 59, u % 1000, u % 97)])
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", L.clock_seconds(text).alias("seconds"))


@query("win14_running_gap", "SELECT user_id, max(gap) AS longest_gap FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id")
def running_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    rows = table(spark, sf_dir, "events").select("user_id", (seconds - F.lag(seconds).over(order)).alias("gap"))
    return rows.groupBy("user_id").agg(F.max("gap").alias("longest_gap"))


@query("win16_longest_first", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query(
    "win16_slots",
    """WITH RECURSIVE j AS (SELECT length(coalesce(text, '')) // 64 AS length, row_number() OVER (ORDER BY length(coalesce(text, '')) // 64 DESC, doc_id) AS n FROM documents),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(list_transform(range(16), lambda x: 0) AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS length, CAST(NULL AS INT) AS slot, CAST(NULL AS BIGINT) AS start
        UNION ALL SELECT j.n, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + j.length ELSE x END), j.length, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INT), list_min(r.loads) FROM r JOIN j ON j.n = r.n + 1)
    SELECT length, slot, start FROM r WHERE n > 0""",
)
def longest_first_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by lengths of 64 characters, on sixteen slots, longest first."""
    size = F.floor(F.length(F.coalesce("text", F.lit(""))) / 64)
    return dispatch.longest_first(table(spark, sf_dir, "documents"), "doc_id", size, 16).select("length", "slot", "start")
