"""Server logs, intervals and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """min.sec.ms.us -> seconds."""
    p = F.split(text, r"\.")
    return p[0].cast("double") * 60 + p[1].cast("double") + p[2].cast("double") / 1e3 + p[3].cast("double") / 1e6


def parse_calls(lines: DataFrame) -> DataFrame:
    """lines(value) of a server log -> one row per task: slot, prompt_ms, prompt_n, eval_ms, eval_n, accepted, drafted.

    Lines of several kinds carry the task's id; the last value of each kind is kept.
    """
    v = F.col("value")
    grab = lambda pattern, group, kind: F.when(v.rlike(pattern), F.regexp_extract(v, pattern, group).cast(kind))
    prompt = r"prompt eval time =\s*([\d.]+) ms /\s*(\d+) tokens"
    decode = r"\| +eval time =\s*([\d.]+) ms /\s*(\d+) tokens"
    draft = r"accept(?:ed|ance).*?\(?\s*(\d+) (?:accepted|/)\s*/?\s*(\d+)"
    rows = lines.select(
        F.regexp_extract(v, r"task (\d+)", 1).alias("task"),
        grab(r"id +(\d+) \|", 1, "int").alias("slot"),
        grab(prompt, 1, "double").alias("prompt_ms"),
        grab(prompt, 2, "long").alias("prompt_n"),
        grab(decode, 1, "double").alias("eval_ms"),
        grab(decode, 2, "long").alias("eval_n"),
        grab(draft, 1, "long").alias("accepted"),
        grab(draft, 2, "long").alias("drafted"),
        F.monotonically_increasing_id().alias("line"),
    ).where("task <> ''")
    names = ["slot", "prompt_ms", "prompt_n", "eval_ms", "eval_n", "accepted", "drafted"]
    return rows.groupBy("task").agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("line"))).alias(n) for n in names])


def decode_rates(calls: DataFrame, least_tokens: int = 200) -> DataFrame:
    """One row: tokens and seconds, the ratio of sums, the median rate of calls that are long enough, acceptance as a ratio of sums."""
    rate = F.when((F.col("eval_n") >= least_tokens) & (F.col("eval_ms") > 0), F.col("eval_n") * 1000 / F.col("eval_ms"))
    return calls.agg(
        F.count("*").alias("calls"),
        F.sum("prompt_n").alias("prompt_tokens"),
        F.sum("eval_n").alias("tokens"),
        (F.sum("eval_ms") / 1000).alias("seconds"),
        (F.sum("eval_n") * 1000 / F.sum("eval_ms")).alias("weighted_rate"),
        F.median(rate).alias("median_rate"),
        (F.sum("accepted") / F.sum("drafted")).alias("acceptance"),
    )


def concurrency(events: DataFrame) -> DataFrame:
    """events(t, generating, prefilling: +1, -1 or 0) -> seconds by (generating, prefilling) and by each alone: grouping sets of the running sums.

    The timeline is one sequence: its running sums are taken per chunk of time, on top of the sums of
    the chunks before, so that no task orders all events.
    """
    moments = events.groupBy("t").agg(F.sum("generating").alias("dg"), F.sum("prefilling").alias("dp"))
    moments = moments.withColumn("chunk", F.floor(F.col("t") / 3600))
    sums = moments.groupBy("chunk").agg(F.sum("dg").alias("sg"), F.sum("dp").alias("sp"), F.min("t").alias("start"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("chunk", F.coalesce(F.sum("sg").over(before), F.lit(0)).alias("bg"), F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.lead("start").over(Window.orderBy("chunk")).alias("next_start"))
    inside = Window.partitionBy("chunk").orderBy("t")
    states = moments.join(bases, "chunk").select(
        (F.col("bg") + F.sum("dg").over(inside)).alias("generating"),
        (F.col("bp") + F.sum("dp").over(inside)).alias("prefilling"),
        (F.coalesce(F.lead("t").over(inside), F.col("next_start")) - F.col("t")).alias("seconds"),
    )
    timed = states.where("seconds is not null")
    return timed.groupingSets([["generating", "prefilling"], ["generating"], ["prefilling"]], "generating", "prefilling").agg(F.sum("seconds").alias("seconds"))


def busy_time(intervals: DataFrame, group: str) -> DataFrame:
    """intervals(start, end) by group: busy, gap (idle time between the first start and the last end), spans."""
    order = Window.partitionBy(group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(order)
    rows = intervals.withColumn("reached", reached)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce("reached", F.col("start")))
    gap = F.when(F.col("start") > F.col("reached"), F.col("start") - F.col("reached")).otherwise(0)
    return rows.groupBy(group).agg(F.sum(F.greatest(fresh, fresh * 0)).alias("busy"), F.sum(gap).alias("gap"), F.count("*").alias("spans"))


def slot_lifecycles(events: DataFrame, slot: str, order: list[str], kind: str, first: str) -> DataFrame:
    """Numbers the lifecycles of each slot: one begins at each event of kind `first`."""
    upto = Window.partitionBy(slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("lifecycle", F.sum(F.when(F.col(kind) == first, 1).otherwise(0)).over(upto))


def committed(ledger: DataFrame) -> DataFrame:
    """ledger(call_id, scope, event, seq, usd) -> scope, committed: a call counts its settled amount, else what was reserved.

    Of several events of one kind the last counts. completed and failed_known_zero settle (null: 0); unknown never does.
    """
    settled = F.col("event").isin("completed", "failed_known_zero")
    usd = F.coalesce("usd", F.lit(0.0))
    calls = ledger.groupBy("scope", "call_id").agg(
        F.max_by(F.when(settled, usd), F.when(settled, F.col("seq"))).alias("actual"),
        F.max_by(F.when(F.col("event") == "reserved", usd), F.when(F.col("event") == "reserved", F.col("seq"))).alias("reserved"),
    )
    return calls.groupBy("scope").agg(F.sum(F.coalesce("actual", "reserved", F.lit(0.0))).alias("committed"), F.count("*").alias("calls"))
