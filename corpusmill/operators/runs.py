"""One row per model over a run's traces, the gates' results and the judges' results.

traces(key, model, status, rounds, prompt_tokens, completion_tokens, reasoning_tokens, latency_s, cost_usd),
gated(key, hard_fail, hard array of codes, chars, dup, citations) with null measures where there is no report,
judged(key, judge, valid, total). Keys are those of one trace each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.joins import sorted_join
from corpusmill.operators import evidence
from corpusmill.operators import gates as G
from corpusmill.operators.summary import exact_floor_percentile
from corpusmill.sources.scratch import stored

MEANS = {"rounds": "rounds_mean", "completion_tokens": "completion_tokens_mean", "reasoning_tokens": "reasoning_tokens_mean", "prompt_tokens": "prompt_tokens_mean", "latency_s": "latency_s_mean"}


def rounded(x: Column, places: int) -> Column:
    """x to some places as a double, halves up; whole multiples of the scaled number, so that engines agree."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + 0.5).cast("double") / scale


def gate_results(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """What the gates say of traces (as gate_masks() takes them), and measures of the reports that are there."""
    masks = evidence.gate_masks(traces, cases)
    hard = masks.select("key", (F.col("mask").bitwiseAND(F.lit(evidence.HARD_MASK)) > 0).alias("hard_fail"), evidence.codes_of(F.col("mask").bitwiseAND(F.lit(evidence.HARD_MASK))).alias("hard"))
    given = traces.where((F.col("status") == "ok") & (F.coalesce("final_markdown", F.lit("")) != ""))
    report = F.col("final_markdown")
    measures = given.select("key", F.length(T.compact(report)).alias("chars"), rounded(T.duplicated_grams(T.compact(report), 12), 4).alias("dup"), F.regexp_count(report, F.lit(G.CITATION)).alias("citations"))
    return sorted_join(hard, measures, "key", "left")


def model_summary(traces: DataFrame, gated: DataFrame, judged: DataFrame) -> DataFrame:
    """model, n, errors, hard_fail_rate, hard_codes, judge_mean_total, means and 90th places of measures, tokens, latency, and the cost.

    A status that is not ok (null included) is an error. Traces without gates or judgements count in n and in
    the tokens only; means without values are null, as are maps without entries. hard_codes counts a code
    once per trace; judge_mean_total holds the mean total of each judge's valid judgements. Nulls are left
    out of means and sums. Tables are reduced to counts by model before they meet, so a model may hold any
    share of the rows; places are found by exact_floor_percentile(), without one task for a model.
    """
    runs = traces.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    models = runs.select("key", "model")
    both = stored(sorted_join(gated, models, "key"), "gated")
    base = runs.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("status").eqNullSafe("ok")).alias("errors"),
        *[rounded(F.avg(c), 2).alias(name) for c, name in MEANS.items()],
        rounded(F.sum("cost_usd"), 4).alias("cost_usd_total"),
    )
    measured = both.groupBy("model").agg(
        rounded(F.avg(F.col("hard_fail").cast("int")), 2).alias("hard_fail_rate"),
        *[rounded(F.avg(c), 2).alias(f"{name}_mean") for c, name in (("chars", "chars"), ("dup", "dup_ratio"), ("citations", "citations"))],
    )
    as_map = lambda df, k, v, name: df.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(name))
    codes = as_map(both.select("model", F.explode("hard").alias("code")).groupBy("model", "code").agg(F.count("*").alias("n")), "code", "n", "hard_codes")
    totals = sorted_join(judged.where("valid and total is not null"), models, "key").groupBy("model", "judge").agg(rounded(F.avg("total"), 2).alias("mean"))
    place = lambda df, column, name: exact_floor_percentile(df.select("model", column), ["model"], column, 0.9).select("model", rounded(F.col("percentile"), 1).alias(name))
    parts = [measured, codes, as_map(totals, "judge", "mean", "judge_mean_total"), place(both, "chars", "chars_p90"), place(runs, "total_tokens", "total_tokens_p90")]
    return reduce(lambda left, right: sorted_join(left, right, "model", "left"), parts, base)


def shown_map(entries: Column) -> Column:
    """key=value pairs of a map in the order of its keys, joined by semicolons; - without any."""
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.coalesce(F.array_join(pairs, ";"), F.lit("-"))
