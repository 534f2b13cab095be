"""The model summary of a run: traces with their gates, judges and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.joins import sorted_join
from corpusmill.operators import evidence as E
from corpusmill.operators import gates as G
from corpusmill.operators import runs
from corpusmill.plans import evidence
from corpusmill.plans.catalogue import SQL, query, table
from corpusmill.sources.scratch import stored

# Totals of a document's trace, from its length; its source is the model.
TOTALS = {
    "rounds": evidence.TRACE["rounds"],
    "prompt_tokens": "coalesce(length(text), 0) % 4099",
    "completion_tokens": f"length({evidence.TRACE['report']})",
    "reasoning_tokens": "coalesce(length(text), 0) % 997",
    "latency_s": "CAST(coalesce(length(text), 0) % 513 AS DOUBLE) / 8",
    "cost_usd": "CAST(coalesce(length(text), 0) % 64 AS DOUBLE) / 128",
}


def _sql() -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in TOTALS.items())
    trace = ", ".join(f"{evidence.TRACE[n].replace('AS STRING', 'AS VARCHAR')} AS {n}" for n in ("report", "status"))
    made = made.replace("AS STRING", "AS VARCHAR")
    r = lambda x, places: f"floor({x} * {10**places}.0 + 0.5) / {10**places}.0"
    p90 = lambda c: r(f"CAST(list_sort(list({c}) FILTER ({c} IS NOT NULL))[least(CAST(floor(0.9 * count({c})) AS BIGINT), count({c}) - 1) + 1] AS DOUBLE)", 1)
    mean = lambda c: r(f"avg({c})", 2)
    grams = "list_transform(range(1, length(body) - 10), lambda i: substring(body, i, 12))"
    hard = ", ".join(f"'{c}'" for c in E.HARD)
    return f"""
WITH v AS (SELECT n, {evidence.NUMERAL} AS numeral FROM (SELECT range AS n, string_split('零一二三四五六七八九', '') AS d FROM range(1000))),
b AS (SELECT doc_id, text, source, doc_id % 90 + 2 AS n, v.numeral FROM documents JOIN v ON v.n = doc_id % 90 + 2),
t AS (SELECT doc_id, source AS model, {trace}, {made} FROM b), g AS ({SQL["str9_all_gates"]}),
m AS (SELECT doc_id, length(body) AS chars, CASE WHEN length(body) >= 12 THEN {r(f"((len({grams}) - len(list_distinct({grams}))) / CAST(len({grams}) AS DOUBLE))", 4)} ELSE 0 END AS dup,
  len(regexp_extract_all(report, '{G.CITATION}')) AS citations FROM (SELECT doc_id, report, regexp_replace(report, '\\s+', '', 'g') AS body FROM t WHERE status = 'ok' AND report <> '')),
s AS (SELECT model, count(*) AS n, count(*) FILTER (status <> 'ok') AS errors, {r("avg(CAST(hard_fail AS INT))", 2)} AS hard_fail_rate, {mean("chars")} AS chars_mean, {p90("chars")} AS chars_p90, {mean("dup")} AS dup_ratio_mean, {mean("citations")} AS citations_mean,
  {", ".join(f"{mean(c)} AS {n}" for c, n in runs.MEANS.items())}, {p90("prompt_tokens + completion_tokens")} AS total_tokens_p90, {r("sum(cost_usd)", 4)} AS cost_usd_total FROM t JOIN g USING (doc_id) LEFT JOIN m USING (doc_id) GROUP BY model),
c AS (SELECT model, string_agg(code || '=' || n, ';' ORDER BY code) AS hard_codes FROM (SELECT model, code, count(*) AS n FROM (SELECT model, unnest(string_split(codes, ',')) AS code FROM t JOIN g USING (doc_id)) WHERE code IN ({hard}) GROUP BY ALL) GROUP BY model),
j AS (SELECT doc_id, 'strict' AS judge, 5 + n_chars % 21 AS total, quality = 1 AS valid FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'mild', 10 + n_chars % 16, lang <> 'de' FROM documents),
q AS (SELECT model, string_agg(judge || '=' || mean, ';' ORDER BY judge) AS judge_mean_total FROM (SELECT model, judge, {mean("total")} AS mean FROM t JOIN j USING (doc_id) WHERE valid GROUP BY ALL) GROUP BY model)
SELECT s.*, coalesce(hard_codes, '-') AS hard_codes, coalesce(judge_mean_total, '-') AS judge_mean_total FROM s LEFT JOIN c USING (model) LEFT JOIN q USING (model)"""


@query("agg1_run_summary", _sql())
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' traces by source, judged by two judges: one from the labels, one from the language."""
    docs = table(spark, sf_dir, "documents")
    marks = sorted_join(docs, table(spark, sf_dir, "labels"), "doc_id")
    judged = marks.select(F.col("doc_id").alias("key"), F.lit("strict").alias("judge"), (F.col("quality") == 1).alias("valid"), (5 + F.col("n_chars") % 21).alias("total")).unionByName(
        docs.select(F.col("doc_id").alias("key"), F.lit("mild").alias("judge"), (F.col("lang") != "de").alias("valid"), (10 + F.col("n_chars") % 16).alias("total"))
    )
    traces, cases = (stored(t, "traces") for t in evidence.traces_of(spark, sf_dir))
    numbered = evidence.numbered(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("source").alias("model"), *[F.expr(e).cast("double" if n in ("latency_s", "cost_usd") else "long").alias(n) for n, e in TOTALS.items()])
    rows = runs.model_summary(stored(sorted_join(numbered, traces.select("key", "status"), "key"), "totals"), runs.gate_results(traces, cases), judged)
    return rows.withColumns({c: runs.shown_map(F.col(c)) for c in ("hard_codes", "judge_mean_total")})
