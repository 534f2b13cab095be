"""Seeded errors of sources, quotes and calls, over candidates that are made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.sourcing import seed_source_errors
from corpusmill.plans.catalogue import query, table
from corpusmill.sources.scratch import stored

# Columns that both engines make of a document: two claims on its first two sentences, two fields, three sources, a call.
_SQL = """
WITH d AS (SELECT doc_id AS case_id, text AS report, lang, n_chars AS k, regexp_extract(text, '^[^ ]*', 0) AS word, strpos(text, '. ') AS e1, strpos(substring(text, strpos(text, '. ') + 2), '. ') AS e2 FROM documents WHERE text IS NOT NULL),
c0 AS (SELECT *, substring(report, 1, e1) AS q1, substring(report, e1 + 2, e2) AS q2, 's' || CAST(k % 3 AS VARCHAR) AS r0, k % 4 = 0 AS rule_c, k % 5 > 0 AS needs, k % 13 AS asked FROM d WHERE e1 > 1 AND e2 > 1),
o AS (SELECT *, CASE WHEN needs THEN ['s0'] ELSE [] END AS ids, '' AS kind FROM c0),
v AS (SELECT case_id, kind, report, q1, q2, ref, kn, calls, word, lang, needs, rule_c, asked, wanted FROM (
    SELECT *, 'first' AS ref, ['s0'] AS kn, ids AS calls, [] AS wanted FROM o
    UNION ALL SELECT * REPLACE ('wrong_evidence_ref' AS kind), 'lang', ['s0'], ids, ['evidence_ref'] FROM o WHERE lang <> ''
    UNION ALL SELECT * REPLACE ('unread_source' AS kind), 'first', ['s0', 's1'], ids, ['source_not_read'] FROM o
    UNION ALL SELECT * REPLACE ('rule_excerpt_basis' AS kind), 'first', ['s0', 's2'], ids, ['rule_excerpt'] FROM o WHERE rule_c
    UNION ALL SELECT * REPLACE ('quote_not_unique' AS kind, report || chr(10) || q1 AS report), 'first', ['s0'], ids, ['quote_invalid'] FROM o
    UNION ALL SELECT * REPLACE ('tool_parameter_overlimit' AS kind, 11 AS asked), 'first', ['s0'], ids, ['retrieval_policy'] FROM o WHERE needs
    UNION ALL SELECT * REPLACE ('unnecessary_retrieval' AS kind, 1 AS asked), 'first', ['s0'], ['s0'], ['unnecessary_retrieval'] FROM o WHERE NOT needs
    UNION ALL SELECT * REPLACE ('missing_required_retrieval' AS kind), 'first', ['s0'], ['s1'], ['missing_retrieval'] FROM o WHERE needs
    UNION ALL SELECT * REPLACE ('several' AS kind, report || chr(10) || q1 AS report, CASE WHEN needs THEN 11 ELSE 1 END AS asked), CASE WHEN lang <> '' THEN 'lang' ELSE 'first' END, CASE WHEN rule_c THEN ['s0', 's1', 's2'] ELSE ['s0', 's1'] END,
        CASE WHEN needs THEN ['s1'] ELSE ['s0'] END, list_sort(['source_not_read', 'quote_invalid'] || CASE WHEN lang <> '' THEN ['evidence_ref'] ELSE [] END || CASE WHEN rule_c THEN ['rule_excerpt'] ELSE [] END
        || CASE WHEN needs THEN ['retrieval_policy', 'missing_retrieval'] ELSE ['unnecessary_retrieval'] END) FROM o)),
f AS (SELECT case_id, kind, report, wanted, list_sort(list_filter([
    CASE WHEN NOT contains(q1, CASE ref WHEN 'lang' THEN lang ELSE word END) OR CASE ref WHEN 'lang' THEN lang ELSE word END = '' THEN 'evidence_ref:c1' END,
    CASE WHEN list_contains(kn, 's1') THEN 'source_not_read:c1' END, CASE WHEN list_contains(kn, 's2') THEN 'rule_excerpt:c1' END,
    CASE WHEN contains(substring(report, 2), q1) THEN 'quote_invalid:c1' END,
    CASE WHEN strpos(report, q2) <> length(q1) + 2 OR contains(substring(report, length(q1) + 3), q2) THEN 'quote_invalid:c2' END,
    CASE WHEN len(calls) > 0 AND asked > 10 THEN 'retrieval_policy:k1' END, CASE WHEN needs AND NOT list_contains(calls, 's0') THEN 'missing_retrieval:s0' END,
    CASE WHEN NOT needs AND len(calls) > 0 THEN 'unnecessary_retrieval:seed' END], lambda x: x IS NOT NULL)) AS failures FROM v),
s AS (SELECT case_id FROM f WHERE kind = '' AND len(failures) = 0)
SELECT case_id, kind, sha256(report) AS report_sha256, array_to_string(failures, ',') AS failures,
       case_id IN (SELECT case_id FROM s) AND list_sort(list_distinct(list_transform(failures, lambda x: split_part(x, ':', 1)))) = list_sort(wanted) AS taken FROM f WHERE kind <> ''
"""


@query("mut2_source_errors", _SQL)
def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven errors of sources, quotes and calls, each alone and all together; failures come from the edited tables."""
    at = F.locate(". ", F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("e1", at).withColumn("rest", F.substr(F.col("text"), F.col("e1") + 2))
    docs = docs.withColumn("e2", F.locate(". ", F.col("rest"))).where("e1 > 1 and e2 > 1").withColumnRenamed("doc_id", "case_id")
    word, k = F.regexp_extract("text", "^[^ ]*", 0), F.col("n_chars")
    reports = docs.select("case_id", F.col("text").alias("report"))
    cut = F.substr(F.col("text"), F.lit(1), F.col("e1")), F.substr(F.col("rest"), F.lit(1), F.col("e2"))
    docs = stored(docs.select("case_id", "e1", "e2", "n_chars", "lang", word.alias("word"), cut[0].alias("q1"), cut[1].alias("q2")), "cases")
    none = F.lit(None).cast("string")
    first = F.struct(F.lit("c1").alias("claim_id"), F.lit(0).alias("start"), F.col("e1").alias("end"), F.col("q1").alias("quote"), F.lit("first").alias("ref"), F.array(F.lit("s0")).alias("knowledge"))
    second = F.struct(F.lit("c2").alias("claim_id"), (F.col("e1") + 1).alias("start"), (F.col("e1") + 1 + F.col("e2")).alias("end"), F.col("q2").alias("quote"), none.alias("ref"), F.array().cast("array<string>").alias("knowledge"))
    claims = docs.select("case_id", F.explode(F.array(first, second)).alias("c")).select("case_id", "c.*")
    fields = docs.select("case_id", F.explode(F.create_map(F.lit("first"), F.col("word"), F.lit("lang"), F.coalesce("lang", F.lit("")))).alias("field", "value"))
    needs = k % 5 > 0
    source = lambda name, rule, read, needed: F.struct(F.lit(name).alias("source_id"), rule.alias("rule"), F.lit(read).alias("read"), needed.alias("needed"))
    sources = docs.select("case_id", F.explode(F.array(source("s0", F.lit(False), True, needs), source("s1", F.lit(False), False, F.lit(False)), source("s2", k % 4 == 0, True, F.lit(False)))).alias("s")).select("case_id", "s.*")
    calls = docs.where(needs).select("case_id", F.lit("k1").alias("call_id"), (k % 13).cast("int").alias("asked"), F.array(F.lit("s0")).alias("ids"))
    made = seed_source_errors(reports, claims, fields, sources, calls)
    return made.select("case_id", "kind", F.sha2("report", 256).alias("report_sha256"), F.array_join("failures", ",").alias("failures"), "taken")
