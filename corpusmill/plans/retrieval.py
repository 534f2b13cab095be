"""Retrieval queries: documents as the knowledge base, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import retrieval as R
from corpusmill.operators.selection import best_per_group
from corpusmill.plans.catalogue import query, table

ASCII_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_.:/-]{2,}')"
INDEX = f"""dt AS (SELECT doc_id AS doc, {ASCII_TOKENS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dt),
p AS (SELECT doc, token, count(*) AS tf, max(ln) AS ln FROM (SELECT doc, unnest(w) AS token, len(w) AS ln FROM dt) GROUP BY doc, token),
q AS (SELECT DISTINCT item_id AS query, unnest({ASCII_TOKENS}) AS token FROM benchmark),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / greatest(mean, 1)))), 9) AS score FROM q JOIN df USING (token) JOIN p USING (token), st GROUP BY query, doc),
k AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)"""


def _scored(spark: SparkSession, sf_dir: str, limit: int, kinds: int = 1) -> DataFrame:
    """Scores of the best documents of each kind (doc modulo kinds) for all benchmark items, `limit` or more of each."""
    docs, tokens = table(spark, sf_dir, "documents"), T.keyword_tokens(F.col("text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(tokens)).alias("token"))
    return R.bm25_best(docs, "doc_id", tokens, queries.distinct(), limit, kinds)


def _ranked(spark: SparkSession, sf_dir: str, limit: int = 24) -> DataFrame:
    return best_per_group(_scored(spark, sf_dir, limit), ["query"], [F.desc("score"), "doc"], limit).withColumnRenamed("place", "rank")


@query("bm25_topk", f"WITH {INDEX} SELECT query, doc, rank, round(score, 6) AS score FROM k WHERE rank <= 24")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query", "doc", "rank", F.round("score", 6).alias("score"))


@query(
    "rrf_fusion",
    f"""WITH {INDEX}, two AS (SELECT query, CASE WHEN doc % 2 = 0 THEN 'chunk' ELSE 'rule' END AS tag, doc, score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, tag ORDER BY score DESC, doc) AS rank FROM two),
    f AS (SELECT query, tag, doc, 1.0 / (60 + rank - 1) AS fused FROM r WHERE rank <= 24),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, tag, doc) AS place FROM f)
    SELECT query, tag, doc, round(fused * 60, 4) AS score, place FROM o WHERE place <= 8""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd documents as the two indexes."""
    scored = _scored(spark, sf_dir, 24, 2).withColumn("tag", F.when(F.col("kind") == 0, "chunk").otherwise("rule"))
    ranked = best_per_group(scored, ["query", "tag"], [F.desc("score"), "doc"], 24).withColumnRenamed("place", "rank")
    return R.fuse(ranked, 8).select("query", "tag", "doc", F.round(F.col("fused") * 60, 4).alias("score"), "place")


@query(
    "context_budget",
    f"""WITH {INDEX}, c AS (SELECT query, doc, rank, text AS content, coalesce(sum(length(text)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM k JOIN documents ON doc = doc_id WHERE rank <= 8)
    SELECT query, doc, rank, CAST(CASE WHEN length(content) <= 9000 - used THEN length(content) ELSE greatest(9000 - used - 1, 1) + 1 END AS BIGINT) AS chars, length(content) > 9000 - used AS content_truncated FROM c WHERE used < 9000""",
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir, 8).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc")
    kept = R.context_budget(hits, "query", ["rank"], "content", 9000)
    return kept.select("query", "doc", "rank", F.length("content").cast("long").alias("chars"), "content_truncated")


@query(
    "jaccard_sets",
    r"""WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS g FROM documents),
    n AS (SELECT source, g, lead(g) OVER o AS h, lead(doc_id) OVER o AS next FROM w WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
    p AS (SELECT source, len(list_intersect(g, h)) AS i, len(g) + len(h) AS t FROM n WHERE next IS NOT NULL)
    SELECT source, count(*) AS pairs, avg(CASE WHEN t > i THEN i / CAST(t - i AS DOUBLE) ELSE 0 END) AS mean_jaccard, avg(CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END) AS no_overlap FROM p GROUP BY source""",
)
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sets of each document and the next of its source."""
    order = Window.partitionBy("source").orderBy("doc_id")
    ids = table(spark, sf_dir, "documents").select("doc_id", "source")
    follow = ids.withColumn("next", F.lead("doc_id").over(order)).where("next is not null")
    sets = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("g"))
    pairs = follow.join(sets, "doc_id").join(sets.toDF("next", "h"), "next").select("source", R.set_similarity(F.col("g"), F.col("h")).alias("j"))
    return pairs.groupBy("source").agg(F.count("*").alias("pairs"), F.avg("j").alias("mean_jaccard"), F.avg((F.col("j") == 0).cast("double")).alias("no_overlap"))


@query("ret1_tokens", f"SELECT item_id, len({ASCII_TOKENS}) AS tokens, len(list_distinct({ASCII_TOKENS})) AS distinct_tokens FROM benchmark")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.keyword_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


@query(
    "ret2_index",
    f"""WITH dt AS (SELECT doc_id AS doc, {ASCII_TOKENS} AS w FROM documents), p AS (SELECT doc, token, count(*) AS tf FROM (SELECT doc, unnest(w) AS token FROM dt) GROUP BY ALL)
    SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS max_tf FROM p GROUP BY token""",
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = R.postings(table(spark, sf_dir, "documents"), "doc_id", T.keyword_tokens(F.col("text")))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))


@query("ret5_lookup", "SELECT 'document' AS record_type, doc_id AS id, length(text) AS chars FROM documents WHERE doc_id IN (3, 7, 11) UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark WHERE item_id IN (3, 7, 11)")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("record_type"), F.col(i).alias("id"), F.length("text").cast("long").alias("chars")) for t, k, i in (("documents", "document", "doc_id"), ("benchmark", "benchmark", "item_id"))]
    return parts[0].unionByName(parts[1]).where(F.col("id").isin(3, 7, 11))


@query("ret6_stable_mode", "SELECT doc_id, CASE WHEN CAST('0x' || substring(sha256('7:' || doc_id), 1, 2) AS INTEGER) % 2 = 0 THEN 'sparse' ELSE 'hybrid' END AS mode FROM documents")
def stable_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(byte % 2 == 0, "sparse").otherwise("hybrid").alias("mode"))


@query(
    "ret8_term_hits",
    r"""WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM benchmark),
    d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))) AS term FROM documents),
    h AS (SELECT item_id, doc_id, 0.2e0 + 0.1e0 * count(*) AS score FROM d JOIN t USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM h)
    SELECT item_id, doc_id, score, place FROM r WHERE place <= 20""",
)
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the 20 documents that hold most of its distinct terms."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return R.term_hits(docs, terms, "doc_id", "item_id", 20)


@query(
    "ret7_hybrid",
    f"""WITH {INDEX}, two AS (SELECT query, CASE WHEN doc % 3 = 0 THEN 'rule' ELSE 'chunk' END AS tag, doc, score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, tag ORDER BY score DESC, doc) AS rank FROM two),
    f AS (SELECT query, tag, doc, 1.0 / (60 + rank - 1) AS fused FROM r WHERE rank <= 24),
    b AS (SELECT *, row_number() OVER (PARTITION BY query, tag ORDER BY fused DESC, tag, doc) AS n FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, tag, doc) AS place FROM b WHERE n <= 5),
    c AS (SELECT query, tag, doc, place, length(text) AS ln, coalesce(sum(length(text)) OVER (PARTITION BY query ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o JOIN documents ON doc = doc_id WHERE place <= 8)
    SELECT query, tag, doc, place, CAST(CASE WHEN ln <= 9000 - used THEN ln ELSE greatest(9000 - used - 1, 1) + 1 END AS BIGINT) AS chars, ln > 9000 - used AS content_truncated FROM c WHERE used < 9000""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes ranked apart, fused, at most five of a kind and eight in all, then cut to a budget of characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    tagged = _scored(spark, sf_dir, 24, 3).withColumn("tag", F.when(F.col("kind") == 0, "rule").otherwise("chunk"))
    kept = R.hybrid(tagged, docs, per_index=24, most=8, per_kind=5, max_chars=9000)
    return kept.select("query", "tag", "doc", "place", F.length("content").cast("long").alias("chars"), "content_truncated")


@query(
    "ret9_neighbours",
    """SELECT l_orderkey, l_linenumber, CASE WHEN lag(l_linenumber) OVER o = l_linenumber - 1 THEN lag(l_partkey) OVER o END AS before,
    CASE WHEN lead(l_linenumber) OVER o = l_linenumber + 1 THEN lead(l_partkey) OVER o END AS after FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return R.neighbours(lines, "l_orderkey", "l_linenumber", "l_partkey").drop("l_partkey")


@query(
    "win8_merge_unique",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM f)
    SELECT user_id, event_type, event_id, place FROM r WHERE place <= 3""",
)
def merge_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_unique(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", ["event_id"], 3)


@query("prj1_initial_query", "SELECT c_custkey, array_to_string(list_filter([trim(c_mktsegment), trim(c_name)], lambda v: v <> ''), chr(10)) AS query FROM customer")
def initial_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", R.initial_query(F.array("c_mktsegment", "c_name", "c_mktsegment")).alias("query"))


@query("prj2_anchor_summary", "SELECT o_orderkey, coalesce(nullif(trim(o_orderpriority), ''), nullif(trim(o_orderstatus), ''), 'unknown') AS anchor FROM orders")
def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.nullif(F.trim("o_orderstatus"), F.lit("")), F.lit("unknown"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("anchor"))


@query("prj3_public_fields", "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: NOT starts_with(k, '_'))), ',') AS fields FROM events WHERE json_valid(props)")
def public_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that begin with an underscore are internal and go."""
    fields = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~F.startswith(k, F.lit("_")))
    return table(spark, sf_dir, "events").where(F.json_object_keys("props").isNotNull()).select("event_id", F.array_join(F.array_sort(F.map_keys(fields)), ",").alias("fields"))


@query("prj4_render", "SELECT c_custkey, 'Customer ' || c_name || ' of ' || c_mktsegment || '.' AS prompt FROM customer")
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each placeholder of the template stands for one value; what the values hold is not looked at again."""
    parts = F.split(F.lit("Customer {name} of {segment}."), r"\{\w+\}")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(parts[0], "c_name", parts[1], "c_mktsegment", parts[2]).alias("prompt"))
