"""Joins, aggregations, comparisons and pivots over the star schema, labels and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.numerals import numeral_of
from corpusmill.operators import summary as A
from corpusmill.operators.patterns import article_targets, find_patterns
from corpusmill.operators.selection import best_per_group, cascade, fold, hash_fraction
from corpusmill.plans.catalogue import query, table
from corpusmill.plans.quality import NUMERAL

HASH = "CAST('0x' || substring(sha256({}), 1, 8) AS BIGINT)"


@query(
    "agg1_model_summary",
    """WITH r AS (SELECT source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS hard_fails, avg(quality) AS mean_quality, avg(n_chars) AS mean_chars,
    list_sort(list(n_chars))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90_chars, CAST(sum(n_chars) AS BIGINT) AS chars FROM r GROUP BY source""",
)
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("hard_fails"), F.avg("quality").alias("mean_quality"), F.avg("n_chars").alias("mean_chars"), F.sum("n_chars").alias("chars"))
    sums = A.joined_by(sums, A.exact_floor_percentiles(rows, ["source"], "n_chars", {"p90_chars": 0.9}), ["source"])
    return sums.select("source", "n", "hard_fails", "mean_quality", "mean_chars", "p90_chars", "chars")


@query("agg1_code_counts", "SELECT user_id, event_type AS code, count(*) AS n FROM events GROUP BY ALL")
def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.code_counts(table(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("codes")), ["user_id"], "codes")


@query(
    "agg2_floor_percentile",
    "SELECT l_returnflag, list_sort(list(l_extendedprice))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_returnflag",
)
def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return A.exact_floor_percentiles(rows, ["l_returnflag"], "l_extendedprice", {"p90": 0.9, "upper_median": 0.5})


@query("agg3_nearest_rank", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS highest FROM orders GROUP BY o_orderpriority")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(A.nearest_rank("o_totalprice", 0.5).alias("p50"), A.nearest_rank("o_totalprice", 0.95).alias("p95"), F.max("o_totalprice").alias("highest"))


@query("agg4_medians", "SELECT p_brand, median(p_retailprice) AS median_price FROM part GROUP BY p_brand")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("median_price"))


@query("agg6_distinct", "SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early")
    return table(spark, sf_dir, "lineitem").groupBy(early).agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("agg7_conditional", "SELECT o_custkey % 10 AS bucket, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY ALL")
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(F.count_if(o == "O").alias("open"), F.count_if(o == "F").alias("done"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"))


@query(
    "agg10_status_rollup",
    """WITH s AS (SELECT source, CASE WHEN quality IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS status, lang FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, lang, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'unknown' ELSE 'pass' END AS status, count(*) FILTER (status = 'fail') AS failed FROM s GROUP BY source, lang""",
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unknown").when(F.col("toxic") == 1, "fail").otherwise("pass")
    return rows.withColumn("s", status).groupBy("source", "lang").agg(A.worst_status(F.col("s")).alias("status"), F.count_if(F.col("s") == "fail").alias("failed"))


@query(
    "agg11_calibration",
    """WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), o AS (SELECT user_id, v AS ov FROM e WHERE event_type = 'view')
    SELECT event_type AS mutation, count(*) AS n, avg(ov - v) AS mean_drop, avg(CASE WHEN v < ov THEN 1.0 ELSE 0.0 END) AS detection_rate FROM e JOIN o USING (user_id) WHERE event_type <> 'view' GROUP BY event_type""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as reports, views as the originals, other events as mutations."""
    from corpusmill.operators.judging import calibration_summary

    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("total"))
    judged = means.select(F.col("user_id").alias("report_id"), F.when(F.col("event_type") == "view", "orig").otherwise(F.col("event_type")).alias("mutation"), F.lit("value").alias("target"), "total", F.create_map(F.lit("value"), F.col("total")).alias("scores"))
    return calibration_summary(judged)


@query(
    "paired_diff",
    """WITH m AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT a.v - b.v AS d FROM m a JOIN m b USING (o_custkey) WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F')
    SELECT count(*) AS pairs, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, avg(d) AS mean_difference FROM p""",
)
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", "O", "F")


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bootstrap_interval(A.bootstrap_means(table(spark, sf_dir, "labels"), "quality", 4000, 7))


@query(
    "agg19_leave_one_out",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
    t AS (SELECT i, sum(x) AS total, count(*) AS n FROM m GROUP BY i), b AS (SELECT label, x, (total - x) / (n - 1) AS rest FROM m JOIN t USING (i))
    SELECT label, round(sum(x * rest) / (sqrt(sum(x * x)) * sqrt(sum(rest * rest)) + 1e-12), 9) AS cosine FROM b GROUP BY label""",
)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each label's mean vector agrees with the mean of the other labels'."""
    means = A.vector_means(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"], "embedding")
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda p: p["mean"]).alias("v"))
    return A.leave_one_out(vectors, "label", "v").select("label", F.round("cosine", 9).alias("cosine"))


@query(
    "vec_macro_diff",
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS mean FROM e GROUP BY ALL)
    SELECT a.label AS left, b.label AS right, sqrt(sum((a.mean - b.mean) ** 2)) AS distance, sum(a.mean * b.mean) / sqrt(sum(a.mean ** 2) * sum(b.mean ** 2)) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL""",
)
def vec_macro_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = A.vector_means(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    right = means.select(F.col("label").alias("right"), "i", F.col("mean").alias("b"))
    both = means.select(F.col("label").alias("left"), "i", F.col("mean").alias("a")).join(right, "i").where(F.col("left") < F.col("right"))
    a, b = F.col("a"), F.col("b")
    return both.groupBy("left", "right").agg(F.sqrt(F.sum((a - b) * (a - b))).alias("distance"), (F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


@query(
    "agg20_component_stats",
    """WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT i, avg(x) AS mean, stddev_pop(x) AS std, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, abs(avg(x)) / stddev_pop(x) AS snr FROM e GROUP BY i ORDER BY snr DESC, i LIMIT 8""",
)
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return A.vector_statistics(rows, "embedding", 8)


FIELDS = """f AS (SELECT c_custkey % 4 AS split, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey % 4, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey % 4, 'rich', CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE '' END FROM customer)"""


@query("field_presence", f"WITH {FIELDS} SELECT split, field, count(*) AS n, count(*) FILTER (trim(value) <> '') AS present, count(DISTINCT value) AS distinct_values FROM f GROUP BY split, field")
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("split"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 5000, "yes").otherwise("").alias("rich"))
    long = rows.unpivot(["split"], ["name", "segment", "rich"], "field", "value")
    return long.groupBy("split", "field").agg(F.count("*").alias("n"), F.count_if(F.trim("value") != "").alias("present"), F.countDistinct("value").alias("distinct_values"))


@query(
    "pivot_vs_base",
    """WITH p AS (SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS v_O, sum(l_quantity) FILTER (l_linestatus = 'F') AS v_F FROM lineitem GROUP BY l_returnflag)
    SELECT p.l_returnflag, p.v_O, p.v_F, p.v_O / b.v_O AS ratio_O, p.v_F / b.v_F AS ratio_F FROM p, (SELECT * FROM p WHERE l_returnflag = 'N') b""",
)
def pivot_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pivot_against(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], F.sum("l_quantity"), "N")


@query(
    "agg24_run_compare",
    """WITH s AS (SELECT o_orderstatus, o_orderpriority AS signal, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY o_orderstatus, o_orderpriority)
    SELECT o_orderstatus, signal, n, place FROM s WHERE place <= 3""",
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("signal")).agg(F.count("*").alias("n"))
    return best_per_group(counts, ["o_orderstatus"], [F.desc("n"), "signal"], 3)


@query("agg26_length_ratio", "SELECT lang, median(n_chars) FILTER (quality = 0) / median(n_chars) FILTER (quality = 1) AS ratio, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    median = lambda q: F.median(F.when(F.col("quality") == q, F.col("n_chars")))
    return rows.groupBy("lang").agg((median(0) / median(1)).alias("ratio"), F.count("*").alias("n"))


@query("jn1_three_way", "SELECT c_mktsegment, n_name, count(*) AS orders, sum(o_totalprice) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))


@query("jn2_broadcast_cases", "SELECT p_brand, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.05 GROUP BY p_brand")
def broadcast_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimiser broadcasts the smaller side where its size allows."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_partkey", "l_quantity")
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("jn3_source_self_join", "SELECT a.o_orderkey, b.o_orderkey AS source_key, a.o_totalprice - b.o_totalprice AS gain FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 AND a.o_orderstatus = b.o_orderstatus")
def source_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sources = rows.select((F.col("o_orderkey") + 1).alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").alias("before"))
    return rows.join(sources, ["o_orderkey", "o_orderstatus"]).select("o_orderkey", (F.col("o_orderkey") - 1).alias("source_key"), (F.col("o_totalprice") - F.col("before")).alias("gain"))


@query(
    "jn4_signature_pairs",
    "SELECT a.source, a.lang, count(*) AS pairs FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY ALL",
)
def signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs share source and signature; counted from group sizes, without making the pairs."""
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg((n * (n - 1) / 2).cast("long").alias("pairs")).where("pairs > 0")


@query(
    "jn9_substring",
    """SELECT p_partkey, s_suppkey FROM part JOIN supplier ON contains(p_name, split_part(s_name, '#', 2)) WHERE split_part(s_name, '#', 2) <> ''""",
)
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a supplier's name inside a part's name; all numbers are looked for in one reading of the names."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.split_part("s_name", F.lit("#"), F.lit(2)).alias("key")).where("key <> ''")
    hits = find_patterns(table(spark, sf_dir, "part"), "p_partkey", "p_name", suppliers, "key").select(F.col("doc").alias("p_partkey"), F.col("pattern").alias("key")).distinct()
    return hits.join(suppliers, "key").select("p_partkey", "s_suppkey")


_LAW = "concat(substring('甲乙丙丁戊己庚', CAST({} % 7 AS INT) + 1, 1), '法')"


@query(
    "jn9_targets",
    f"""WITH v AS (SELECT n, {NUMERAL} AS numeral FROM (SELECT range AS n, string_split('零一二三四五六七八九', '') AS d FROM range(1000))),
    r AS (SELECT p_partkey, concat(p_name, CASE WHEN p_size % 3 > 0 THEN {_LAW.format("p_partkey")} ELSE '' END, '第', CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE numeral END, '条 ', p_type) AS text FROM part JOIN v ON n = p_size),
    i AS (SELECT s_suppkey, {_LAW.format("s_suppkey")} AS law, n, numeral FROM supplier JOIN v ON n = s_suppkey % 50 + 1)
    SELECT s_suppkey, p_partkey, CAST(least(nullif(strpos(text, '第' || numeral || '条'), 0), nullif(strpos(text, '第' || CAST(n AS VARCHAR) || '条'), 0)) - 1 AS BIGINT) AS start
    FROM i JOIN r ON contains(text, law) AND (contains(text, '第' || numeral || '条') OR contains(text, '第' || CAST(n AS VARCHAR) || '条'))""",
)
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records that name a law (or none) and an article, in numerals or digits; suppliers ask for an article of a law."""
    number = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(numeral_of(F.col("p_size")))
    law = F.when(F.col("p_size") % 3 > 0, F.expr(_LAW.format("p_partkey"))).otherwise("")
    records = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", law, F.lit("第"), number, F.lit("条 "), "p_type").alias("text"))
    items = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_LAW.format("s_suppkey")).alias("law"), (F.col("s_suppkey") % 50 + 1).alias("number"))
    return article_targets(records, "p_partkey", "text", items, "s_suppkey")


_VECTORS = "SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(label AS DOUBLE) AS y FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(
    "agg20_gram_sums",
    f"""WITH v AS ({_VECTORS}), w AS (SELECT * FROM v WHERE len(e) = (SELECT max(len(e)) FROM v)), x AS (SELECT row_number() OVER () AS r, list_append(e, y) AS e FROM w),
    l AS (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM x)
    SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS total FROM l a JOIN l b ON a.r = b.r AND a.i < (SELECT max(i) FROM l) GROUP BY 1, 2""",
)
def gram_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X'X of all embeddings, and X'y with their label in the last column."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", F.col("label").cast("double").alias("y"))
    _, gram, cross = A.gram_sums(rows, "embedding", "y")
    whole = np.column_stack([gram, cross])
    cells = [(i, j, float(x)) for (i, j), x in np.ndenumerate(whole)]  # the width squared
    return spark.createDataFrame(cells, "i long, j long, total double")


@query("agg20_ridge_weights")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the components that best give the label, scaled to a mean gain of one."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", F.col("label").cast("double").alias("y"))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(A.ridge_weights(rows, "embedding", "y", 1e-3))], "i long, weight double")


@query("jn12_reconcile", "SELECT coalesce(s.n_nationkey, c.n_nationkey) AS nation, coalesce(s.k, 0) AS suppliers, coalesce(c.k, 0) AS customers FROM (SELECT s_nationkey AS n_nationkey, count(*) AS k FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS k FROM customer GROUP BY 1) c ON s.n_nationkey = c.n_nationkey")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full").select("nation", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("jn15_unmask", f"SELECT item_id, CASE WHEN first_is_a THEN 'chosen' ELSE 'rejected' END AS winner FROM (SELECT item_id, {HASH.format(chr(39) + 'ab:' + chr(39) + ' || item_id')} / 4294967295.0 < 0.5 AS first_is_a FROM benchmark)")
def unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reviewer says A; the answer key tells which side that was."""
    key = table(spark, sf_dir, "benchmark").select("item_id", (hash_fraction(F.lit("ab"), F.col("item_id")) < 0.5).alias("first_is_a"))
    reviews = key.select("item_id", F.lit("A").alias("winner"))
    return reviews.join(key, "item_id").select("item_id", F.when(F.col("first_is_a"), "chosen").otherwise("rejected").alias("winner"))


@query("jn16_union_first_wins", "SELECT text_key, min(prio) AS prio FROM (SELECT sha256(text) AS text_key, 0 AS prio FROM benchmark UNION ALL SELECT sha256(text), 1 FROM documents) GROUP BY text_key")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.sha2("text", 256).alias("text_key"), F.lit(p).alias("prio")) for t, p in (("benchmark", 0), ("documents", 1))]
    return parts[0].unionByName(parts[1]).groupBy("text_key").agg(F.min("prio").alias("prio"))


@query("jn17_grid", "SELECT r_name AS model, count(*) AS jobs FROM region, customer GROUP BY r_name")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by models; the models are a fixed short list."""
    models = F.array(*[F.lit(r["r_name"]) for r in table(spark, sf_dir, "region").collect()])  # five rows
    jobs = table(spark, sf_dir, "customer").select(F.explode(models).alias("model"))
    return jobs.groupBy("model").agg(F.count("*").alias("jobs"))


@query("mth1_score", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality + 3 * (n_chars % 100) / 100.0 ELSE (n_chars % 100) / 100.0 - 4e-5 * n_chars END AS score FROM documents LEFT JOIN labels USING (doc_id)")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    part = (F.col("n_chars") % 100) / 100.0
    return rows.select("doc_id", F.when(F.col("quality").isNotNull(), F.col("quality") + 3 * part).otherwise(part - F.lit(4e-5) * F.col("n_chars")).alias("score"))


@query("mth2_margin_loss", "SELECT l_returnflag, avg(ln(1 + exp(-(l_discount - l_tax)))) AS loss, avg(l_discount - l_tax) AS margin FROM lineitem GROUP BY l_returnflag")
def margin_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(F.log1p(F.exp(-m))).alias("loss"), F.avg(m).alias("margin"))


@query("conv_last_turn", "SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role, length(max_by(text, turn)) AS last_chars, count(*) AS turns FROM conversations GROUP BY conv_id")
def conv_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.length(F.max_by("text", "turn")).cast("long").alias("last_chars"), F.count("*").alias("turns"))


@query(
    "conv_summary",
    """SELECT role, count(*) AS n, avg(length(text)) AS mean_chars, list_sort(list(length(text)))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90_chars, quantile_disc(length(text), 0.9) AS p90_nearest FROM conversations GROUP BY role""",
)
def conv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("c"))
    sums = rows.groupBy("role").agg(F.count("*").alias("n"), F.avg("c").alias("mean_chars"), A.nearest_rank("c", 0.9).cast("long").alias("p90_nearest"))
    return sums.join(A.exact_floor_percentile(rows, ["role"], "c", 0.9).withColumnRenamed("percentile", "p90_chars"), "role")


@query("flt2_acceptance", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'no_judge' WHEN quality = 0 THEN 'gate' WHEN toxic = 1 THEN 'worse' WHEN n_chars < 200 THEN 'gain' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = cascade(("no_judge", F.col("quality").isNull()), ("gate", F.col("quality") == 0), ("worse", F.col("toxic") == 1), ("gain", F.col("n_chars") < 200))
    return rows.select("doc_id", reason.alias("reason"))


@query("smp6_folds", f"SELECT {HASH.format('c_mktsegment')} % 3 AS fold, count(*) AS n FROM customer GROUP BY ALL")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(fold(F.col("c_mktsegment"), 3).alias("fold")).agg(F.count("*").alias("n"))


@query("win13_first_difference", "WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_custkey, min(pos) AS first_change FROM p WHERE nxt IS NOT NULL AND nxt <> o_orderstatus GROUP BY o_custkey")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.lead("o_orderstatus").over(order).alias("nxt"), (F.row_number().over(order) - 1).alias("pos"))
    return rows.where("nxt <> o_orderstatus").groupBy("o_custkey").agg(F.min("pos").cast("long").alias("first_change"))


@query("snk2_upsert", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even order keys are the old rows, odd ones the new."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return best_per_group(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc(F.col("o_orderkey") % 2), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")
