"""Gates, duplication, privacy, sections, n-grams and other text measures over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import gates, judging, markdown, ngrams, patterns
from corpusmill.operators.ngrams import value_hits
from corpusmill.operators.selection import cascade, difference
from corpusmill.operators.summary import exact_floor_percentile
from corpusmill.plans.catalogue import query, table
from corpusmill.sources.scratch import stored_in_small_batches

BODY = r"regexp_replace(text, '\s+', '', 'g')"
GRAMS = "CASE WHEN length(body) >= 12 THEN list_transform(range(1, length(body) - 10), lambda i: substring(body, i, 12)) ELSE [] END"
RATIO = "CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / CAST(len(g) AS DOUBLE) ELSE 0 END"
EMAIL = r"regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+')"
PHONE = "regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)')"
ID_NUMBER = "regexp_matches(text, '(^|[^0-9])[0-9]{17}[0-9Xx]([^0-9]|$)')"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.compact(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.length(body).alias("chars"), T.duplicated_grams(body, 12).alias("dup"))
    private = F.col("text").rlike(gates.EMAIL) | F.col("text").rlike(gates.PHONE) | F.col("text").rlike(gates.ID_NUMBER)
    return docs.withColumn("private", private).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


REASON = "CASE WHEN private THEN 'privacy' WHEN dup > 0.3 THEN 'loop' WHEN quality IS NULL THEN 'no_label' WHEN quality = 0 THEN 'low_quality' END"
MEASURED = f"""b AS (SELECT doc_id, source, text, {BODY} AS body FROM documents), gr AS (SELECT *, {GRAMS} AS g FROM b),
m AS (SELECT gr.doc_id, source, length(body) AS chars, {RATIO} AS dup, {EMAIL} OR {PHONE} OR {ID_NUMBER} AS private, quality FROM gr LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, {REASON} AS reason FROM m)"""


def _reason() -> Column:
    return cascade(("privacy", F.col("private")), ("loop", F.col("dup") > 0.3), ("no_label", F.col("quality").isNull()), ("low_quality", F.col("quality") == 0))


@query(
    "gate_summary",
    f"""WITH {MEASURED} SELECT source, count(*) AS n, count(*) FILTER (reason IS NULL) AS selected, count(*) FILTER (private) AS private,
    count(*) FILTER (dup > 0.3) AS loops, avg(chars) AS mean_chars, max(dup) AS max_dup FROM r GROUP BY source""",
)
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).withColumn("reason", _reason())
    return rows.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("reason").isNull()).alias("selected"),
        F.count_if("private").alias("private"),
        F.count_if(F.col("dup") > 0.3).alias("loops"),
        F.avg("chars").alias("mean_chars"),
        F.max("dup").alias("max_dup"),
    )


@query("select_cascade", f"WITH {MEASURED} SELECT coalesce(reason, 'selected') AS reason, count(*) AS n FROM r GROUP BY 1")
def select_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).select(F.coalesce(_reason(), F.lit("selected")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("dup_ratio", f"WITH b AS (SELECT doc_id, {BODY} AS body FROM documents), gr AS (SELECT doc_id, {GRAMS} AS g FROM b) SELECT doc_id, {RATIO} AS dup_12gram_ratio FROM gr")
def dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.duplicated_grams(T.compact(F.col("text")), 12).alias("dup_12gram_ratio"))


@query(
    "agg8_reasoning_loop",
    f"""WITH b AS (SELECT conv_id, turn, {BODY} AS body FROM conversations WHERE role = 'assistant'), gr AS (SELECT *, {GRAMS} AS g FROM b)
    SELECT conv_id, max(CASE WHEN length(body) >= 400 THEN {RATIO} ELSE 0 END) AS reasoning_loop, CAST(sum(length(body)) AS BIGINT) AS reasoning_chars FROM gr GROUP BY conv_id""",
)
def reasoning_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = turns.select("conv_id", gates.loop_ratio(F.col("text")).alias("loop"), F.length(T.compact(F.col("text"))).alias("chars"))
    return rows.groupBy("conv_id").agg(F.max("loop").alias("reasoning_loop"), F.sum("chars").alias("reasoning_chars"))


@query("pii_flags", f"SELECT doc_id, {EMAIL} AS email, {PHONE} AS phone, {ID_NUMBER} AS id_number FROM documents")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(gates.EMAIL).alias("email"), t.rlike(gates.PHONE).alias("phone"), t.rlike(gates.ID_NUMBER).alias("id_number"))


@query(
    "str8_unit_numbers",
    r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS numbers, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'))) AS distinct_numbers FROM documents",
)
def unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("numbers"), F.size(F.array_distinct(found)).cast("long").alias("distinct_numbers"))


@query(
    "section_stats",
    r"""WITH h AS (SELECT page_id, regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g') AS t FROM pages),
    s AS (SELECT page_id, string_split_regex(t, '(?m)^#{1,6}[ \t\n\f\r]+[^ \t\n\f\r].*$') AS parts FROM h)
    SELECT page_id, len(parts) - 1 AS sections, CAST(coalesce(list_sum(list_transform(parts[2:], lambda x: length(regexp_replace(x, '\s+', '', 'g')))), 0) AS BIGINT) AS body_chars FROM s""",
)
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_replace("html", "<h[1-6][^>]*>", "\n# ")
    rows = table(spark, sf_dir, "pages").select("page_id", T.heading_parts(marked).alias("s"))
    chars = F.aggregate(F.transform("s", lambda x: F.length(T.compact(x["body"]))), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("page_id", F.size("s").cast("long").alias("sections"), chars.alias("body_chars"))


@query(
    "str4_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[。；;\n]'), lambda x: trim(x) <> '') AS p FROM documents)
    SELECT doc_id, len(p) AS sentences, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s""",
)
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    longest = F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0))
    return rows.select("doc_id", F.size("p").cast("long").alias("sentences"), longest.cast("long").alias("longest"))


@query(
    "str12_format_flags",
    r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\r?\n'), lambda l: len(regexp_extract_all(l, '\*\*')) % 2 = 1)) > 0 AS unbalanced_bold,
    len(regexp_extract_all(text, '[A-Za-z]{4,}')) AS latin_words FROM documents""",
)
def format_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.regexp_count("text", F.lit("[A-Za-z]{4,}")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", T.unbalanced_bold(F.col("text")).alias("unbalanced_bold"), latin.alias("latin_words"))


@query(
    "str13_quote_check",
    r"""WITH b AS (SELECT item_id, text AS quote, regexp_replace(text, '\s+', '', 'g') AS q FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)
    SELECT item_id, doc_id, strpos(t, q) - 1 AS start FROM b JOIN d ON contains(t, q) WHERE length(q) > 0""",
)
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return patterns.verbatim_quotes(table(spark, sf_dir, "documents"), quotes, "doc_id", "text", "item_id").select("item_id", "doc_id", "start")


@query(
    "benchmark_overlap",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM benchmark),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
    bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b WHERE len(w) >= 8)
    SELECT item_id, doc_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL""",
)
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 8-grams of words that a document and a benchmark item share."""
    return ngrams.shared_grams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 8).select("item_id", "doc_id", "shared")


TOKENS = r"""d AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents),
t AS (SELECT doc, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM d),
l AS (SELECT doc, pos, token || ' ' || lead(token, 1) OVER o || ' ' || lead(token, 2) OVER o || ' ' || lead(token, 3) OVER o AS gram FROM t WINDOW o AS (PARTITION BY doc ORDER BY pos)),
g AS (SELECT * FROM l WHERE gram IS NOT NULL)"""


@query("ngram_first_seen", f"WITH {TOKENS}, m AS (SELECT doc, min(pos) OVER (PARTITION BY doc, gram) < pos AS again FROM g) SELECT doc, count(*) FILTER (again) AS repeated, count(*) AS total FROM m GROUP BY doc")
def ngram_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.per_sequence(table(spark, sf_dir, "documents"), "doc_id", "text", ngrams.repeats_of(4), ("repeated", "total"))


@query(
    "win10_loop_coverage",
    f"""WITH {TOKENS}, o AS (SELECT doc, gram FROM g GROUP BY ALL HAVING count(*) >= 3),
    p AS (SELECT doc, unnest(range(pos, pos + 4)) AS place FROM g JOIN o USING (doc, gram)) SELECT doc, count(DISTINCT place) AS covered FROM p GROUP BY doc""",
)
def loop_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.per_sequence(table(spark, sf_dir, "documents"), "doc_id", "text", ngrams.loops_of(4, 3), ("covered",))


@query(
    "set7_answer_overlap",
    r"""WITH c AS (SELECT conv_id AS doc, role, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM conversations WHERE role IN ('user', 'assistant')),
    g AS (SELECT DISTINCT doc, role, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM c WHERE len(w) >= 3)
    SELECT a.doc, count(u.gram) AS shared, count(*) AS total FROM g a LEFT JOIN g u ON a.doc = u.doc AND a.gram = u.gram AND u.role = 'user' WHERE a.role = 'assistant' GROUP BY a.doc""",
)
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "role", F.explode(F.array_distinct(T.word_grams(T.words(F.col("text")), 3))).alias("gram"))
    return ngrams.overlap(turns.where("role = 'assistant'"), turns.where("role = 'user'"))


@query("win11_speculation")
def speculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.per_sequence(table(spark, sf_dir, "documents"), "doc_id", "text", ngrams.drafts_of(2, 8), ("steps", "accepted"))


@query(
    "win12_neighbour_overlap",
    r"""WITH c AS (SELECT conv_id AS doc, turn AS start, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS w FROM conversations),
    n AS (SELECT *, lead(w) OVER o AS nw, lead(start) OVER o AS next_start FROM c WINDOW o AS (PARTITION BY doc ORDER BY start))
    SELECT doc, start, next_start, CASE WHEN len(w) > 0 AND nw IS NOT NULL THEN len(list_intersect(w, nw)) / CAST(len(w) AS DOUBLE) END AS shared_with_next FROM n""",
)
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("start"), F.array_distinct(T.words(F.col("text"))).alias("grams"))
    return ngrams.neighbour_overlap(spans, ["start"]).drop("grams")


@query(
    "agg27_keyword_density",
    r"""WITH k AS (SELECT lang, 1000.0 * len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+'), lambda w: w IN ('the', 'der', 'die', 'de', 'la', 'el'))) / greatest(length(text), 1) AS d FROM documents)
    SELECT lang, avg(d) AS mean_density, list_sort(list(d))[len(list(d)) // 2 + 1] AS upper_median FROM k GROUP BY lang""",
)
def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed words per 1000 characters; a word is a run of letters, digits and underscores."""
    rows = table(spark, sf_dir, "documents").select("lang", T.keyword_density(F.col("text"), ("the", "der", "die", "de", "la", "el")).alias("d"))
    means = rows.groupBy("lang").agg(F.avg("d").alias("mean_density"))
    return means.join(exact_floor_percentile(rows, ["lang"], "d", 0.5).withColumnRenamed("percentile", "upper_median"), "lang")


@query(
    "agg9_value_coverage",
    r"""WITH v AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS v, regexp_replace(text, '[^一-鿿A-Za-z0-9]', '', 'g') AS s FROM benchmark),
    g AS (SELECT item_id, list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS g FROM v WHERE length(s) >= 2),
    d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS body FROM documents), b AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(body)), lambda i: substring(body, i, 2))) AS pair FROM d),
    i AS (SELECT item_id, len(g) AS n, unnest(g) AS pair FROM g), c AS (SELECT doc_id, item_id, count(*) AS k FROM b JOIN i USING (pair) GROUP BY doc_id, item_id),
    w AS (SELECT doc_id, item_id FROM d JOIN v ON contains(body, v) WHERE length(s) >= 2), every AS (SELECT doc_id, item_id FROM c UNION SELECT doc_id, item_id FROM w)
    SELECT doc_id, item_id, coalesce(k, 0) / CAST(len(g) AS DOUBLE) AS hit, w.doc_id IS NOT NULL AS whole FROM every JOIN g USING (item_id) LEFT JOIN c USING (doc_id, item_id) LEFT JOIN w USING (doc_id, item_id)
    WHERE coalesce(k, 0) >= 0.6 * len(g) OR w.doc_id IS NOT NULL""",
)
def value_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text against every document: pairs whose covered share of character pairs reaches 0.6, or that hold the text whole."""
    return value_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "value"), "doc_id", "item_id", 0.6)


@query("str6_sanitised_pages")
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", ""), "<[^>]+>", " ")
    clean = stored_in_small_batches(markdown.sanitised(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "text"), "clean")
    return clean.select("page_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"))


@query(
    "url_pages_clean",
    r"""SELECT page_id, nullif(regexp_extract(url, '^[^:/?#]+://([^/?#:]+)', 1), '') AS host,
    length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>', '', 'g'), '<[^>]+>', chr(10), 'g'), '\s+', '', 'g')) AS chars FROM pages""",
)
def url_pages_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav)[^>]*>.*?</\1>", ""), "<[^>]+>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.length(T.compact(body)).alias("chars"))


@query("str7_normalised_markdown")
def normalised_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", markdown.normalise(F.col("text")).alias("m")).select("doc_id", F.length("m").alias("chars"), F.sha2("m", 256).alias("sha"))


@query(
    "str14_pointers",
    r"SELECT page_id, replace(replace(list_filter(string_split(url, '/'), lambda p: p <> '')[-1], '~1', '/'), '~0', '~') AS token FROM pages",
)
def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(T.pointer_tokens(F.col("url")), -1).alias("token"))


@query("str19_labels", r"SELECT page_id, trim(regexp_replace(lower(url), '[^\p{L}\p{Nd}]+', '_', 'g'), '_') AS label FROM pages")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normal_label(F.col("url")).alias("label"))


@query("src11_objects", """SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL""")
def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object with a wanted key, behind thinking, prose and a broken brace."""
    said = F.concat(F.lit('<think>{"k": 0}</think> so {this: '), F.col("props"), F.lit(' and {"j": 1}'))
    rows = table(spark, sf_dir, "events").select("event_id", judging.extract_object(said, "k").alias("found"))
    return rows.where("found is not null").select("event_id", F.get_json_object("found", "$.k").alias("value"))


@query("src12_arrays", "SELECT event_id, 2 AS items, json_extract_string(props, '$.k') AS last FROM events")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last array of objects with a wanted key, behind a shorter one and an array of numbers."""
    said = F.concat(F.lit("first: ["), F.col("props"), F.lit("] then ["), F.col("props"), F.lit(", "), F.col("props"), F.lit("] end [1, 2]"))
    rows = table(spark, sf_dir, "events").select("event_id", judging.extract_array(said, "k").alias("found"))
    items = F.from_json("found", "array<struct<k:string>>")
    return rows.select("event_id", F.size(items).alias("items"), F.element_at(items, -1)["k"].alias("last"))


@query("src13_split", "SELECT event_id, 2 + event_id % 2 AS objects FROM events")
def split_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that follow one another in a text; odd events have one more."""
    more = F.when(F.col("event_id") % 2 == 1, F.col("props")).otherwise("")
    said = F.concat(F.col("props"), F.lit("\n noted {"), F.col("props"), F.lit(" "), more)
    return table(spark, sf_dir, "events").select("event_id", F.size(judging.split_objects(said)).cast("long").alias("objects"))


@query("diff1_similarity")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation against the next one."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("a"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("b", F.lead("a").over(order)).withColumn("next", F.lead("turn").over(order)).where("next is not null").drop("next")
    return difference(pairs, "a", "b").drop("a", "b")
