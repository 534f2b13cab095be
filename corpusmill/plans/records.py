"""JSON records, acceptance rules and remaining joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import documents as J
from corpusmill.functions import text as T
from corpusmill.operators import acceptance as A
from corpusmill.operators import gates
from corpusmill.operators.selection import best_per_group
from corpusmill.plans.catalogue import query, table


@query("jsn2_signature", "SELECT count(*) AS signatures, max(n) AS largest FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(J.signature(F.col("o_orderstatus"), F.col("o_orderpriority"))).agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("signatures"), F.max("n").alias("largest"))


@query("jsn1_canonical", "SELECT event_id, CASE WHEN json_valid(props) THEN sha256(replace(props, ' ', '')) END AS digest FROM events")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.canonical_digest(F.col("props")).alias("digest"))


@query("jsn4_leaves")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.size(J.string_leaves(F.col("props"))).alias("strings"))


# A document as JSON: keys in one of two orders, spaces or none, strings of letters only, an unreadable one now and then.
_KEYED = {"a": """concat('"note":', CASE WHEN n_chars % 3 = 0 THEN 'null' WHEN n_chars % 3 = 1 THEN '""' ELSE '" "' END)""", "b": """concat('"place":{"source":"', source, '","n":', CAST(n_chars AS STRING), '}')""", "c": """concat('"tags":["', lang, '",true,["', lang, source, '"],', CAST(n_chars % 7 AS STRING), ']')"""}
_SORTED = f"""concat('{{', {_KEYED["a"]}, ',"place":{{"n":', CAST(n_chars AS VARCHAR), ',"source":"', source, '"}},', {_KEYED["c"].replace("STRING", "VARCHAR")}, '}}')"""
_WRITTEN = f"""CASE WHEN doc_id % 13 = 0 THEN concat('{{', {_KEYED["a"]}) WHEN n_chars % 2 = 0 THEN concat('{{ ', {_KEYED["c"]}, ' , ', {_KEYED["a"]}, ',  ', {_KEYED["b"]}, '}}') ELSE concat('{{', {_KEYED["b"]}, ', ', {_KEYED["c"]}, ', ', {_KEYED["a"]}, ' }}') END"""


@query(
    "jsn1_nested",
    f"""SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN sha256({_SORTED}) END AS digest,
    CASE WHEN doc_id % 13 = 0 THEN [] ELSE list_sort(list_filter([CASE n_chars % 3 WHEN 1 THEN '' WHEN 2 THEN ' ' END, source, lang, lang || source], lambda x: x IS NOT NULL)) END AS strings FROM documents""",
)
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests and string leaves of nested JSON whose keys stand in any order; null and none where it does not parse."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WRITTEN).alias("json"))
    return rows.select("doc_id", J.canonical_digest(F.col("json")).alias("digest"), F.array_sort(J.string_leaves(F.col("json"))).alias("strings"))


@query("jsn5_key_check", "SELECT event_type, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0) AS with_unknown, count(*) FILTER (NOT list_contains(json_keys(props), 'k')) AS with_missing FROM events WHERE json_valid(props) GROUP BY event_type")
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("keys", F.json_object_keys("props")).where("keys is not null")
    faults = J.key_faults(F.col("keys"), ["k"])
    return rows.groupBy("event_type").agg(F.count_if(F.size(faults["unknown"]) > 0).alias("with_unknown"), F.count_if(F.size(faults["missing"]) > 0).alias("with_missing"))


@query("flt1_select_traces", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'no_report' WHEN quality IS NULL THEN 'hard_fail' WHEN toxic = 1 THEN 'warn_excluded' WHEN quality < 1 THEN 'low_score' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def select_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select(
        "doc_id",
        F.col("text").alias("report"),
        F.col("quality").isNull().alias("hard_fail"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("warn"),
        F.col("quality").isNotNull().alias("primary_valid"),
        F.col("quality").cast("double").alias("primary"),
        F.lit(False).alias("secondary_valid"),
        F.lit(0.0).alias("secondary"),
    )
    return rows.select("doc_id", A.selection_reason(1.0, ["toxic"]).alias("reason"))


@query(
    "flt3_revision_gain",
    """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE b - a END AS gain FROM m""",
)
def revision_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as the judge's score of the revision, views as that of the original."""
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(of("view").alias("a"), of("click").alias("b"))
    as_map = lambda c: F.map_filter(F.create_map(F.lit("judge"), F.col(c)), lambda _, v: v.isNotNull())
    return rows.select("user_id", A.mean(A.judge_gains(as_map("b"), as_map("a"))).alias("gain"))


@query("flt5_exclude_limit", "WITH p AS (SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE n_chars > 30000) ORDER BY source LIMIT 4) SELECT doc_id, source FROM documents JOIN p USING (source)")
def exclude_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sources of which no document was used before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    used = docs.where("n_chars > 30000").select("source").distinct()
    first = docs.select("source").distinct().join(used, "source", "left_anti").orderBy("source").limit(4)
    return docs.join(F.broadcast(first), "source").select("doc_id", "source")


@query("flt9_request_window", "SELECT conv_id, CASE WHEN sum(length(text)) + 500 > 6000 THEN 'fail' WHEN sum(length(text)) + 500 > 3000 THEN 'warn' ELSE 'pass' END AS state FROM conversations GROUP BY conv_id")
def request_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return sums.select("conv_id", A.request_window(F.col("n"), 500, 3000, 6000).alias("state"))


@query("flt11_outbound", "SELECT source, count(*) FILTER (lang IN ('en', 'fr')) AS may_leave, count(*) AS n FROM documents GROUP BY source")
def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(A.outbound(F.col("lang"), ["en", "fr"])).alias("may_leave"), F.count("*").alias("n"))


@query("src5_provenance_split", "SELECT CASE WHEN source IN ('src0', 'src1') THEN 'synthetic' ELSE 'rejected' END AS part, count(*) AS n FROM documents GROUP BY ALL")
def provenance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source").isin("src0", "src1"), "synthetic").otherwise("other")
    kept, rejected = A.split_by_provenance(table(spark, sf_dir, "documents").select("doc_id", kind.alias("provenance")))
    both = kept.select(F.lit("synthetic").alias("part")).unionByName(rejected.select(F.lit("rejected").alias("part")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query("src6_by_digest", "SELECT count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1) AS duplicates FROM (SELECT row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents)")
def by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rejected = A.by_digest(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["doc_id"])
    both = kept.select(F.lit(True).alias("ok")).unionByName(rejected.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("duplicates"))


@query(
    "jn5_dataset_pairs",
    """WITH t AS (SELECT source AS case_id, doc_id AS path, lang AS sig, quality = 1 AS published, toxic = 1 AS terminal, n_chars AS tokens FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY path) AS rn FROM t WHERE published) WHERE rn = 1),
    p AS (SELECT c.case_id, c.path AS chosen, t.path AS rejected, row_number() OVER (PARTITION BY c.case_id ORDER BY t.terminal DESC, t.path) AS rn FROM c JOIN t ON c.case_id = t.case_id AND c.sig = t.sig AND t.path <> c.path AND t.tokens <= 8000)
    SELECT case_id, chosen, rejected FROM p WHERE rn = 1""",
)
def dataset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    none = F.array().cast("array<string>")
    traces = rows.select(F.col("source").alias("case_id"), F.col("doc_id").alias("path"), F.col("lang").alias("sig"), (F.col("quality") == 1).alias("published"), none.alias("blocking"), (F.col("toxic") == 1).alias("terminal"), F.lit(True).alias("synthetic"), F.col("n_chars").alias("tokens"))
    return A.dataset_pairs(traces, 8000)


@query("prj5_snippets", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS fields FROM part")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("title"), F.col("p_name"), F.lit("category"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(J.without_empty(values)).alias("fields"))


@query("prj6_calls", "SELECT event_id, coalesce(value, user_id / 2.0) AS tokens FROM events")
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    call = F.struct(none.cast("string").alias("content"), none.cast("string").alias("reasoning"), F.col("value").alias("prompt_tokens"), none.cast("double").alias("output_tokens"), F.struct(F.col("event_type").alias("content"), none.cast("string").alias("reasoning")).alias("response"), F.struct((F.col("user_id") / 2.0).alias("prompt_tokens"), none.cast("double").alias("completion_tokens")).alias("usage"))
    return table(spark, sf_dir, "events").select("event_id", J.normalised_call(call)["prompt_tokens"].alias("tokens"))


@query("prj7_messages", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message lists, reasoning taken out."""
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit("…").alias("reasoning"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return rows.select("conv_id", F.size(J.without_reasoning(F.col("messages"))).cast("long").alias("messages"))


@query("prj8_export", "SELECT d.doc_id, d.lang, l.quality, b.item_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return docs.join(items, F.col("item_id") == F.col("doc_id"), "left")


@query(
    "str10_number_provenance",
    r"""WITH n AS (SELECT conv_id, role, list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS n FROM conversations), u AS (SELECT conv_id, list_distinct(flatten(list(n))) AS known FROM n WHERE role = 'user' GROUP BY conv_id),
    a AS (SELECT conv_id, list_distinct(flatten(list(n))) AS said FROM n WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id, len(list_filter(said, lambda x: NOT list_contains(coalesce(known, []), x))) AS unsupported FROM a LEFT JOIN u USING (conv_id)""",
)
def number_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that an answer gives and no question of the conversation has."""
    numbers = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))).alias("n"))
    said = numbers.where("role = 'assistant'").select("conv_id", "n").distinct()
    known = numbers.where("role = 'user'").select("conv_id", "n").distinct()
    new = said.join(known, ["conv_id", "n"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("u"))
    every = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id").distinct()
    return every.join(new, "conv_id", "left").select("conv_id", F.coalesce("u", F.lit(0)).alias("unsupported"))


@query(
    "str11_verbatim",
    r"""WITH c AS (SELECT conv_id, unnest(string_split_regex(text, '[。；.;\n]')) AS clause FROM conversations WHERE role = 'user'), u AS (SELECT conv_id, trim(clause) AS clause FROM c WHERE length(trim(clause)) >= 3),
    a AS (SELECT conv_id, text FROM conversations WHERE role = 'assistant') SELECT a.conv_id, count(*) AS copied FROM a JOIN u ON a.conv_id = u.conv_id AND contains(a.text, u.clause) GROUP BY a.conv_id""",
)
def verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    clauses = turns.where("role = 'user'").select("conv_id", F.explode(F.split("text", r"[。；.;\n]")).alias("c")).select("conv_id", F.trim("c").alias("clause")).where("length(clause) >= 3")
    answers = turns.where("role = 'assistant'").select("conv_id", "text")
    return answers.join(clauses, "conv_id").where(F.contains("text", "clause")).groupBy("conv_id").agg(F.count("*").alias("copied"))


@query(
    "str17_unnegated",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), 'the') AS g FROM documents),
    m AS (SELECT doc_id, text, g, unnest(range(1, len(g))) AS i FROM d), e AS (SELECT doc_id, text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + 3 * (i - 1) AS BIGINT) AS pos FROM m),
    c AS (SELECT doc_id, count(*) FILTER (NOT regexp_matches(substring(text, greatest(pos - 24, 1), least(pos, 25)), 'on|ing')) AS n FROM e GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (doc_id)""",
)
def unnegated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a syllable that none of two others stands before, within 25 characters."""
    found = J.unnegated(F.coalesce("text", F.lit("")), "the", "on|ing")
    return table(spark, sf_dir, "documents").select("doc_id", found.cast("long").alias("n"))


@query("str18_budget_split", "SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN strpos(text, '. ') - 1 END AS start, length(CASE WHEN strpos(text, '. ') > 0 THEN substring(text, strpos(text, '. ') + 2) ELSE '' END) AS after_chars FROM documents")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = J.budget_split(F.col("text"), ". ")
    return table(spark, sf_dir, "documents").select("doc_id", cut["start"].cast("long").alias("start"), F.length(cut["after"]).cast("long").alias("after_chars"))


@query("str9_gate_codes", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '<tool_call>') THEN 'tool_markup' END, CASE WHEN regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+') THEN 'email' END, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]{4,}')) > 8 THEN 'english' END, CASE WHEN text NOT LIKE '%' || chr(10) || '%' THEN 'one_line' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents")
def gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    codes = gates.codes(("tool_markup", t.rlike("<tool_call>")), ("email", t.rlike(gates.EMAIL)), ("english", F.regexp_count(t, F.lit("[A-Za-z]{4,}")) > 8), ("one_line", ~F.contains(t, F.lit("\n"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("win20_last_matching", "SELECT conv_id, max_by(length(text), turn) AS chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.sources.readers import candidate_call

    call = F.struct("turn", F.when(F.col("role") == "assistant", "generator").otherwise("other").alias("role"), F.length("text").cast("long").alias("chars"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    return rows.select("conv_id", candidate_call(F.col("calls"))["chars"].alias("chars")).where("chars is not null")


@query("win21_target_rank", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (lang = 'en') DESC, contains(text, 'the') DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("lang") == "en").alias("a"), F.contains("text", F.lit("the")).alias("b"))
    return best_per_group(rows, ["source"], [F.desc("a"), F.desc("b"), "doc_id"], 5).select("source", "doc_id", F.col("place").alias("rank"))


@query("smp7_first_cases", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source ORDER BY source LIMIT 7")
def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id")).orderBy("source").limit(7)


@query("met11_core_focus", r"WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[。；;\n]'), lambda x: trim(x) <> '') AS p FROM documents) SELECT doc_id, len(p) AS sentences, len(list_filter(p, lambda x: regexp_matches(x, 'th|de'))) AS core FROM s")
def core_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.operators.metrics import core_focus as focus

    rows = focus(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("report")), "th|de")
    return rows.select(F.col("case_id").alias("doc_id"), F.col("sentences").cast("long").alias("sentences"), F.col("core").cast("long").alias("core"))


@query("agg23_strata", "SELECT lang, source, count(*) AS n, count(*) FILTER (trim(text) <> '') AS present FROM documents GROUP BY lang, source")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(T.present(F.col("text"))).alias("present"))


@query("agg5_mean_empty", "SELECT o_orderpriority, avg(CASE WHEN o_totalprice > 1e12 THEN o_totalprice END) AS mean_none, avg(o_totalprice) AS mean, max(o_totalprice) AS highest FROM orders GROUP BY o_orderpriority")
def mean_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(price > 1e12, price)).alias("mean_none"), F.avg(price).alias("mean"), F.max(price).alias("highest"))


@query("agg25_paired_table", "SELECT source, lang, median(n_chars) AS median_chars, avg(n_chars) / max(avg(n_chars)) OVER (PARTITION BY source) AS share FROM documents GROUP BY source, lang")
def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.median("n_chars").alias("median_chars"), F.avg("n_chars").alias("m"))
    return rows.select("source", "lang", "median_chars", (F.col("m") / F.max("m").over(Window.partitionBy("source"))).alias("share"))
