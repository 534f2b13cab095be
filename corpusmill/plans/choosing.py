"""Selection, sampling, pairs and dataset builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import datasets as D
from corpusmill.operators import selection as S
from corpusmill.operators.summary import blended_vocabulary
from corpusmill.plans.catalogue import query, table
from corpusmill.sources.scratch import stored

FRACTION = "CAST('0x' || substring(sha256({}), 1, 8) AS BIGINT)"


@query("best_of_k", "SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE n_chars <= 20000) WHERE place <= 3")
def best_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of each source that fit a limit."""
    fitting = table(spark, sf_dir, "documents").where("n_chars <= 20000").select("source", "doc_id", "n_chars")
    return S.best_per_group(fitting, ["source"], [F.desc("n_chars"), "doc_id"], 3)


CANDIDATES = """c AS (SELECT source AS case_id, lang AS sig, doc_id AS name, quality + n_chars / 100000.0 AS score, n_chars AS reasoning_chars,
    CASE WHEN toxic = 1 THEN ['loop'] WHEN quality = 0 THEN ['hard_gate'] ELSE [] END AS reasons FROM documents JOIN labels USING (doc_id)),
ch AS (SELECT case_id, sig, name AS chosen, score AS cs, reasoning_chars AS cc FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, reasoning_chars, name) AS rn FROM c WHERE len(reasons) = 0) WHERE rn = 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reasons = F.when(F.col("toxic") == 1, F.array(F.lit("loop"))).when(F.col("quality") == 0, F.array(F.lit("hard_gate"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("source").alias("case_id"), F.col("lang").alias("sig"), F.col("doc_id").alias("name"), reasons.alias("reasons"), (F.col("quality") + F.col("n_chars") / 100000.0).alias("score"), F.col("n_chars").alias("reasoning_chars"))


@query(
    "pref_pairs",
    f"""WITH {CANDIDATES}, p AS (SELECT c.case_id, chosen, name AS rejected, CASE WHEN list_contains(reasons, 'loop') THEN 0 WHEN len(reasons) > 0 THEN 1 WHEN score <= cs - 0.01 THEN 2 END AS kind, abs(reasoning_chars - cc) AS dist, score FROM c JOIN ch USING (case_id, sig) WHERE name <> chosen),
    o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY kind, CASE WHEN kind = 0 THEN dist WHEN kind = 2 THEN score ELSE 0 END, rejected) AS rn FROM p WHERE kind IS NOT NULL)
    SELECT case_id, chosen, rejected, ['terminal', 'gate', 'quality'][kind + 1] AS kind FROM o WHERE rn = 1""",
)
def pref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.preference_pairs(_candidates(spark, sf_dir), margin=0.01)


@query(
    "stratified_audit",
    """WITH k AS (SELECT doc_id, lang, sha256('7:' || doc_id) AS h FROM documents), s AS (SELECT lang, greatest(ceil(count(*) * 0.02), 1) AS quota FROM k GROUP BY lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS rn FROM k JOIN s USING (lang)), f AS (SELECT doc_id, lang FROM r WHERE rn <= quota),
    m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h) AS rm FROM r WHERE rn > quota)
    SELECT doc_id, lang FROM f UNION ALL SELECT doc_id, lang FROM m WHERE rm <= 40 - (SELECT count(*) FROM f)""",
)
def stratified_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.stratified_sample(docs, "lang", S.hash_order(F.lit("7"), F.col("doc_id")), 0.02, 40)


@query("holdout_split", f"SELECT source IN (SELECT DISTINCT source FROM documents ORDER BY source DESC LIMIT 3) AS held_out, {FRACTION.format('source')} % 5 AS fold, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.hold_out(table(spark, sf_dir, "documents").select("source", "n_chars"), "source", 3).withColumn("fold", S.fold(F.col("source"), 5))
    return rows.groupBy("held_out", "fold").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("jn19_split_leak", f"WITH d AS (SELECT DISTINCT {FRACTION.format('source')} % 3 AS split, sha256(text) AS h FROM documents) SELECT a.split AS left, b.split AS right, count(*) AS shared FROM d a JOIN d b ON a.h = b.h AND a.split < b.split GROUP BY ALL")
def split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_leak(table(spark, sf_dir, "documents").withColumn("split", S.fold(F.col("source"), 3)), "split", F.sha2("text", 256))


@query("hash_sample", f"SELECT conv_id, turn FROM (SELECT *, min(turn) OVER w AS lo, max(turn) OVER w AS hi FROM conversations WINDOW w AS (PARTITION BY conv_id)) WHERE {FRACTION.format(chr(39) + '7:' + chr(39) + ' || conv_id || ' + chr(39) + ':' + chr(39) + ' || turn')} / 4294967295.0 < 0.3 OR turn IN (lo, hi)")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by hash; the first and last of a conversation always."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    kept = (S.hash_fraction(F.lit("7"), F.col("conv_id"), F.col("turn")) < 0.3) | (F.col("turn") == F.col("lo")) | (F.col("turn") == F.col("hi"))
    return turns.join(ends, "conv_id").where(kept).select("conv_id", "turn")


@query("round_robin_quota", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS place FROM documents) SELECT doc_id, lang, place FROM r WHERE place <= 10 ORDER BY place, lang LIMIT 30")
def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", ["n_chars", "doc_id"], 10, 30).select("doc_id", "lang", "place")


@query("win18_select_unique")
def select_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: copies of a text are one call, sources are batches."""
    kinds = F.array(*[F.lit(k) for k in ("revised", "anchor_revised", "seeded", "anchor")])
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("batch"), F.sha2("text", 256).alias("call"), F.col("doc_id").cast("string").alias("pair_id"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"), F.col("n_chars").alias("tokens"))
    return S.select_unique(rows, "7", {"revised": 5, "anchor_revised": 3, "seeded": 3, "anchor": 2}, 5000, 2)


SHARED = {"pairs": 9, "anchors": 6, "seeded": 3, "originals": 2, "min_long": 5, "long_tokens": 5000}
_KIND = "CASE WHEN n_chars % 4 = 0 THEN 'revised' WHEN n_chars % 4 = 1 THEN 'anchor_revised' WHEN n_chars % 4 = 2 THEN 'seeded' ELSE 'anchor' END"


def _shared_caps() -> str:
    """The eight passes one after another; each takes the first rows of unused calls, as many as its caps leave."""
    kinds = {"revised": ("pairs", None, ("revised", "seeded")), "anchor_revised": ("anchors", None, ("anchor_revised", "anchor")), "seeded": ("pairs", "seeded", ("revised", "seeded")), "anchor": ("anchors", "originals", ("anchor_revised", "anchor"))}
    parts, before = [f"c AS (SELECT doc_id, sha256(text) AS call, CAST(doc_id AS VARCHAR) AS pair_id, {_KIND} AS kind, n_chars AS tokens, sha256(sha256(text) || '7' || CAST(doc_id AS VARCHAR)) AS o FROM documents)", "t0 AS (SELECT call, pair_id, kind, tokens, 0 AS step, o FROM c WHERE false)"], "t0"
    for step, (long, kind) in enumerate(((long, kind) for long in (True, False) for kind in kinds), 1):
        cap, own, family = kinds[kind]
        listed = ", ".join(f"'{k}'" for k in family)
        left = [f"{SHARED[cap]} - (SELECT count(*) FROM {before} WHERE kind IN ({listed}))"]
        left += [f"{SHARED[own]} - (SELECT count(*) FROM {before} WHERE kind = '{kind}')"] if own else []
        left += [f"{SHARED['min_long']} - (SELECT count(*) FROM {before} WHERE tokens > {SHARED['long_tokens']})"] if long else []
        only = f" AND tokens > {SHARED['long_tokens']}" if long else ""
        pool = f"SELECT *, row_number() OVER (PARTITION BY call ORDER BY o) AS rn FROM c WHERE kind = '{kind}'{only} AND call NOT IN (SELECT call FROM {before})"
        parts.append(f"t{step} AS (SELECT * FROM {before} UNION ALL SELECT call, pair_id, kind, tokens, {step}, o FROM (SELECT *, row_number() OVER (ORDER BY o) AS place FROM ({pool}) WHERE rn = 1) WHERE place <= least({', '.join(left)}))")
        before = f"t{step}"
    return f"WITH {', '.join(parts)}, s AS (SELECT pair_id, CAST(row_number() OVER (ORDER BY step, o) - 1 AS INTEGER) AS place FROM {before}) SELECT c.pair_id, c.kind, s.place FROM c LEFT JOIN s USING (pair_id)"


@query("win18_shared_caps", _shared_caps())
def shared_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate, copies of a text being one call: its place among the chosen, null where it is dropped."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.sha2("text", 256).alias("call"), F.col("doc_id").cast("string").alias("pair_id"), F.expr(_KIND).alias("kind"), F.col("n_chars").alias("tokens"))
    return S.select_shared(rows, "7", **SHARED).select("pair_id", "kind", "place")


@query("win5_gain_cap", "SELECT source, doc_id, n_chars AS gain FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1 ORDER BY gain DESC, source LIMIT 10")
def gain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.best_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("gain")), ["source"], [F.desc("gain"), "doc_id"])
    return best.orderBy(F.desc("gain"), "source").limit(10).select("source", "doc_id", "gain")


@query("win19_strided_parts", "SELECT part, count(*) AS n, min(item_id) AS first FROM (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 4 AS part FROM benchmark) GROUP BY part")
def strided_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.sources.readers import numbered

    return numbered(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 4).groupBy("part").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))


@query("smp3_sides", f"SELECT item_id, {FRACTION.format(chr(39) + 'ab:' + chr(39) + ' || item_id')} / 4294967295.0 < 0.5 AS first_is_a FROM benchmark")
def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.blind_sides(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "ab")


@query("smp4_one_per_case", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id)) AS rn FROM documents) WHERE rn = 1")
def one_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    return S.best_per_group(rows, ["source"], [S.hash_order(F.lit("7"), F.col("doc_id"))]).drop("place")


@query("smp5_scenarios", f"SELECT o_orderkey, ['rear_end', 'side', 'head_on', 'pedestrian'][{FRACTION.format(chr(39) + 'type:' + chr(39) + ' || o_orderkey')} % 4 + 1] AS type FROM orders")
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("rear_end", "side", "head_on", "pedestrian")])
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("type:"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (draw % 4 + 1).cast("int")).alias("type"))


@query("resume_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is not done yet."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("jn6_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_semi")


@query("jn14_first_run_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_run_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return S.first_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("jn20_missing_lookup", "SELECT source, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def missing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(marks, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("flt4_subset", "SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda t: t NOT IN ('view', 'click'))) = 0 AS repairable FROM events GROUP BY user_id")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.collect_set("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.size(F.array_except(codes, F.array(F.lit("view"), F.lit("click")))) == 0).alias("repairable"))


@query("flt8_window_state", "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars > 8000 THEN 'fail' WHEN n_chars > 3000 THEN 'warn' ELSE 'pass' END AS state FROM documents")
def window_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.window_state(F.col("n_chars"), 3000, 8000).alias("state"))


@query("flt12_text_validator", r"SELECT item_id, CASE WHEN length(text) < 40 THEN 'too_short' WHEN length(text) > 400 THEN 'too_long' WHEN regexp_matches(text, '[#*`|]') THEN 'markdown' WHEN regexp_matches(text, '[0-9]') THEN 'numbers' END AS reason FROM benchmark")
def text_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    reason = S.cascade(("too_short", F.length(t) < 40), ("too_long", F.length(t) > 400), ("markdown", t.rlike(r"[#*`|]")), ("numbers", t.rlike("[0-9]")))
    return table(spark, sf_dir, "benchmark").select("item_id", reason.alias("reason"))


@query("set5_ordered_dedupe", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("set3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("set6_symmetric", "SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("l"))
    right = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("r"))
    both = left.join(right, "doc_id", "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l") & F.col("r")).alias("both"))


@query("set1_union", "SELECT kind, count(*) AS n FROM (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations) GROUP BY kind")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), "text") for t, k in (("documents", "document"), ("conversations", "turn"))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("n"))


VOCABULARY = r"""t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS token FROM documents) GROUP BY token),
p AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS token FROM conversations) GROUP BY token)"""


def _vocabulary(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(T.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "vocab_topk",
    f"""WITH {VOCABULARY} SELECT token, coalesce(t.n / (SELECT sum(n) FROM t), 0) + 0.1 * coalesce(p.n / (SELECT sum(n) FROM p), 0) AS score, token IN ('the', 'zzz') AS forced
    FROM t FULL JOIN p USING (token) ORDER BY forced DESC, score DESC, token LIMIT 200""",
)
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended_vocabulary(_vocabulary(spark, sf_dir, "documents"), _vocabulary(spark, sf_dir, "conversations"), 0.1, 200, ["the", "zzz"])


@query(
    "agg18_fold_coverage",
    rf"""WITH w AS (SELECT {FRACTION.format('source')} % 5 AS fold, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')) AS token FROM documents), c AS (SELECT fold, token, count(*) AS n FROM w GROUP BY ALL),
    o AS (SELECT a.fold, b.token, sum(b.n) AS n FROM (SELECT DISTINCT fold FROM c) a JOIN c b ON a.fold <> b.fold GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, token) AS rn FROM o)
    SELECT c.fold, CAST(sum(c.n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k.token IS NOT NULL THEN c.n ELSE 0 END) AS BIGINT) AS covered FROM c LEFT JOIN k ON c.fold = k.fold AND c.token = k.token AND k.rn <= 500 GROUP BY c.fold""",
)
def fold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a fold's text the 500 most frequent words of the other folds cover."""
    words = table(spark, sf_dir, "documents").select(S.fold(F.col("source"), 5).alias("fold"), F.explode(T.words(F.col("text"))).alias("token"))
    counts = stored(words.groupBy("fold", "token").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("token").agg(F.sum("n").alias("t"))
    folds = counts.select("fold").distinct()  # five rows
    grid = totals.join(F.broadcast(folds), how="cross").join(counts, ["fold", "token"], "left").select("fold", "token", (F.col("t") - F.coalesce("n", F.lit(0))).alias("other")).where("other > 0")
    top = S.best_per_group(grid, ["fold"], [F.desc("other"), "token"], 500).select("fold", "token", F.lit(True).alias("in_top"))
    rows = counts.join(top, ["fold", "token"], "left")
    return rows.groupBy("fold").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("in_top"), F.col("n")).otherwise(0)).alias("covered"))


@query("arr1_label_mask", "SELECT conv_id, turn, CAST(list_sum(list_transform(range(0, least(turn, 5)), lambda i: -100)) AS BIGINT) AS masked, turn + 3 AS length FROM conversations WHERE turn > 0")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask over `turn` prompt places (five at most in the sum) and three target ids."""
    rows = table(spark, sf_dir, "conversations").where("turn > 0")
    mask = S.label_mask(F.sequence(F.lit(1), F.col("turn").cast("int")), F.array(F.lit(1), F.lit(2), F.lit(3)))
    masked = F.aggregate(F.slice(mask, F.lit(1), F.least("turn", F.lit(5)).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("conv_id", "turn", masked.alias("masked"), F.size(mask).cast("long").alias("length"))


@query("agg22_manifest", "SELECT lang AS kind, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS tokens, max(n_chars) AS longest, avg(n_chars) AS mean FROM documents GROUP BY ROLLUP (lang)")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.manifest(table(spark, sf_dir, "documents"), "lang", F.col("n_chars"))


@query("snk6_final_set", "SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def final_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.excluded(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return kept.agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("jsn1_digests", "SELECT doc_id, sha256(doc_id || '|' || source || '|' || lang) AS digest, substring(sha256(text), 1, 12) AS short FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "lang"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("digest"), F.substring(F.sha2("text", 256), 1, 12).alias("short"))


@query("jsn3_object_test", "SELECT event_type, count(*) FILTER (json_valid(props) AND json_type(props) = 'OBJECT') AS objects, count(*) AS n FROM events GROUP BY event_type")
def object_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_object = F.json_object_keys("props").isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(is_object).alias("objects"), F.count("*").alias("n"))
