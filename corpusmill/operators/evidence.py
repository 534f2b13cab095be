"""The report gates as relations: what a report says and what its case and snippets hold are long tables.

References to articles, cited ids, quantities and clock times are rows, and so are the numbers and ids
that the case and its visible snippets hold. A reference is supported if a join finds its (law, number)
in one snippet. Every check gives bits to traces, and the bits of a trace are OR-ed at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.joins import sorted_join
from corpusmill.functions.numerals import folded_numbers, numeral_value
from corpusmill.operators import gates as G
from corpusmill.sources.scratch import stored_in_small_batches

HARD = (
    "no_report",
    "truncated_output",
    "tool_call_unknown_tool",
    "tool_call_arguments_not_json",
    "tool_markup_in_report",
    "citation_not_visible",
    "article_not_in_visible_text",
    "sentencing_or_crime_language",
    "fabricated_quantity",
    "privacy_leak",
)
SOFT = (
    "tool_call_other",
    "no_retrieval_round",
    "no_citations",
    "liability_assertion_unhedged",
    "responsibility_ratio_claim",
    "unsupported_number",
    "plate_in_report",
    "guidance_verbatim",
    "meta_language",
    "english_leakage",
    "missing_sections",
    "unbalanced_bold",
    "reasoning_loop",
)
CODES = (*HARD, *SOFT)
BIT = {code: 1 << i for i, code in enumerate(CODES)}
HARD_MASK = sum(BIT[c] for c in HARD)


def _mask(*pairs: tuple[str, Column]) -> Column:
    """The bits of the codes whose condition holds."""
    out = F.lit(0).cast("long")
    for code, condition in pairs:
        out = out.bitwiseOR(F.when(condition, F.lit(BIT[code])).otherwise(0).cast("long"))
    return out


@dataclass
class Evidence:
    """Long tables by trace: snippets (key, sid, text), numbers (key, sid, number) of articles, ids (key, id), quantities (key, number) that the case or a snippet holds."""

    snippets: DataFrame
    numbers: DataFrame
    ids: DataFrame
    quantities: DataFrame


def evidence(rows: DataFrame) -> Evidence:
    """rows(key, snippets, corpus)."""
    every = rows.select("key", F.posexplode("snippets").alias("sid", "s"))
    texts = every.select("key", "sid", G.snippet_text(F.col("s")).alias("text"))
    found = texts.select("key", "sid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(G.ARTICLE), F.lit(1)), numeral_value))).alias("number")).where("number is not null")
    ids = rows.select("key", F.explode(G.visible_ids(F.col("snippets"))).alias("id"))
    quantities = rows.select("key", F.explode(G.known_numbers(F.col("corpus"))).alias("number")).distinct()
    return Evidence(texts, found, ids, quantities)


def references(rows: DataFrame) -> DataFrame:
    """rows(key, report) -> key, law (core of its name, empty if none is named), number (null if it is no numeral), shown; as often as they stand."""
    pairs = F.arrays_zip(F.regexp_extract_all("report", F.lit(G.LAW_ARTICLE), F.lit(1)).alias("law"), F.regexp_extract_all("report", F.lit(G.LAW_ARTICLE), F.lit(2)).alias("article"))
    named = rows.select("key", F.explode(pairs).alias("p")).select("key", F.trim(F.regexp_replace("p.law", "^中华人民共和国", "")).alias("law"), F.col("p.article").alias("article"), F.concat(F.lit("《"), "p.law", F.lit("》第"), "p.article", F.lit("条")).alias("shown"))
    rest = F.regexp_extract_all(F.regexp_replace("report", G.LAW_ARTICLE, " "), F.lit(G.ARTICLE), F.lit(1))
    bare = rows.select("key", F.explode(rest).alias("article")).select("key", F.lit("").alias("law"), "article", F.concat(F.lit("第"), "article", F.lit("条")).alias("shown"))
    return named.unionByName(bare).select("key", "law", numeral_value(F.col("article")).alias("number"), "shown")


def unsupported_references(asked: DataFrame, held: Evidence) -> DataFrame:
    """The references that no snippet supports: one that names the law (any, for a bare one) and has the number."""
    laws = asked.select("key", "law").distinct()
    naming = sorted_join(laws, held.snippets, "key").where(F.contains("text", "law")).select("key", "law", "sid")
    supported = sorted_join(naming, held.numbers, ["key", "sid"]).select("key", "law", "number").distinct()
    return sorted_join(asked, supported, ["key", "law", "number"], "left_anti")


def invisible_ids(rows: DataFrame, held: Evidence) -> DataFrame:
    """key, id of cited ids that no snippet has, neither whole nor behind the last #."""
    cited = rows.select("key", F.explode(G.cited_ids(F.col("report"))).alias("cited")).distinct()
    for tried in (F.col("cited"), F.substring_index("cited", "#", -1)):
        cited = sorted_join(cited.withColumn("id", tried), held.ids, ["key", "id"], "left_anti").select("key", "cited")
    return cited.withColumnRenamed("cited", "id")


def unsupported_quantities(rows: DataFrame, held: Evidence) -> DataFrame:
    """key, shown, hard: quantities and clock hours of the report that neither case nor snippets have; speeds and clock times are hard."""
    units = F.arrays_zip(*[F.regexp_extract_all("report", F.lit(G.UNIT_NUMBER), F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "unit"))])
    found = rows.select("key", F.explode(units).alias("q")).select("key", "q.n", "q.unit").distinct()
    short = F.when(F.contains("n", F.lit(".")), F.regexp_replace("n", r"\.?0+$", "")).otherwise(F.col("n"))
    for tried in (F.col("n"), short):
        found = sorted_join(found.withColumn("number", tried), held.quantities, ["key", "number"], "left_anti").select("key", "n", "unit")
    measured = found.select("key", F.concat("n", "unit").alias("shown"), F.col("unit").isin(*G.SPEED_UNITS).alias("hard"))
    times = F.arrays_zip(*[F.regexp_extract_all("report", F.lit(G.CLOCK), F.lit(i)).alias(n) for i, n in ((1, "h"), (2, "m"))])
    hours = rows.select("key", F.explode(times).alias("c")).select("key", "c.h", "c.m").distinct().withColumn("bare", F.ltrim("h", F.lit("0")))
    known = held.quantities.select("key", F.ltrim("number", F.lit("0")).alias("bare")).distinct()
    clocks = sorted_join(hours, known, ["key", "bare"], "left_anti").select("key", F.concat("h", F.lit("时"), "m").alias("shown"), F.lit(True).alias("hard"))
    return measured.unionByName(clocks)


def gate_masks(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """key, mask (see BIT), unsupported (distinct references and standards without support): one row per trace whose case is there.

    traces and cases as evaluate_gates() takes them. Keys are those of one trace each. Without a report
    the only code is no_report; issues of tool calls that have no code of their own are tool_call_other.
    What traces have thought is measured before they meet their cases, so it moves nowhere; the met rows,
    which every check reads, are stored.
    """
    report = F.coalesce("final_markdown", F.lit(""))
    thought = F.when((F.col("status") == "ok") & (report != ""), F.col("reasoning"))
    looped = F.coalesce(F.array_max(G.loop_ratios(thought)), F.lit(0.0))
    length = F.coalesce(F.array_max(F.transform(thought, lambda x: F.length(x))), F.lit(0))
    narrow = traces.withColumns({"_loop": looped, "_longest": length}).drop("reasoning")
    joined = sorted_join(narrow, cases, "case_id").withColumn("snippets", F.coalesce("visible_snippets", F.expr("slice(visible_snippets, 1, 0)")))
    corpus = F.concat_ws(" ", F.map_values("accident_data"), "guidance", F.transform("snippets", G.snippet_text))
    wanted = ("key", "status", "report", "snippets", "corpus", "guidance", "tool_call_issues", "any_truncated", "retrieval_rounds", "_loop", "_longest")
    rows = stored_in_small_batches(joined.withColumns({"report": report, "corpus": corpus}).select(*wanted), "traces")
    given = rows.where((F.col("status") == "ok") & (F.col("report") != ""))
    held = evidence(given)

    issues = F.coalesce("tool_call_issues", F.array().cast("array<string>"))
    titles = F.array_join(T.sections(F.col("report")).getField("title"), " ")
    missing = F.lit(False)
    for title in G.SECTIONS:
        missing = missing | ~F.contains("titles", F.lit(title))
    r = F.col("report")
    english = F.filter(F.regexp_extract_all(F.regexp_replace(r, G.CITATION, ""), F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.lower(w) != "markdown")
    own = _mask(
        ("truncated_output", F.coalesce("any_truncated", F.lit(False))),
        ("tool_call_unknown_tool", F.array_contains(issues, "unknown_tool")),
        ("tool_call_arguments_not_json", F.array_contains(issues, "arguments_not_json")),
        ("tool_call_other", F.size(F.array_except(issues, F.lit(list(G.HARD_ISSUES)))) > 0),
        ("tool_markup_in_report", r.rlike(G.TOOL_MARKUP)),
        ("sentencing_or_crime_language", r.rlike(G.CRIME)),
        ("privacy_leak", r.rlike(G.ID_NUMBER) | r.rlike(G.PHONE) | r.rlike(G.EMAIL)),
        ("no_retrieval_round", F.coalesce("retrieval_rounds", F.lit(0)) == 0),
        ("no_citations", F.size(G.cited_ids(r)) == 0),
        ("liability_assertion_unhedged", F.exists(T.sentences(r), lambda s: s.rlike(G.LIABILITY) & ~s.rlike(G.HEDGE))),
        ("responsibility_ratio_claim", r.rlike(G.RATIO)),
        ("plate_in_report", r.rlike(G.PLATE)),
        ("guidance_verbatim", G.verbatim_clauses(r, F.col("guidance")) > 0),
        ("meta_language", r.rlike(G.META)),
        ("english_leakage", F.size(english) > 8),
        ("missing_sections", missing),
        ("unbalanced_bold", T.unbalanced_bold(r)),
        ("reasoning_loop", (F.col("_loop") > 0.3) & (F.col("_longest") >= 2000)),
    )
    zero = F.lit(0).cast("long")
    standards = F.size(F.array_distinct(G.unsupported_standards(r, F.col("corpus")))).cast("long")
    bad = unsupported_references(references(given), held).select("key", "shown").distinct()
    loose = unsupported_quantities(given, held)
    bits = [
        rows.select("key", F.when((F.col("status") == "ok") & (r != ""), zero).otherwise(F.lit(BIT["no_report"])).alias("mask"), zero.alias("n")),
        given.withColumn("titles", titles).select("key", own.alias("mask"), zero.alias("n")),
        given.select("key", standards.alias("n")).where("n > 0").select("key", F.lit(BIT["article_not_in_visible_text"]).cast("long").alias("mask"), "n"),
        bad.select("key", F.lit(BIT["article_not_in_visible_text"]).cast("long").alias("mask"), F.lit(1).cast("long").alias("n")),
        invisible_ids(given, held).select("key", F.lit(BIT["citation_not_visible"]).cast("long").alias("mask"), zero.alias("n")),
        loose.select("key", F.when(F.col("hard"), BIT["fabricated_quantity"]).otherwise(BIT["unsupported_number"]).cast("long").alias("mask"), zero.alias("n")),
    ]
    every = bits[0]
    for more in bits[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("unsupported"))


def codes_of(mask: Column) -> Column:
    """Names of a mask's codes, hard ones first."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) > 0, F.lit(c)) for c, b in BIT.items()]))
