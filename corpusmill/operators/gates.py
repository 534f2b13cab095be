"""Deterministic gates over reports: hard and warning codes, and the measures beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.numerals import folded_numbers, numeral_value

# The patterns and word lists of the gates.
CITATION = r"\[依据[:：]\s*([^\]]+)\]"
LAW_ARTICLE = r"《([^》]{2,40})》\s*第([零〇一二三四五六七八九十百千两0-9]+)条"
ARTICLE = r"第([零〇一二三四五六七八九十百千两0-9]{1,6})条"
STANDARD = r"GB/?T?\s?\d{3,5}(?:\.\d+)?\s?[-—–]\s?\d{4}"
TOOL_MARKUP = r'retrieve_knowledge|"action"\s*:\s*"retrieve"|<tool_call>|<function_call>'
CRIME = r"判处|有期徒刑|拘役|管制|构成.{0,8}罪"
LIABILITY = r"(?:负|承担|应负|应承担)(?:全部|主要|次要|同等|无)责任"
HEDGE = r"可能|倾向|研判|待核实|不排除|拟|方向|如果|若|或|记载|材料显示|认定书|事故信息|信息不足|不得|不能|不予"
RATIO = r"\d+\s*[:：]\s*\d+\s*(?:的)?(?:责任|比例)|\d+\s*%\s*(?:的)?(?:责任|过错)|责任比例(?:为|约|按|划分为|认定为)|(?:按|以)\s*\d+\s*[比:：]\s*\d+"
ID_NUMBER = r"(?<!\d)\d{17}[\dXx](?!\d)"
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PLATE = r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][·\s]?[A-Z0-9]{5,6}"
META = r"根据系统提示|我(?:已)?(?:调用|检索|查阅)了|工具返回|以下是(?:最终)?报告|作为.{0,6}(?:模型|助手)"
UNIT_NUMBER = r"(\d+(?:\.\d+)?)\s*(km/h|公里/小时|千米/小时|公里每小时|公里|千米|米|厘米|cm|分钟|秒|小时|岁|人|辆|元|度|%|℃|年驾龄|年)"
CLOCK = r"(?<!\d)(\d{1,2})\s*(?:[:：]|时)\s*(\d{1,2})\s*(?:分)?"
SPEED_UNITS = ("km/h", "公里/小时", "千米/小时", "公里每小时")
SECTIONS = ("事故概要", "事实与证据边界", "事故经过", "致因分析", "责任分析", "依据与待补证据")
HARD_ISSUES = ("unknown_tool", "arguments_not_json")
UNMEASURED_FIELD = "号牌号码"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def codes(*pairs: tuple[str, Column]) -> Column:
    """The codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in pairs]))


def visible_ids(snippets: Column) -> Column:
    """Ids, citations and source#id of all visible snippets."""
    ids = F.flatten(F.transform(snippets, lambda s: F.array(F.coalesce(s["id"], F.lit("")), F.coalesce(s["citation"], F.lit("")), F.concat(F.coalesce(s["source"], F.lit("")), F.lit("#"), F.coalesce(s["id"], F.lit(""))))))
    return F.array_distinct(F.filter(ids, lambda i: i != ""))


def cited_ids(report: Column) -> Column:
    lists = F.transform(_all(report, CITATION, 1), lambda m: F.split(m, r"[;；,，、\s]+"))
    return F.filter(F.flatten(lists), lambda c: c != "")


def invisible_citations(report: Column, snippets: Column) -> Column:
    """Sorted distinct cited ids, ten at most, that no visible snippet has, neither whole nor behind the last #."""
    seen = visible_ids(snippets)
    bad = F.filter(cited_ids(report), lambda c: ~F.array_contains(seen, c) & ~F.array_contains(seen, F.substring_index(c, "#", -1)))
    return F.slice(F.array_sort(F.array_distinct(bad)), 1, 10)


def snippet_text(s: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(s[k], F.lit("")) for k in ("title", "content", "authority", "source", "id")])


def unsupported_articles(report: Column, snippets: Column) -> Column:
    """References to articles that no visible snippet with the law's name holds; bare ones need the number alone."""
    texts = F.transform(snippets, snippet_text)

    def supported(number: Column, core: Column | None) -> Column:
        def holds(s: Column) -> Column:
            numbers = F.transform(_all(s, ARTICLE, 1), numeral_value)
            named = F.lit(True) if core is None else F.contains(s, core)
            return F.array_contains(numbers, numeral_value(number)) & named

        return F.coalesce(F.exists(texts, holds), F.lit(False))

    pairs = F.arrays_zip(_all(report, LAW_ARTICLE, 1).alias("law"), _all(report, LAW_ARTICLE, 2).alias("article"))
    core = lambda p: F.trim(F.regexp_replace(p["law"], "^中华人民共和国", ""))
    named = F.filter(pairs, lambda p: ~supported(p["article"], core(p)))
    bare = F.filter(_all(F.regexp_replace(report, LAW_ARTICLE, " "), ARTICLE, 1), lambda a: ~supported(a, None))
    return F.concat(F.transform(named, lambda p: F.concat(F.lit("《"), p["law"], F.lit("》第"), p["article"], F.lit("条"))), F.transform(bare, lambda a: F.concat(F.lit("第"), a, F.lit("条"))))


def unsupported_standards(report: Column, corpus: Column) -> Column:
    return F.filter(_all(report, STANDARD), lambda s: ~F.contains(T.compact(corpus), T.compact(s)))


def known_numbers(corpus: Column) -> Column:
    return F.array_union(_all(corpus, r"\d+(?:\.\d+)?"), folded_numbers(corpus))


def unsupported_quantities(report: Column, numbers: Column) -> Column:
    """struct<hard, soft>: quantities without a source; speeds and clock times are hard."""
    found = F.arrays_zip(_all(report, UNIT_NUMBER, 1).alias("n"), _all(report, UNIT_NUMBER, 2).alias("unit"))
    short = lambda n: F.when(F.contains(n, F.lit(".")), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)
    loose = F.filter(found, lambda q: ~F.array_contains(numbers, q["n"]) & ~F.array_contains(numbers, short(q["n"])))
    fast = lambda q: q["unit"].isin(*SPEED_UNITS)
    name = lambda q: F.concat(q["n"], q["unit"])
    hours = F.arrays_zip(_all(report, CLOCK, 1).alias("h"), _all(report, CLOCK, 2).alias("m"))
    bare = F.transform(numbers, lambda n: F.ltrim(n, F.lit("0")))
    clocks = F.filter(hours, lambda c: ~F.array_contains(bare, F.ltrim(c["h"], F.lit("0"))) & ~F.array_contains(numbers, c["h"]))
    hard = F.concat(F.transform(F.filter(loose, fast), name), F.transform(clocks, lambda c: F.concat(c["h"], F.lit("时"), c["m"])))
    return F.struct(F.array_distinct(hard).alias("hard"), F.array_distinct(F.transform(F.filter(loose, lambda q: ~fast(q)), name)).alias("soft"))


def verbatim_clauses(report: Column, guidance: Column) -> Column:
    """How many guidance clauses of 16 characters or more stand in the report word for word."""
    bare = F.transform(guidance, lambda g: F.regexp_replace(g, "^(需要关注|信息不足|待核实)[:：]", ""))
    clauses = F.transform(F.flatten(F.transform(bare, lambda g: F.split(g, "[；。]"))), lambda c: F.trim(c))
    return F.size(F.filter(clauses, lambda c: (F.length(c) >= 16) & F.contains(report, c)))


def field_coverage(accident: Column, report: Column, threshold: float = 0.6) -> Column:
    """struct<ratio, missing>: fields whose pairs of characters, or whole value, the report shows."""
    return T.bound(T.compact(report), lambda body: _field_coverage(accident, body, threshold))


def _field_coverage(accident: Column, body: Column, threshold: float) -> Column:
    fields = F.transform(F.map_entries(accident), lambda e: F.struct(e["key"].alias("field"), T.compact(e["value"]).alias("value"), T.coverage(e["value"], body).alias("hit")))
    measured = F.filter(fields, lambda f: (f["field"] != UNMEASURED_FIELD) & f["hit"].isNotNull())
    missing = F.filter(measured, lambda f: (f["hit"] < threshold) & ~F.contains(body, f["value"]))
    n = F.size(measured)
    return F.struct(F.when(n > 0, (n - F.size(missing)) / n).alias("ratio"), F.transform(missing, lambda f: f["field"]).alias("missing"))


def loop_ratio(text: Column, n: int = 12, floor: int = 400) -> Column:
    """Duplication of character n-grams; 0 for texts of fewer than `floor` characters."""
    return F.coalesce(T.duplicated_grams(T.compact(text), n, floor), F.lit(0.0))


def loop_ratios(texts: Column, n: int = 12, floor: int = 400) -> Column:
    """loop_ratio() of each text of an array."""
    return T.duplicated_grams_each(F.transform(texts, T.compact), n, floor)


def missing_cases(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, traces: how many traces name a case that is not there."""
    return traces.join(cases.select("case_id").distinct(), "case_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("traces"))


def evaluate_gates(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """traces(key, case_id, status, final_markdown, visible_snippets, tool_call_issues, any_truncated, retrieval_rounds,
    reasoning array<string>) joined to cases(case_id, accident_data map, guidance array<string>): one row per trace with
    hard_fail, hard, warn and measures. Without a report the only code is no_report. Traces whose case is
    not in cases are not evaluated; missing_cases() counts them.
    """
    report = F.coalesce("final_markdown", F.lit(""))
    given = F.col("status").eqNullSafe("ok") & (report != "")
    joined = traces.join(cases, "case_id")
    corpus = F.concat_ws(" ", F.map_values("accident_data"), "guidance", F.transform("visible_snippets", snippet_text))
    rows = joined.withColumn("corpus", corpus).withColumn("numbers", known_numbers(F.col("corpus")))
    rows = rows.withColumns(
        {
            "bad_citations": invisible_citations(report, F.col("visible_snippets")),
            "bad_articles": F.concat(unsupported_articles(report, F.col("visible_snippets")), unsupported_standards(report, F.col("corpus"))),
            "quantities": unsupported_quantities(report, F.col("numbers")),
            "asserted": F.filter(T.sentences(report), lambda s: s.rlike(LIABILITY) & ~s.rlike(HEDGE)),
            "loop": F.coalesce(F.array_max(loop_ratios(F.col("reasoning"))), F.lit(0.0)),
            "longest": F.coalesce(F.array_max(F.transform("reasoning", lambda r: F.length(r))), F.lit(0)),
            "titles": F.array_join(T.sections(report).getField("title"), " "),
            "english": F.size(F.filter(_all(F.regexp_replace(report, CITATION, ""), "[A-Za-z]{4,}"), lambda w: F.lower(w) != "markdown")),
        }
    )
    issues = F.coalesce("tool_call_issues", F.array().cast("array<string>"))
    hard = codes(
        ("truncated_output", F.coalesce("any_truncated", F.lit(False))),
        *[(f"tool_call_{i}", F.array_contains(issues, i)) for i in HARD_ISSUES],
        ("tool_markup_in_report", report.rlike(TOOL_MARKUP)),
        ("citation_not_visible", F.size("bad_citations") > 0),
        ("article_not_in_visible_text", F.size("bad_articles") > 0),
        ("sentencing_or_crime_language", report.rlike(CRIME)),
        ("fabricated_quantity", F.size("quantities.hard") > 0),
        ("privacy_leak", report.rlike(ID_NUMBER) | report.rlike(PHONE) | report.rlike(EMAIL)),
    )
    soft_issues = F.transform(F.array_except(issues, F.lit(list(HARD_ISSUES))), lambda i: F.concat(F.lit("tool_call_"), i))
    missing = F.lit(False)
    for title in SECTIONS:
        missing = missing | ~F.contains(F.col("titles"), F.lit(title))
    warn = codes(
        ("no_retrieval_round", F.coalesce("retrieval_rounds", F.lit(0)) == 0),
        ("no_citations", F.size(cited_ids(report)) == 0),
        ("liability_assertion_unhedged", F.size("asserted") > 0),
        ("responsibility_ratio_claim", report.rlike(RATIO)),
        ("unsupported_number", F.size("quantities.soft") > 0),
        ("plate_in_report", report.rlike(PLATE)),
        ("guidance_verbatim", verbatim_clauses(report, F.col("guidance")) > 0),
        ("meta_language", report.rlike(META)),
        ("english_leakage", F.col("english") > 8),
        ("missing_sections", missing),
        ("unbalanced_bold", T.unbalanced_bold(report)),
        ("reasoning_loop", (F.col("loop") > 0.3) & (F.col("longest") >= 2000)),
    )
    none = F.array().cast("array<string>")
    found = field_coverage(F.col("accident_data"), report)
    return rows.select(
        "key",
        "case_id",
        F.when(given, F.size(hard) > 0).otherwise(True).alias("hard_fail"),
        F.when(given, hard).otherwise(F.array(F.lit("no_report"))).alias("hard"),
        F.when(given, F.concat(soft_issues, warn)).otherwise(none).alias("warn"),
        F.when(given, F.length(T.compact(report))).alias("chars"),
        F.when(given, F.size(T.sections(report))).alias("sections"),
        F.when(given, T.duplicated_grams(T.compact(report), 12)).alias("dup_12gram_ratio"),
        F.when(given, F.size(_all(report, CITATION))).alias("citations"),
        F.when(given, F.aggregate(F.transform("reasoning", lambda r: F.length(r)), F.lit(0), lambda a, b: a + b)).alias("reasoning_chars"),
        F.when(given, F.col("loop")).alias("reasoning_loop_12gram"),
        F.when(given, found["ratio"]).alias("fact_coverage"),
        F.when(given, found["missing"]).alias("fact_missing_fields"),
    )
