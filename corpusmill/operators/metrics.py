"""Field-level quality checks in three values (pass, fail, unknown), over long tables.

fields(case_id, field, value, kind, sensitive), claims(case_id, claim_id, start, end, refs array),
obligations(case_id, obligation_id, treatment, resolution), reports(case_id, report),
conflicts(case_id, field). Every check gives rows (case_id, check, field, status).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.joins import sorted_join
from corpusmill.operators.gates import PLATE
from corpusmill.operators.summary import worst_status
from corpusmill.sources.scratch import stored

# The marker words and prefixes of the checks.
MISSING = ("信息不足", "未提供", "未记载", "缺少", "待核实", "无法确认", "未知", "空缺", "输入为空", "为空", "空白", "无记载", "没有记载", "未见记载", "未填写", "未给出", "缺失")
ATTRIBUTION = ("事故信息记载", "材料显示", "初查记录", "调查记录", "认定材料", "记录显示", "已提供材料", "输入记载", "鉴定记录", "报告记载", "据记载", "待核实")
CONFLICT = ("冲突", "矛盾", "不一致", "两种记载", "存在差异", "需核对", "待核对")
KEY_OUTCOMES = ("事故认定原因", "事故初查原因", "主要违法行为", "事故责任")
REF_PREFIX = r"^(?:accident:/|evidence:/|snapshot:/|/)"
OBLIGATION_PREFIX = r"^(?:fact_obligation:|fact-obligation:|obligation:|fact:)"


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers]), F.lit(False))


def claim_text(report: Column, start: Column, end: Column) -> Column:
    """The claim's part of the report; empty where the span is not inside it."""
    inside = (start >= 0) & (start < end) & (end <= F.length(report))
    return F.when(F.coalesce(inside, F.lit(False)), F.substr(report, start + 1, end - start)).otherwise("")


def ref_field(ref: Column) -> Column:
    """The field name that a reference points to: the first part of its pointer, or what stands behind the last / or :."""
    bare = F.regexp_replace(F.trim(ref), REF_PREFIX, "")
    token = F.element_at(T.pointer_tokens(F.concat(F.lit("/"), bare)), 1)
    return F.when(F.trim(ref).rlike(REF_PREFIX), token).otherwise(F.regexp_extract(F.trim(ref), r"([^/:]+)$", 1))


def used_fields(claims: DataFrame, fields: DataFrame, reports: DataFrame) -> DataFrame:
    """case_id, field, value, kind, claim_id, text: one row for each known field that a claim refers to."""
    rows = sorted_join(claims, reports, "case_id").select("case_id", "claim_id", claim_text(F.col("report"), F.col("start"), F.col("end")).alias("text"), F.explode("refs").alias("ref"))
    refs = rows.select("case_id", "claim_id", "text", ref_field(F.col("ref")).alias("field")).distinct()
    return sorted_join(refs, fields.select("case_id", "field", "value", "kind"), ["case_id", "field"])


def local_sentence(text: Column, field: Column, value: Column) -> Column:
    """The one sentence that names the field (and holds the value), or else the one that holds the value; null if there is not just one."""

    def chosen(v: Column) -> Column:
        named, valued = v["named"], v["valued"]
        by_name = F.when((F.size(named) == 1) & ((F.length(value) == 0) | F.contains(F.get(named, F.lit(0)), value)), F.get(named, F.lit(0)))
        return F.when(F.size(named) > 0, by_name).when(F.size(valued) == 1, F.get(valued, F.lit(0)))

    def found(parts: Column) -> Column:
        named = F.filter(parts, lambda p: F.contains(p, field))
        valued = F.filter(parts, lambda p: (F.length(value) > 0) & F.contains(p, value))
        return T.bound(F.struct(named.alias("named"), valued.alias("valued")), chosen)

    return T.bound(T.sentences_kept(text), found)


def explicit_value(text: Column, field: Column) -> Column:
    """What stands behind `field:` up to the sentence's end; null without that label."""
    tail = F.substr(text, F.instr(text, field) + F.length(field))
    at = F.when(F.instr(text, field) > 0, F.regexp_extract(tail, r"^\s*[：:]\s*([^。！？!?；;\n]+)", 1))
    return F.when(F.length(at) > 0, F.btrim(at, F.lit(" ，,")))


def alignment(used: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """case_id, field, claim_id, status of each claim against the value it refers to; evidence(case_id, field, text) is optional."""
    rows = used
    if evidence is not None:
        rows = sorted_join(rows, evidence.select("case_id", "field", F.col("text").alias("evidence")), ["case_id", "field"], "left")
    else:
        rows = rows.withColumn("evidence", F.lit(None).cast("string"))
    said = explicit_value(F.col("text"), F.col("field"))
    local = local_sentence(F.col("text"), F.col("field"), F.col("value"))
    value_there = (F.length("value") > 0) & F.contains(F.col("evidence"), F.col("value"))
    status = (
        F.when(~T.present(F.col("text")), "fail")
        .when(said.isNotNull(), F.when(F.contains(said, F.col("value")), "pass").otherwise("fail"))
        .when(local.isNotNull() & (F.length("value") > 0) & F.contains(local, F.col("value")), "pass")
        .when(F.contains(F.col("text"), F.col("field")), F.when(F.col("text").rlike("[：:]"), "fail").otherwise("unknown"))
        .when(value_there, "pass")
        .otherwise("unknown")
    )
    return rows.select("case_id", "field", "claim_id", status.alias("status"))


def empty_field_check(fields: DataFrame, used: DataFrame) -> DataFrame:
    """Blank fields: unknown if no claim refers to them, fail if one does without a missing-marker, else pass."""
    marked = used.withColumn("marked", has_any(F.col("text"), MISSING)).groupBy("case_id", "field").agg(F.min("marked").alias("all_marked"))
    blank = sorted_join(fields.where(~T.present(F.col("value"))), marked, ["case_id", "field"], "left")
    status = F.when(F.col("all_marked").isNull(), "unknown").when(~F.col("all_marked"), "fail").otherwise("pass")
    return blank.select("case_id", F.lit("empty_field").alias("check"), "field", status.alias("status"))


def attribution_check(fields: DataFrame, used: DataFrame) -> DataFrame:
    """Evaluation fields with a value: each claim needs an attribution marker in the sentence that holds the field."""
    local = local_sentence(F.col("text"), F.col("field"), F.col("value"))
    one = F.when(~T.present(F.col("text")), "fail").when(local.isNull(), "unknown").when(has_any(local, ATTRIBUTION), "pass").otherwise("fail")
    rolled = used.withColumn("one", one).groupBy("case_id", "field").agg(worst_status(F.col("one")).alias("status"))
    stated = fields.where((F.col("kind") == "evaluation") & T.present(F.col("value")))
    return sorted_join(stated, rolled, ["case_id", "field"], "left").select("case_id", F.lit("attribution").alias("check"), "field", F.coalesce("status", F.lit("unknown")).alias("status"))


def obligation_check(fields: DataFrame, used: DataFrame, obligations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row per field by the ten ordered rules, and a fail row for each obligation that names no field."""
    mapped = obligations.withColumn("field", F.regexp_replace(F.trim("obligation_id"), OBLIGATION_PREFIX, ""))
    per_field = mapped.groupBy("case_id", "field").agg(F.count("*").alias("n"), F.first("treatment").alias("treatment"), F.first(F.coalesce("resolution", F.lit(""))).alias("resolution"))
    uses = used.select("case_id", "field").distinct().withColumn("used", F.lit(True))
    clash = conflicts.select("case_id", "field").distinct().withColumn("clash", F.lit(True))
    rows = fields
    for told in (per_field, uses, clash):
        rows = sorted_join(rows, told, ["case_id", "field"], "left")
    state = F.when(F.col("clash"), "conflict").when(T.present(F.col("value")), "present").otherwise("missing")
    is_, treat, text = (lambda s: state == s), F.col("treatment"), F.col("resolution")
    used_here, spoken = F.coalesce("used", F.lit(False)), T.present(F.col("resolution"))
    head = F.substr(F.regexp_replace("value", r"[\p{P}\s]", ""), F.lit(1), F.lit(6))
    status = (
        F.when(F.col("n").isNull(), "unknown")
        .when(F.col("n") > 1, "fail")
        .when(is_("present") & treat.isin("not_relevant", "uncertain") & has_any(text, MISSING) & ~F.contains(text, head), "fail")
        .when(is_("missing") & (treat == "not_relevant") & F.col("field").isin(*KEY_OUTCOMES), "fail")
        .when(is_("present") & used_here & (treat == "covered") & spoken, "pass")
        .when(is_("present") & used_here & (treat == "uncertain") & spoken & (F.col("kind") != "fact"), "pass")
        .when(is_("missing") & spoken & ((treat == "not_relevant") | ((treat == "uncertain") & has_any(text, MISSING + CONFLICT))), "pass")
        .when(is_("conflict") & (treat == "uncertain") & has_any(text, CONFLICT), "pass")
        .when(is_("present") & ~used_here, "unknown")
        .otherwise("fail")
    )
    known = rows.select("case_id", F.lit("obligations").alias("check"), "field", status.alias("status"))
    strays = sorted_join(mapped, fields.select("case_id", "field"), ["case_id", "field"], "left_anti")
    return known.unionByName(strays.select("case_id", F.lit("obligations").alias("check"), "field", F.lit("fail").alias("status")))


def conflict_check(conflicts: DataFrame, fields: DataFrame, used: DataFrame, obligations: DataFrame, reports: DataFrame) -> DataFrame:
    """Conflicts need a marker in a claim, a resolution, or near the field's first mention in the report."""
    known = sorted_join(sorted_join(conflicts, fields.select("case_id", "field").withColumn("known", F.lit(True)), ["case_id", "field"], "left"), reports, "case_id")
    in_claims = used.where(has_any(F.col("text"), CONFLICT)).select("case_id", "field").distinct().withColumn("in_claim", F.lit(True))
    solved = obligations.withColumn("field", F.regexp_replace(F.trim("obligation_id"), OBLIGATION_PREFIX, "")).where(has_any(F.col("resolution"), CONFLICT))
    rows = known
    for told in (in_claims, solved.select("case_id", "field").distinct().withColumn("solved", F.lit(True))):
        rows = sorted_join(rows, told, ["case_id", "field"], "left")
    at = F.instr("report", F.col("field"))
    near = F.when(at > 0, F.substr(F.col("report"), F.greatest(at - 80, F.lit(1)), F.length("field") + 160 + F.least(at - 1, F.lit(80))))
    held = F.coalesce("in_claim", "solved", has_any(near, CONFLICT))
    status = F.when(F.col("known").isNull(), "unknown").when(held, "pass").otherwise("fail")
    return rows.select("case_id", F.lit("conflicts").alias("check"), "field", status.alias("status"))


def privacy_check(reports: DataFrame, hidden: DataFrame) -> DataFrame:
    """hidden(case_id, value): a hidden value or a number plate in the report fails; without hidden values it is unknown."""
    leaks = sorted_join(hidden, reports, "case_id").groupBy("case_id").agg(F.max((T.present(F.col("value")) & F.contains(F.col("report"), F.col("value"))).cast("int")).alias("leak"))
    rows = sorted_join(reports, leaks, "case_id", "left")
    status = F.when((F.col("leak") == 1) | F.col("report").rlike(PLATE), "fail").when(F.col("leak").isNull(), "unknown").otherwise("pass")
    return rows.select("case_id", F.lit("privacy").alias("check"), F.lit("").alias("field"), status.alias("status"))


def coverage_check(fields: DataFrame, used: DataFrame) -> DataFrame:
    """Fields with a value: pass if a claim refers to them, else fail."""
    uses = used.select("case_id", "field").distinct().withColumn("used", F.lit(True))
    rows = sorted_join(fields.where(T.present(F.col("value"))), uses, ["case_id", "field"], "left")
    return rows.select("case_id", F.lit("coverage").alias("check"), "field", F.when(F.col("used"), "pass").otherwise("fail").alias("status"))


def evaluate_candidates(fields: DataFrame, claims: DataFrame, obligations: DataFrame, conflicts: DataFrame, reports: DataFrame, hidden: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """All seven checks: case_id, check, field, status. The claims' fields, which six of them read, are stored."""
    used = stored(used_fields(claims, fields, reports), "used")
    aligned = alignment(used.where(T.present(F.col("value"))), evidence).groupBy("case_id", "field").agg(worst_status(F.col("status")).alias("status")).select("case_id", F.lit("alignment").alias("check"), "field", "status")
    checks = [
        coverage_check(fields, used),
        aligned,
        empty_field_check(fields, used),
        attribution_check(fields, used),
        obligation_check(fields, used, obligations, conflicts),
        conflict_check(conflicts, fields, used, obligations, reports),
        privacy_check(reports, hidden),
    ]
    return reduce(DataFrame.unionByName, checks)


def roll_up(checks: DataFrame) -> DataFrame:
    """case_id, status, strict_pass, applicable, failed."""
    rolled = checks.groupBy("case_id").agg(worst_status(F.col("status")).alias("status"), F.count("*").alias("applicable"), F.count_if(F.col("status") == "fail").alias("failed"))
    return rolled.withColumn("strict_pass", F.col("status") == "pass")


def fail_signals(checks: DataFrame) -> DataFrame:
    """case_id, signals: sorted metric:<check>:<field> of what fails."""
    failed = checks.where("status = 'fail'").select("case_id", F.concat_ws(":", F.lit("metric"), "check", "field").alias("signal"))
    return failed.groupBy("case_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def core_focus(reports: DataFrame, pattern: str) -> DataFrame:
    """case_id, sentences, core, share: sentences that match the pattern."""
    rows = reports.select("case_id", T.sentences(F.col("report")).alias("s"))
    core = F.size(F.filter("s", lambda x: x.rlike(pattern)))
    return rows.select("case_id", F.size("s").alias("sentences"), core.alias("core"), F.when(F.size("s") > 0, core / F.size("s")).alias("share"))
