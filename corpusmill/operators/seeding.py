"""Seeded single errors in structured candidates, taken only if the checks see that error and no other.

Every error is one edit: a splice of the report, and what goes with it in claims and obligations. All
edits of all cases, and the cases as they are, are checked in one plan; see metrics for the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.joins import sorted_join
from corpusmill.operators import metrics as M
from corpusmill.sources.scratch import stored

# The made-up value, and what the obligations then say.
MADE_UP = "合成占位值"
NOT_COVERED = "该字段未在候选正文中覆盖，当前不适用。"
BLANK = "输入为空，无法确认。"
# Checks that may fail for each error.
TARGETS = {
    "omit_key_fact": ("coverage", "obligations"),
    "empty_field_fabrication": ("empty_field",),
    "evaluation_as_fact": ("attribution",),
    "obligation_mismatch": ("obligations",),
    "swallow_conflict": ("conflicts", "obligations"),
}
RATIO = (0.85, 1.15)


def _edit(rows: DataFrame, kind: str, field: Column | str | None = None, at: Column | None = None, until: Column | None = None, insert: Column | None = None, drop: Column | None = None, ref: Column | None = None, treatment: str | None = None, resolution: str | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    zero = F.lit(0)
    return rows.select(
        "case_id",
        F.lit(kind).alias("kind"),
        text(F.col(field) if isinstance(field, str) else field).alias("field"),
        (zero if at is None else at).cast("int").alias("at"),
        (zero if until is None else until).cast("int").alias("until"),
        (F.lit("") if insert is None else insert).alias("insert"),
        text(drop).alias("drop"),
        text(ref).alias("ref"),
        F.lit(treatment).cast("string").alias("treatment"),
        F.lit(resolution).cast("string").alias("resolution"),
    )


def _least(rows: DataFrame, *order: str) -> DataFrame:
    """One row per case: the first in the order."""
    columns = [c for c in rows.columns if c != "case_id"]
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy("case_id").agg(first.alias("r")).select("case_id", "r.*")


def edits(fields: DataFrame, claims: DataFrame, obligations: DataFrame, conflicts: DataFrame, reports: DataFrame) -> DataFrame:
    """case_id, kind and the edit: an unchanged row per case, and one for each error that the case has a place for."""
    used = sorted_join(M.used_fields(claims, fields, reports), claims.select("case_id", "claim_id", "start", "end", F.size("refs").alias("n")), ["case_id", "claim_id"])
    stated = used.where(T.present(F.col("value")) & (F.col("n") == 1))
    facts = _least(stated.where("kind = 'fact'"), "claim_id", "field")
    said = _least(stated.where("kind = 'evaluation'"), "claim_id", "field")
    bare = F.regexp_replace("text", "|".join(M.ATTRIBUTION), "")
    blank = sorted_join(fields.where((F.col("kind") == "fact") & ~T.present(F.col("value"))), used.select("case_id", "field"), ["case_id", "field"], "left_anti")
    blank = sorted_join(_least(blank.select("case_id", "field"), "field"), reports, "case_id")
    clash = _least(sorted_join(used, conflicts.select("case_id", "field"), ["case_id", "field"], "left_semi").where(M.has_any(F.col("text"), M.CONFLICT)), "claim_id", "field")
    calm = F.regexp_replace("text", "|".join(M.CONFLICT), "")
    parts = [
        _edit(reports, "orig"),
        _edit(facts, "omit_key_fact", "field", F.col("start"), F.col("end"), drop=F.col("claim_id"), treatment="not_relevant", resolution=NOT_COVERED),
        _edit(blank, "empty_field_fabrication", "field", F.length("report"), F.length("report"), F.concat(F.lit("\n"), "field", F.lit(f"：{MADE_UP}。")), ref=F.concat(F.lit("accident:/"), "field"), treatment="uncertain", resolution=BLANK),
        _edit(said.where(bare != F.col("text")), "evaluation_as_fact", "field", F.col("start"), F.col("end"), bare),
        _edit(facts, "obligation_mismatch", "field", treatment="not_relevant", resolution=BLANK),
        _edit(clash, "swallow_conflict", "field", F.col("start"), F.col("end"), calm, treatment="covered", resolution="x"),
    ]
    return reduce(DataFrame.unionByName, parts)


def variants(made: DataFrame, fields: DataFrame, claims: DataFrame, obligations: DataFrame, conflicts: DataFrame, reports: DataFrame, hidden: DataFrame) -> dict[str, DataFrame]:
    """The tables of all edited cases, whose case_id is <case_id>::<kind>. Claims behind a splice move, the claim that it is in is resized."""
    key = F.concat_ws("::", "case_id", "kind").alias("case_id")
    delta = F.length("insert") - (F.col("until") - F.col("at"))
    keys = made.select("case_id", F.col("kind").alias("e_kind"))
    copy = lambda df: sorted_join(df, keys, "case_id").withColumn("case_id", F.concat_ws("::", "case_id", "e_kind")).drop("e_kind")
    moved = lambda c: F.when(F.col(c) >= F.col("until"), F.col(c) + delta).otherwise(F.col(c))
    start = F.when((F.col("start") >= F.col("until")) & (F.col("until") > F.col("at")) | (F.col("start") > F.col("until")), F.col("start") + delta).otherwise(F.col("start"))
    kept = sorted_join(claims, made, "case_id").where(~F.coalesce(F.col("claim_id") == F.col("drop"), F.lit(False)))
    kept = kept.select(key, "claim_id", start.alias("start"), F.when(F.col("until") > F.col("at"), moved("end")).otherwise(F.col("end")).alias("end"), "refs")
    added = made.where("ref is not null").select(key, F.lit("seed").alias("claim_id"), (F.col("at") + 1).alias("start"), (F.col("at") + F.length("insert")).alias("end"), F.array("ref").alias("refs"))
    about = F.regexp_replace(F.trim("obligation_id"), M.OBLIGATION_PREFIX, "")
    hit = F.coalesce((about == F.col("field")) & F.col("e_treatment").isNotNull(), F.lit(False))
    duties = sorted_join(obligations, made.select("case_id", "kind", "field", F.col("treatment").alias("e_treatment"), F.col("resolution").alias("e_resolution")), "case_id")
    duties = duties.select(key, "obligation_id", F.when(hit, F.col("e_treatment")).otherwise(F.col("treatment")).alias("treatment"), F.when(hit, F.col("e_resolution")).otherwise(F.col("resolution")).alias("resolution"))
    text = F.concat(F.substr("report", F.lit(1), F.col("at")), "insert", F.substr(F.col("report"), F.col("until") + 1))
    return {
        "fields": copy(fields),
        "claims": kept.unionByName(added),
        "obligations": duties,
        "conflicts": copy(conflicts),
        "reports": sorted_join(reports, made, "case_id").select(key, text.alias("report")),
        "hidden": copy(hidden),
    }


def seed_errors(fields: DataFrame, claims: DataFrame, obligations: DataFrame, conflicts: DataFrame, reports: DataFrame, hidden: DataFrame) -> DataFrame:
    """case_id, kind, field, report, signals, ratio of the errors that are taken.

    A case whose checks fail as it is has none. Of an edited case only checks of the error's kind, on the
    edit's field, may fail, and one must; its report is from 0.85 to 1.15 times as long as before. The
    edits and the edited tables, which every check reads, are stored, so no plan holds all of them.
    """
    made = stored(edits(fields, claims, obligations, conflicts, reports), "edits")
    edited = {name: stored(df, name) for name, df in variants(made, fields, claims, obligations, conflicts, reports, hidden).items()}
    failed = M.evaluate_candidates(**edited).where("status = 'fail'").select(F.col("case_id").alias("key"), F.struct("check", "field").alias("failure"))
    failed = stored(failed.groupBy("key").agg(F.array_sort(F.collect_set("failure")).alias("failures")), "failures")
    rows = made.select("case_id", "kind", "field", F.concat_ws("::", "case_id", "kind").alias("key"))
    rows = sorted_join(rows, failed, "key", "left")
    sound = rows.where((F.col("kind") == "orig") & F.col("failures").isNull()).select("case_id")
    allowed = F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.forall("failures", lambda f: F.array_contains(F.try_element_at(allowed, F.col("kind")), f["check"]) & (f["field"] == F.col("field")))
    taken = sorted_join(rows.where(F.col("kind") != "orig").where(F.coalesce(own & (F.size("failures") > 0), F.lit(False))), sound, "case_id", "left_semi")
    texts = edited["reports"].select(F.col("case_id").alias("key"), "report")
    both = sorted_join(sorted_join(taken, texts, "key"), reports.select("case_id", F.length("report").alias("before")), "case_id")
    signals = F.transform("failures", lambda f: F.concat_ws(":", F.lit("metric"), f["check"], f["field"]))
    return both.select("case_id", "kind", "field", "report", signals.alias("signals"), (F.length("report") / F.col("before")).alias("ratio")).where(F.col("ratio").between(*RATIO))
