"""A report candidate's seven checks in three values, over long tables.

fields(case_id, field, value, kind), claims(case_id, claim_id, start, end, refs array),
obligations(case_id, obligation_id, treatment, resolution), conflicts(case_id, conflict_id, fields array),
reports(case_id, report), hidden(case_id, value) of values that must not be told, latent(case_id, field,
value) of true values behind blank fields, evidence(case_id, id, text) of records that claims refer to.

What cannot be shown from the text stays unknown: a field that no claim refers to is neither covered nor
left out. A field's rules are CASEs over joins by case and field, so a case is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import metrics as M
from corpusmill.sources.scratch import stored

CHECKS = ("coverage", "alignment", "empty_field", "attribution", "obligations", "conflicts", "privacy")
# A number plate, and the characters that a value's hint is read without.
FULL_PLATE = "(?<![A-Za-z0-9])[京沪津渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-Z0-9]{5}(?![A-Za-z0-9])"
# The same plates, sought from the letter behind the place: a class of plain letters is told apart faster than one of Han characters.
PLATE_TAIL = r"[A-Z][A-Z0-9]{5}(?![A-Za-z0-9])"
PLATE_SEARCH = PLATE_TAIL + "(?<=" + FULL_PLATE.replace("(?![A-Za-z0-9])", "") + ")"
HINT_OMITS = r"[\s，。,.;；:：、（）()]"
KEY = ["case_id", "field"]


def _decoded(pointer: Column) -> Column:
    return F.replace(F.replace(pointer, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def possible_fields(ref: Column) -> Column:
    """Names that a reference may mean, the likeliest first.

    Behind a prefix these are the whole pointer and its first part; else the reference itself, and
    every end of it that stands behind a slash or a colon, longest first.
    """
    name = F.trim(ref)
    bare = F.regexp_replace(name, M.REF_PREFIX, "")
    pointer = F.array(_decoded(bare), _decoded(F.substring_index(bare, "/", 1)))
    ends = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))
    cut = T.bound(F.split(name, "(?<=[/:])"), ends)
    return F.when(name.rlike(M.REF_PREFIX), pointer).when(F.contains(name, F.lit("/")) | F.contains(name, F.lit(":")), cut).otherwise(F.array(name))


def _resolve(rows: DataFrame, ref: Column, fields: DataFrame) -> DataFrame:
    """rows(case_id, .., no) with field: the first possible field of ref that the case has; rows without one go."""
    tried = rows.select("*", F.posexplode(possible_fields(ref)).alias("_at", "field"))
    met = tried.join(fields.select(*KEY), KEY)
    first = met.groupBy(*rows.columns).agg(F.min("_at").alias("_at"))  # a number, which is grouped without a sort
    return first.withColumn("field", F.get(possible_fields(ref), F.col("_at"))).drop("_at")


def told_by_reports(reports: DataFrame, claims: DataFrame, latent: DataFrame | None, hidden: DataFrame, clashes: DataFrame) -> DataFrame:
    """case_id, kind, claim_id, field, value, text, held: all that is asked of reports, so that a report meets it once.

    A claim has its text. Of a latent or hidden value it is held whether the report has it; of a field in conflict,
    which has a row if the report names it, whether a conflict is told of near its first mention.
    """
    asked = [claims.select("case_id", "claim_id", "start", "end", F.lit("claim").alias("kind")), clashes.select(*KEY, F.lit("near").alias("kind")).distinct()]
    asked.append(hidden.where(T.present(F.col("value"))).select("case_id", "value", F.lit("hidden").alias("kind")))
    if latent is not None:
        asked.append(latent.where(T.present(F.col("value"))).select(*KEY, "value", F.lit("latent").alias("kind")))
    near = F.substr(F.col("report"), F.greatest(F.col("_at") - 80, F.lit(1)), F.length("field") + 160 + F.least(F.col("_at") - 1, F.lit(80)))
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), asked).join(reports, "case_id")
    met = met.withColumn("_at", F.when(F.col("kind") == "near", F.instr("report", F.col("field")))).where("_at IS NULL OR _at > 0")
    met = met.withColumn("text", F.when(F.col("kind") == "claim", M.claim_text(F.col("report"), F.col("start"), F.col("end"))).when(F.col("_at") > 0, near))
    held = F.when(F.col("_at") > 0, M.has_any(F.col("text"), M.CONFLICT)).otherwise(F.contains("report", "value"))
    return met.select("case_id", "kind", "claim_id", "field", "value", F.when(F.col("kind") == "claim", F.col("text")).alias("text"), held.alias("held"))


def referring_claims(claims: DataFrame, fields: DataFrame, reports: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """case_id, field, value, kind, claim_id, text, no: a row for each reference (the no-th of its claim) that means a known field."""
    refs = claims.select("case_id", "claim_id", F.posexplode("refs").alias("no", "ref"))
    found = _resolve(refs, F.col("ref"), fields).select("case_id", "claim_id", "no", "field")
    if told is None:
        texts = claims.join(reports, "case_id").select("case_id", "claim_id", M.claim_text(F.col("report"), F.col("start"), F.col("end")).alias("text"))
    else:
        texts = told.where("kind = 'claim'").select("case_id", "claim_id", "text")
    return found.join(texts, ["case_id", "claim_id"]).join(fields.select(*KEY, "value", "kind"), KEY)


def labelled_value(text: Column, field: Column) -> Column:
    """What the first `field:` is followed by, up to the sentence's end; null without such a label."""
    pattern = F.concat(F.lit(r"\Q"), F.replace(field, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*[：:]\s*([^。！？!?；;\n]+)"))
    said = F.regexp_extract_all(text, pattern, F.lit(1))
    return F.btrim(F.trim(F.get(said, F.lit(0))), F.lit(" ，,"))


def claim_alignment(used: DataFrame, claims: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """case_id, field, status of each used reference: whether the claim's own words, or a record it refers to, hold the field's value."""
    text, field, value = F.col("text"), F.col("field"), F.col("value")
    rows = used.withColumn("_said", labelled_value(text, field))
    own = (
        F.when(~T.present(text), "fail")
        .when(F.col("_said").isNotNull(), F.when(F.contains("_said", value), "pass").otherwise("fail"))
        .when(F.contains(M.local_sentence(text, field, value), value), "pass")
        .when(F.contains(text, field), F.when(text.rlike("[：:]"), "fail").otherwise("unknown"))
    )
    rows = rows.select("case_id", "claim_id", "no", "field", "value", own.alias("status"))
    if evidence is not None:
        records = claims.select("case_id", "claim_id", F.explode("refs").alias("id")).join(evidence, ["case_id", "id"]).select("case_id", "claim_id", F.col("text").alias("_record"))
        met = rows.join(records, ["case_id", "claim_id"], "left")
        backed = F.when(F.col("status").isNull() & F.contains("_record", value), "pass")
        rows = met.groupBy(*rows.columns).agg(F.max(backed.isNotNull()).alias("_backed")).withColumn("status", F.coalesce("status", F.when(F.col("_backed"), "pass")))
    return rows.select(*KEY, F.coalesce("status", F.lit("unknown")).alias("status"))


def _rows(df: DataFrame, check: str, item: Column | str = "field") -> DataFrame:
    return df.select("case_id", F.lit(check).alias("check"), (F.col(item) if isinstance(item, str) else item).alias("item"), "status")


def coverage_and_alignment(fields: DataFrame, used: DataFrame, claims: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Facts with a value: coverage has one row per field, alignment one per reference; without a reference both are unknown."""
    facts = fields.where((F.col("kind") == "fact") & T.present(F.col("value"))).select(*KEY)
    stated = claim_alignment(used.where((F.col("kind") == "fact") & T.present(F.col("value"))), claims, evidence)
    rows = facts.join(stated.select(*KEY, "status"), KEY, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    covered = rows.groupBy(*KEY).agg(M.worst_status(F.col("status")).alias("status"))
    return _rows(covered, "coverage").unionByName(_rows(rows, "alignment"))


def empty_fields(fields: DataFrame, used: DataFrame, told: DataFrame) -> DataFrame:
    """Blank fields: pass if all claims about one say that it is missing, fail if one does not or the report tells the true value."""
    marked = used.groupBy(*KEY).agg(F.every(M.has_any(F.col("text"), M.MISSING)).alias("marked"))
    rows = fields.where(~T.present(F.col("value"))).select(*KEY).join(marked, KEY, "left")
    true = told.where("kind = 'latent' AND held").select(*KEY).distinct().withColumn("told", F.lit(True))
    rows = rows.join(true, KEY, "left")
    status = F.when(F.col("told"), "fail").when(F.col("marked").isNull(), "unknown").when(F.col("marked"), "pass").otherwise("fail")
    return _rows(rows.withColumn("status", status), "empty_field")


def named_field(obligation_id: Column) -> Column:
    """The field name in an obligation's id."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(obligation_id, F.lit("")), M.OBLIGATION_PREFIX, ""), "^accident:/", "")
    return F.ltrim(_decoded(bare), F.lit("/"))


def obligation_states(fields: DataFrame, used: DataFrame, duties: DataFrame, clashing: DataFrame) -> DataFrame:
    """A row per field by the ordered rules, and one row for the obligations of a case that name no field."""
    one = duties.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("treatment").alias("treatment"), F.first("resolution").alias("resolution"))
    uses = used.select(*KEY).distinct().withColumn("used", F.lit(True))
    rows = fields.join(one, KEY, "left").join(uses, KEY, "left").join(clashing.withColumn("clash", F.lit(True)), KEY, "left")
    clash, there, uses_it = F.coalesce("clash", F.lit(False)), T.present(F.col("value")), F.coalesce("used", F.lit(False))
    present, missing = ~clash & there, ~clash & ~there
    treat, said = F.coalesce("treatment", F.lit("")), F.coalesce("resolution", F.lit(""))
    spoken, open_ends = T.present(said), M.has_any(said, M.MISSING + M.CONFLICT)
    hint = F.substring(F.regexp_replace("value", HINT_OMITS, ""), 1, 6)
    shown = (hint != "") & F.contains(said, hint)
    status = (
        F.when(F.col("n").isNull(), "unknown")
        .when(F.col("n") > 1, "fail")
        .when(present & treat.isin("not_relevant", "uncertain") & M.has_any(said, M.MISSING) & ~shown, "fail")
        .when(missing & (treat == "not_relevant") & F.col("field").isin(*M.KEY_OUTCOMES), "fail")
        .when(present & uses_it & spoken & ((treat == "covered") | ((treat == "uncertain") & (F.col("kind") != "fact"))), "pass")
        .when(missing & spoken & ((treat == "not_relevant") | ((treat == "uncertain") & open_ends)), "pass")
        .when(clash & (treat == "uncertain") & open_ends, "pass")
        .when(present & ~uses_it, "unknown")
        .otherwise("fail")
    )
    strays = duties.join(fields.select(*KEY), KEY, "left_anti").select("case_id").distinct().select("*", F.lit("?").alias("field"), F.lit("fail").alias("status"))
    return _rows(rows.withColumn("status", status), "obligations").unionByName(_rows(strays, "obligations"))


def conflict_states(clashes: DataFrame, conflicts: DataFrame, used: DataFrame, duties: DataFrame, told: DataFrame) -> DataFrame:
    """A row per conflict: pass if a claim or an obligation about one of its fields, or the report near that field's first mention, tells of a conflict; unknown if it names no known field."""
    claimed = used.where(M.has_any(F.col("text"), M.CONFLICT)).select(*KEY)
    solved = duties.where(M.has_any(F.col("resolution"), M.CONFLICT)).select(*KEY)
    open_ = claimed.unionByName(solved).unionByName(told.where("kind = 'near' AND held").select(*KEY)).distinct().withColumn("open", F.lit(True))
    known = clashes.join(open_, KEY, "left").groupBy("case_id", "conflict_id").agg(F.max(F.coalesce("open", F.lit(False))).alias("open"))
    rows = conflicts.select("case_id", "conflict_id").join(known, ["case_id", "conflict_id"], "left")
    status = F.when(F.col("open").isNull(), "unknown").when(F.col("open"), "pass").otherwise("fail")
    return _rows(rows.withColumn("status", status), "conflicts", F.col("conflict_id").cast("string"))


def privacy_states(reports: DataFrame, told: DataFrame) -> DataFrame:
    """A row per hidden value that is not blank, and a failing one for a report with a number plate."""
    leaks = told.where("kind = 'hidden'").select("case_id", "value", F.when(F.col("held"), "fail").otherwise("pass").alias("status"))
    plates = reports.where(F.col("report").rlike(PLATE_SEARCH)).select("case_id", F.lit("plate").alias("field"), F.lit("fail").alias("status"))
    return _rows(leaks, "privacy", F.sha2("value", 256)).unionByName(_rows(plates, "privacy"))


def field_checks(fields: DataFrame, claims: DataFrame, obligations: DataFrame, conflicts: DataFrame, reports: DataFrame, hidden: DataFrame, latent: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """All seven checks, item by item: case_id, check, item, status.

    Null values and reports count as empty. Fields, reports, and the ids of claims, conflicts and records are
    unique within a case. Tables may be empty; a check without items gives no rows.
    """
    fields = fields.withColumn("value", F.coalesce("value", F.lit("")))
    reports = reports.select("case_id", F.coalesce("report", F.lit("")).alias("report"))
    duties = obligations.withColumn("field", named_field(F.col("obligation_id")))
    named = conflicts.select("case_id", "conflict_id", F.posexplode("fields").alias("no", "name"))
    clashes = stored(_resolve(named, F.col("name"), fields).select("case_id", "conflict_id", "field").distinct(), "clashes")
    told = stored(told_by_reports(reports, claims, latent, hidden, clashes), "told")
    used = stored(referring_claims(claims, fields, reports, told), "used")
    valued = used.where((F.col("kind") == "evaluation") & T.present(F.col("value")))  # the others' sentences are not asked for
    parts = [
        coverage_and_alignment(fields, used, claims, evidence),
        empty_fields(fields, used, told),
        M.attribution_check(fields, valued).withColumnRenamed("field", "item"),
        obligation_states(fields, used, duties, clashes.select(*KEY).distinct()),
        conflict_states(clashes, conflicts, used, duties, told),
        privacy_states(reports, told),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_summary(cases: DataFrame, items: DataFrame) -> DataFrame:
    """case_id, check, status, applicable, passed, failed, unknown: all seven checks of every case; unknown without items."""
    count = lambda s: F.count_if(F.col("status") == s)
    counted = items.groupBy("case_id", "check").agg(F.count("*").alias("applicable"), count("pass").alias("passed"), count("fail").alias("failed"), count("unknown").alias("unknown"), M.worst_status(F.col("status")).alias("status"))
    every = cases.select("case_id", F.explode(F.lit(list(CHECKS))).alias("check")).join(counted, ["case_id", "check"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("applicable", "passed", "failed", "unknown")]
    return every.select("case_id", "check", F.coalesce("status", F.lit("unknown")).alias("status"), *zero)


def overall(summary: DataFrame) -> DataFrame:
    """case_id, overall, strict_pass, open_checks: the worst status of the checks that apply; unknown is no pass."""
    applies = F.when(F.col("applicable") > 0, F.col("status"))
    rows = summary.groupBy("case_id").agg(F.coalesce(M.worst_status(applies), F.lit("unknown")).alias("overall"), F.count_if((F.col("applicable") > 0) & (F.col("status") != "pass")).alias("open_checks"))
    return rows.withColumn("strict_pass", F.col("overall") == "pass")
