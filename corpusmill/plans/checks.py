"""The seven checks over cases that are made from documents: what a case says follows from the document's id and length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import checks, metrics
from corpusmill.plans.catalogue import query, table
from corpusmill.sources.scratch import stored


BASE = {"n": "length(coalesce(text, ''))", "sound": "(doc_id * 7 + length(coalesce(text, ''))) % 3 = 0"}
SOUND = "sound"


def _pick(k: int, *options: str, sound: str = "false") -> str:
    """One of the options, another for each k; the first wherever `sound` holds, so that some cases pass all checks."""
    place = f"(doc_id * 31 + {k} * 17 + (doc_id + {k}) * (doc_id + 3) + n * {k + 3}) % {len(options)}"
    return f"element_at(array({', '.join(options)}), CAST(CASE WHEN {sound} THEN 1 ELSE 1 + {place} END AS INT))"


# field, kind, values, what the report says (with v for the value), reference
_SPECS = [
    ("天气", "fact", ["'晴'", "'阴雨'", "''"], ["concat('天气：', v, '。')", "'天气：雪。'", "concat('当日', v, '，无风。')", "'提到天气。'", "'天气为空。'", "''", "concat('天气好！天气', v, '。')", "concat('天气: ', v, '，与笔录不一致；')"]),
    ("安全带/头盔使用情况", "fact", ["'已使用'", "''"], ["concat('安全带/头盔使用情况 ： ', v, '。')", "concat('驾驶人', v, '安全带。')", "'安全带/头盔使用情况未记载。'", "'另行说明。'", "'关于安全带/头盔使用情况：'"]),
    ("年龄", "fact", ["'45'", "'五十'", "''"], ["concat('年龄', v, '岁。')", "'年龄：30。'", "'年龄存在差异，需核对。'", "'不详。'", "concat('其人', v, '岁。')", "'年龄未填写。'"]),
    ("事故责任", "evaluation", ["'甲方全责'", "''"], ["concat('材料显示事故责任为', v, '。')", "concat('我们认为事故责任为', v, '。')", "'事故责任待核实。'", "concat('据记载，', v, '。')", "concat('事故责任', v, '；事故责任', v, '。')", "''"]),
    ("致死原因", "evaluation", ["'颅脑损伤'", "''", "''"], ["concat('鉴定记录称致死原因为', v, '。')", "concat('致死原因：', v, '。')", "'致死原因未知。'", "'未见记载'"]),
]
_N = range(len(_SPECS))
VALUES = {f"v{i}": _pick(i, *s[2], sound=SOUND) for i, s in enumerate(_SPECS)}
PIECES = {f"p{i}": _pick(10 + i, *[o.replace(", v,", f", v{i},") for o in s[3]], sound=SOUND) for i, s in enumerate(_SPECS)}
_POINTER = lambda name: name.replace("/", "~1")
REFS = {f"r{i}": _pick(20 + i, f"'accident:/{_POINTER(s[0])}'", f"'evidence:/{_POINTER(s[0])}/0'", f"'{s[0]}'", f"'case:{s[0]}'", f"'/{s[0]}'", "'law:none'", sound=SOUND) for i, s in enumerate(_SPECS)}
STRETCH = {f"e{i}": _pick(30 + i, "0", "0", "0", "0", "0", "1000000", sound=SOUND) for i in _N}  # some spans end beyond the report
RECORDS = {f"d{i}": _pick(40 + i, f"concat('记录：', v{i})", "'记录：无'", "''", sound=SOUND) for i in _N}
IDS = {f"o{i}": _pick(50 + i, f"'fact:{s[0]}'", f"'obligation:accident:/{_POINTER(s[0])}'", f"'/{s[0]}'", f"'{s[0]}'", f"'fact-obligation:{s[0]}'", "'fact:无此'" if i == 2 else f"'{s[0]}'", "''" if i == 4 else f"'{s[0]}'", sound=SOUND) for i, s in enumerate(_SPECS)}
TREATMENTS = {f"t{i}": _pick(60 + i, "'covered'", "'covered'", "'uncertain'", "'not_relevant'", "'uncertain'", sound=SOUND) for i in _N}
ENDINGS = {f"s{i}": _pick(70 + i, "'已写'", "'未提供'", "'两种记载存在冲突'", "''", f"concat('缺少佐证：', v{i})", "'写明'", sound=SOUND) for i in _N}
EXTRA = {
    "plate": _pick(80, "''", "''", "''", "'车号京A12345。'", "'车号京A123456。'", "''", "''"),
    "twice": _pick(81, "true", "false", "false", "false", "false", "false", "false"),
    "clash1": _pick(82, "true", "false", "false"),
    "clash2": _pick(83, "true", "false", "false", "false"),
    "clash3": _pick(84, "true", "false", "false", "false", "false", "false", "false"),
    "secret": _pick(85, "'the'", "''", "'张三'", "' '"),
    "truth": _pick(86, "'30'", "'雪'", "'乙方'"),
}
REPORT = f"concat({', '.join(PIECES)}, plate, coalesce(text, ''))"
_START = lambda i: " + ".join(["0", *[f"length(p{j})" for j in range(i)]])


def cases_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One case per document, as the tables that field_checks() takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for made in (BASE, VALUES, PIECES | REFS | STRETCH | RECORDS | IDS | TREATMENTS | ENDINGS | EXTRA, {"report": REPORT}):  # each reads those before it
        docs = docs.withColumns({name: F.expr(e) for name, e in made.items()})
    base = stored(docs.drop("text").withColumnRenamed("doc_id", "case_id"), "cases")
    many = lambda rows: base.select("case_id", F.inline(F.array(*[F.struct(*[F.expr(e).alias(n) for n, e in r.items()]) for r in rows])))
    clash = [("1", "array('天气', '年龄')", "clash1"), ("2", "array('accident:/事故责任')", "clash2"), ("3", "array('无此')", "clash3")]
    return {
        "fields": many([{"field": f"'{s[0]}'", "value": f"v{i}", "kind": f"'{s[1]}'"} for i, s in enumerate(_SPECS)]),
        "claims": many([{"claim_id": f"'{i}'", "start": _START(i), "end": f"{_START(i)} + length(p{i}) + e{i}", "refs": f"array(r{i}, 'ev-{i}')"} for i in _N]),
        "obligations": many([{"obligation_id": f"o{i}", "treatment": f"t{i}", "resolution": f"s{i}", "there": "true"} for i in _N] + [{"obligation_id": "'fact:天气'", "treatment": "'covered'", "resolution": "'x'", "there": "twice"}]).where("there").drop("there"),
        "conflicts": many([{"conflict_id": f"'{c}'", "fields": f, "there": w} for c, f, w in clash]).where("there").drop("there"),
        "reports": base.select("case_id", "report"),
        "hidden": base.select("case_id", F.col("secret").alias("value")),
        "latent": many([{"field": f"'{_SPECS[i][0]}'", "value": "truth"} for i in (0, 2)]),
        "evidence": many([{"id": f"'ev-{i}'", "text": f"d{i}"} for i in _N]),
    }


def _sql(last: str) -> str:
    """The rules of the seven checks over the same cases."""
    made = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items()).replace("element_at(array(", "list_element(list_value(")
    each = lambda row: " UNION ALL ".join(f"SELECT doc_id, {row(i)} FROM r" for i in _N)
    any_of = lambda words: "'" + "|".join(words) + "'"
    stop = "。！？!?；;\\n"
    missing, clash, both = any_of(metrics.MISSING), any_of(metrics.CONFLICT), any_of(metrics.MISSING + metrics.CONFLICT)
    worst = "CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unknown') OR count(status) = 0 THEN 'unknown' ELSE 'pass' END"
    plate = checks.FULL_PLATE.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "(?:$|[^A-Za-z0-9])")
    return f"""
WITH n AS (SELECT doc_id, text, {made(BASE)} FROM documents), v AS (SELECT *, {made(VALUES)} FROM n), p AS (SELECT *, {made(PIECES | REFS | STRETCH | RECORDS | IDS | TREATMENTS | ENDINGS | EXTRA)} FROM v), r AS (SELECT *, {REPORT} AS report FROM p),
f AS ({each(lambda i: f"'{_SPECS[i][0]}' AS field, v{i} AS value, '{_SPECS[i][1]}' AS kind")}),
c AS ({each(lambda i: f"'{i}' AS claim_id, r{i} AS ref, d{i} AS record, CASE WHEN length(p{i}) + e{i} BETWEEN 1 AND length(report) - ({_START(i)}) THEN substring(report, {_START(i)} + 1, length(p{i}) + e{i}) ELSE '' END AS t")}),
o AS (SELECT doc_id, replace(ltrim(regexp_replace(regexp_replace(id, '^(fact_obligation:|fact-obligation:|obligation:|fact:)', ''), '^accident:/', ''), '/'), '~1', '/') AS field, treatment, resolution
  FROM ({each(lambda i: f"o{i} AS id, t{i} AS treatment, s{i} AS resolution")} UNION ALL SELECT doc_id, 'fact:天气', 'covered', 'x' FROM r WHERE twice)),
k AS (SELECT doc_id, '1' AS conflict, unnest(['天气', '年龄']) AS field FROM r WHERE clash1 UNION ALL SELECT doc_id, '2', '事故责任' FROM r WHERE clash2 UNION ALL SELECT doc_id, '3', '无此' FROM r WHERE clash3),
u AS (SELECT f.*, c.claim_id, c.t, c.record, list_filter(regexp_extract_all(c.t, '[^{stop}]*[{stop}]|[^{stop}]+'), lambda s: trim(s) <> '') AS parts
  FROM c JOIN f ON c.doc_id = f.doc_id AND replace(c.ref, '~1', '/') IN (f.field, 'accident:/' || f.field, 'evidence:/' || f.field || '/0', 'case:' || f.field, CASE WHEN contains(f.field, '/') AND c.ref = '/' || f.field THEN '' ELSE '/' || f.field END)
  UNION ALL SELECT f.*, c.claim_id, c.t, c.record, [] FROM c JOIN f ON c.doc_id = f.doc_id AND c.ref = '/' || f.field AND contains(f.field, '/')),
l AS (SELECT *, list_filter(parts, lambda s: contains(s, field)) AS named, list_filter(parts, lambda s: value <> '' AND contains(s, value)) AS valued, regexp_extract(t, field || '\\s*[：:]\\s*([^{stop}]+)', 1) AS said FROM u),
w AS (SELECT *, CASE WHEN len(named) > 0 THEN CASE WHEN len(named) = 1 AND (value = '' OR contains(named[1], value)) THEN named[1] END WHEN len(valued) = 1 THEN valued[1] END AS local FROM l),
a AS (SELECT doc_id, field, CASE WHEN trim(t) = '' THEN 'fail' WHEN said <> '' THEN CASE WHEN contains(said, value) THEN 'pass' ELSE 'fail' END WHEN contains(coalesce(local, ''), value) THEN 'pass'
  WHEN contains(t, field) THEN CASE WHEN regexp_matches(t, '[：:]') THEN 'fail' ELSE 'unknown' END WHEN contains(record, value) THEN 'pass' ELSE 'unknown' END AS status FROM w WHERE kind = 'fact' AND value <> ''),
al AS (SELECT f.doc_id, f.field, coalesce(a.status, 'unknown') AS status FROM f LEFT JOIN a ON a.doc_id = f.doc_id AND a.field = f.field WHERE f.kind = 'fact' AND f.value <> ''),
em AS (SELECT f.doc_id, f.field, CASE WHEN f.field IN ('天气', '年龄') AND contains(r.report, r.truth) THEN 'fail' WHEN m.held IS NULL THEN 'unknown' WHEN m.held THEN 'pass' ELSE 'fail' END AS status
  FROM f JOIN r USING (doc_id) LEFT JOIN (SELECT doc_id, field, bool_and(regexp_matches(t, {missing})) AS held FROM u GROUP BY ALL) m ON m.doc_id = f.doc_id AND m.field = f.field WHERE f.value = ''),
att AS (SELECT f.doc_id, f.field, x.status FROM f LEFT JOIN (SELECT doc_id, field, CASE WHEN trim(t) = '' THEN 'fail' WHEN local IS NULL THEN 'unknown' WHEN regexp_matches(local, {any_of(metrics.ATTRIBUTION)}) THEN 'pass' ELSE 'fail' END AS status FROM w) x
  ON x.doc_id = f.doc_id AND x.field = f.field WHERE kind = 'evaluation' AND value <> ''),
at1 AS (SELECT doc_id, field, {worst} AS status FROM att GROUP BY ALL),
o1 AS (SELECT doc_id, field, count(*) AS n, any_value(treatment) AS treatment, any_value(resolution) AS said FROM o GROUP BY ALL),
ob AS (SELECT f.doc_id, f.field, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'fail'
  WHEN state = 'present' AND treatment <> 'covered' AND regexp_matches(said, {missing}) AND NOT contains(said, left(f.value, 6)) THEN 'fail'
  WHEN state = 'missing' AND treatment = 'not_relevant' AND f.field = '事故责任' THEN 'fail'
  WHEN state = 'present' AND used AND said <> '' AND (treatment = 'covered' OR (treatment = 'uncertain' AND kind <> 'fact')) THEN 'pass'
  WHEN state = 'missing' AND said <> '' AND (treatment = 'not_relevant' OR (treatment = 'uncertain' AND regexp_matches(said, {both}))) THEN 'pass'
  WHEN state = 'conflict' AND treatment = 'uncertain' AND regexp_matches(said, {both}) THEN 'pass' WHEN state = 'present' AND NOT used THEN 'unknown' ELSE 'fail' END AS status
  FROM (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND k.field = f.field) THEN 'conflict' WHEN value <> '' THEN 'present' ELSE 'missing' END AS state,
    EXISTS (SELECT 1 FROM u WHERE u.doc_id = f.doc_id AND u.field = f.field) AS used FROM f) f LEFT JOIN o1 ON o1.doc_id = f.doc_id AND o1.field = f.field
  UNION ALL SELECT DISTINCT doc_id, '?', 'fail' FROM o WHERE field IN ('', '无此')),
told AS (SELECT doc_id, field FROM u WHERE regexp_matches(t, {clash}) UNION SELECT doc_id, field FROM o WHERE regexp_matches(resolution, {clash})
  UNION SELECT doc_id, field FROM (SELECT DISTINCT doc_id, field FROM k) JOIN r USING (doc_id) WHERE contains(report, field) AND regexp_matches(substring(report, greatest(strpos(report, field) - 80, 1), length(field) + 160 + least(strpos(report, field) - 1, 80)), {clash})),
co AS (SELECT k.doc_id, k.conflict AS field, CASE WHEN bool_and(k.field = '无此') THEN 'unknown' WHEN bool_or(told.field IS NOT NULL) THEN 'pass' ELSE 'fail' END AS status FROM k LEFT JOIN told ON told.doc_id = k.doc_id AND told.field = k.field GROUP BY k.doc_id, k.conflict),
pr AS (SELECT doc_id, 'value' AS field, CASE WHEN contains(report, secret) THEN 'fail' ELSE 'pass' END AS status FROM r WHERE trim(secret) <> '' UNION ALL SELECT doc_id, 'plate', 'fail' FROM r WHERE regexp_matches(report, '{plate}')),
items AS (SELECT 'coverage' AS "check", * FROM (SELECT doc_id, field, {worst} AS status FROM al GROUP BY ALL) UNION ALL SELECT 'alignment', * FROM al UNION ALL SELECT 'empty_field', * FROM em UNION ALL SELECT 'attribution', * FROM at1
  UNION ALL SELECT 'obligations', * FROM ob UNION ALL SELECT 'conflicts', * FROM co UNION ALL SELECT 'privacy', * FROM pr),
s AS (SELECT d.doc_id, "check", {worst} AS status, count(status) AS applicable, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'unknown') AS unknown
  FROM (SELECT doc_id, unnest([{", ".join(f"'{c}'" for c in checks.CHECKS)}]) AS "check" FROM documents) d LEFT JOIN items USING (doc_id, "check") GROUP BY ALL)
{last.format(worst=worst)}"""


@query("met_field_checks", _sql("SELECT * FROM s"))
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks of every case, with their counts."""
    cases = cases_of(spark, sf_dir)
    return checks.check_summary(cases["reports"], checks.field_checks(**cases)).withColumnRenamed("case_id", "doc_id")


@query(
    "met_overall",
    _sql("SELECT doc_id, {worst} AS overall, count(status) FILTER (status <> 'pass') AS open_checks, {worst} = 'pass' AS strict_pass FROM (SELECT doc_id, CASE WHEN applicable > 0 THEN status END AS status FROM s) GROUP BY doc_id"),
)
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = cases_of(spark, sf_dir)
    return checks.overall(checks.check_summary(cases["reports"], checks.field_checks(**cases))).withColumnRenamed("case_id", "doc_id")
