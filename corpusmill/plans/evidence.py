"""The gates over reports that are made from documents: phrases stand in a report as the document's id and length tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evidence
from corpusmill.plans.catalogue import query, table
from corpusmill.plans.quality import NUMERAL


def _some(k: int, of: int, then: str, otherwise: str = "''") -> str:
    """`then` for about `of` sevenths of the documents, others for each k."""
    return f"CASE WHEN (doc_id * 31 + {k} * 17 + length(coalesce(text, '')) * {k + 3}) % 7 < {of} THEN {then} ELSE {otherwise} END"


_LINES = [
    "'## 事故概要'", "'## 事实与证据边界'", "'## 事故经过'", "'## 致因分析'", "'## 责任分析'",
    _some(0, 5, "'## 依据与待补证据'"), _some(1, 1, "'甲方负主要责任。'"), _some(2, 2, "'乙方可能负次要责任。'"), _some(3, 1, "'双方按 3:7 的责任划分'"),
    _some(4, 2, "'车速60km/h；'"), _some(5, 2, "'车速45公里/小时；'"), _some(6, 2, "'共9人受伤，行驶8.50公里'"), _some(7, 2, "'10时25分许发生'"),
    _some(8, 3, "concat('依《中华人民共和国道路交通安全法》第', numeral, '条')"), _some(9, 2, "concat('又第', CAST(n AS STRING), '条')"), _some(10, 2, "'见GB 7258-2017'"),
    _some(11, 4, "'[依据：law-1]'"), _some(12, 1, "'[依据: src#law-1；ghost-3]'"), _some(13, 1, "'涉嫌构成交通肇事罪'"), _some(14, 1, "'<tool_call>'"),
    _some(15, 1, "'电话13812345678'"), _some(16, 1, "'a.b@c.de'"), _some(17, 1, "'京A·12345'"), _some(18, 1, "'根据系统提示'"),
    _some(19, 1, "'this report says nothing about many other things that drivers know'"), _some(20, 1, "'**半边'"), _some(21, 1, "'请核对现场勘查笔录与车辆检验报告是否一致'"), _some(22, 2, "'依《刑法》第七十六条'"),
]
# Columns that both engines make from documents; n is the article that the report names, numeral the same as a numeral.
TRACE = {
    "report": _some(30, 6, "concat(" + ", chr(10), ".join(_LINES) + ")"),
    "status": _some(31, 6, "'ok'", "'error'"),
    "truncated": _some(32, 1, "true", "false"),
    "unknown_tool": _some(33, 1, "true", "false"),
    "not_json": _some(34, 1, "true", "false"),
    "other_issue": _some(35, 1, "true", "false"),
    "rounds": _some(36, 2, "0", "2"),
    "accident": _some(37, 3, "'车速四十五，时间10时，伤9人，行驶8.5公里'", "'无'"),
    "guidance": "'待核实：请核对现场勘查笔录与车辆检验报告是否一致；其余从略'",
    "law_text": f"concat('道路交通安全法 第', {_some(38, 3, 'numeral', chr(39) + '三' + chr(39))}, '条 ', {_some(39, 3, chr(39) + 'GB 7258-2017' + chr(39))})",
    "other_text": "'其他规定 第七十六条'",
    "reasoning": _some(40, 2, "repeat('甲乙丙丁戊己庚辛壬癸子丑寅', 200)", "coalesce(text, '')"),
}
_BARE = r"replace(replace(replace(replace({x}, ' ', ''), chr(9), ''), chr(10), ''), chr(13), '')"
_DIGITS = "零〇一二三四五六七八九十百千两"


def _sql() -> str:
    """Each gate's rule over the same traces."""
    from corpusmill.operators import gates as G

    q = lambda p: "'" + p.replace("'", "''") + "'"
    columns = ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {name}" for name, e in TRACE.items())
    edge = lambda p: q(p.replace(r"(?<!\d)", r"(?:^|[^0-9])").replace(r"(?!\d)", r"(?:[^0-9]|$)"))  # noqa: E731  RE2 looks neither back nor ahead
    liable = f"len(list_filter(string_split_regex(report, '[。；;\\n]'), lambda s: regexp_matches(s, {q(G.LIABILITY)}) AND NOT regexp_matches(s, {q(G.HEDGE)}))) > 0"
    body = _BARE.format(x="reasoning")
    loop = f"length({body}) >= 400 AND length(reasoning) >= 2000 AND (SELECT 1 - count(DISTINCT substring({body}, i, 12)) / count(*) FROM range(1, length({body}) - 10) AS t(i)) > 0.3"
    english = f"len(list_filter(regexp_extract_all(regexp_replace(report, {q(G.CITATION)}, '', 'g'), '[A-Za-z]{{4,}}'), lambda w: lower(w) <> 'markdown')) > 8"
    corpus = "concat_ws(' ', accident, guidance, law_text, other_text, 'law-1 law-2')"
    own = {
        "truncated_output": "truncated", "tool_call_unknown_tool": "unknown_tool", "tool_call_arguments_not_json": "not_json", "tool_call_other": "other_issue",
        "tool_markup_in_report": f"regexp_matches(report, {q(G.TOOL_MARKUP)})", "sentencing_or_crime_language": f"regexp_matches(report, {q(G.CRIME)})",
        "privacy_leak": f"regexp_matches(report, {edge(G.ID_NUMBER)}) OR regexp_matches(report, {edge(G.PHONE)}) OR regexp_matches(report, {q(G.EMAIL)})",
        "no_retrieval_round": "rounds = 0", "no_citations": f"NOT regexp_matches(report, {q(G.CITATION)})", "liability_assertion_unhedged": liable,
        "responsibility_ratio_claim": f"regexp_matches(report, {q(G.RATIO)})", "plate_in_report": f"regexp_matches(report, {q(G.PLATE)})",
        "guidance_verbatim": "contains(report, '请核对现场勘查笔录与车辆检验报告是否一致')", "meta_language": f"regexp_matches(report, {q(G.META)})", "english_leakage": english,
        "missing_sections": " OR ".join(f"NOT regexp_matches(report, '(?m)^#+ .*{s}')" for s in G.SECTIONS),
        "unbalanced_bold": "len(list_filter(string_split(report, chr(10)), lambda l: (length(l) - length(replace(l, '**', ''))) // 2 % 2 = 1)) > 0",
        "reasoning_loop": loop,
    }
    plain = " UNION ALL ".join(f"SELECT key, '{code}' AS code FROM g WHERE {rule}" for code, rule in own.items())
    values = f"""CAST(coalesce((SELECT any_value(v.n) FROM v WHERE v.numeral = x), TRY_CAST(x AS BIGINT)) AS BIGINT)"""
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(evidence.CODES))
    hard = ", ".join(f"'{c}'" for c in evidence.HARD)
    return f"""
WITH v AS (SELECT n, {NUMERAL} AS numeral FROM (SELECT range AS n, string_split('零一二三四五六七八九', '') AS d FROM range(1000))),
b AS (SELECT doc_id, text, doc_id % 90 + 2 AS n, v.numeral FROM documents JOIN v ON v.n = doc_id % 90 + 2),
t AS (SELECT doc_id AS key, n, {columns} FROM b),
g AS (SELECT * FROM t WHERE status = 'ok' AND report <> ''),
s AS (SELECT key, 'law-1' AS id, law_text || '  src law-1' AS text FROM g UNION ALL SELECT key, 'law-2', other_text || '   law-2' FROM g),
sn AS (SELECT key, id, text, {values} AS number FROM (SELECT key, id, text, unnest(regexp_extract_all(text, {q(G.ARTICLE)}, 1)) AS x FROM s)),
named AS (SELECT key, unnest(regexp_extract_all(report, {q(G.LAW_ARTICLE)}, 1)) AS law, unnest(regexp_extract_all(report, {q(G.LAW_ARTICLE)}, 2)) AS x FROM g),
refs AS (SELECT key, replace(law, '中华人民共和国', '') AS law, {values} AS number, law || x AS shown FROM named
    UNION SELECT key, '', {values}, x FROM (SELECT key, unnest(regexp_extract_all(regexp_replace(report, {q(G.LAW_ARTICLE)}, ' ', 'g'), {q(G.ARTICLE)}, 1)) AS x FROM g)),
loose AS (SELECT key, shown FROM refs r WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.key = r.key AND sn.number = r.number AND contains(sn.text, r.law))),
std AS (SELECT DISTINCT key, shown FROM (SELECT key, law_text, unnest(regexp_extract_all(report, {q(G.STANDARD)})) AS shown FROM g) WHERE NOT contains(replace(law_text, ' ', ''), replace(shown, ' ', ''))),
cited AS (SELECT key, unnest(string_split_regex(trim(c), '[;；,，、\\s]+')) AS c FROM (SELECT key, unnest(regexp_extract_all(report, {q(G.CITATION)}, 1)) AS c FROM g)),
ghosts AS (SELECT key FROM cited WHERE c <> '' AND c NOT IN ('law-1', 'src#law-1', 'law-2', '#law-2') AND regexp_extract(c, '[^#]*$') NOT IN ('law-1', 'law-2')),
runs AS (SELECT key, unnest(regexp_extract_all({corpus}, '[{_DIGITS}]+')) AS x FROM g),
known AS (SELECT key, unnest(regexp_extract_all({corpus}, '[0-9]+(?:\\.[0-9]+)?')) AS number FROM g
    UNION SELECT key, CAST({values} AS VARCHAR) FROM runs WHERE regexp_matches(x, '[十百千]')
    UNION SELECT key, CAST(strpos('零一二三四五六七八九', d) - 1 AS VARCHAR) FROM (SELECT key, unnest(string_split(x, '')) AS d FROM runs) WHERE strpos('零一二三四五六七八九', d) > 0),
qty AS (SELECT key, unnest(regexp_extract_all(report, {q(G.UNIT_NUMBER)}, 1)) AS n, unnest(regexp_extract_all(report, {q(G.UNIT_NUMBER)}, 2)) AS unit FROM g),
bad_qty AS (SELECT key, unit FROM qty WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.key = qty.key AND k.number IN (qty.n, CASE WHEN contains(qty.n, '.') THEN regexp_replace(qty.n, '\\.?0+$', '') ELSE qty.n END))),
clock AS (SELECT key, unnest(regexp_extract_all(report, {edge(G.CLOCK)}, 1)) AS h FROM g),
bad_clock AS (SELECT key FROM clock WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.key = clock.key AND ltrim(k.number, '0') = ltrim(clock.h, '0'))),
fired AS (SELECT key, 'no_report' AS code FROM t WHERE NOT (status = 'ok' AND report <> '') UNION {plain.replace("UNION ALL", "UNION")}
    UNION SELECT key, 'article_not_in_visible_text' FROM loose UNION SELECT key, 'article_not_in_visible_text' FROM std UNION SELECT key, 'citation_not_visible' FROM ghosts
    UNION SELECT key, CASE WHEN unit IN ({", ".join(q(u) for u in G.SPEED_UNITS)}) THEN 'fabricated_quantity' ELSE 'unsupported_number' END FROM bad_qty UNION SELECT key, 'fabricated_quantity' FROM bad_clock),
o(code, i) AS (VALUES {order}),
c AS (SELECT key, string_agg(code, ',' ORDER BY i) AS codes, bool_or(code IN ({hard})) AS hard_fail FROM fired JOIN o USING (code) GROUP BY key),
u AS (SELECT key, count(*) AS n FROM (SELECT key, shown FROM loose UNION SELECT key, shown FROM std) GROUP BY key)
SELECT t.key AS doc_id, coalesce(c.hard_fail, false) AS hard_fail, coalesce(c.codes, '') AS codes, coalesce(u.n, 0) AS unsupported FROM t LEFT JOIN c USING (key) LEFT JOIN u USING (key)
"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the article that their reports name, as a number and as a numeral."""
    from corpusmill.functions.numerals import numeral_of

    return table(spark, sf_dir, "documents").withColumn("n", F.expr("doc_id % 90 + 2")).withColumn("numeral", numeral_of(F.col("n")))


def traces_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Traces and cases, one of each per document."""
    docs = numbered(spark, sf_dir)
    rows = docs.select("doc_id", "n", *[F.expr(e).alias(name) for name, e in TRACE.items()])
    none = F.lit(None).cast("string")
    law = F.struct(F.lit("law-1").alias("id"), F.lit("src").alias("source"), none.alias("title"), none.alias("authority"), F.col("law_text").alias("content"), none.alias("citation"))
    other = F.struct(F.lit("law-2").alias("id"), none.alias("source"), none.alias("title"), none.alias("authority"), F.col("other_text").alias("content"), none.alias("citation"))
    issue = lambda c, name: F.when(F.col(c), F.lit(name))
    traces = rows.select(
        F.col("doc_id").alias("key"), F.col("doc_id").alias("case_id"), "status", F.col("report").alias("final_markdown"), F.array(law, other).alias("visible_snippets"),
        F.array_compact(F.array(issue("unknown_tool", "unknown_tool"), issue("not_json", "arguments_not_json"), issue("other_issue", "empty_query"))).alias("tool_call_issues"),
        F.col("truncated").alias("any_truncated"), F.col("rounds").alias("retrieval_rounds"), F.array("reasoning").alias("reasoning"),
    )
    cases = rows.select(F.col("doc_id").alias("case_id"), F.create_map(F.lit("accident"), "accident").alias("accident_data"), F.array("guidance").alias("guidance"))
    return traces, cases


@query("str9_all_gates", _sql())
def all_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of the gates, with support of articles, ids and quantities found by joins."""
    masks = evidence.gate_masks(*traces_of(spark, sf_dir))
    mask = F.col("mask")
    return masks.select(F.col("key").alias("doc_id"), (mask.bitwiseAND(F.lit(evidence.HARD_MASK)) > 0).alias("hard_fail"), F.array_join(evidence.codes_of(mask), ",").alias("codes"), "unsupported")
