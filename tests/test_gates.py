import pytest
from pyspark.sql import functions as F

from corpusmill.operators.evidence import codes_of, gate_masks
from corpusmill.operators.gates import SECTIONS, evaluate_gates

TRACE = "key string, case_id string, status string, final_markdown string, visible_snippets array<struct<id:string,source:string,title:string,authority:string,content:string,citation:string>>, tool_call_issues array<string>, any_truncated boolean, retrieval_rounds int, reasoning array<string>"
CASE = "case_id string, accident_data map<string,string>, guidance array<string>"
SNIPPET = ("r-1", "law", "交通法", "国家", "《交通法》第十七条 慢行", "r-1")
REPORT = "\n".join(f"## {t}\n车辆缓慢行驶。" for t in SECTIONS) + "\n依据《交通法》第十七条 [依据: r-1]\n车速 30 公里/小时"


HARD = {
    "truncated_output": {"any_truncated": True},
    "tool_call_unknown_tool": {"tool_call_issues": ["unknown_tool"]},
    "tool_markup_in_report": {"final_markdown": REPORT + "<tool_call>"},
    "citation_not_visible": {"final_markdown": REPORT + "[依据: r-9]"},
    "article_not_in_visible_text": {"final_markdown": REPORT + "《交通法》第十八条"},
    "sentencing_or_crime_language": {"final_markdown": REPORT + "判处罚金"},
    "fabricated_quantity": {"final_markdown": REPORT + "时速 87 公里/小时"},
    "privacy_leak": {"final_markdown": REPORT + " a.b@c.org"},
    "no_report": {"status": "error"},
}
WARN = {
    "no_retrieval_round": {"retrieval_rounds": 0},
    "no_citations": {"final_markdown": REPORT.replace("[依据: r-1]", "")},
    "liability_assertion_unhedged": {"final_markdown": REPORT + "\n甲方负全部责任。"},
    "responsibility_ratio_claim": {"final_markdown": REPORT + "\n责任比例为三七"},
    "unsupported_number": {"final_markdown": REPORT + "\n有 5 人在场"},
    "plate_in_report": {"final_markdown": REPORT + "\n京A12345"},
    "guidance_verbatim": {"final_markdown": REPORT + "\n请核对现场照片与监控录像的时间顺序是否一致"},
    "meta_language": {"final_markdown": REPORT + "\n工具返回如上"},
    "english_leakage": {"final_markdown": REPORT + "\n" + "word " * 9},
    "unbalanced_bold": {"final_markdown": REPORT + "\n**半个"},
    "missing_sections": {"final_markdown": REPORT.replace("## 致因分析", "## 其他")},
    "tool_call_slow": {"tool_call_issues": ["slow"]},
    "reasoning_loop": {"reasoning": ["重复的一段话反复出现" * 300]},
}


@pytest.fixture(scope="module")
def rows(spark):
    """The clean trace and one changed trace per code, evaluated together."""
    clean = {"key": "clean", "case_id": "c", "status": "ok", "final_markdown": REPORT, "visible_snippets": [SNIPPET], "tool_call_issues": [], "any_truncated": False, "retrieval_rounds": 1, "reasoning": ["短"]}
    traces = [clean] + [clean | {"key": code} | change for code, change in (HARD | WARN).items()]
    cases = spark.createDataFrame([("c", {"车速": "30公里", "天气": "晴天"}, ["信息不足：请核对现场照片与监控录像的时间顺序是否一致"])], CASE)
    table = spark.createDataFrame([tuple(t.values()) for t in traces], TRACE)
    joined = gate_masks(table, cases).withColumn("codes", codes_of(F.col("mask")))
    found = {r.key: r for r in evaluate_gates(table, cases).join(joined, "key").collect()}
    assert len(found) == len(traces)
    return found


def test_clean_report_passes(rows):
    row = rows["clean"]
    assert not row.hard_fail and row.hard == [] and row.warn == []
    assert row.fact_missing_fields == ["天气"] and row.fact_coverage == 0.5


@pytest.mark.parametrize("code", HARD)
def test_one_change_gives_one_hard_code(rows, code):
    assert rows[code].hard == [code] and rows[code].hard_fail and rows[code].warn == []


@pytest.mark.parametrize("code", WARN)
def test_one_change_gives_one_warning(rows, code):
    assert rows[code].hard == [] and rows[code].warn == [code]


def test_relations_give_the_same_codes(rows):
    """Long tables, joins and bits say what the arrays of a row say."""
    for row in rows.values():
        other = [c for c in row.warn if c.startswith("tool_call_")]
        assert set(row.codes) == {*row.hard, *(c for c in row.warn if c not in other), *(["tool_call_other"] if other else [])}
        assert (row.unsupported > 0) == ("article_not_in_visible_text" in row.hard)


def test_an_article_needs_one_snippet_with_both_law_and_number(spark):
    """The law stands in one snippet and the number in another: no support. Bare references need the number alone; a null key column elsewhere does no harm."""
    snippets = [("a", None, "甲法", None, "第三条 甲法", None), ("b", None, "乙法", None, "第七条", None)]
    reports = {"both": "《甲法》第三条", "apart": "《甲法》第七条", "bare": "第七条", "none": "第九条", "digits": "《中华人民共和国乙法》第7条", "twice": "《甲法》第七条，《甲法》第七条，第八条"}
    traces = spark.createDataFrame([(k, "c", "ok", v, snippets, None, None, None, None) for k, v in reports.items()] + [("empty", "c", "ok", "第一条", None, None, None, None, None)], TRACE)
    found = {r.key: r.unsupported for r in gate_masks(traces, spark.createDataFrame([("c", {"a": "b"}, [])], CASE)).collect()}
    assert found == {"both": 0, "apart": 1, "bare": 0, "none": 1, "digits": 0, "twice": 2, "empty": 1}
