from corpusmill.operators import judging as J
from corpusmill.operators import metrics as M
from corpusmill.operators import seeding as S

REPORT = "天气：晴。材料显示事故责任为甲方。路况信息不足。"


def tables(spark, **over):
    given = {
        "fields": [("c", "天气", "晴", "fact", False), ("c", "事故责任", "甲方", "evaluation", False), ("c", "路况", "", "fact", False)],
        "claims": [("c", "1", 0, 5, ["accident:/天气"]), ("c", "2", 5, 17, ["accident:/事故责任"]), ("c", "3", 17, 24, ["accident:/路况"])],
        "obligations": [("c", "fact:天气", "covered", "已写"), ("c", "fact:事故责任", "covered", "已写"), ("c", "fact:路况", "not_relevant", "未提供")],
        "conflicts": [],
        "reports": [("c", REPORT)],
        "hidden": [("c", "张三")],
    } | over
    schemas = {
        "fields": "case_id string, field string, value string, kind string, sensitive boolean",
        "claims": "case_id string, claim_id string, start int, end int, refs array<string>",
        "obligations": "case_id string, obligation_id string, treatment string, resolution string",
        "conflicts": "case_id string, field string",
        "reports": "case_id string, report string",
        "hidden": "case_id string, value string",
    }
    return {k: spark.createDataFrame(v, schemas[k]) for k, v in given.items()}


def failing(spark, **over):
    checks = M.evaluate_candidates(**tables(spark, **over))
    return sorted((r.check, r.field) for r in checks.collect() if r.status != "pass")


def test_good_candidate_passes(spark):
    assert failing(spark) == []
    assert M.roll_up(M.evaluate_candidates(**tables(spark))).first().strict_pass


def test_one_change_one_failure(spark):
    base = tables(spark)
    doubled = [tuple(r) for r in base["obligations"].collect()] + [("c", "fact:天气", "covered", "x")]
    assert failing(spark, obligations=doubled) == [("obligations", "天气")]
    stray = [tuple(r) for r in base["obligations"].collect()] + [("c", "fact:无此", "covered", "x")]
    assert failing(spark, obligations=stray) == [("obligations", "无此")]
    assert failing(spark, hidden=[("c", "甲方")]) == [("privacy", "")]
    assert failing(spark, reports=[("c", REPORT.replace("晴", "雨"))]) == [("alignment", "天气")]
    assert failing(spark, reports=[("c", REPORT.replace("材料显示", "我们认为"))]) == [("attribution", "事故责任")]
    assert failing(spark, conflicts=[("c", "天气")]) == [("conflicts", "天气"), ("obligations", "天气")]


def test_unknown_is_not_pass(spark):
    checks = M.evaluate_candidates(**tables(spark, claims=[("c", "1", 0, 5, ["accident:/天气"])]))
    states = {(r.check, r.field): r.status for r in checks.collect()}
    assert states["empty_field", "路况"] == "unknown" and states["attribution", "事故责任"] == "unknown"


def test_judgement_parsing(spark):
    dims = ", ".join(f'"{d}": 4' for d in J.DIMENSIONS)
    good = '<think>{"dimensions": 1}</think>```json\n{"dimensions": {' + dims + '}, "defects": [{"dimension": "a", "type": "t", "quote": "天 气"}, {"dimension": "a", "type": "t", "quote": "没有"}]}\n```'
    rows = [("k", "j", good, "今天气好"), ("b", "j", good.replace(": 4", ": true", 1), ""), ("h", "j", good.replace(": 4", ": 6", 1), ""), ("n", "j", "no json {", ""), ("z", "j", None, "")]
    raw = spark.createDataFrame(rows, "key string, judge string, content string, report string")
    got = {r.key: r for r in J.parse_judgement(raw).collect()}
    assert got["k"].valid and got["k"].total == 20 and got["k"].unverified == 1
    assert not any(got[k].valid for k in "bhnz")


def test_mutations_change_what_they_say(spark):
    report = "# 标题\n开头\n## 致因分析\n原因 [依据: r-1]\n## 责任分析\n长长的一段责任说明，比别的都长出不少\n"
    plan = {r.mutation: r.text for r in J.calibration_plan(spark.createDataFrame([("r", report)], "report_id string, text string")).collect()}
    assert "drop_evidence_boundary" not in plan and plan["orig"] == report
    assert "原因" not in plan["drop_causation"] and "责任分析" in plan["drop_causation"]
    assert "[依据" not in plan["strip_citations"] and plan["duplicate_section"].count("长长的一段责任说明") == 3


def test_seeded_errors_are_single(spark):
    filler = "其余情况已经核对无误。" * 20
    text = "天气：晴。材料显示事故责任为甲方。路况信息不足。车速两种记载存在冲突。"
    fields = [("c", "天气", "晴", "fact", False), ("c", "事故责任", "甲方", "evaluation", False), ("c", "路况", "", "fact", False), ("c", "伤情", "", "fact", False), ("c", "车速", "六十", "fact", False)]
    claims = [("c", "1", 0, 5, ["accident:/天气"]), ("c", "2", 5, 17, ["accident:/事故责任"]), ("c", "3", 17, 24, ["accident:/路况"]), ("c", "4", 24, 35, ["accident:/车速"])]
    duties = [("c", "fact:天气", "covered", "已写"), ("c", "fact:事故责任", "covered", "已写"), ("c", "fact:路况", "not_relevant", "未提供"), ("c", "fact:伤情", "not_relevant", "未提供"), ("c", "fact:车速", "uncertain", "记载不一致")]
    given = tables(spark, fields=fields, claims=claims, obligations=duties, conflicts=[("c", "车速")], reports=[("c", text + filler)])
    bad = [r for r in M.evaluate_candidates(**given).collect() if r.status == "fail"]
    assert not bad
    got = {r.kind: r for r in S.seed_errors(**given).collect()}
    assert set(got) == {"omit_key_fact", "empty_field_fabrication", "evaluation_as_fact", "obligation_mismatch", "swallow_conflict"}
    assert got["omit_key_fact"].report == text[5:] + filler and "metric:coverage:天气" in got["omit_key_fact"].signals
    assert got["empty_field_fabrication"].report.endswith("\n伤情：合成占位值。") and got["empty_field_fabrication"].signals == ["metric:empty_field:伤情"]
    assert got["evaluation_as_fact"].report == text.replace("材料显示", "") + filler
    assert got["obligation_mismatch"].report == text + filler and got["obligation_mismatch"].signals == ["metric:obligations:天气"]
    assert "冲突" not in got["swallow_conflict"].report
    assert S.seed_errors(**tables(spark, reports=[("c", REPORT.replace("晴", "雨"))])).count() == 0


def test_seeded_errors_read_stored_tables(spark, small_dir):
    """The plan of the result does not hold the checks of all edited tables."""
    from corpusmill import plans

    made = plans.QUERIES["mut2_seeded_errors"](spark, small_dir)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 10
