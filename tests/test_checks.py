from pyspark.sql import functions as F

from corpusmill.operators import checks as C

SCHEMAS = {
    "fields": "case_id string, field string, value string, kind string",
    "claims": "case_id string, claim_id string, start int, end int, refs array<string>",
    "obligations": "case_id string, obligation_id string, treatment string, resolution string",
    "conflicts": "case_id string, conflict_id string, fields array<string>",
    "reports": "case_id string, report string",
    "hidden": "case_id string, value string",
    "latent": "case_id string, field string, value string",
    "evidence": "case_id string, id string, text string",
}
REPORT = "天气：晴。材料显示事故责任为甲方。路况信息不足。"
GOOD = {
    "fields": [("c", "天气", "晴", "fact"), ("c", "事故责任", "甲方", "evaluation"), ("c", "路况", "", "fact")],
    "claims": [("c", "1", 0, 5, ["accident:/天气"]), ("c", "2", 5, 17, ["accident:/事故责任"]), ("c", "3", 17, 24, ["accident:/路况"])],
    "obligations": [("c", "fact:天气", "covered", "已写"), ("c", "fact:事故责任", "covered", "已写"), ("c", "fact:路况", "not_relevant", "不影响判断")],
    "conflicts": [],
    "reports": [("c", REPORT)],
    "hidden": [("c", "张三")],
}


def tables(spark, **over):
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in (GOOD | over).items()}


def test_a_good_candidate_passes_every_check_that_applies(spark):
    given = tables(spark)
    summary = C.check_summary(given["reports"], C.field_checks(**given))
    got = {r.check: (r.status, r.applicable) for r in summary.collect()}
    assert got == {"coverage": ("pass", 1), "alignment": ("pass", 1), "empty_field": ("pass", 1), "attribution": ("pass", 1), "obligations": ("pass", 3), "conflicts": ("unknown", 0), "privacy": ("pass", 1)}
    assert C.overall(summary).first().strict_pass
    none = C.check_summary(given["reports"], C.field_checks(**tables(spark, fields=[], claims=[], obligations=[], hidden=[])))
    assert {r.status for r in none.collect()} == {"unknown"} and C.overall(none).first().overall == "unknown"


# What is changed, and the items whose status is then another.
CHANGES = [
    ({"claims": GOOD["claims"][1:]}, [("alignment", "天气", "unknown"), ("coverage", "天气", "unknown"), ("obligations", "天气", "unknown")]),
    ({"claims": [("c", "1", 0, 99, ["accident:/天气"]), *GOOD["claims"][1:]]}, [("alignment", "天气", "fail"), ("coverage", "天气", "fail")]),
    ({"reports": [("c", REPORT.replace("晴", "雨"))]}, [("alignment", "天气", "fail"), ("coverage", "天气", "fail")]),
    ({"reports": [("c", REPORT.replace("材料显示", "我们认为"))]}, [("attribution", "事故责任", "fail")]),
    ({"reports": [("c", REPORT.replace("信息不足", "十分良好"))]}, [("empty_field", "路况", "fail")]),
    ({"reports": [("c", REPORT + "车号京A12345。")]}, [("privacy", "plate", "fail")]),
    ({"reports": [("c", REPORT + "车号京A123456。")]}, []),
    ({"latent": [("c", "路况", "甲方")]}, [("empty_field", "路况", "fail")]),
    ({"latent": [("c", "路况", " ")]}, []),
    ({"obligations": [*GOOD["obligations"], ("c", "天气", "covered", "x")]}, [("obligations", "天气", "fail")]),
    ({"obligations": [*GOOD["obligations"], ("c", "fact:无此", "covered", "x"), ("c", None, None, None)]}, [("obligations", "?", "fail")]),
    ({"obligations": [("c", "fact:accident:/天气", "uncertain", "未提供"), *GOOD["obligations"][1:]]}, [("obligations", "天气", "fail")]),
    ({"obligations": [GOOD["obligations"][0], ("c", "obligation:/事故责任", "uncertain", "未提供甲方材料"), GOOD["obligations"][2]]}, []),
    ({"obligations": [*GOOD["obligations"][:2], ("c", "fact:路况", "uncertain", "已写")]}, [("obligations", "路况", "fail")]),
    ({"conflicts": [("c", "k", ["天气", "无此"])]}, [("conflicts", "k", "fail"), ("obligations", "天气", "fail")]),
    ({"conflicts": [("c", "k", ["无此"]), ("c", "l", [])]}, [("conflicts", "k", "unknown"), ("conflicts", "l", "unknown")]),
    ({"conflicts": [("c", "k", ["/天气"])], "reports": [("c", REPORT + "记载矛盾")], "obligations": [("c", "天气", "uncertain", "未知"), *GOOD["obligations"][1:]]}, [("conflicts", "k", "pass")]),
    ({"hidden": [("c", "甲方"), ("c", " "), ("c", None)]}, None),
]


def test_one_change_changes_what_depends_on_it(spark):
    variants = [{}, *[over for over, _ in CHANGES]]
    keys = [*GOOD, "latent"]
    given = {k: spark.createDataFrame([(str(i), *row[1:]) for i, v in enumerate(variants) for row in (GOOD | v).get(k, [])], SCHEMAS[k]) for k in keys}
    got = [[] for _ in variants]
    for r in C.field_checks(**given).collect():
        got[int(r.case_id)].append((r.check, r["item"], r.status))
    for found, (over, expected) in zip(got[1:], CHANGES, strict=True):
        changed = sorted(x for x in found if x not in got[0])
        if expected is None:
            assert [(c, s) for c, _, s in changed] == [("privacy", "fail")], over
        else:
            assert changed == expected, over


def test_records_support_claims_in_other_words(spark):
    claims = [("c", "1", 0, 6, ["accident:/天气", "ev"]), *[(c, i, a + 1, b + 1, r) for c, i, a, b, r in GOOD["claims"][1:]]]
    records = [("天晴", "pass"), ("天阴", "unknown"), (None, "unknown")]
    alike = {k: [(str(i), *row[1:]) for i in range(3) for row in v] for k, v in (GOOD | {"claims": claims, "reports": [("c", "当时很好呀。材料显示事故责任为甲方。路况信息不足。")]}).items()}
    given = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in alike.items()}
    evidence = spark.createDataFrame([(str(i), "ev", text) for i, (text, _) in enumerate(records)], SCHEMAS["evidence"])
    got = {r.case_id: r.status for r in C.field_checks(**given, evidence=evidence).where("check = 'alignment'").collect()}
    assert got == {str(i): status for i, (_, status) in enumerate(records)}


def test_references_name_fields_in_every_form(spark):
    fields = spark.createDataFrame([("c", f, "x", "fact") for f in ("带/盔", "盔", "a~b", "a.*b")], SCHEMAS["fields"])
    asked = {"accident:/带~1盔": "带/盔", "evidence:/带~1盔/0": "带/盔", "/带/盔": "带/盔", "x:带/盔": "带/盔", "y/盔": "盔", " 盔 ": "盔", "snapshot:/a~0b": "a~b", "带盔": None, "": None, "q:a.*b": "a.*b"}
    claims = spark.createDataFrame([("c", "1", 0, 1, [*asked, None])], SCHEMAS["claims"])
    used = C.referring_claims(claims, fields, spark.createDataFrame([("c", "z")], SCHEMAS["reports"])).collect()
    assert {list(asked)[r.no]: r.field for r in used} == {k: v for k, v in asked.items() if v}


def test_labelled_values(spark):
    rows = [("天气好，天气 ： 晴，。", "天气", "晴"), ("天气：。", "天气", None), ("天气： 。", "天气", ""), ("a.*b:c", "a.*b", "c"), ("axb:c", "a.*b", None), (r"q\Ez：1；", r"q\Ez", "1"), (None, "天气", None)]
    df = spark.createDataFrame(rows, "t string, f string, v string")
    assert [r.got for r in df.select(C.labelled_value(F.col("t"), F.col("f")).alias("got")).collect()] == [v for _, _, v in rows]


def test_plates_are_sought_from_their_letters(spark):
    texts = ["京A12345", "x京A12345", "，京A12345。", "京A123456", "京a12345", "京京A12345", "AB12345", "京A1234", "9京A12345，沪B99999", "京AAA京A12345z 川Z00000", "", None, "\n京A12345\n", "😀京A12345", "京A12345京A12345"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(C.FULL_PLATE).alias("a"), F.col("t").rlike(C.PLATE_SEARCH).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {True, False, None}
