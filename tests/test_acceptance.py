from pyspark.sql import functions as F

from corpusmill.functions import documents as J
from corpusmill.operators import acceptance as A
from corpusmill.operators import retrieval as R

REVISION = "clean boolean, looping boolean, coverage double, o_coverage double, citations int, judges map<string,double>, o_judges map<string,double>, primary string, kind string, o_hard_fail boolean"
GOOD = (True, False, 0.8, 0.8, 2, {"a": 20.0, "b": 18.0}, {"a": 18.0, "b": 17.0}, "a", "quality", False)


def changed(at, value):
    return (*GOOD[:at], value, *GOOD[at + 1 :])


def test_revision_reasons_one_change_each(spark):
    cases = {None: GOOD, "gate": changed(0, False), "coverage_drop": changed(2, 0.5), "no_citations": changed(4, 0), "missing_judge": changed(5, {"b": 20.0}), "gain": changed(5, {"a": 20.0, "b": 16.0}), "below_absolute": (*GOOD[:5], {"a": 10.0}, {}, *GOOD[7:])}
    for reason, row in cases.items():
        assert spark.createDataFrame([row], REVISION).select(A.revision_reason(1.0, 0.1, 15.0).alias("r")).first().r == reason
    pairs = {None: GOOD, "worse": changed(5, {"a": 20.0, "b": 16.0}), "original_gate": changed(9, True), "original_clean": changed(8, "gate"), "small_gain": changed(5, {"a": 18.5, "b": 18.0})}
    for reason, row in pairs.items():
        assert spark.createDataFrame([row], REVISION).select(A.revision_pair_reason(1.0, 0.1, 15.0).alias("r")).first().r == reason


def test_json_expressions(spark):
    df = spark.createDataFrame([('{"b": [1, "x"], "a": {"c": "y"}}', '{"a":{"c":"y"},"b":[1,"x"]}'), ("no", None)], "v string, w string")
    rows = df.select(J.canonical_digest(F.col("v")).alias("v"), J.canonical_digest(F.col("w")).alias("w"), J.string_leaves(F.col("v")).alias("s")).collect()
    assert rows[0].v == rows[0].w is not None and rows[0].s == ["x", "y"] and rows[1].v is None and rows[1].s == []


def test_unnegated_and_budget(spark):
    text = "甲方负责。不能认定乙方负责。" + "远" * 30 + "负责"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.unnegated(F.col("t"), "负责", "不能|不得").alias("n")).first().n == 2
    cut = df.select(J.budget_split(F.col("t"), "不能").alias("c")).first().c
    assert (cut.before, cut.start) == ("甲方负责。", 5) and cut.after.startswith("认定")


def test_context_budget_clips_the_crossing_record(spark):
    df = spark.createDataFrame([("q", i, "x" * 40) for i in range(4)], "query string, rank int, content string")
    got = R.context_budget(df, "query", ["rank"], "content", 100).orderBy("rank").collect()
    assert [len(r.content) for r in got] == [40, 40, 20] and [r.content_truncated for r in got] == [False, False, True] and got[2].content.endswith("…")


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "speed limit speed"), (2, "traffic light"), (3, "speed of light")], "id long, text string")
    index = R.postings(docs, "id", F.split("text", " "))
    queries = spark.createDataFrame([("q", "speed"), ("q", "limit")], "query string, token string")
    got = R.bm25(index, queries, 3, 8 / 3).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 3]
    fused = R.fuse(spark.createDataFrame([("q", "a", 1, 1), ("q", "b", 2, 1), ("q", "a", 3, 2)], "query string, tag string, doc long, rank int"), 2).orderBy("place").collect()
    assert [(r.tag, r.doc) for r in fused] == [("a", 1), ("b", 2)]
