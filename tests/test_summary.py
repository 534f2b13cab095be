import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import reports as Q
from corpusmill.operators import retrieval as R
from corpusmill.operators import selection as S
from corpusmill.operators import summary as A


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_floor_percentiles_are_those_of_sorted_lists(spark, q):
    r = np.random.default_rng(1)
    groups = {"many": r.normal(0, 1, 3000), "one": [5.0], "tied": [1.0] * 400 + [2.0] * 300, "few": [3.0, 1.0, 2.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)]
    got = {x.g: x.percentile for x in A.exact_floor_percentile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q).collect()}
    assert got == {g: float(sorted(vs)[min(int(q * len(vs)), len(vs) - 1)]) for g, vs in groups.items()}


def test_bootstrap_narrows_with_the_data(spark):
    r = np.random.default_rng(2)
    widths = []
    for n in (100, 1600):
        values = r.integers(0, 6, n).astype(float)
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        means = A.bootstrap_means(df, "v", 2000, 7)
        low, high = A.bootstrap_interval(means).first()
        assert [low, high] == list(A.bootstrap_interval(A.bootstrap_means(df.repartition(5), "v", 2000, 7)).first())
        error = values.std() / n**0.5
        assert abs((low + high) / 2 - values.mean()) < 0.3 * error and abs((high - low) / (2 * 1.96 * error) - 1) < 0.15
        widths.append(high - low)
    assert widths[1] < 0.4 * widths[0]
    assert A.bootstrap_means(df.limit(0), "v", 10, 7).count() == 0


def test_leave_one_out_cosines(spark):
    v = np.random.default_rng(3).normal(0, 1, (5, 4))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "k int, v array<double>")
    got = {x.k: x.cosine for x in A.leave_one_out(df, "k", "v").collect()}
    for i in range(5):
        rest = np.delete(v, i, 0).mean(0)
        assert abs(got[i] - v[i] @ rest / np.linalg.norm(v[i]) / np.linalg.norm(rest)) < 1e-9


def test_places_over_a_whole_table(spark):
    rows = [(int(x), "ab"[i % 2]) for i, x in enumerate(np.random.default_rng(4).integers(0, 300, 900))] + [(None, "a")]
    df = spark.createDataFrame(rows, "n int, s string").repartition(5)
    got = sorted((x.place, x.n, x.s) for x in S.global_rank(df, ["n", "s"], "place", ranges=7).collect())
    assert [p for p, _, _ in got] == list(range(901))
    assert [(n, s) for _, n, s in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert S.global_rank(df.limit(0), ["n", "s"], "place").count() == 0 and S.global_rank(df.limit(1), ["n", "s"], "place").first().place == 0


def test_family_caps_hold_in_turns(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3], f"f{i // 6}") for i in range(60)], "id int, kind string, family string")
    got = S.round_robin(df, "kind", ["id"], 8, 12, "family", 2).collect()
    assert len(got) == 8 and max(sum(r.family == f for r in got) for f in {r.family for r in got}) == 2


def test_terminal_failures_alone_are_cut(spark):
    df = spark.createDataFrame([(list(range(9)), "terminal"), (list(range(9)), "gate"), ([1], "gate")], "r array<int>, k string")
    got = [x.c for x in df.select(S.cut_terminal(F.col("r"), F.lit(4), F.col("k"), 10).alias("c")).collect()]
    assert got == [list(range(6)), None, [1]]


def test_hybrid_balances_kinds_and_keeps_the_budget(spark):
    scored = spark.createDataFrame([(1, "chunk" if d % 4 else "rule", d, 10.0 - d) for d in range(12)], "query int, tag string, doc int, score double")
    contents = spark.createDataFrame([(d, "x" * 100) for d in range(12)], "doc int, content string")
    got = R.hybrid(scored, contents, per_index=6, most=5, per_kind=2, max_chars=250).orderBy("place").collect()
    assert [(x.tag, x.doc) for x in got] == [("chunk", 1), ("rule", 0), ("chunk", 2)]
    assert [x.content_truncated for x in got] == [False, False, True] and len(got[2].content) == 50


def test_writer_items(spark):
    records = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta alpha"), (3, "omega words here")], "id int, text string")
    closing = "依据第三条" + "字" * 60
    rows = [(1, "beta gamma", 1, [1], closing, ""), (2, "alpha", 1, [3], closing, ""), (3, " ", 1, [1], closing, ""), (4, "omega", 4, [3], closing, ""), (5, "omega", 3, [3], "第三条", ""), (6, "omega", 3, [3], "字" * 70, ""), (7, "omega", 3, [3], closing + "样本", ""), (8, "omega", 2, [3], closing, "r" * 121), (9, None, None, None, None, None)]
    written = spark.createDataFrame(rows, "key int, query string, top_k int, targets array<int>, closing string, reason string")
    got = {x.key: x.rejection for x in R.writer_reasons(written, records, "key", "id", S.F.split("text", " ")).collect()}
    assert got == {1: None, 2: "target_not_found", 3: "empty_query", 4: "top_k", 5: "closing_length", 6: "no_article", 7: "meta_words", 8: "reason_length", 9: "empty_query"}


def test_offline_report_quality(spark):
    report = "# 1.2 概要\n甲车在人民路行驶，车速45公里。不能认定承担全部责任。乙方负主要责任；字段未提供，12米。"
    rows = spark.createDataFrame([(report, "车速 45", ["人民路", "长安街", "x", "行驶"]), (None, None, ["人民路"])], "report string, prompt string, facts array<string>")
    got = Q.offline_quality(rows).collect()
    assert (got[0].chars, got[0].recall, got[0].fabricated, got[0].asserted, got[0].form) == (len(report), 0.67, ["12"], 1, 2)
    assert (got[1].chars, got[1].recall, got[1].fabricated, got[1].asserted, got[1].form) == (0, 0.0, [], 0, 0)


def test_ridge_weights_are_those_of_a_plain_solve(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (700, 6))
    y = x @ np.array([1.0, -2, 0, 0.5, 3, 0]) + r.normal(0, 0.1, 700)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    odd = [(None, 1.0), ([float("nan")] * 6, 1.0), ([1.0] * 5 + [None], 2.0), ([1.0] * 3, 2.0), ([1.0] * 6, None), ([float("inf")] * 6, 1.0)]
    df = spark.createDataFrame(rows + odd, "e array<double>, y double").repartition(20)
    n, gram, cross = A.gram_sums(df, "e", "y", block=64)
    assert n == 700 and np.allclose(gram, x.T @ x) and np.allclose(cross, x.T @ y)
    g, s = x.T @ x / 700, x.T @ y / 700
    want = np.linalg.solve(g + 0.01 * np.trace(g) / 6 * np.eye(6), s)
    assert np.allclose(A.ridge_weights(df, "e", "y", 0.01), want / (want @ s))
    assert len(A.ridge_weights(df.limit(0), "e", "y", 0.01)) == 0


def test_percentiles_of_many_values_and_of_a_null_group(spark):
    """Rough quantiles of so many values differ between two readings; a null is a group of its own."""
    rows = spark.range(0, 300_000, 1, 23).selectExpr("nullif(id % 3, 2) AS g", "xxhash64(id) AS v")
    got = {x.g: (x.p, x.m) for x in A.exact_floor_percentiles(rows, ["g"], "v", {"p": 0.9, "m": 0.5}).collect()}
    for g in (0, 1, None):
        values = sorted(x.v for x in rows.where(f"g <=> {'null' if g is None else g}").collect())
        assert got[g] == (values[90_000], values[50_000])
    assert {x.g for x in A.exact_floor_percentile(rows, ["g"], "v", 0.9).collect()} == {0, 1, None}
