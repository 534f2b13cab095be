from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import numerals, text as T
from corpusmill.operators import markdown
from corpusmill.operators import ngrams as N
from corpusmill.operators import patterns as P


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression(F.col("v")).alias("x"))
    return [r.x for r in sorted(df.collect(), key=lambda r: r.i)]


def test_duplicate_ratio_is_that_of_counts(spark):
    texts = ["", "abc", "aaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc", "日本日本日本日本日本日本日本"]
    got = column(spark, texts, lambda c: T.duplicate_ratio(T.char_grams(c, 4)))
    for text, x in zip(texts, got, strict=True):
        grams = [text[i : i + 4] for i in range(len(text) - 3)]
        want = sum(n - 1 for n in Counter(grams).values()) / len(grams) if grams else 0
        assert abs(x - want) < 1e-12


def test_duplication_is_that_of_counts(spark):
    texts = [None, "", "abc", "a" * 3000, "abcabcabcabcabcabc", "日本" * 9, "\U0001f600x" * 40, "".join(chr(97 + i * i % 26) for i in range(2000))]
    want = []
    for text in texts:
        grams = [text[i : i + 12] for i in range(len(text) - 11)] if text else []
        want.append((len(grams) - len(set(grams))) / len(grams) if grams else 0.0)
    assert column(spark, texts, lambda c: T.duplicated_grams(c, 12)) == [None, *want[1:]]
    assert column(spark, [texts, None], lambda c: T.duplicated_grams_each(c, 12, 400), "array<string>") == [[w if t and len(t) >= 400 else 0.0 for t, w in zip(texts, want, strict=True)], None]


def test_keyword_counts_are_those_of_the_tokens(spark):
    texts = ["道路法 GB-7258 a x1", "", None, "一 二三四 a.b:c/d 五", "A" * 50 + "中文字" * 7]
    assert column(spark, texts, T.keyword_count) == [len(x) for x in column(spark, texts, T.keyword_tokens)]


def test_grams_values_and_quotes_are_brute_force(spark):
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choice(words, 30))) for i in range(40)] + [(90, ""), (91, None), (92, "short")]
    items = [(i, " ".join(docs[i][1].split()[5 : 5 + n])) for i, n in enumerate([3, 4, 9, 12, 1])] + [(70, ""), (71, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: {tuple(w[i : i + 3]) for w in [(t or "").split()] for i in range(len(w) - 2)}
    want = {(i, j, len(grams(a) & grams(b))) for i, a in items for j, b in docs if grams(a) & grams(b)}
    assert {tuple(x) for x in N.shared_grams(d, q, "doc_id", "item_id", 3).collect()} == want
    bare = lambda t: (t or "").replace(" ", "")
    want = {(i, j) for i, a in items for j, b in docs if bare(a) and bare(a) in bare(b)}
    want = {(i, j, bare(dict(docs)[j]).find(bare(dict(items)[i]))) for i, j in want}
    got = [tuple(x) for x in P.verbatim_quotes(d, q, "doc_id", "text", "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.verbatim_quotes(d, q.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    kept = lambda t: "".join(c for c in bare(t) if c.isalnum())
    more = items + [(80, "w1-w2"), (81, "w3, w4 -"), (82, "zz"), (83, "a")]
    docs2 = docs + [(95, "x w1-w2 y"), (96, "w3,w4-"), (97, "w 1 w 2")]
    d2, q2 = spark.createDataFrame(docs2, "doc_id long, text string"), spark.createDataFrame(more, "item_id long, value string")
    for threshold in (0.6, 0.9, 1.0):
        share = {(j, i): (len(pairs(kept(a)) & pairs(bare(b))) / len(pairs(kept(a))), bare(a) in bare(b)) for i, a in more for j, b in docs2 if pairs(kept(a))}
        want = {(*k, *v) for k, v in share.items() if v[0] >= threshold - 1e-12 or v[1]}
        assert {tuple(x) for x in N.value_hits(d2, q2, "doc_id", "item_id", threshold).collect()} == want


def test_patterns_are_found_in_shards_and_overlapping(spark):
    texts = [(1, "abcabcd 日本日本語"), (2, ""), (3, None), (4, "aaaa"), (4, "aaaa")]
    words = ["abc", "bc", "日本", "日本語", "aa", "", None, "abc", "zz"]
    d, p = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((i, w, at) for i, t in texts for w in {w for w in words if w} for at in range(len(t or "")) if (t or "").startswith(w, at))
    for shard_bytes in (1 << 20, 6):
        assert sorted(tuple(x) for x in P.find_patterns(d, "id", "t", p, "w", shard_bytes).collect()) == want
    assert P.find_patterns(d, "id", "t", p.limit(0), "w").count() == P.find_patterns(d.limit(0), "id", "t", p, "w").count() == 0


def test_tables_in_one_line_and_lone_labels(spark):
    one = "| 项目 | 内容 | |---|:---:| | 时间 | 10时 | | 地点 | | | 车速 | 60 |"
    assert markdown.normalise_lines(one) == "| 项目 | 内容 | |---|:---:||\n| 时间 | 10时 ||\n| 地点 | ||\n| 车速 | 60 |"
    assert markdown.normalise_lines("表：| a | b |---|---| c | d |") == "表：| a | b |---|---|\nc | d |"
    assert markdown.normalise_lines("| a | b |\n|---|---|\n| c | d |") == "| a | b |\n|---|---|\n| c | d |"
    assert markdown.normalise_lines("a | b | c | d | e | f | g") == "a | b | c | d | e | f | g"
    assert markdown.normalise_lines("**结论**：\n正文。\n**结论：**\n****：") == "## 结论\n\n正文。\n\n**结论：**\n\n****："


def test_compact_takes_out_every_kind_of_white_space(spark):
    assert column(spark, ["a b\tc　d e\n"], T.compact) == ["abcde"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 999), min_size=1, max_size=20))
def test_numerals_round_trip(spark, numbers):
    assert column(spark, numbers, lambda c: numerals.numeral_value(numerals.numeral_of(c)), "int") == numbers


def test_numeral_values(spark):
    cases = {"十": 10, "九十九": 99, "一百零三": 103, "两千": 2000, "12": 12, "一x": None, "二百五": 205}
    assert column(spark, list(cases), numerals.numeral_value) == list(cases.values())


def test_folded_numbers(spark):
    (got,) = column(spark, ["二零二六年十二月"], numerals.folded_numbers)
    assert set(got) == {"2026", "2", "0", "6", "12"}


def test_law_item(spark):
    (got,) = column(spark, ["《中华人民共和国道路法（修正）》第四十三条"], numerals.law_item)
    assert (got.law, got.article) == ("道路法", 43)


def test_sections_and_bold(spark):
    (got,) = column(spark, ["intro\n## One\nbody\n# Two  \n\nmore"], T.sections)
    assert [s.title for s in got] == ["One", "Two"] and "body" in got[0].body
    got = column(spark, ["plain text", "", None, "# A\n---\n\n# B\n***\nx\n___\n"], T.sections)
    assert [[(s.title, s.body) for s in x] for x in got] == [[("正文", "plain text")], [], [], [("A", "# A"), ("B", "x")]]
    assert column(spark, ["a **b** c", "a ** b\nc"], T.unbalanced_bold) == [False, True]


def test_tokens_are_pairs_and_ascii(spark):
    assert column(spark, ["道路法 GB-7258 a x1"], T.keyword_tokens) == [["道路", "路法", "gb-7258", "x1"]]


def test_pointer_and_label(spark):
    assert column(spark, ["/a~1b/c~0d"], T.pointer_tokens) == [["a/b", "c~d"]]
    assert column(spark, ["  Ab--C d! "], T.normal_label) == ["ab_c_d"]


def test_every_turn_is_compared_with_the_next(spark, tmp_path):
    from corpusmill.plans.texts import similarity

    rows = [(1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (1, 4, "four"), (2, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.conv_id, r.turn) for r in similarity(spark, str(tmp_path)).collect()) == [(1, 0), (1, 1), (1, 2)]


def test_values_meet_documents_where_they_stand(spark, monkeypatch):
    """No row of a document is shuffled, and several shards of values find what one finds."""
    from corpusmill.operators import ngrams

    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma delta") for i in range(40)] + [(None, "alpha"), (99, None)], "d long, text string")
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["alpha beta", "gam-ma", "delta 9", "zz", "x", "", None])], "i long, value string")
    one = ngrams.value_hits(docs, values, "d", "i", 0.6)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngrams, "SHARD_CHARS", 8)
    several = ngrams.value_hits(docs, values, "d", "i", 0.6)
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, several.collect())) and (7, 0, 1.0, True) in got
    assert ngrams.value_hits(docs, values.limit(0), "d", "i", 0.6).collect() == []
