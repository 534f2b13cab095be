import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def stages(spark, small_dir, tmp_path_factory):
    """The output of each stage over the smallest tables, written and read again."""
    docs, out = spark.read.parquet(f"{small_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def test_all_but_the_last_keep_the_columns(spark, small_dir, stages):
    columns = spark.read.parquet(f"{small_dir}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_quality_keeps_good_documents(spark, small_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in stages["quality"])
    good = [i for i in before if labels.get(i) == 1]
    assert after < before and sum(i in after for i in good) >= 0.97 * len(good)


def test_no_shared_line_is_left(stages):
    seen = Counter()
    for r in stages["lines"][1].collect():
        for key in {x.strip(" \t\x0b\x0c\r").lower() for x in r.text.split("\n")}:
            seen[key] += len(key) >= 10
    assert max(seen.values()) == 1


def test_near_duplicates_leave_one_each(stages):
    before, after = stages["near_duplicates"]
    words = [(r.text or "").lower().split() for r in after.collect()]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]
    left = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert 0 < after.count() <= before.count() and left <= 0.02 * len(sets)


def test_mixture_and_packing_keep_words(stages):
    words = lambda d: sum(len(r.text.split()) for r in d.collect())
    before, after = stages["mixture"]
    assert abs(words(before) - words(after)) <= 0.03 * words(before)
    docs, packed = stages["packing"]
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert all(n <= 2048 for n in (r["sum(length)"] for r in packed.groupBy("sequence_id").sum("length").collect()))


def test_stages_take_odd_rows_and_empty_tables(spark, small_dir):
    """Nulls in any column, empty, repeated and very long texts, columns whose names clash; then no rows at all."""
    words = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without an id, but with words", "en", "a", 36), (4, words, "en", "b", 7), (5, "a short text of some words here", None, None, None)]
    rows += [(5, "a short text of some words here", None, None, None), (6, "x" * 1_000_000, "de", "b", 1_000_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema).selectExpr("*", "1 as Seq", "2 as h", "3 as component_id", "'z' as Text")
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, small_dir)
            assert name == "packing" or docs.columns == columns
        assert (docs.count() > 0) == (n > 0)


@pytest.mark.parametrize("name", [n for n in SQL if n.startswith("op")])
def test_query_is_its_sql(spark, small_dir, name):
    db = duckdb.connect()
    for f in os.listdir(small_dir):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small_dir}/{f}'")
    found = db.sql(SQL[name])
    df = entry.queries()[name](spark, small_dir).select(*found.columns)
    assert Counter(tuple(map(str, r)) for r in df.collect()) == Counter(tuple(map(str, r)) for r in found.fetchall())
