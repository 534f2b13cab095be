"""The best documents by BM25, scored where the documents stand."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import patterns
from corpusmill.operators import retrieval as R


def test_best_of_each_kind_as_by_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11}" for k in range(1, i % 9 + 2))) for i in range(60)] + [(60, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"w{t}") for q in range(4) for t in range(q, 2 * q + 3)], "query long, token string")
    tokens = T.keyword_tokens(F.col("text"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean")).first()
    every = R.bm25_scores(R.postings(docs, "doc_id", tokens, queries), queries, stats["n"], stats["mean"]).withColumn("kind", (F.col("doc") % 2).cast("int"))
    first = lambda df: sorted((x.query, x.kind, x.n, x.doc, round(x.score, 8)) for x in df.withColumn("n", F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("score"), "doc"))).where("n <= 5").collect())
    want = first(every)
    best = R.bm25_best(docs, "doc_id", tokens, queries, 5, 2)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
    assert first(best) == want
    monkeypatch.setattr(R, "SHARD_TOKENS", 6)
    assert first(R.bm25_best(docs, "doc_id", tokens, queries, 5, 2)) == want


def test_an_article_meets_only_items_of_a_law_that_its_record_names(spark):
    records = spark.createDataFrame([(1, "甲法第五条"), (2, "乙法第5条"), (3, "甲法乙法第5条第五条"), (4, "第五条")], "r long, text string")
    items = spark.createDataFrame([(1, "甲法", 5), (2, "乙法", 5), (3, "丙法", 5), (4, "甲法", 6), (5, "甲法", 5)], "i long, law string, number long")
    got = sorted(map(tuple, patterns.article_targets(records, "r", "text", items, "i").collect()))
    assert got == [(1, 1, 2), (1, 3, 4), (2, 2, 2), (2, 3, 4), (5, 1, 2), (5, 3, 4)]
