"""Work that must not grow faster than its tables: what moves between tasks, what is computed twice, how much passes to Python or the driver at once."""

import re
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import checks, evidence, judging, markdown, metrics, ngrams, reports, runs, seeding, sourcing
from corpusmill.plans import checks as plans_checks
from corpusmill.plans import choosing
from corpusmill.plans import evidence as plans_evidence
from corpusmill.plans import quality as plans_quality
from corpusmill.plans import runs as plans_runs
from corpusmill.plans import sourcing as plans_sourcing
from corpusmill.sources import scratch
from corpusmill.streaming import budgets


def plan_of(df):
    return df._jdf.queryExecution().toString()


TEXTS = [(1, "a b a b a b c a b a b"), (2, "One"), (3, None), (4, "x y z " * 40), (5, "!"), (6, "p q r s t u v w")]


def in_rows_and_long(spark, measure, columns):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    tokens = docs.select(F.col("doc_id").alias("doc"), F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    return {tuple(r) for r in ngrams.per_sequence(docs, "doc_id", "text", measure, columns).collect()}, tokens


def test_drafts_are_walked_where_the_texts_stand(spark):
    got, tokens = in_rows_and_long(spark, ngrams.drafts_of(2, 8), ("steps", "accepted"))
    assert got == {tuple(r) for r in ngrams.speculation(tokens, 2, 8).collect()} and {r[0] for r in got} == {1, 2, 4, 6}


def test_loops_and_repeats_are_counted_where_the_texts_stand(spark):
    got, tokens = in_rows_and_long(spark, ngrams.loops_of(2, 3), ("covered",))
    assert got == {tuple(r) for r in ngrams.loop_coverage(ngrams.sequence_grams(tokens, 2), 2, 3).collect()} and {r[0] for r in got} == {1, 4}
    got, _ = in_rows_and_long(spark, ngrams.repeats_of(4), ("repeated", "total"))
    assert got == {tuple(r) for r in ngrams.seen_before(ngrams.sequence_grams(tokens, 4)).collect()}


def test_seeded_items_move_no_text(spark):
    texts = spark.createDataFrame([("r", "# A\nb\n## 致因分析\nc\n"), ("s", "x")], "report_id string, text string").repartition(3)
    items = judging.seeded_items(texts.localCheckpoint())
    assert "Exchange" not in plan_of(items) and "Sort" not in plan_of(items)
    assert sorted(items.collect()) == sorted(judging.calibration_plan(texts).collect())


def test_rows_pass_to_python_in_small_batches(spark):
    rows = spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = scratch.stored_in_small_batches(rows.mapInPandas(lambda batches: (b.head(1).assign(n=len(b))[["n"]] for b in batches), "n long"), "sizes")
    found = [r.n for r in sizes.collect()]
    assert sum(found) == 3000 and max(found) * 10_000 <= 2 * scratch.BATCH_BYTES


def test_sanitising_a_table_walks_each_text_once(spark):
    texts = ["a\n# B\nc", "```md\n```", "", None, "<think>x</think> # A\nb", "x\r\ny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    clean = markdown.sanitised(rows, "text")
    twice = clean.select("i", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"))
    assert plan_of(twice).split("Physical Plan")[1].count("walk(") == 1
    assert sorted(clean.collect()) == sorted(rows.select("i", markdown.sanitise(F.col("text")).alias("text")).collect())


def test_recall_looks_for_the_facts_pairs_alone(spark):
    rows = spark.createDataFrame([("abc d", ["abcd", "x", "xy", "ab zz"]), ("", ["ab"]), ("aab", [])], "report string, facts array<string>")
    found = rows.select(reports.fact_recall(F.col("facts"), F.col("report")).alias("x"))
    assert [r.x for r in found.collect()] == [1 / 3, 0.0, 0.0]
    assert "array_intersect" not in plan_of(found)


def test_fold_coverage_counts_the_words_once(spark, small_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(choosing, "stored", lambda df, name: kept.append(name) or scratch.stored(df, name))
    assert "RegExpExtractAll" not in plan_of(choosing.fold_coverage(spark, small_dir)) and kept == ["counts"]


def test_a_scope_writes_a_call_once_a_batch_and_has_one_timer():
    class Store:
        def __init__(self):
            self.entries, self.writes, self.reads = {}, 0, 0

        def exists(self):
            return () in self.entries

        def get(self):
            return self.entries[()]

        def update(self, value):
            self.entries[()] = value

        def clear(self):
            self.entries.pop((), None)

        def containsKey(self, key):
            self.reads += 1
            return key in self.entries

        def getValue(self, key):
            return self.entries[key]

        def updateValue(self, key, value):
            self.writes += 1
            self.entries[key] = value

        def removeKey(self, key):
            del self.entries[key]

        def iterator(self):
            return iter(list(self.entries.items()))

    class Handle:
        timers = []
        getValueState = getMapState = lambda self, *a: Store()

        def registerTimer(self, at):
            self.timers.append(at)

    ledger = budgets.Reservations(1000.0, 100)
    ledger.init(Handle())
    rows = [("reserved", c, float(i)) for i in range(30) for c in ("a", "b")] + [("completed", "b", 1.0)]
    batch = pd.DataFrame([(e, c, i, usd, i) for i, (e, c, usd) in enumerate(rows)], columns=["event", "call_id", "seq", "usd", "at"])
    out = pd.concat(ledger.handleInputRows(("s",), iter([batch]), None))
    assert list(out.outcome) == ["granted"] * 60 and ledger.committed.get() == (30.0,)
    assert (ledger.held.writes, ledger.actual.writes, ledger.held.reads, len(Handle.timers)) == (1, 1, 0, 1)
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 158)
    late = pd.concat(ledger.handleExpiredTimer(("s",), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: 158)))
    assert late.values.tolist() == [["s", "a", 58, "unsettled"]] and not ledger.timer.exists()


def test_gates_store_rows_without_what_was_thought(spark, small_dir, monkeypatch):
    kept = {}
    monkeypatch.setattr(evidence, "stored_in_small_batches", lambda df, name: kept.setdefault(name, df) and scratch.stored_in_small_batches(df, name))
    plan = plan_of(plans_evidence.all_gates(spark, small_dir))
    assert "reasoning" not in kept["traces"].columns and "documents.parquet" not in plan.split("Physical Plan")[1]


def test_source_errors_keep_texts_and_quotes_once_a_case(spark, small_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(sourcing, "_stored", lambda df, name: kept.append((name, df.columns)) or scratch.stored(df, name))
    found = plans_sourcing.source_errors(spark, small_dir)
    assert {n for n, _ in kept} >= {"kinds", "splices", "claims", "calls", "failures"} and not [n for n, c in kept if {"report", "quote"} & set(c)]
    assert found.where("kind = 'several' and taken").count() > 0


def test_checks_cut_a_claim_into_sentences_once(spark):
    """A step's plan names an expression as often as it is computed."""
    rows = spark.createDataFrame([("a. b", "a", "b")], "text string, field string, value string")
    local = plan_of(rows.select(metrics.local_sentence(F.col("text"), F.col("field"), F.col("value")).alias("x"))).split("Physical Plan")[1]
    assert local.count("split(text") == 1
    names = plan_of(rows.select(checks.possible_fields(F.col("text")).alias("x"))).split("Physical Plan")[1]
    assert names.count("split(") == 1
    used = spark.createDataFrame([("c", "1", 0, "f", "v", "fact", "f: v")], "case_id string, claim_id string, no int, field string, value string, kind string, text string")
    assert plan_of(checks.claim_alignment(used, None, None)).split("Physical Plan")[1].count("regexp_extract_all(") == 1


def test_cases_write_their_texts_once(spark, small_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(plans_checks, "stored", lambda df, name: kept.append((name, df.columns)) or scratch.stored(df, name))
    plans_checks.cases_of(spark, small_dir)
    assert [n for n, columns in kept if {"text", "report"} & set(columns)] == ["cases"]


def test_a_report_moves_once_for_all_checks(spark, small_dir, monkeypatch):
    kept = {}
    monkeypatch.setattr(checks, "stored", lambda df, name: kept.setdefault(name, df) and scratch.stored(df, name))
    plan = plan_of(checks.field_checks(**plans_checks.cases_of(spark, small_dir))).split("Physical Plan")[1]
    reads = [line for line in plan.split("Join")[1:] if "report#" in line.split("\n")[0]]
    assert "told" in kept and not reads and "report#" not in plan_of(kept["used"]).split("Physical Plan")[1]


def broadcast_by(*frames):
    """The first keys of the joins for which a side is gathered and broadcast, nothing at all among them."""
    return {k for df in frames for k in re.findall(r"BroadcastHashJoin \[(\w+)#|(BroadcastNestedLoopJoin)", plan_of(df)) for k in k if k}


def keeping(monkeypatch, kept, *modules):
    """The tables that the modules store."""
    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, name: kept.append(df) or scratch.stored(df, name))


def test_a_run_summary_broadcasts_no_table_by_trace(spark, small_dir, monkeypatch):
    kept = []
    keeping(monkeypatch, kept, plans_runs, runs)
    found = plans_runs.run_summary(spark, small_dir)
    assert len(kept) == 4 and broadcast_by(found, *kept) <= {"model"}


def test_gates_broadcast_no_table_by_trace(spark, small_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(evidence, "stored_in_small_batches", lambda df, name: kept.append(df) or scratch.stored_in_small_batches(df, name))
    assert not broadcast_by(plans_evidence.all_gates(spark, small_dir), *kept) and len(kept) == 1


def test_seeded_errors_broadcast_no_table_by_case(spark, small_dir, monkeypatch):
    kept = []
    keeping(monkeypatch, kept, seeding, metrics)
    assert not broadcast_by(plans_quality.seeded_errors(spark, small_dir), *kept) and len(kept) == 9
