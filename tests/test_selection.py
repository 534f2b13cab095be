import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import datasets as D
from corpusmill.operators import selection as S

CANDIDATE = "case_id string, sig string, name string, reasons array<string>, score double, reasoning_chars long"


def pairs(spark, rows, margin=1.0):
    return [tuple(r) for r in S.preference_pairs(spark.createDataFrame(rows, CANDIDATE), margin).collect()]


def test_terminal_failures_come_first_and_gate_failures_are_never_chosen(spark):
    rows = [("c", "s", "best", [], 20.0, 100), ("c", "s", "top_but_gated", ["hard_gate"], 25.0, 90), ("c", "s", "loop_far", ["loop"], None, 900), ("c", "s", "loop_near", ["loop"], None, 120)]
    assert pairs(spark, rows) == [("c", "best", "loop_near", "terminal")]


def test_signature_must_agree_and_margin_holds(spark):
    rows = [("c", "s", "best", [], 20.0, 100), ("c", "other", "low", [], 5.0, 100), ("c", "s", "close", [], 19.5, 100)]
    assert pairs(spark, rows) == []
    assert pairs(spark, [*rows, ("c", "s", "low", [], 12.0, 50)]) == [("c", "best", "low", "quality")]


def test_ties_prefer_shorter_reasoning(spark):
    rows = [("c", "s", "long", [], 20.0, 300), ("c", "s", "short", [], 20.0, 100), ("c", "s", "bad", ["truncated"], None, 1)]
    assert pairs(spark, rows) == [("c", "short", "bad", "terminal")]


def test_unique_selection_keeps_caps_and_calls_and_is_the_same_again(spark):
    rows = [("b", f"call{i // 3}", f"p{i}", ("revised", "seeded", "anchor")[i % 3], 100 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "batch string, call string, pair_id string, kind string, tokens long")
    caps = {"revised": 6, "seeded": 4, "anchor": 3}
    first = S.select_unique(df, "7", caps, 4000, 5).join(df, ["batch", "pair_id"]).collect()
    again = S.select_unique(df.repartition(7), "7", caps, 4000, 5).collect()
    assert len({r.call for r in first}) == len(first) == 13
    assert sum(r.tokens > 4000 for r in first) >= 5
    assert {r.pair_id for r in first} == {r.pair_id for r in again}


def test_stratified_sample_meets_the_minimum(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, kind string")
    got = S.stratified_sample(df, "kind", S.hash_order(F.col("id")), 0.2, 15).collect()
    assert len(got) == 15 and len({r.id for r in got}) == 15 and {r.kind for r in got} == {"a", "b"}
    small = S.stratified_sample(df.limit(4), "kind", S.hash_order(F.col("id")), 0.2, 15).collect()
    assert len(small) == 4


def test_audit_states(spark):
    sample = spark.createDataFrame([("p", "A", "d"), ("q", "B", "e")], "pair_id string, chosen_side string, digest string")
    review = lambda *rows: D.audit_status(sample, spark.createDataFrame(list(rows), "pair_id string, winner string, passed boolean, digest string")).first().status
    assert review(("p", "A", True, "d")) == "pending"
    assert review(("p", "A", True, "d"), ("q", "B", True, "x")) == "pending"
    assert review(("p", "A", True, "d"), ("q", "tie", True, "e")) == "failed"
    assert review(("p", "A", True, "d"), ("q", "B", True, "e")) == "passed"


def test_row_reasons(spark):
    schema = "synthetic boolean, published boolean, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>, c_start int, r_start int, tokens_said int"
    good = [True, True, [1, 2], [3], [4], 2, 2, 2]
    changes = {None: {}, "not_published": {1: False}, "empty_chosen": {3: []}, "token_boundary_invalid": {5: 1}, "prompt_tokens_mismatch": {7: 9}, "identical_response_tokens": {4: [3]}, "over_max_len": {3: [5] * 20}}
    for reason, change in changes.items():
        row = [change.get(i, v) for i, v in enumerate(good)]
        assert spark.createDataFrame([tuple(row)], schema).select(D.row_reasons(10).alias("r")).first().r == reason


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 5, 3]), ([1], [1, 2]), ([1], [1])], "a array<int>, b array<int>")
    assert [r.x for r in df.select(S.first_difference(F.col("a"), F.col("b")).alias("x")).collect()] == [1, 1, None]
    assert df.select(S.label_mask(F.col("a"), F.col("b")).alias("x")).first().x == [-100, -100, -100, 1, 5, 3]
    states = spark.createDataFrame([(1,), (6,), (11,), (None,)], "n int").select(S.window_state(F.col("n"), 5, 10).alias("s")).collect()
    assert [r.s for r in states] == ["pass", "warn", "fail", "unknown"]


def chosen_by_hand(rows, seed, pairs, anchors, seeded, originals, min_long, long_tokens):
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.sha256((r[0] + seed + r[1]).encode()).hexdigest())
    used, n, out = set(), dict.fromkeys(("revised", "seeded", "anchor_revised", "anchor"), 0), []
    for want_long in (True, False):
        for kind in ("revised", "anchor_revised", "seeded", "anchor"):
            for call, pair, k, tokens in order:
                pair_kind = k in ("revised", "seeded")
                if k != kind or call in used or want_long and (tokens <= long_tokens or sum(t > long_tokens for *_, t in out) >= min_long):
                    continue
                full = n["revised"] + n["seeded"] >= pairs if pair_kind else n["anchor_revised"] + n["anchor"] >= anchors
                if full or k == "seeded" and n[k] >= seeded or k == "anchor" and n[k] >= originals:
                    continue
                used.add(call)
                n[k] += 1
                out.append((call, pair, k, tokens))
    return {r[1]: i for i, r in enumerate(out)}


@pytest.mark.parametrize("seed", range(4))
def test_shared_caps_are_those_of_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(f"c{r.randint(0, 25)}", f"p{i}", r.choice(["revised", "seeded", "anchor_revised", "anchor", "other"]), r.randint(1, 100)) for i in range(80)]
    caps = {"pairs": r.randint(0, 12), "anchors": r.randint(0, 8), "seeded": r.randint(0, 5), "originals": r.randint(0, 4), "min_long": r.randint(0, 9), "long_tokens": 70}
    df = spark.createDataFrame(rows, "call string, pair_id string, kind string, tokens long")
    got = S.select_shared(df, "s", **caps).collect()
    assert len(got) == 80
    assert {x.pair_id: x.place for x in got if x.place is not None} == chosen_by_hand([x for x in rows if x[2] != "other"], "s", **caps)
