import statistics

import numpy as np

from corpusmill.operators import runs as R

TRACES = "key long, model string, status string, rounds long, prompt_tokens long, completion_tokens long, reasoning_tokens long, latency_s double, cost_usd double"
GATED = "key long, hard_fail boolean, hard array<string>, chars long, dup double, citations long"
JUDGED = "key long, judge string, valid boolean, total long"


def mean(xs, places=2):
    return int(statistics.fmean(xs) * 10**places + 0.5) / 10**places if xs else None


def place(xs):
    xs = sorted(xs)
    return float(xs[min(int(0.9 * len(xs)), len(xs) - 1)]) if xs else None


def test_summary_is_that_of_plain_lists(spark):
    r = np.random.default_rng(5)
    model = lambda i: "hot" if i % 3 else f"m{i % 5}"  # noqa: E731  two thirds of the rows have one model
    traces = [(i, model(i), [None, "ok", "ok", "error"][r.integers(4)], *(int(x) for x in r.integers(0, 3000, 4)), float(r.integers(0, 80)) / 8, float(r.integers(0, 64)) / 64) for i in range(120)]
    gated = [(i, bool(h), ["privacy_leak", "no_report"][: int(h)], *((int(r.integers(900)), float(r.integers(64)) / 64, int(r.integers(5))) if i % 4 else (None, None, None))) for i, h in enumerate(r.integers(0, 3, 120)) if i % 7]
    judged = [(int(i), j, [True, True, False, None][r.integers(4)], int(t) if t else None) for j in "ab" for i, t in enumerate(r.integers(0, 26, 110))]
    got = {x.model: x for x in R.model_summary(spark.createDataFrame(traces, TRACES).repartition(3), spark.createDataFrame(gated, GATED), spark.createDataFrame(judged, JUDGED)).collect()}
    assert set(got) == {model(i) for i in range(120)}
    for name, row in got.items():
        mine = [t for t in traces if t[1] == name]
        keys = {t[0] for t in mine}
        g = [x for x in gated if x[0] in keys]
        measured = [x for x in g if x[3] is not None]
        assert (row.n, row.errors) == (len(mine), sum(t[2] != "ok" for t in mine))
        assert row.hard_fail_rate == mean([x[1] for x in g])
        codes = [c for x in g for c in x[2]]
        assert (row.hard_codes or {}) == {c: codes.count(c) for c in codes}
        totals = {j: [t for k, q, ok, t in judged if k in keys and q == j and ok and t is not None] for j in "ab"}
        assert (row.judge_mean_total or {}) == {j: mean(v) for j, v in totals.items() if v}
        assert (row.chars_mean, row.chars_p90) == (mean([x[3] for x in measured]), place([x[3] for x in measured]))
        assert (row.dup_ratio_mean, row.citations_mean) == (mean([x[4] for x in measured]), mean([x[5] for x in measured]))
        assert (row.rounds_mean, row.completion_tokens_mean, row.latency_s_mean) == (mean([t[3] for t in mine]), mean([t[5] for t in mine]), mean([t[7] for t in mine]))
        assert row.total_tokens_p90 == place([t[4] + t[5] for t in mine]) and row.cost_usd_total == mean([sum(t[8] for t in mine)], 4)


def test_runs_without_gates_judges_or_traces(spark):
    empty = [spark.createDataFrame([], s) for s in (GATED, JUDGED)]
    row = R.model_summary(spark.createDataFrame([(1, "m", None, None, None, 4, None, None, None)], TRACES), *empty).first()
    assert (row.n, row.errors, row.completion_tokens_mean) == (1, 1, 4.0)
    assert [row[c] for c in ("hard_fail_rate", "hard_codes", "judge_mean_total", "chars_mean", "chars_p90", "rounds_mean", "total_tokens_p90", "cost_usd_total")] == [None] * 8
    assert R.model_summary(spark.createDataFrame([], TRACES), *empty).count() == 0
