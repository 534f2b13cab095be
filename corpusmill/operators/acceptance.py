"""Acceptance of traces and revisions: ordered reasons, judge comparisons, eligibility and window checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.selection import cascade, window_state


def selection_reason(min_score: float, excluded_warnings: list[str], slack: float = 3.0) -> Column:
    """Why a trace is not selected, over report, hard_fail, warn array, primary_valid, primary, secondary_valid, secondary."""
    secondary_low = F.coalesce(F.col("secondary_valid"), F.lit(False)) & (F.col("secondary") < min_score - slack)
    return cascade(
        ("no_report", ~F.coalesce(F.length("report") > 0, F.lit(False))),
        ("hard_fail", F.coalesce(F.col("hard_fail"), F.lit(True))),
        ("warn_excluded", F.arrays_overlap("warn", F.array(*[F.lit(w) for w in excluded_warnings]))),
        ("no_judge", ~F.coalesce("primary_valid", F.lit(False))),
        ("low_score", (F.col("primary") < min_score) | secondary_low),
    )


def judge_gains(after: Column, before: Column) -> Column:
    """Gains of the judges that both maps have."""
    shared = F.array_intersect(F.map_keys(after), F.map_keys(before))
    return F.transform(shared, lambda k: F.try_element_at(after, k) - F.try_element_at(before, k))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values))


def revision_reason(min_gain: float, drop: float, absolute: float) -> Column:
    """Why a revision is not accepted, over clean, looping, coverage, o_coverage, citations, judges map, o_judges map, primary name.

    Without the primary judge in common, a revision of an unjudged original needs the absolute score.
    """
    gains = judge_gains(F.col("judges"), F.col("o_judges"))
    shared = F.array_contains(F.map_keys("judges"), F.col("primary")) & F.array_contains(F.map_keys("o_judges"), F.col("primary"))
    alone = ~shared & (F.size("o_judges") == 0)
    score = F.try_element_at("judges", F.col("primary"))
    return cascade(
        ("gate", ~F.col("clean") | F.col("looping")),
        ("coverage_drop", F.col("coverage") < F.col("o_coverage") - drop),
        ("no_citations", F.col("citations") < 1),
        ("below_absolute", alone & (F.coalesce(score, F.lit(-1.0)) < absolute)),
        ("missing_judge", ~shared & ~alone),
        ("gain", shared & ((F.array_min(gains) < 0) | (mean(gains) < min_gain))),
    )


def revision_pair_reason(quality_gain: float, drop: float, absolute: float) -> Column:
    """Why an original and its revision do not make a pair, over kind (gate or quality), o_hard_fail and the columns above."""
    gains = judge_gains(F.col("judges"), F.col("o_judges"))
    score = F.try_element_at("judges", F.col("primary"))
    gain = score - F.try_element_at("o_judges", F.col("primary"))
    gate, quality = F.col("kind") == "gate", F.col("kind") == "quality"
    return cascade(
        ("revision_gate", ~F.col("clean")),
        ("original_clean", gate & ~F.col("o_hard_fail")),
        ("below_absolute", gate & (F.coalesce(score, F.lit(-1.0)) < absolute)),
        ("original_gate", quality & F.col("o_hard_fail")),
        ("worse", quality & (F.array_min(gains) < 0)),
        ("small_gain", quality & (F.coalesce(gain, F.lit(-1.0)) < quality_gain)),
        ("coverage_drop", quality & (F.col("coverage") < F.col("o_coverage") - drop)),
    )


def eligible(with_judges: bool) -> Column:
    """No reasons, and a judge's score or, without judges, a measured coverage."""
    return (F.size("reasons") == 0) & (F.col("judge").isNotNull() if with_judges else F.col("coverage").isNotNull())


def request_window(prompt: Column, reserve: int, stable: int, hard: int) -> Column:
    """Length state of a request with room for its output."""
    return window_state(prompt + reserve, stable, hard)


def loadable(max_len: int) -> Column:
    """Rows a trainer takes: no empty response, inside the limit; a row without rejected side is an anchor."""
    longest = F.size("prompt_ids") + F.greatest(F.size("chosen_ids"), F.coalesce(F.size("rejected_ids"), F.lit(0)))
    return (F.size("chosen_ids") > 0) & F.coalesce(F.size("rejected_ids") > 0, F.lit(True)) & (longest <= max_len)


def outbound(kind: Column, allowed: list[str]) -> Column:
    """May leave: only kinds on the list; everything else, null too, stays."""
    return F.coalesce(kind.isin(*allowed), F.lit(False))


def independent(review_digest: Column, digest: Column, reviewer: Column, author: Column, evidence: Column, known: Column) -> Column:
    """Reviewed by someone else, on the same digest, with evidence that is known."""
    same = review_digest.isNotNull() & (review_digest == digest)
    return F.coalesce(same & (reviewer != author) & (F.size(evidence) > 0) & (F.size(F.array_except(evidence, known)) == 0), F.lit(False))


def split_by_provenance(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synthetic traces, and all others as rejects."""
    synthetic = F.coalesce(F.col("provenance") == "synthetic", F.lit(False))
    return traces.where(synthetic), traces.where(~synthetic)


def by_digest(revisions: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """One revision per digest, and duplicates or rows without a well-formed digest as rejects."""
    from pyspark.sql import Window

    well = F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False))
    ranked = revisions.withColumn("_n", F.row_number().over(Window.partitionBy("digest").orderBy(*order)))
    reason = F.when(~well, "format").when(F.col("_n") > 1, "duplicate")
    return ranked.where(reason.isNull()).drop("_n"), ranked.where(reason.isNotNull()).withColumn("reason", reason).drop("_n")


def dataset_pairs(traces: DataFrame, max_total: int) -> DataFrame:
    """traces(case_id, path, sig, published, blocking array, terminal, synthetic, tokens) -> chosen and rejected paths of equal case and signature."""
    from corpusmill.operators.selection import best_per_group

    chosen = best_per_group(traces.where(F.col("published") & (F.size("blocking") == 0)), ["case_id"], ["path"]).select("case_id", "sig", F.col("path").alias("chosen"))
    pool = traces.where("synthetic").join(chosen, ["case_id", "sig"]).where((F.col("path") != F.col("chosen")) & (F.col("tokens") <= max_total))
    return best_per_group(pool, ["case_id"], [F.desc("terminal"), "path"]).select("case_id", "chosen", F.col("path").alias("rejected"))
