"""Dataset builds: training rows with named rejections, exclusion lists, audits, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.selection import cascade, hash_fraction, window_state


def row_reasons(max_total: int) -> Column:
    """Why a preference row is rejected, first reason only; null for a good one.

    Works on prompt_ids, chosen_ids, rejected_ids (null for anchors), c_start, r_start, published, synthetic,
    tokens_said (the prompt length that the trace recorded).
    """
    total = F.size("prompt_ids") + F.greatest(F.size("chosen_ids"), F.coalesce(F.size("rejected_ids"), F.lit(0)))
    return cascade(
        ("not_synthetic", ~F.col("synthetic")),
        ("not_published", ~F.col("published")),
        ("empty_prompt", F.size("prompt_ids") == 0),
        ("empty_chosen", F.size("chosen_ids") == 0),
        ("empty_rejected", F.size("rejected_ids") == 0),
        ("token_boundary_invalid", (F.col("c_start") != F.size("prompt_ids")) | (F.col("rejected_ids").isNotNull() & (F.col("r_start") != F.size("prompt_ids")))),
        ("prompt_tokens_mismatch", F.col("tokens_said") != F.size("prompt_ids")),
        ("identical_response_tokens", F.col("chosen_ids") == F.col("rejected_ids")),
        ("over_max_len", total > max_total),
    )


def window_guard(stable: int, hard: int) -> Column:
    """Length state of a preference row: prompt and the longer response."""
    return window_state(F.size("prompt_ids") + F.greatest(F.size("chosen_ids"), F.coalesce(F.size("rejected_ids"), F.lit(0))), stable, hard)


def excluded(rows: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the list."""
    return rows.join(exclusions.select(key).distinct(), key, "left_anti")


def manifest(rows: DataFrame, kind: str, tokens: Column) -> DataFrame:
    """One row per kind and one over all (kind null): rows, tokens, longest, mean."""
    sized = rows.select(F.col(kind).alias("kind"), tokens.alias("tokens"))
    return sized.rollup("kind").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.avg("tokens").alias("mean"))


def blind_sides(pairs: DataFrame, pair_id: str, seed: str) -> DataFrame:
    """Adds first_is_a: which side of a pair is shown as A, by hash; the answer key for unmasking."""
    return pairs.withColumn("first_is_a", hash_fraction(F.lit(seed), F.col(pair_id)) < 0.5)


def audit_status(sample: DataFrame, reviews: DataFrame) -> DataFrame:
    """sample(pair_id, chosen_side, digest), reviews(pair_id, winner, passed, digest) -> one row: status, reviewed, sampled.

    failed on any false pass, tie or other winner; pending while reviews are missing or their digest differs; else passed.
    """
    joined = sample.join(reviews.select("pair_id", "winner", "passed", F.col("digest").alias("r_digest")), "pair_id", "left")
    seen = F.col("r_digest").isNotNull() & (F.col("r_digest") == F.col("digest"))
    bad = seen & (~F.coalesce("passed", F.lit(False)) | ~F.coalesce(F.col("winner") == F.col("chosen_side"), F.lit(False)))
    counted = joined.agg(F.count("*").alias("sampled"), F.count_if(seen).alias("reviewed"), F.count_if(bad).alias("failing"))
    status = F.when(F.col("failing") > 0, "failed").when((F.col("reviewed") < F.col("sampled")) | (F.col("sampled") == 0), "pending").otherwise("passed")
    return counted.select(status.alias("status"), "sampled", "reviewed")


def unanimous(reviews: DataFrame) -> DataFrame:
    """reviews(pair_id, reviewer, winner, passed) -> pair_id, winner (tie unless all agree), passed (all)."""
    return reviews.groupBy("pair_id").agg(F.when(F.countDistinct("winner") == 1, F.min("winner")).otherwise("tie").alias("winner"), F.bool_and("passed").alias("passed"))


def split_leak(rows: DataFrame, split: str, digest: Column) -> DataFrame:
    """left, right, shared: distinct digests that two splits have in common."""
    keyed = rows.select(F.col(split).alias("split"), digest.alias("digest")).distinct()
    sets = keyed.groupBy("digest").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    pairs = sets.select(F.explode(F.expr("flatten(transform(splits, a -> transform(filter(splits, b -> b > a), b -> struct(a as left, b as right))))")).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.count("*").alias("shared"))
