"""Summaries of runs: order statistics, paired comparison, bootstrap, roll-ups, pivots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.scratch import stored

RANGES = 64


def joined_by(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Rows of both sides with equal groups; a null is a group like any other."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in group})
    return left.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])).drop(*[f"_of_{c}" for c in group])


def exact_floor_percentiles(df: DataFrame, group: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """group.., and for each name: q of places sorted[min(floor(q * n), n - 1)] of each group's values that are not null.

    Equal values are counted first, once for all places. Counts are then summed over ranges of values between
    rough quantiles of the group, and only the ranges that hold a wanted place are put in order, so no group
    is gathered in one task, however many values it has. Rough quantiles differ from one run to the next,
    so they are stored: both readings deal the counts by the same ones.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    cuts = stored(counts.groupBy(*group).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts")), "cuts")
    dealt = joined_by(counts, cuts, group).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    mine = Window.partitionBy(*group)
    sums = dealt.groupBy(*group, "_range").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumns({"_n": F.sum("_s").over(mine), "_upto": F.sum("_s").over(mine.orderBy("_range"))})
    asked = sums.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(q).alias("q")) for k, q in places.items()])))
    asked = asked.withColumn("_wanted", F.least(F.floor(F.col("_q.q") * F.col("_n")), F.col("_n") - 1)).where((F.col("_upto") > F.col("_wanted")) & (F.col("_upto") - F.col("_s") <= F.col("_wanted")))
    holding = stored(asked.select(*group, "_range", F.col("_q.name").alias("_name"), (F.col("_wanted") - F.col("_upto") + F.col("_s")).alias("_left")), "ranges")
    reached = joined_by(dealt, holding, [*group, "_range"]).withColumn("_reached", F.sum("_c").over(Window.partitionBy(*group, "_name").orderBy("_v"))).where(F.col("_reached") > F.col("_left"))
    return reached.groupBy(*group).agg(*[F.min(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places])


def exact_floor_percentile(df: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """group.., percentile; see exact_floor_percentiles()."""
    return exact_floor_percentiles(df, group, value, {"percentile": q})


def nearest_rank(value: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def code_counts(df: DataFrame, group: list[str], codes: str) -> DataFrame:
    """group, code, n."""
    return df.select(*group, F.explode(codes).alias("code")).groupBy(*group, "code").agg(F.count("*").alias("n"))


def worst_status(status: Column) -> Column:
    """Roll-up of pass, unknown, fail: fail beats unknown beats pass; null without rows."""
    rank = F.max(F.when(status == "fail", 2).when(status == "unknown", 1).when(status == "pass", 0))
    return F.when(rank == 2, "fail").when(rank == 1, "unknown").when(rank == 0, "pass")


def paired(df: DataFrame, key: list[str], system: str, value: str, left: str, right: str, tie: float = 0.0) -> DataFrame:
    """One row: pairs, wins, ties, losses of left against right on equal keys, and the mean difference."""
    one = lambda name, alias: df.where(F.col(system) == name).groupBy(*key).agg(F.avg(value).alias(alias))
    both = one(left, "a").join(one(right, "b"), key).withColumn("d", F.col("a") - F.col("b"))
    return both.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("d") > tie).alias("wins"),
        F.count_if(F.abs("d") <= tie).alias("ties"),
        F.count_if(F.col("d") < -tie).alias("losses"),
        F.avg("d").alias("mean_difference"),
    )


def bootstrap_means(df: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """replicate, mean: means of resamples of as many rows as there are, by Poisson weights.

    A row stands in a resample as often as a Poisson variable of mean 1 says, so a value that occurs c
    times weighs in by one of mean c: only the histogram of values is drawn for. Each value's draws are
    seeded by the value, so reruns agree, and the tasks sum weights and weighted values per replicate.
    Null values are left out; without values there are no rows.
    """
    histogram = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")).withColumn("h", F.abs(F.xxhash64("v")))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, sums = np.zeros(resamples), np.zeros(resamples)
        seen = False
        for batch in batches:
            for v, c, h in zip(batch.v, batch.c, batch.h, strict=True):
                w = np.random.default_rng([seed, h]).poisson(c, resamples)
                weights, sums, seen = weights + w, sums + w * v, True
        if seen:
            yield pd.DataFrame({"replicate": np.arange(resamples), "w": weights, "s": sums})

    parts = histogram.mapInPandas(draw, "replicate long, w double, s double")
    return parts.groupBy("replicate").agg((F.sum("s") / F.sum("w")).alias("mean"))


def bootstrap_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    return replicates.agg(nearest_rank("mean", low).alias("low"), nearest_rank("mean", 1 - low).alias("high"))


def pivot_against(df: DataFrame, row: str, column: str, values: list, measure: Column, base: str) -> DataFrame:
    """A pivot table, and each cell as a ratio to the base row's cell; the base row is one row."""
    table = df.groupBy(row).pivot(column, values).agg(measure)
    names = [str(v) for v in values]
    basis = table.where(F.col(row) == base).select(*[F.col(f"`{n}`").alias(f"_{n}") for n in names])
    out = table.join(F.broadcast(basis))
    return out.select(row, *[F.col(f"`{n}`").alias(f"v_{n}") for n in names], *[(F.col(f"`{n}`") / F.col(f"_{n}")).alias(f"ratio_{n}") for n in names])


def vector_means(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group, i, mean: component means, kept long."""
    return df.select(*group, F.posexplode(vector).alias("i", "x")).groupBy(*group, "i").agg(F.avg("x").alias("mean"))


def leave_one_out(df: DataFrame, key: str, vector: str) -> DataFrame:
    """df(key, vector), a row per key -> key, cosine of its vector with the mean of all others'; null for a single row.

    The mean of the others is (sum - own) / (n - 1); sums are by component, so no vector but a row's own is held.
    """
    long = df.select(key, F.posexplode(vector).alias("i", "x"))
    sums = long.groupBy("i").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    both = long.join(sums, "i").withColumn("rest", F.when(F.col("n") > 1, (F.col("total") - F.col("x")) / (F.col("n") - 1)))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    return both.groupBy(key).agg((dot("x", "rest") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("rest", "rest")) + F.lit(1e-12))).alias("cosine"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_statistics(df: DataFrame, vector: str, top: int) -> DataFrame:
    """i, mean, std, rms, snr, peak of each component over all rows: the `top` of the highest |mean| / std."""
    long = df.select(F.posexplode(vector).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return stats.withColumn("snr", F.abs("mean") / F.col("std")).orderBy(F.desc("snr"), "i").limit(top)


def blended_vocabulary(tokens: DataFrame, prior: DataFrame, weight: float, top: int, forced: list[str]) -> DataFrame:
    """tokens(token, n), prior(token, n) -> the top tokens by share + weight * prior share; forced tokens always."""
    total = tokens.agg(F.sum("n").alias("t"))
    prior_total = prior.agg(F.sum("n").alias("pt"))
    both = tokens.select("token", F.col("n").alias("a")).join(prior.select("token", F.col("n").alias("p")), "token", "full")
    rows = both.join(F.broadcast(total)).join(F.broadcast(prior_total))
    score = F.coalesce(F.col("a") / F.col("t"), F.lit(0.0)) + weight * F.coalesce(F.col("p") / F.col("pt"), F.lit(0.0))
    listed = F.col("token").isin(*forced) if forced else F.lit(False)
    return rows.select("token", score.alias("score"), listed.alias("forced")).orderBy(F.desc("forced"), F.desc("score"), "token").limit(top)


def gram_sums(rows: DataFrame, features: str, target: str, block: int = 4096) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, X'X and X'y of rows(features array<double>, target double): tasks sum blocks of rows, and their sums are added as a tree.

    Rows with nulls or non-finite numbers, or of another width than the widest, take no part. What
    reaches the driver is one matrix of the width squared, which must be moderate.
    """
    x = F.col(features).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col(target).isNotNull() & ~F.isnan(target)
    sound = rows.where(F.coalesce(fine, F.lit(False)))
    width = sound.agg(F.max(F.size(x))).first()[0]
    if not width:
        return 0, np.zeros((0, 0)), np.zeros(0)
    wide = sound.where(F.size(x) == width).select(x.alias("x"), F.col(target).cast("double").alias("y"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((width + 1, width + 1)), 0
        for batch in batches:
            for at in range(0, len(batch), block):
                some = batch.iloc[at : at + block]
                both = np.column_stack([np.stack(some.x.to_list()), some.y.to_numpy()])
                total, n = total + both.T @ both, n + len(both)
        yield pd.DataFrame({"v": [np.append(total.ravel(), n)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1) ** 2 + 1)
        for batch in batches:
            for v in batch.v:
                total = total + v
        yield pd.DataFrame({"v": [total]})

    sums, parts = wide.mapInPandas(partial, "v array<double>"), wide.rdd.getNumPartitions()
    while parts > 1:  # eight sums meet in a task
        parts = -(-parts // 8)
        sums = sums.repartition(parts).mapInPandas(added, "v array<double>")
    flat = np.sum([r.v for r in sums.collect()], axis=0)
    matrix = flat[:-1].reshape(width + 1, width + 1)
    return int(flat[-1]), matrix[:-1, :-1], matrix[:-1, -1]


def ridge_weights(rows: DataFrame, features: str, target: str, strength: float) -> np.ndarray:
    """Weights v of (G + strength * trace(G) / d * I) v = s, by Cholesky factors, scaled so that v's mean gain v's is one.

    G and s are the means of xx' and xy. No rows, or a target that no feature goes with: no weights (empty).
    """
    n, gram, cross = gram_sums(rows, features, target)
    if not n or not np.abs(cross).max() > 0:
        return np.zeros(0)
    gram, cross = gram / n, cross / n
    d = len(cross)
    lower = np.linalg.cholesky(gram + strength * np.trace(gram) / d * np.eye(d))
    v = np.linalg.solve(lower.T, np.linalg.solve(lower, cross))
    return v / (v @ cross)
