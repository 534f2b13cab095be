"""Selection: rejection cascades, choices per group, pairs, quotas, hold-outs, hash samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import matching


def cascade(*steps: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; null where none does (a null condition does not hold)."""
    out = F.when(F.coalesce(steps[0][1], F.lit(False)), F.lit(steps[0][0]))
    for name, condition in steps[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out


def hash_fraction(*parts: Column) -> Column:
    """The first 32 bits of SHA-256 over the colon-joined parts, as a share of 0xFFFFFFFF: the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def hash_order(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def fold(group: Column, k: int) -> Column:
    """A group's fold among k, from the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 8), 16, 10).cast("long") % k


def best_per_group(df: DataFrame, group: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def preference_pairs(candidates: DataFrame, margin: float) -> DataFrame:
    """candidates(case_id, sig, name, reasons array, score, reasoning_chars) -> one chosen-rejected pair per case.

    Chosen: no reasons, highest score, then shortest reasoning. Rejected: same case and signature; failures
    that end a generation first (nearest reasoning length), then other gate failures, then rows whose
    score is lower by `margin` or more (lowest first). Names break ties.
    """
    terminal = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in ("truncated", "loop", "no_report")]))
    ranked = candidates.where(F.size("reasons") == 0).where("score is not null")
    chosen = best_per_group(ranked, ["case_id"], [F.desc("score"), "reasoning_chars", "name"]).drop("place")
    chosen = chosen.select("case_id", "sig", F.col("name").alias("chosen"), F.col("score").alias("chosen_score"), F.col("reasoning_chars").alias("chosen_chars"))
    pool = candidates.join(chosen, ["case_id", "sig"]).where(F.col("name") != F.col("chosen"))
    kind = F.when(terminal, 0).when(F.size("reasons") > 0, 1).when(F.col("score") <= F.col("chosen_score") - margin, 2)
    pool = pool.withColumn("kind", kind).where("kind is not null")
    key = F.when(F.col("kind") == 0, F.abs(F.col("reasoning_chars") - F.col("chosen_chars")).cast("double")).when(F.col("kind") == 2, F.col("score")).otherwise(0.0)
    best = best_per_group(pool.withColumn("key", key), ["case_id"], ["kind", "key", "name"])
    names = F.element_at(F.array(F.lit("terminal"), F.lit("gate"), F.lit("quality")), F.col("kind") + 1)
    return best.select("case_id", "chosen", F.col("name").alias("rejected"), names.alias("kind"))


def round_robin(df: DataFrame, kind: str, order: list[str], per_kind: int, total: int, family: str | None = None, per_family: int = 0) -> DataFrame:
    """Rows taken in turns over kinds: per_kind of each at most, per_family of each family among those, total at most.

    The quotas cut each kind first, so the last rankings see at most kinds * per_kind rows.
    """
    mine = best_per_group(df, [kind], order, per_kind)
    if family is not None:
        turn = Window.partitionBy(family).orderBy("place", kind)
        mine = mine.withColumn("_f", F.row_number().over(turn)).where(F.col("_f") <= per_family).drop("_f")
    return mine.orderBy("place", kind).limit(total)


def global_rank(df: DataFrame, order: list[str], name: str, ranges: int = 200) -> DataFrame:
    """Adds each row's place, from 0, in the order over the whole table; equal rows have places next to each other.

    Rows are dealt over ranges between keys drawn by hash, ranked inside their range, and moved up by
    the sizes of the ranges before, so no task holds the table.
    """
    key = F.struct(*order)
    drawn = df.select(*order).distinct().orderBy(F.xxhash64(*order), *order).limit(10 * ranges).orderBy(*order).collect()  # 10 * ranges keys
    cuts = drawn[:: max(1, len(drawn) // ranges)][1:]
    types = [df.schema[c].dataType for c in order]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, types, order, strict=True)]) for r in cuts])
    place = F.size(F.filter(bounds, lambda b: b <= key)) if cuts else F.lit(0)
    dealt = df.withColumn("_range", place)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_range", before.alias("_base"))  # a row per range
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(bases), "_range").withColumn(name, F.col("_at") + F.col("_base")).drop("_range", "_at", "_base")


def stratified_sample(df: DataFrame, kind: str, key: Column, fraction: float, minimum: int) -> DataFrame:
    """Of each kind max(1, ceil(n * fraction)) rows by hash order; if that is fewer than minimum, more from the rest."""
    mine = Window.partitionBy(kind).orderBy("_key")
    rows = df.withColumn("_key", key)
    sizes = df.groupBy(kind).agg(F.greatest(F.ceil(F.count("*") * fraction), F.lit(1)).alias("_quota"))
    ranked = rows.withColumn("_n", F.row_number().over(mine)).join(sizes, kind)
    first = ranked.where("_n <= _quota")
    rest = ranked.where("_n > _quota").orderBy("_key").limit(minimum).withColumn("_m", F.row_number().over(Window.orderBy("_key")))
    taken = first.agg(F.count("*").alias("_taken"))
    more = rest.join(F.broadcast(taken)).where(F.col("_m") <= F.lit(minimum) - F.col("_taken")).select(*df.columns)
    return first.select(*df.columns).unionByName(more)


def hold_out(df: DataFrame, group: str, n: int) -> DataFrame:
    """Adds held_out: the row is of one of the n last groups. The groups are counted on their distinct values."""
    last = df.select(group).distinct().orderBy(F.desc(group)).limit(n).select(F.col(group).alias("_last"))
    last = F.broadcast(last)  # n rows
    return df.join(last, F.col(group) == F.col("_last"), "left").withColumn("held_out", F.col("_last").isNotNull()).drop("_last")


def first_wins(df: DataFrame, key: list[str], priority: list) -> DataFrame:
    """One row per key: that of the highest priority."""
    return best_per_group(df, key, priority).drop("place")


def select_unique(
    candidates: DataFrame, seed: str, caps: dict[str, int], long_tokens: int, min_long: int, batch: str = "batch"
) -> DataFrame:
    """candidates(batch, call, pair_id, kind, tokens): a call is used once; passes revised, anchor_revised, seeded, anchor.

    Rows go by sha256(call, seed, pair_id). caps: rows of each pass at most. A first run looks at rows of more than
    long_tokens until min_long are found, the second at all. The running counters make it sequential, so it runs
    per batch, on the columns it needs, and the caller joins the chosen pair ids back. No more than sum(caps)
    calls are ever used, so of each kind, long and short apart, the first sum(caps) calls are enough, each
    by its first row: a batch's group has a constant size.
    """
    passes = ("revised", "anchor_revised", "seeded", "anchor")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        counts = dict.fromkeys(passes, 0)
        long_rows, out = 0, []
        rows = rows.sort_values("_order")
        for want_long in (True, False):
            for kind in passes:
                for r in rows[rows["kind"] == kind].itertuples():
                    if want_long and (long_rows >= min_long or r.tokens <= long_tokens):
                        continue
                    if r.call in used or counts[kind] >= caps.get(kind, 0):
                        continue
                    used.add(r.call)
                    counts[kind] += 1
                    long_rows += r.tokens > long_tokens
                    out.append((getattr(r, batch), r.pair_id, len(out)))
        return pd.DataFrame(out, columns=[batch, "pair_id", "place"])

    keyed = candidates.select(batch, "call", "pair_id", "kind", "tokens", hash_order(F.col("call"), F.lit(seed), F.col("pair_id")).alias("_order"))
    most = sum(caps.values())
    keyed = keyed.withColumn("_long", F.col("tokens") > long_tokens)
    keyed = best_per_group(keyed, [batch, "kind", "_long", "call"], ["_order"]).drop("place")
    keyed = best_per_group(keyed, [batch, "kind", "_long"], ["_order"], most).drop("place", "_long")
    schema = f"{batch} {candidates.schema[batch].dataType.simpleString()}, pair_id string, place int"
    return keyed.groupBy(batch).applyInPandas(choose, schema)


PAIR_KINDS = {"revised": False, "seeded": True}  # kind -> whether it counts against the seeded cap
ANCHOR_KINDS = {"anchor_revised": False, "anchor": True}  # kind -> whether it counts against the cap of originals


def select_shared(candidates: DataFrame, seed: str, pairs: int, anchors: int, seeded: int, originals: int, min_long: int, long_tokens: int) -> DataFrame:
    """candidates(call, pair_id, kind, tokens) with place: the order in which a row is chosen, null where it is dropped.

    A call is used once. Rows go by sha256(call, seed, pair_id). Pairs (revised, seeded) share one cap
    and anchors (anchor_revised, anchor) another; seeded pairs and original anchors have a cap of their
    own within them. Passes over the kinds look at rows of more than long_tokens first, until min_long
    are chosen, and then at all. What a pass takes is the first rows of distinct unused calls up to what
    its caps leave, so each is a rank and a threshold; rows chosen so far, as many as the caps at most,
    are broadcast. Kinds that are none of the four are dropped.
    """
    spark = candidates.sparkSession
    rows = candidates.withColumn("_order", F.sha2(F.concat("call", F.lit(seed), "pair_id"), 256))
    chosen: list[tuple] = []
    count = dict.fromkeys((*PAIR_KINDS, *ANCHOR_KINDS), 0)
    longs = 0
    for want_long in (True, False):
        for kind in ("revised", "anchor_revised", "seeded", "anchor"):
            family, cap, own = (PAIR_KINDS, pairs, seeded) if kind in PAIR_KINDS else (ANCHOR_KINDS, anchors, originals)
            left = cap - sum(count[k] for k in family)
            left = min(left, own - count[kind]) if family[kind] else left
            left = min(left, min_long - longs) if want_long else left
            if left <= 0:
                continue
            pool = rows.where(F.col("kind") == kind)
            pool = pool.where(F.col("tokens") > long_tokens) if want_long else pool
            if chosen:
                used = spark.createDataFrame([(c,) for c, *_ in chosen], "call string")
                pool = pool.join(F.broadcast(used), "call", "left_anti")
            first = pool.groupBy("call").agg(F.min(F.struct("_order", "pair_id", "tokens")).alias("r")).orderBy("r").limit(left)
            for r in first.collect():  # no more than a cap's rows
                chosen.append((r.call, r.r.pair_id, kind, len(chosen)))
                count[kind] += 1
                longs += r.r.tokens > long_tokens
    taken = spark.createDataFrame(chosen, "call string, pair_id string, kind string, place int")
    return candidates.join(F.broadcast(taken), ["call", "pair_id", "kind"], "left")


def window_state(total: Column, stable: int, hard: int) -> Column:
    """pass up to stable, warn up to hard, fail beyond; an unknown total is unknown, never pass."""
    return F.when(total.isNull(), "unknown").when(total > hard, "fail").when(total > stable, "warn").otherwise("pass")


def label_mask(prompt: Column, target: Column, ignored: int = -100) -> Column:
    """Training labels: the prompt's places are ignored, the target's are its own ids."""
    return F.concat(F.array_repeat(F.lit(ignored), F.size(prompt)), target)


def shares_prefix(a: Column, b: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def cut_terminal(rejected: Column, prompt_length: Column, kind: Column, most: int) -> Column:
    """A rejected answer that is too long with its prompt: cut to fit where it fails by not ending, for a cut one fails alike; null (no pair) for any other failure."""
    fits = prompt_length + F.size(rejected) <= most
    return F.when(fits, rejected).when(kind == "terminal", F.slice(rejected, F.lit(1), F.greatest(F.lit(most) - prompt_length, F.lit(0))))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first difference of two arrays, the length of the shorter if one begins the other, null if they are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0))), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).when(F.size(a) != F.size(b), n)


def difference(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ratio and the numbers of equal, deleted and inserted characters of two texts (longest matching blocks)."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(pairs.schema.jsonValue()).add("ratio", "double").add("equal", "long").add("deleted", "long").add("inserted", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = x[left].fillna(""), x[right].fillna("")
            equal, before, after = matching.in_groups(list(zip(a, b, strict=True))), a.str.len().to_numpy("int64"), b.str.len().to_numpy("int64")
            ratio = np.where(before + after > 0, 2.0 * equal / np.maximum(before + after, 1), 1.0)
            yield x.assign(ratio=ratio, equal=equal, deleted=before - equal, inserted=after - equal)

    return pairs.mapInPandas(run, schema)
