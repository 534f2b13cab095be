"""Mixing sources to target weights in fixed-length blocks of words.

The words of each source, its documents in a seeded order, form one stream that is cut into blocks.
Every output shard draws how many of its slots each source fills. These are multinomial counts under
the condition that over all shards each source fills the slots of its target: that law is the
multivariate hypergeometric one, which is drawn by halving ranges of shards, so any task can draw
its own shards, and sources meet their targets whatever the size of the input. Slots are numbered
per source across shards, and a keyed permutation of block indexes maps each number to a block, pass
after pass, so no block is taken again before every other one was. Slots and blocks meet in an
equi-join on the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.llm.common import ASCII_SPACE, numbered_columns, pick, restored, stash, with_python_path

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
BUCKETS = 4096
MAX_SOURCES = 100_000  # more are refused: each shard's draw has one count per source
SPAN_SLOTS = 1 << 29  # slots of a range of shards that is drawn as a whole; numpy draws below 10^9


def targets(sizes: list[int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> list[float]:
    """Share the sum of sizes by weights (repeated over the list); no target is above cap times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        per = left / sum(w[i] for i in free)
        over = [i for i in free if per * w[i] > cap * sizes[i]]
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else per * w[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)] if over else []
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each row: a Feistel network on the least even bit width, walked until inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            x = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def share_out(counts: list[int], upto: int) -> np.ndarray:
    """How many of the first `upto` slots each source has, if its slots were spread evenly: whole numbers whose sum is upto."""
    total, edges, at = max(sum(counts), 1), [0], 0
    for n in counts:
        at += n
        edges.append(at * upto // total)
    return np.diff(np.array(edges, dtype=np.int64))


def shard_counts(counts: list[int], shard_slots: int, seed: int, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, slots of each source) for the shards from first to stop; over all shards a source has `counts` slots.

    A range of shards holds known counts; its left half's are a multivariate hypergeometric draw from
    them, seeded by the range, so that any two tasks draw alike.
    """
    total = sum(counts)
    span = max(SPAN_SLOTS // shard_slots, 1)

    def halve(a: int, b: int, mine: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if b <= first or a >= stop:
            return
        if b - a == 1:
            yield a, mine
            return
        middle = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(mine, min((middle - a) * shard_slots, int(mine.sum())), method="marginals")
        yield from halve(a, middle, left)
        yield from halve(middle, b, mine - left)

    for a in range(first // span * span, stop, span):
        b = min(a + span, -(-total // shard_slots))
        yield from halve(a, b, share_out(counts, min(b * shard_slots, total)) - share_out(counts, a * shard_slots))


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of value over all earlier rows of the group, by (bucket, order); a group's buckets are summed apart."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return running.join(bases, [*group, bucket]).withColumn(name, F.col(name) + F.col("_base")).drop("_base")


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, stop) of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(ids) != 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(ids, cuts) if len(r)]


@dataclass
class Mixture:
    """documents: doc_id, seq, size, source_size, target, share. pieces: shard, slot, pass, seq, word (first), words (number)."""

    documents: DataFrame
    pieces: DataFrame


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    cap: int = 3,
    block_words: int = 64,
    shard_slots: int = 1024,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seq_col: str | None = None,
) -> Mixture:
    """Mix all documents to their sources' targets: see Mixture.

    Sources are taken by code point, null last, and weighed by `weights`, repeated; null is a source
    like any other. The per-source table goes to the driver: sources are a dimension, not data, and
    more than MAX_SOURCES are an error. Null text has no words. No word is taken more than `cap` times.
    Rows repeated with one id are documents each; ties in the seeded order go by id and place. seq
    numbers the rows as they are read, so docs must be a stored table; reruns on it agree. An empty
    table, or one without words, gives no pieces. Extra columns are not read.
    """
    spark = docs.sparkSession
    with_python_path(spark)
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col, **{"seq": seq_col} if seq_col else {})
    rows = rows if seq_col else rows.withColumn("seq", F.monotonically_increasing_id())
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))
    sized = stash(rows.select("doc_id", "seq", "source", size.alias("size"), order.alias("order")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    goals = targets(sizes, weights, cap)
    table = [(r["source"], i, n, g) for i, (r, n, g) in enumerate(zip(totals, sizes, goals, strict=True))]
    sources = spark.createDataFrame(table, "s_source string, share int, source_size long, target double")
    documents = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")

    bucket = F.expr(f"cast(shiftrightunsigned(order, 52) % {BUCKETS} as int)")
    placed = prefix_sum(documents.where("size > 0").withColumn("bucket", bucket), ["share"], "bucket", ["order", "doc_id", "seq"], "size", "start")
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    blocks = placed.select("share", "seq", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    blocks = blocks.select("share", "block", "seq", begin.alias("word"), (end - begin).alias("words"))

    n_blocks = np.array([-(-n // block_words) for n in sizes], dtype=np.int64)
    counts = [min(round(g / block_words), cap * int(n)) for g, n in zip(goals, n_blocks, strict=True)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _runs(batch.id.to_numpy()):
                drawn = shard_counts(counts, shard_slots, seed, a, b)
                yield pd.DataFrame([(shard, i, n) for shard, mine in drawn for i, n in enumerate(mine.tolist()) if n], columns=["shard", "share", "n"])

    drawn = spark.range(math.ceil(sum(counts) / shard_slots)).mapInPandas(draw, "shard long, share int, n long")
    drawn = stash(drawn, "draws").withColumn("bucket", F.expr("shard div 4096"))
    numbered = prefix_sum(drawn, ["share"], "bucket", ["shard"], "n", "base")
    slots = numbered.select("shard", "share", F.posexplode(F.expr("sequence(base, base + n - 1)")).alias("slot", "number"))

    @F.pandas_udf("long")
    def block_of(share: pd.Series, number: pd.Series) -> pd.Series:
        s, g = share.to_numpy(), number.to_numpy()
        n = n_blocks[s]
        key = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ ((g // n).astype(np.uint64) + np.uint64(seed)) * np.uint64(0xA0761D6478BD642F)
        return pd.Series(permute(g % n, n, key))

    per_source = spark.createDataFrame([(i, int(n)) for i, n in enumerate(n_blocks)], "share int, n_blocks long")
    slots = slots.join(F.broadcast(per_source), "share")  # MAX_SOURCES rows at most
    slots = slots.select("shard", "slot", "share", F.expr("number div n_blocks").alias("pass"), block_of("share", "number").alias("block"))
    pieces = slots.join(blocks, ["share", "block"]).select("shard", "slot", "pass", "seq", "word", "words")
    return Mixture(documents.drop("source", "order"), pieces)


def words_taken(mixture: Mixture) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    taken = mixture.pieces.groupBy("seq").agg(F.sum("words").alias("taken"))
    joined = mixture.documents.join(taken, "seq", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def text_of_words(text: Column, runs: Column) -> Column:
    """What stands from the first to the last word of each run (word, words), in order; runs that do not touch are joined by \\n.

    The text is cut behind each word, so a piece is a word with the white space before it.
    """
    space = F.lit(ASCII_SPACE)

    def cut_out(v: Column) -> Column:
        def run(r: Column, i: Column) -> Column:
            before = F.get(v["runs"], i - 1)
            words = F.array_join(F.slice(v["pieces"], r["word"].cast("int") + 1, r["words"].cast("int")), "")
            touches = (i > 0) & (before["word"] + before["words"] == r["word"])
            return F.when(touches, words).when(i > 0, F.concat(F.lit("\n"), F.ltrim(words, space))).otherwise(F.ltrim(words, space))

        taken = F.aggregate(v["runs"], F.lit(0).cast("long"), lambda n, r: n + r["words"])
        whole = taken == F.size(F.filter(v["pieces"], lambda p: F.btrim(p, space) != ""))
        return F.when(whole, text).otherwise(F.array_join(F.transform(v["runs"], run), ""))

    return bound(F.struct(F.split(text, WORD_END, -1).alias("pieces"), F.array_sort(runs).alias("runs")), cut_out)


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixture as documents: for each pass that takes words of a document, a row with those words as its text.

    All columns stay, whatever their names; n_chars, where there is one, follows the new text. Documents
    without words (null, empty) have no part in a mixture of words. The numbered rows are stored, so docs
    may be any table. An empty table gives an empty result.
    """
    plain, at = numbered_columns(docs)
    held = stash(plain.withColumn("seq", F.monotonically_increasing_id()), "numbered")
    names = {k: at[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("source_col", "source"))}
    mixture = mix(held, text_col=at[text_col], seq_col="seq", **names, **options)
    runs = mixture.pieces.groupBy("seq", "pass").agg(F.collect_list(F.struct("word", "words")).alias("runs"))
    text = at[text_col]
    out = held.join(runs, "seq").withColumn(text, text_of_words(F.col(text), F.col("runs")))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return restored(out, docs.columns)
