"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing depends on the lengths alone, and lengths lie between 1 and the capacity: the
whole table reduces to a histogram of at most `capacity` rows, however many documents there are.
The driver packs that histogram with a segment tree over remaining capacities, whose leaves count
equal open bins, and gets a plan of bounded size: which ranks of each length go to which bins. Tasks
then place every piece by its length and its rank among pieces of that length. No token moves in a
shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path

END_ID = 0
CACHE_WORDS = 150_000  # cached words of a Python worker, at most
_CACHES: dict[str, tuple] = {}


# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file, if ids rise in the order of merges; else None.

    Then the fast merger, which always merges the pair of least id, gives the file's own ids.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != sorted(ids):
        return None
    singles = {c: model["vocab"][c] for c in byte_of}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in [*singles.items(), *zip(merges, ids, strict=True)]}


class CachedEncoder:
    """Token ids of texts under a tokenizers file, as little-endian unsigned 32-bit bytes.

    The byte-level pattern never lets a pre-token cross from a word into the space behind it, so a
    text can be cut before each single space and its words encoded apart, most of them from a cache.
    Where white space stands on both sides of a space, its run may be split otherwise; such texts
    are encoded whole, and so are texts that hold the string of an added token, which tokenizers turns
    into that token's id. New words are encoded together, in one text: each begins with a token that
    begins with a space, and no other token does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.doubled = re.compile(r"\s \s")
        self.plain = re.compile(r"\S+").fullmatch
        ranks = merge_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        if self.fast and len(text) < 1_000_000 and not self.added.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, fresh: list[str]) -> None:
        plain = [w for w in fresh if self.plain(w)]
        ids = self._ids("".join(" " + w for w in plain))
        cuts = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
        data = ids.tobytes()
        self.words.update((w, data[4 * a : 4 * b]) for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True))
        self.words.update((w, self._ids(" " + w).tobytes()) for w in fresh if w not in self.words)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        for at in range(0, len(texts), 256):
            parts = [None if self.doubled.search(t) or self.added.search(t) else t.split(" ") for t in texts[at : at + 256]]
            fresh = {w for p in parts if p for w in p[1:]}.difference(words)
            if fresh:
                self._learn(list(fresh))
            for text, p in zip(texts[at : at + 256], parts, strict=True):
                yield self._ids(text).tobytes() if p is None else self._ids(p[0]).tobytes() + b"".join(map(words.__getitem__, p[1:]))


def encoder(path: str) -> CachedEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CACHES[path] = (CachedEncoder(path),)
    return _CACHES[path][0]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids; only the first piece may be shorter than the capacity."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digest: bool = False, flush_bytes: int = 1 << 21
) -> DataFrame:
    """doc_id, piece, start, length, and ids array<int> and/or ids_crc32 as asked for.

    A document is the ids of its text, then END_ID; null text counts as empty and gives END_ID alone.
    Documents of more than `capacity` ids are cut into pieces of that length, the first maybe shorter.
    A task holds one batch of texts, the ids of one document, and up to flush_bytes of pieces.
    """
    with_python_path(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long" + ", ids array<int>" * ids + ", ids_crc32 long" * digest

    def table(doc_ids: list, pieces: list, starts: list, lengths: list, parts: list[bytes]) -> pa.RecordBatch:
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())}
        if ids:
            ends = np.append(0, np.cumsum(np.array(lengths, dtype=np.int64))).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
        if digest:
            columns["ids_crc32"] = pa.array([zlib.crc32(p) for p in parts], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for doc_id, data in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                data += end
                n = len(data) // 4
                starts = cut_points(n, capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    for to, value in zip(held, (doc_id, piece, a, b - a, data[4 * a : 4 * b]), strict=True):
                        to.append(value)
                    size += 4 * (b - a)
                    if size >= flush_bytes:
                        yield table(*held)
                        held, size = ([], [], [], [], []), 0
            yield table(*held)

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, schema)


class OpenBins:
    """A segment tree over remaining capacities 0..capacity: each leaf stacks groups of equal open bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.width)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def push(self, remaining: int, first: int, count: int) -> None:
        self.groups.setdefault(remaining, []).append((first, count))
        i = remaining + self.width
        while i and not self.full[i]:
            self.full[i] = True
            i //= 2

    def pop(self, remaining: int) -> tuple[int, int]:
        out = self.groups[remaining].pop()
        if not self.groups[remaining]:
            i = remaining + self.width
            self.full[i] = False
            while i > 1 and not (self.full[i] or self.full[i ^ 1]):
                i //= 2
                self.full[i] = False
        return out

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity >= size of any open bin."""
        i = size + self.width
        if self.full[i]:
            return size
        while i > 1 and not (i % 2 == 0 and self.full[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.width:
            i = 2 * i if self.full[2 * i] else 2 * i + 1
        return i - self.width


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (size, first rank, first bin, items per bin, offset) runs.

    Equal items go to the tightest bin until it has no room for another, so whole groups of equal
    bins are filled in one step; the result is that of placing the items one by one.
    """
    bins, plan, fresh = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = bins.tightest(size)
            if room is None:
                per = capacity // size
                first, count, room = fresh, -(-left // per), capacity
                fresh += count
            else:
                first, count = bins.pop(room)
                per = room // size
            filled = min(count, left // per)
            if filled:
                plan.append((size, rank, first, per, capacity - room))
                rank, left = rank + filled * per, left - filled * per
                if room - per * size:
                    bins.push(room - per * size, first, filled)
            if filled < count and left and left < per:
                plan.append((size, rank, first + filled, per, capacity - room))
                bins.push(room - left * size, first + filled, 1)
                rank, left, filled = rank + left, 0, filled + 1
            if filled < count:
                bins.push(room, first + filled, count - filled)
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset: gapless from 0 within each sequence.

    Ranks of equal lengths come from counts per (length, bucket) and a running count inside each
    bucket, so no length is gathered in one task. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    with_python_path(spark)
    stored = stash(pieces, "pieces")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.rdd.getNumPartitions())
    keyed = stored.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(tasks * 4)).cast("int"))
    counts = stash(keyed.groupBy("length", "bucket").count(), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_bins(totals, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")

    by_size: dict[int, np.ndarray] = {s: np.array([p[1:] for p in plan if p[0] == s], dtype=np.int64) for s in totals}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            runs = by_size[int(size)]
            run = runs[np.searchsorted(runs[:, 0], ranks[mine], side="right") - 1]
            step = ranks[mine] - run[:, 0]
            sequence[mine] = run[:, 1] + step // run[:, 2]
            offset[mine] = run[:, 3] + step % run[:, 2] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(*stored.columns, "at.sequence_id", "at.offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digest: bool = False) -> DataFrame:
    """Tokenise all documents and pack them: one row per piece with its sequence_id and offset.

    Null text counts as empty: such a document is END_ID alone. Repeated rows are packed as often as
    they stand; null ids pass through; extra columns are not read. Documents longer than the capacity
    are cut, none else.
    """
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, id_col, text_col, ids, digest), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and doc_ids with lengths in order: the packed training sequences."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
