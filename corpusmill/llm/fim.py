"""Fill-in-the-middle texts from an index of distinct texts.

Ids and digests of all rows tell which digests occur more than once. Texts of those meet once, told
apart by their content, and get a list of line ends in Elias-Fano code; the ids of their documents,
chunk by chunk, are joined back to them. A text that occurs once is never shuffled: its list is made
where it is read. Each document's seeded cut is two selections in its text's list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path
from corpusmill.llm.exact_dedup import hit_filter

# The marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FLUSH_CHARS = 1 << 20  # of yielded texts, or one text
CHUNK_ROWS = 4096  # ids that are joined to a text at once
SCAN_CHARS = 1 << 20


@dataclass(frozen=True)
class EliasFano:
    """A rising list of integers: `width` low bits of each, packed, and the high parts in unary, as 64-bit words."""

    count: int
    width: int
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        """values: rising, none above universe."""
        count = len(values)
        width = max((universe // count).bit_length() - 1, 0) if count else 0
        values = values.astype(np.int64)
        low = np.packbits((values[:, None] >> np.arange(width) & 1).astype(bool).ravel(), bitorder="little")
        ones = np.zeros(-(-((universe >> width) + count + 1) // 64) * 64, dtype=bool)
        ones[(values >> width) + np.arange(count)] = True
        return EliasFano(count, width, low, np.packbits(ones, bitorder="little").view(np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        word = int(np.searchsorted(upto, i, side="right"))
        inside = i - (int(upto[word - 1]) if word else 0)
        place = 64 * word + int(np.flatnonzero(np.unpackbits(self.high[word : word + 1].view(np.uint8), bitorder="little"))[inside])
        first = i * self.width
        bits = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.width]
        return (place - i) << self.width | int((bits.astype(np.int64) << np.arange(self.width)).sum())

    def __bytes__(self) -> bytes:
        return np.array([self.count, self.width, len(self.low)], dtype=np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def read(data: bytes) -> EliasFano:
        count, width, n = np.frombuffer(data, dtype=np.int64, count=3).tolist()
        return EliasFano(count, width, np.frombuffer(data, np.uint8, n, 24), np.frombuffer(data[24 + n :], np.uint64))


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, in code points, its line break with it; read a million characters at a time."""
    found = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(text), SCAN_CHARS):
        points = np.frombuffer(text[at : at + SCAN_CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found.append(np.flatnonzero(points == 10) + at + 1)
    if text and not text.endswith("\n"):
        found.append(np.array([len(text)]))
    return np.concatenate(found)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def cut(text: str, ends: EliasFano, doc_id: int | None, seed: int, rate: int, spm: int, marked: bool) -> tuple[str, int | None, int | None, str]:
    """form, code points of prefix and middle, output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or marked or h3 % 100 >= rate:
        return "plain", None, None, text
    a, b = sorted((h1 % (ends.count + 1), h2 % (ends.count + 1)))
    p, q = (ends.select(k - 1) if k else 0 for k in (a, b))
    if h4 % 100 < spm:
        return "spm", p, q - p, f"{SUFFIX}{text[q:]}{PREFIX}{text[:p]}{MIDDLE}{text[p:q]}"
    return "psm", p, q - p, f"{PREFIX}{text[:p]}{SUFFIX}{text[q:]}{MIDDLE}{text[p:q]}"


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. No cut text holds a mark, so an output is cut at its three marks."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        lists = [bytes(EliasFano.of(line_ends(t), len(t))) for t in texts]
        yield pa.RecordBatch.from_pydict({"digest": batch["digest"], "text": batch["text"], "ends": pa.array(lists, pa.binary())})


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    A text is cut before two of its lines, which are drawn from SHA-256 of the seed and the id; `rate` of
    100 documents are cut, and `spm` of 100 of those have the suffix first. Empty texts, null ones among
    them, and texts that hold a mark stay as they are: form plain, lengths null. Rows repeated with one
    id and text say the same; null ids are drawn alike. An empty table gives an empty result. Extra
    columns are not read. digest_bytes: of SHA-256 by which texts meet; fewer only make collisions
    likelier, and texts of one digest that differ are cut each where they are read.
    """
    spark = docs.sparkSession
    with_python_path(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes))
    ids = stash(keyed.select("doc_id", "digest").withColumn("block", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "fim-ids")
    copies = stash(ids.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "fim-copies")
    size = copies.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    hits = hit_filter(copies, size["texts"])

    met = hits.probe(keyed)
    index = stash(met.where("maybe").select("digest", "text").distinct().mapInArrow(_indexed, "digest binary, text string, ends binary"), "fim-index")
    mixed = stash(index.groupBy("digest").count().where("count > 1").select("digest"), "fim-collisions")

    # Texts of so many documents that they would fill a good part of a task, less than 8 a task: cut up by blocks of ids.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(size["rows"] / (8 * tasks), 1.0)
    hot = F.broadcast(copies.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    chunks = hits.probe(ids).where("maybe").join(hot, "digest", "left").groupBy("digest", part, "block").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    spread = index.join(hot, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    alone = met.where(~F.col("maybe"))
    if not mixed.isEmpty():
        alone = alone.unionByName(met.where("maybe").join(mixed, "digest", "left_semi"), allowMissingColumns=True)
        spread = spread.join(mixed, "digest", "left_anti")
    joined = spread.join(chunks, ["digest", "part"]).select("ids", "text", "ends")
    every = alone.select(F.array(F.struct("doc_id")).alias("ids"), "text", F.lit(None).cast("binary").alias("ends")).unionByName(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            held, chars = [], 0
            for members, text, ends in zip(batch["ids"], batch["text"], batch["ends"], strict=True):
                text, data = text.as_py(), ends.as_py()
                known = EliasFano.of(line_ends(text), len(text)) if data is None else EliasFano.read(data)
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                for member in members.as_py():
                    form, prefix, middle, output = cut(text, known, member["doc_id"], seed, rate, spm, marked)
                    held.append((member["doc_id"], known.count, form, prefix, middle, output))
                    chars += len(output) + 1
                    if chars >= FLUSH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, chars = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return every.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
