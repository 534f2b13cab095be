"""Exact top-k by integer inner product over a bit-sliced index.

Vectors are quantised to integers and stored in blocks of rows; each attribute is a stack of bitmaps,
one per binary place. A query adds attribute slices, weighted by its own components, with bitmap
arithmetic: full adders over bitmaps of equal weight. The low places of the attributes are left out
of the sum, and what they can add has a known bound; rows are selected from the most significant
slice of the sum downward, widened by that bound, and their scores are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, e array<long>: floor(scale * x), x as double. Vectors that are null, or hold null or non-finite components, go."""
    rows = pick(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("e"))


def _packed(bits: np.ndarray, words: int) -> np.ndarray:
    return np.packbits(np.pad(bits, (0, words * 64 - len(bits))), bitorder="little").view(np.uint64)


@dataclass
class SlicedIndex:
    """A block of rows: attribute values, and bitmaps of the values less their minimum, places `low` and up."""

    values: np.ndarray  # row, attribute
    low: int
    top: np.ndarray  # the highest value less the lowest, of each attribute
    bitmaps: np.ndarray  # bitmap, word: attribute by attribute, from place `low` up

    @staticmethod
    def of(values: np.ndarray, low: int) -> SlicedIndex:
        shifted = values - values.min(axis=0)
        top, words = shifted.max(axis=0), -(-len(values) // 64)
        maps = [_packed((shifted[:, d] >> b & 1).astype(bool), words) for d in range(values.shape[1]) for b in range(low, int(top[d]).bit_length())]
        return SlicedIndex(values, low, top, np.array(maps, dtype=np.uint64).reshape(len(maps), words))

    def __post_init__(self):
        self.rows = len(self.values)
        self.valid = _packed(np.ones(self.rows, dtype=bool), -(-self.rows // 64))
        self.slices, at = [], 0
        for t in self.top.tolist():
            places = range(self.low, t.bit_length())
            self.slices.append(list(zip(places, self.bitmaps[at : at + len(places)], strict=True)))
            at += len(places)

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of the coarse sum, and the constant to add to it.

        A component's weight is written with digits 1 and -1; a negative digit adds the complement.
        """
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, q in enumerate(query.tolist()):
            place = 0
            while q:
                if q & 1:
                    digit = 2 - (q & 3)
                    q -= digit
                    for b, bits in self.slices[d]:
                        columns.setdefault(place + b, []).append(bits if digit > 0 else bits ^ ONES)
                        constant -= (digit < 0) << (place + b)
                q >>= 1
                place += 1
        out, place = [], 0
        while place <= max(columns, default=-1):
            column = columns.get(place, [])
            carries = columns.setdefault(place + 1, []) if len(column) > 1 else None
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                carries.append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                carries.append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.valid))
            place += 1
        return out, constant

    def at_least(self, total: list[np.ndarray], bound: int) -> np.ndarray:
        """The bitmap of rows whose sum is bound or more."""
        if bound <= 0:
            return self.valid
        if bound.bit_length() > len(total):
            return np.zeros_like(self.valid)
        more, equal = np.zeros_like(self.valid), self.valid.copy()
        for place in range(len(total) - 1, -1, -1):
            if bound >> place & 1:
                equal &= total[place]
            else:
                more |= equal & total[place]
                equal &= ~total[place]
        return more | equal

    def kth(self, total: list[np.ndarray], k: int) -> int:
        """The k-th highest sum: from the most significant slice down, a slice's rows are taken if there are k of them."""
        among, need, value = self.valid, k, 0
        for place in range(len(total) - 1, -1, -1):
            high = among & total[place]
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                among, value = high, value | 1 << place
            else:
                among, need = among & ~total[place], need - n
        return value

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k highest scores (k or more rows, if there are)."""
        total, _ = self.add(query)
        if self.rows <= k or not total:
            return np.arange(self.rows)
        rest = np.minimum(self.top, (1 << self.low) - 1)
        spread = int((np.abs(query) * rest).sum())  # what the low places can add, from least to most
        bits = self.at_least(total, self.kth(total, k) - spread)
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.rows])


def block_best(index: SlicedIndex, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's k best rows for a query, without the query's own row; ties to smaller ids."""
    own = ids == query_id
    rows = index.boundary(query, k + int(own.sum()))
    rows = rows[~own[rows]]
    scores = index.values[rows].astype(np.int64) @ query
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][order], scores[order]


def _narrowed(values: np.ndarray) -> tuple[str, bytes]:
    """The values in the narrowest integers that hold them."""
    kind = np.result_type(np.min_scalar_type(int(values.min(initial=0))), np.min_scalar_type(int(values.max(initial=0))), np.int16)
    return kind.str, values.astype(kind).tobytes()


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int, name: str, low: int | None = None) -> DataFrame:
    """Stored blocks: name, ids, kind and data (row-major), width; with `low` also top and bitmaps, the block's slices.

    A block holds block_rows rows at most, and no more than block_bytes at eight bytes a component (one row at least).
    Shorter vectors are padded with zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        width = 0

        def packed() -> pd.DataFrame:
            data = np.zeros((len(held), width), dtype=np.int64)
            for i, (_, e) in enumerate(held):
                data[i, : len(e)] = e
            kind, values = _narrowed(data)
            out = {"ids": [np.array([i for i, _ in held], dtype=np.int64).tobytes()], "kind": [kind], "data": [values], "width": [width]}
            if low is not None:
                index = SlicedIndex.of(data, low)
                out |= {"top": [index.top.astype(np.int64).tobytes()], "bitmaps": [index.bitmaps.tobytes()]}
            return pd.DataFrame(out)

        for batch in batches:
            for vec_id, e in zip(batch.vec_id, batch.e, strict=True):
                wider = max(width, len(e))
                if held and (len(held) == block_rows or (len(held) + 1) * wider * 8 > block_bytes):
                    yield packed()
                    held, wider = [], len(e)
                held.append((vec_id, np.asarray(e, dtype=np.int64)))
                width = wider
        if held:
            yield packed()

    schema = "ids binary, kind string, data binary, width int" + ", top binary, bitmaps binary" * (low is not None)
    return stash(rows.mapInPandas(run, schema).withColumn(name, F.monotonically_increasing_id()), name)


def _matrix(kind: str, data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(rows, width)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


BLOCK_BYTES = 32 << 20
BROADCAST_BYTES = 32 << 20


def rounds(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """(name, bytes) in their order -> groups of names of `most` bytes together, or of one name."""
    out, held = [], 0
    for name, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    low: int = 3,
    block_rows: int = 65536,
    query_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of highest score.

    The score is the integer inner product of the quantised vectors; ties go to smaller ids, and a query
    gets all rows if they are fewer than k. Null vectors, null ids and vectors with null or non-finite
    components take no part; a shorter vector counts as padded with zeros. Rows repeated with one id are
    candidates each; such a query is asked once. The index is stored, slices and all. Queries and rows
    meet in blocks: index blocks stay where they are, and query blocks are broadcast to them, in rounds of
    BROADCAST_BYTES; only k rows of each two blocks leave a task. Scores are 64-bit integers: components of
    magnitude c and vectors of d components need d * c * c below 2^63. An empty table, or one without queries, gives an empty
    result. Extra columns are not read.
    """
    spark = vectors.sparkSession
    with_python_path(spark)
    rows = quantised(vectors, scale, id_col, vector_col)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    index = _blocks(rows, block_rows, BLOCK_BYTES, "row_block", low)
    asked = _blocks(queries, query_rows, BLOCK_BYTES // 4, "query_block").withColumnsRenamed({"ids": "q_ids", "kind": "q_kind", "data": "q_data", "width": "q_width"})
    sizes = asked.select("query_block", (F.octet_length("q_data") + F.octet_length("q_ids")).alias("bytes")).collect()  # two numbers per block of queries
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, q_ids = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                found = SlicedIndex(_matrix(r.kind, r.data, len(ids), r.width), low, np.frombuffer(r.top, dtype=np.int64), np.frombuffer(r.bitmaps, dtype=np.uint64).reshape(-1, -(-len(ids) // 64)))
                wanted = _wide(_matrix(r.q_kind, r.q_data, len(q_ids), r.q_width), r.width)[:, : r.width].astype(np.int64)
                best = [(query_id, *block_best(found, ids, query_id, query, k)) for query_id, query in zip(q_ids.tolist(), wanted, strict=True)]
                lengths = [len(b[1]) for b in best]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, lengths), "vec_id": np.concatenate([b[1] for b in best]), "score": np.concatenate([b[2] for b in best])})

    names = ["ids", "kind", "data", "width", "top", "bitmaps", "q_ids", "q_kind", "q_data", "q_width"]
    found = []
    for blocks in rounds([(r["query_block"], r["bytes"]) for r in sizes], BROADCAST_BYTES):
        some = asked.where(F.col("query_block").isin(*blocks))
        pairs = index.withColumn("query_block", F.explode(F.lit(blocks).cast("array<long>"))).join(F.broadcast(some), "query_block")
        found.append(pairs.select(names).mapInPandas(run, "query_id long, vec_id long, score long"))
    if len(found) > 1:  # a round's queries are let go before the next one's are sent
        found = [stash(best, "best") for best in found]
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
