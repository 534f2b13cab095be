"""SimHash near-duplicates, linked through the generalised pigeonhole principle.

If two fingerprints differ in at most tau bits and their bits are split into m parts with thresholds
t_1..t_m that sum to tau - m + 1, some part differs in at most its threshold. Correlated bits share a
part, and a dynamic programme gives each part its threshold (-1: skipped) from estimated candidate
counts. Documents with one fingerprint are one class from the start; classes meet in buckets of one
part's value and are verified there. A bucket yields a minimum spanning forest of its links, never all pairs.
One with too many members is split by the values of its remaining parts, thresholds chosen anew, or cut
into tiles that are compared two by two in tasks of their own, whichever copies a member less often;
neither loses a link. Components come from alternating large-star and small-star joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import discarded, pick, stash, with_python_path
from corpusmill.llm.graph import components

BITS = 64
NO_ID = (1 << 63) - (1 << 41)  # nodes from here on stand for classes whose ids are all null
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.2
NO_BOUND = 1 << 62
WHOLE = 2  # the side of rows that are compared with all others of their key


def fingerprint(text: str, shingle_words: int = 3, seed: int = 42) -> int:
    """As a signed 64-bit integer; a bit is set if it is in more than half of the shingles' XXH64 values."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle_words, len(words)) - 1 :]
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    hashes = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64, count=len(stops))
    return majority_bits(hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are each set in more than half of the hashes, as a signed integer; zero without hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every whole text; null text has no words."""
    with_python_path(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "fp": [fingerprint(t or "", shingle_words) for t in batch.text]})

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def bit_moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the shares of them in which bits i and j are both set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch.fp.to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        yield pd.DataFrame({"v": [np.append(total.ravel(), n)]})

    sums = classes.select("fp").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(BITS * BITS + 1)
    for i, v in sums.collect():  # 4097 rows
        flat[i] = v
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS) / max(flat[-1], 1)


def ball_size(bits: int, t: int) -> int:
    return sum(math.comb(bits, k) for k in range(t + 1))


def group_bits(moments: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows from a free bit by the bits most correlated with it."""
    p = np.diag(moments)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((moments - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: strength[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def plan_parts(n: int, moments: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part: the cheapest split over all part counts and threshold vectors."""
    p = np.diag(moments)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, min(tau + 2, 9)):
        groups = group_bits(moments, m)
        costs = []
        for bits in groups:
            chance = np.array([1.0])  # of each distance in these bits, taken as independent
            for q in 2 * p[bits] * (1 - p[bits]):
                chance = np.convolve(chance, [1 - q, q])
            costs.append({-1: 0.0} | {t: n * (ball_size(len(bits), t) + (t > 0)) * SIGNATURE_COST + n * n / 2 * chance[: t + 1].sum() * CANDIDATE_COST for t in range(min(tau, 4) + 1)})
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of thresholds -> cost, thresholds
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (c, chosen) in reach.items():
                for t, extra in cost.items():
                    if total + t not in step or c + extra < step[total + t][0]:
                        step[total + t] = (c + extra, [*chosen, t])
            reach = step
        if tau - m + 1 in reach and reach[tau - m + 1][0] < best[0]:
            best = (reach[tau - m + 1][0], list(zip(groups, reach[tau - m + 1][1], strict=True)))
    return best[1]


def _flips(bits: list[int], t: int) -> np.ndarray:
    """Masks of all ways to flip up to t of the bits, none first."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MAX_BALL = 300  # flipped values per row and part of the plan; the last fine part has its whole ball (697 values for 3 bits of 16)
FRAME_ROWS = 100_000  # of a yielded frame


def fine_parts(tau: int) -> list[list[int]]:
    """All bits again in tau + 1 parts, so that some part of any link is equal."""
    return [list(range(BITS))[i :: tau + 1] for i in range(tau + 1)]


def _even(left: list[int], tau: int) -> dict[int, int]:
    whole, rest = divmod(tau - len(left) + 1, max(len(left), 1))
    return {i: whole + (k < rest) for k, i in enumerate(left)}


def _thresholds(parts: list[tuple[list[int], int]], used: int, tau: int) -> dict[int, int]:
    """Of the parts that are left: those of the plan at first, later an even share of tau - m + 1.

    Where a part's ball would be too large, the bucket goes by fine_parts() instead, numbered from
    len(parts) on; these too cover all bits, so every link of the bucket meets in one of them.
    """
    if not used:
        return {i: t for i, (_, t) in enumerate(parts)}
    shares = _even([i for i in range(len(parts)) if not used >> i & 1], tau)
    if used >> len(parts) == 0 and all(ball_size(len(parts[i][0]), t) <= MAX_BALL for i, t in shares.items()):
        return shares
    return _even([len(parts) + i for i in range(tau + 1) if not used >> len(parts) + i & 1], tau)


BUCKET = "key long, fp long, node long, own boolean, used int"


def signatures(rows: DataFrame, parts: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """rows(key, fp, node, own, used) -> a row for each part that is left and each value in its ball.

    own: the value is the fingerprint's own, here and in all steps before. Keys are hashes of the parts'
    values; a chance collision only adds candidates.
    """
    places = [bits for bits, _ in parts] + fine_parts(tau)
    masks = [np.uint64(sum(1 << b for b in bits)) for bits in places]
    fine = lambda i: i >= len(parts)
    flips = {(i, t): _flips(bits, t) for i, bits in enumerate(places) for t in range(tau + 1) if fine(i) or ball_size(len(bits), t) <= MAX_BALL or t <= parts[i][1]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for used, rows in batch.groupby("used"):
                for i, t in _thresholds(parts, int(used), tau).items():
                    if t < 0:
                        continue
                    ball = flips[i, t]
                    step = max(1, FRAME_ROWS // len(ball))
                    for at in range(0, len(rows), step):
                        some = rows.iloc[at : at + step]
                        fp, key = some.fp.to_numpy(dtype=np.int64).view(np.uint64), some.key.to_numpy(dtype=np.int64).view(np.uint64)
                        value = (fp & masks[i])[:, None] ^ ball[None, :]
                        hashed = _mix64(value ^ _mix64(key + np.uint64(i + 1))[:, None])
                        own = some.own.to_numpy(dtype=bool)[:, None] & (np.arange(len(ball)) == 0)[None, :]
                        w = len(ball)
                        yield pd.DataFrame({"key": hashed.ravel().view(np.int64), "fp": np.repeat(some.fp.to_numpy(), w), "node": np.repeat(some.node.to_numpy(), w), "own": own.ravel(), "used": np.int32(int(used) | 1 << i)})

    return rows.mapInPandas(run, BUCKET)


def split_copies(parts: list[tuple[list[int], int]], used: int, tau: int, steps: int = 2) -> int:
    """How many rows a member of a bucket gives when the bucket is split `steps` times more; NO_BOUND if no part is left."""
    places = [bits for bits, _ in parts] + fine_parts(tau)
    if used >> len(parts) == (1 << tau + 1) - 1:
        return NO_BOUND
    shares = {i: t for i, t in _thresholds(parts, used, tau).items() if t >= 0}
    after = {i: min(split_copies(parts, used | 1 << i, tau, steps - 1), MAX_BALL) if steps > 1 else 1 for i in shares}
    return sum(ball_size(len(places[i]), t) * after[i] for i, t in shares.items())


def bucket_links(fp: np.ndarray, own: np.ndarray, tau: int, before: list[tuple[np.uint64, int]] = (), side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the edges of a minimum spanning forest, by distance, of the links between own members and all members.

    before: (mask, threshold) of the parts in front of this bucket's: a pair that meets in one of them is
    left to it, and one between an own member and another is left to the smaller fingerprint's bucket. So
    each pair counts in one place, and the forests of all buckets together hold one of the whole graph.
    side: only pairs of one member of tile 0 and one of tile 1 count.
    """
    rows, place = [], np.arange(len(fp))
    for a in np.flatnonzero(own):
        distance = np.bitwise_count(fp ^ fp[a])
        close = (distance <= tau) & np.where(own, place > a, fp > fp[a])
        hits = np.flatnonzero(close if side is None else close & (side != side[a]))
        for mask, t in before if len(hits) else ():
            hits = hits[np.bitwise_count((fp[hits] ^ fp[a]) & mask) > t]
        if len(hits):
            rows.append((a, hits.astype(np.int32), distance[hits]))
    us, vs, label = [], [], place.copy()
    for t in range(tau + 1 if rows else 0):
        for a, hits, distance in rows:
            some = np.flatnonzero(distance <= t)
            some = some[label[hits[some]] != label[a]]
            if len(some):
                old, first = np.unique(label[hits[some]], return_index=True)
                us += hits[some[first]].tolist()
                vs += [a] * len(first)
                label[np.isin(label, old)] = label[a]
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def verify_buckets(rows: DataFrame, parts: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """Edges (u, v) of nodes within each key; rows are dealt and sorted by key, so a bucket, or a pair of its tiles, streams past once."""

    plan = [(np.uint64(sum(1 << b for b in bits)), t) for bits, t in parts]
    in_front = {1 << i: [p for p in plan[:i] if p[1] >= 0] for i in range(len(plan))}  # of buckets that were not split

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None

        def edges(x: pd.DataFrame) -> pd.DataFrame:
            key = x.key.to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(key))
            fp, node, own = x.fp.to_numpy(dtype=np.int64).view(np.uint64), x.node.to_numpy(), x.own.to_numpy(dtype=bool)
            used, side = x.used.to_numpy(), x.side.to_numpy()
            us, vs = [], []
            for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
                left, right = bucket_links(fp[a:b], own[a:b], tau, in_front.get(int(used[a]), []), side[a:b] if side[a] < WHOLE else None)
                us.append(node[a:b][left])
                vs.append(node[a:b][right])
            u, v = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (us, vs))
            return pd.DataFrame({"u": u, "v": v}).query("u != v").drop_duplicates()

        for batch in batches:
            x = batch if carried is None else pd.concat([carried, batch])
            whole = x.key.to_numpy() != x.key.iloc[-1] if len(x) else np.zeros(0, dtype=bool)
            carried = x[~whole]
            if whole.any():
                yield edges(x[whole])
        if carried is not None and len(carried):
            yield edges(carried)

    dealt = rows.select("key", "fp", "node", "own", "used", "side").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "u long, v long")


def in_tiles(rows: DataFrame, key: str, member: str) -> DataFrame:
    """rows with `tiles`, the number of tiles of their key -> a row for each two tiles that it is in: `key` of the two, and `side`.

    Each two members of a key meet once: on the sides 0 and 1, or in a WHOLE tile.
    """
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
    two = F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), WHOLE).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn(key, two).withColumn("side", side.cast("byte")).drop("mine", "other", "tiles")


def similar_classes(classes: DataFrame, tau: int, most: int = 2048) -> DataFrame:
    """classes(fp, node) -> edges (u, v) at tau or fewer bits that connect all nodes which such links connect.

    most: members of a bucket that are compared as they are; larger buckets are split, or cut into tiles of
    so many members, where that copies them less.
    """
    with_python_path(classes.sparkSession)
    n, moments = bit_moments(classes)
    parts = plan_parts(n, moments, tau)
    rows = classes.select(F.lit(0).cast("long").alias("key"), "fp", "node", F.lit(True).alias("own"), F.lit(0).alias("used"))
    found, about = [], n * sum(ball_size(len(bits), t) for bits, t in parts if t >= 0)
    while True:
        signed = stash(signatures(rows, parts, tau), "signatures", rows=None if found else about)
        sizes = signed.groupBy("key").agg(F.count("*").alias("n"), F.first("used").alias("used")).where(F.col("n") > most)
        large = stash(sizes.select("key", "used", F.ceil(F.col("n") / most).alias("tiles")), "large-buckets", rows=about // most)
        kinds = [r["used"] for r in large.select("used").distinct().collect()]  # sets of parts, a few hundred at most
        if not kinds:
            found.append(stash(verify_buckets(signed.withColumn("side", F.lit(WHOLE)), parts, tau), "links", rows=2 * n))
            break
        copies = F.create_map(*[F.lit(x) for u in kinds for x in (u, split_copies(parts, u, tau))])
        tiled, split = (stash(large.where(w).select("key", "tiles"), "large-buckets", rows=about // most) for w in (F.col("tiles") <= copies[F.col("used")], F.col("tiles") > copies[F.col("used")]))
        small = signed.join(large, "key", "left_anti").withColumn("side", F.lit(WHOLE))
        cut_up = in_tiles(signed.join(tiled, "key"), "key", "fp")
        found.append(stash(verify_buckets(small.unionByName(cut_up), parts, tau), "links", rows=2 * n))
        rows = signed.join(split, "key", "left_semi")
        if split.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


SEEN = 500_000  # texts that a task remembers


def shingle_sets(rows: DataFrame, shingle_words: int) -> DataFrame:
    """rows(doc_id, text) -> doc_id, node, shingles: the text's hash (case of A-Z and white space aside), and the distinct hashes of the word shingles of the whole text, in order.

    A task leaves the shingles of a text out (null) where it has already given them for the same text. A
    frame holds FRAME_ROWS shingles, or those of one text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            ids = batch.doc_id.astype("Int64")
            nodes, sets, held, done = [], [], 0, 0
            if len(seen) > SEEN:
                seen.clear()
            for i, text in enumerate(batch.text):
                if held >= FRAME_ROWS:
                    yield framed(ids[done:i], nodes, sets)
                    nodes, sets, held, done = [], [], 0, i
                words = (text or "").encode("utf-8", "replace").lower().split()
                joined = b" ".join(words)
                nodes.append(xxhash.xxh64_intdigest(joined))
                if nodes[-1] in seen:
                    sets.append(None)
                    continue
                seen.add(nodes[-1])
                ends = np.cumsum([len(w) + 1 for w in words])
                stops = (ends - 1).tolist()[min(shingle_words, max(len(words), 1)) - 1 :] if words else []
                hashes = [xxhash.xxh64_intdigest(joined[x:y]) for x, y in zip([0, *ends[:-1].tolist()], stops, strict=False)]
                sets.append(np.unique(np.array(hashes, dtype=np.uint64)).view(np.int64))
                held += len(sets[-1])
            yield framed(ids[done:], nodes, sets)

    def framed(ids: pd.Series, nodes: list[int], sets: list) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": ids.to_numpy(), "node": np.array(nodes, dtype=np.uint64).view(np.int64), "shingles": sets}).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, "doc_id long, node long, shingles array<long>")


def shingle_counts(sets: DataFrame, counters: int = 1 << 21, chunk: int = 1 << 15) -> np.ndarray:
    """How many texts hold a shingle, at most: counts over all texts, of all shingles that share a counter (the hash's low bits).

    Each task counts into an array of fixed size and hands on what is not zero, part by part; the parts
    are added up as a stream.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(counters, dtype=np.uint32)
        for batch in batches:
            every = np.concatenate([np.zeros(0, dtype=np.int64), *batch.shingles])
            total += np.bincount(every & (counters - 1), minlength=counters).astype(np.uint32)
        for at in range(0, counters, chunk):
            found = np.flatnonzero(total[at : at + chunk])
            if len(found):
                yield pd.DataFrame({"part": [at // chunk], "places": [found.astype(np.uint16).tobytes()], "counts": [total[at : at + chunk][found].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = None, np.zeros(chunk, dtype=np.uint32)
        for batch in batches:
            for p, places, data in zip(batch.part, batch.places, batch.counts, strict=True):
                if part is not None and p != part:
                    yield pd.DataFrame({"part": [part], "counts": [total.tobytes()]})
                    total = np.zeros(chunk, dtype=np.uint32)
                part = p
                total[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(data, dtype=np.uint32)
        if part is not None:
            yield pd.DataFrame({"part": [part], "counts": [total.tobytes()]})

    out = np.zeros(counters, dtype=np.uint32)
    with discarded(sets.sparkSession):
        parts = stash(sets.select("shingles").mapInPandas(count, "part int, places binary, counts binary"), "counts")
        sums = stash(parts.repartition("part").sortWithinPartitions("part").mapInPandas(add, "part int, counts binary"), "counts")
        for part, data in sums.collect():  # four bytes a counter
            out[part * chunk : (part + 1) * chunk] = np.frombuffer(data, dtype=np.uint32)
    return out


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """sets(node, shingles) -> shingle, node, size, place, n, hot: the rarest shingles of each text, as many as needed.

    Two sets of the similarity share at least similarity * size of either, so under one order of all
    shingles the first size - ceil(similarity * size) + 1 of both have a common one. Any order will do;
    frequent shingles are last, that few texts meet. n: how many texts hold the shingle, at most; hot: so
    many that they would fill a good part of a task.
    """
    spark = sets.sparkSession
    known = shingle_counts(sets)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = max(int(known.sum(dtype=np.int64)) / (40 * tasks), 4 * float(known.mean()), 8.0)  # a fifth of all shingles are prefixes
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                taken = [np.zeros(0, dtype=np.int64)]
                for s in some.shingles:
                    s = s[np.argsort(counts[s & (len(counts) - 1)], kind="stable")]
                    taken.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1])
                lengths, sizes = [len(t) for t in taken[1:]], [len(s) for s in some.shingles]
                places = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(n) for n in lengths]])
                every = np.concatenate(taken)
                n = counts[every & (len(counts) - 1)]
                yield pd.DataFrame({"shingle": every, "node": np.repeat(some.node.to_numpy(), lengths), "size": np.repeat(sizes, lengths), "place": places, "n": n.astype(np.int64), "hot": n > hot})

    return sets.mapInPandas(run, "shingle long, node long, size int, place int, n long, hot boolean")


MAX_BROADCAST = 1_000_000  # nodes of eight bytes


def both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Stored pairs (u, v) with the columns of table(node, ...), one row a node, for both: leaf, hub, a_.. and b_...

    A node of so many pairs that they would fill a good part of a task (fewer than 16 a task) is the hub of
    its pairs: their other ends are looked up first, and then meet copies of the hub's row in several
    tasks. So a pair moves with one row of the table, and a hub's row moves once for each of its parts.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(pairs.count() / (8 * tasks), 64.0)
    degrees = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).groupBy("node").count()
    hubs = stash(degrees.where(F.col("count") > most).select("node", F.ceil(F.col("count") / most).cast("int").alias("parts")), "hubs", rows=16 * tasks)
    few = F.broadcast(hubs)
    met = pairs.join(few.toDF("u", "u_parts"), "u", "left").join(few.toDF("v", "v_parts"), "v", "left")
    turned = F.coalesce("u_parts", F.lit(1)) > F.coalesce("v_parts", F.lit(1))
    met = met.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("hub"), F.greatest(F.coalesce("u_parts", F.lit(1)), F.coalesce("v_parts", F.lit(1))).alias("parts"))
    met = met.withColumn("part", F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int")).drop("parts")
    values = [c for c in table.columns if c != "node"]
    leaves = table.select(F.col("node").alias("leaf"), *[F.col(c).alias(f"a_{c}") for c in values])
    copies = table.join(few, "node", "left").select(F.col("node").alias("hub"), *[F.col(c).alias(f"b_{c}") for c in values], F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return met.join(leaves, "leaf").join(copies, ["hub", "part"])


def _pair() -> list[Column]:
    return [F.greatest("leaf", "hub").alias("u"), F.least("leaf", "hub").alias("v")]


def similar_texts(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Stored pairs (u, v) whose shingle sets have a Jaccard similarity of at least `similarity`; sets(node, shingles)."""
    about = pairs.count()
    with discarded(pairs.sparkSession):
        nodes = stash(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "nodes", rows=2 * about)
        few = nodes.count() <= MAX_BROADCAST  # then the sets stay where they are
        named = stash(sets.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"]), "shingles")
        both = both_ends(pairs, named)
        shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
        alike = shared >= F.lit(similarity) * (F.size("a_shingles") + F.size("b_shingles") - shared)
        return stash(both.where(alike).select(*_pair()), "links", outer=True, rows=about)


def occupancy(shingles: np.ndarray, most: int = 1024) -> bytes:
    """How many shingles fall into each of 64 to `most` cells, as many as shingles or more if that may be; a byte each.

    Two sets share no more than the sum, over all cells, of the lesser of their counts. A count of 255 or
    more has no byte; then all cells say 255, and there is no bound.
    """
    cells = min(max(64, 1 << max(len(shingles) - 1, 1).bit_length()), most)
    counts = np.bincount(shingles & (cells - 1), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b"\xff" * cells


def _halved(x: np.ndarray) -> np.ndarray:
    """Counts in half as many cells."""
    n = x.shape[1] // 2
    return np.minimum(x[:, :n].astype(np.uint16) + x[:, n:], 255).astype(np.uint8)


def may_share(a: bytes, b: bytes) -> int:
    """At most how many shingles two texts of these cells have in common."""
    x, y = (np.frombuffer(c, dtype=np.uint8)[None, :] for c in (a, b))
    while x.shape[1] != y.shape[1]:
        x, y = (_halved(x), y) if x.shape[1] > y.shape[1] else (x, _halved(y))
    return NO_BOUND if 255 in (a[0], b[0]) else int(np.minimum(x, y).sum(dtype=np.int64))


def text_cells(sets: DataFrame, postings: DataFrame, texts: int | None = None) -> DataFrame:
    """Stored node, size, cells, fp of the texts that have a posting; see occupancy() and majority_bits(). texts: about how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch.node, "size": [len(s) for s in batch.shingles], "cells": [occupancy(s) for s in batch.shingles], "fp": [majority_bits(np.asarray(s, dtype=np.int64)) for s in batch.shingles]})

    every = sets.mapInPandas(run, "node long, size int, cells binary, fp long")
    return stash(every.join(postings.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "cells", rows=texts)


TAU = 3  # bits in which the fingerprints of two shingle sets may differ to be linked


def fingerprint_links(prints: DataFrame, tau: int = TAU, texts: int | None = None) -> DataFrame:
    """prints(node, fp) -> pairs (u, v), u > v: each node and the least of its fingerprint, and least nodes at tau bits or fewer, as similar_classes() links them."""
    classes = stash(prints.groupBy("fp").agg(F.min("node").alias("node")), "classes", rows=texts)
    equal = prints.select(F.col("node").alias("u"), "fp").join(classes, "fp").where(F.col("u") != F.col("node")).select("u", F.col("node").alias("v"))
    near = similar_classes(classes, tau)
    return equal.unionByName(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def likely(pairs: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Stored pairs (u, v) whose sizes and cells allow the similarity."""

    @F.pandas_udf("boolean")
    def allowed(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
        need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
        return pd.Series([may_share(x, y) >= k for x, y, k in zip(a, b, need, strict=True)], dtype=bool)

    both = both_ends(pairs, cells.select("node", "size", "cells"))
    near = F.least("a_size", "b_size") >= F.lit(similarity - 1e-9) * F.greatest("a_size", "b_size")
    return both.where(near).where(allowed("a_size", "a_cells", "b_size", "b_cells")).select(*_pair())


def likely_pairs(size: np.ndarray, place: np.ndarray, root: np.ndarray, cells: list[bytes], similarity: float, tile: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the pairs of different roots that may have the similarity, by their sizes, what stands behind their common shingle, and their cells.

    tile: only pairs of one row of tile 0 and one of tile 1 count.
    """
    order = np.argsort(size, kind="stable")
    size, place, root = size[order].astype(np.int64), place[order].astype(np.int64), root[order]
    side = np.zeros(len(size), dtype=np.int8) if tile is None else tile[order]
    left = size - place
    width = np.array([len(cells[i]) for i in order])
    own = {w: np.frombuffer(b"".join(cells[i] for i, v in zip(order, width, strict=True) if v == w), dtype=np.uint8).reshape(-1, w) for w in np.unique(width)}
    half = {w: _halved(x) for w, x in own.items()}
    rank = np.zeros(len(size), dtype=np.int64)
    for w in own:
        rank[width == w] = np.arange((width == w).sum())
    open_ = np.array([cells[i][0] == 255 for i in order])
    us, vs = [], []
    for i in range(len(size)):
        stop = np.searchsorted(size, size[i] / similarity + 1e-9, side="right")
        js = np.arange(i + 1, stop)
        need = np.ceil(similarity / (1 + similarity) * (size[i] + size[js]) - 1e-9)
        ok = (root[js] != root[i]) & (np.minimum(left[i], left[js]) >= need)
        if tile is not None:
            ok &= side[js] != side[i]
        js, need, w = js[ok], need[ok], width[i]
        mine = own[w][rank[i]]
        for v, table in ((w, own), (2 * w, half)):
            same = width[js] == v
            if same.any():
                bound = np.minimum(table[v][rank[js[same]]], mine).sum(axis=1, dtype=np.int64)
                hits = js[same][(bound >= need[same]) | open_[i] | open_[js[same]]]
                us.append(np.full(len(hits), i))
                vs.append(hits)
        far = js[(width[js] != w) & (width[js] != 2 * w)]  # of so similar sizes there are none
        us.append(np.full(len(far), i))
        vs.append(far)
    join = lambda x: order[np.concatenate(x)] if x else np.zeros(0, dtype=np.int64)
    return join(us), join(vs)


TILE = 2048  # members of a shingle that one task compares with each other
POSTINGS = 20  # of a text, about
FRAME_PAIRS = 1_000_000  # of a yielded frame, before those of one more shingle or two tiles


def meeting_pairs(postings: DataFrame, cells: DataFrame, similarity: float, most: int = TILE) -> DataFrame:
    """postings(shingle, node, size, place, root) -> pairs (u, v) of different roots that meet at a shingle and may have the similarity.

    The members of a shingle are compared inside one task, in which only likely pairs are formed; a shingle
    of more than `most` members is cut into tiles, and each two tiles are compared by themselves.
    """
    tiles = postings.groupBy("shingle").agg(F.ceil(F.count("*") / most).cast("int").alias("tiles")).where("tiles > 1")
    tiled = postings.join(tiles, "shingle", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumnRenamed("shingle", "key")
    rows = in_tiles(tiled, "key", "node").select("key", "node", "size", "place", "root", "side").join(cells.select("node", "cells"), "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None

        def pairs(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key, node = x.key.to_numpy(), x.node.to_numpy()
            cuts = np.append(0, np.append(np.flatnonzero(np.diff(key)) + 1, len(key)))
            columns, held, side = [x[c].to_numpy() for c in ("size", "place", "root")], x.cells.to_list(), x.side.to_numpy()
            us, vs, ready = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if ready >= FRAME_PAIRS:
                    yield framed(us, vs)
                    us, vs, ready = [], [], 0
                if b - a > 1:
                    left, right = likely_pairs(*[c[a:b] for c in columns], held[a:b], similarity, side[a:b] if side[a] < WHOLE else None)
                    us.append(node[a:b][left])
                    vs.append(node[a:b][right])
                    ready += len(left)
            if us:
                yield framed(us, vs)

        def framed(us: list[np.ndarray], vs: list[np.ndarray]) -> pd.DataFrame:
            u, v = np.concatenate(us), np.concatenate(vs)
            return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).query("u != v").drop_duplicates()

        for batch in batches:
            x = batch if carried is None else pd.concat([carried, batch])
            whole = x.key.to_numpy() != x.key.iloc[-1] if len(x) else np.zeros(0, dtype=bool)
            carried = x[~whole]
            if whole.any():
                yield from pairs(x[whole])
        if carried is not None and len(carried):
            yield from pairs(carried)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "u long, v long").distinct()


def similar_pairs(sets: DataFrame, similarity: float, most: int = TILE, *, texts: int | None = None) -> DataFrame:
    """sets(node, shingles), a few equal rows of a node at most -> pairs (u, v), all at the similarity or above, that connect all nodes which such pairs connect.

    texts: about how many nodes there are, if known.

    First come the links of the sets' fingerprints by the generalised pigeonhole, and each text meets two
    ends of the prefix shingles that it shares most often: the member that shares most with others, which
    is where copies of one text come from, and the least node. All these pairs are compared as sets; they
    join most of a group of copies. Fingerprints alone would miss similar texts that differ in more bits,
    so the nodes that are still apart and share a prefix shingle are then compared, and none is lost.
    """
    every = Window.partitionBy("shingle", F.when(F.col("hot"), F.col("node")))  # a hot shingle is shared, and its texts need not meet here
    listed = prefixes(sets, similarity).withColumns({"low": F.min("node").over(every), "high": F.max("node").over(every)})
    postings = stash(listed.where("hot or low < high").select("shingle", "node", "size", "place", "n").dropDuplicates(["shingle", "node"]), "postings", rows=texts and POSTINGS * texts)
    cells = text_cells(sets, postings, texts)
    weights = postings.groupBy("node").agg(F.sum("n").alias("weight"))
    at = F.struct("node", "size", "place")
    ends = postings.join(weights, "node").groupBy("shingle").agg(F.min(at).alias("low"), F.max(F.struct("weight", "node", "size", "place")).alias("hub"))
    met = postings.join(ends, "shingle")

    def near(end: str) -> Column:
        """Whether the shingles from this common one on are enough; at the first common shingle they are all that is shared."""
        e = F.col(end)
        reach = F.least(F.col("size") - F.col("place"), e["size"] - e["place"])
        return reach >= F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + e["size"]) - 1e-9)

    counted = [met.where((F.col(f"{c}.node") != F.col("node")) & near(c)).groupBy("node", F.col(f"{c}.node").alias("end")).count() for c in ("low", "hub")]
    best = [m.groupBy("node").agg(F.max_by("end", F.struct("count", "end")).alias("end")) for m in counted]
    nearest = best[0].unionByName(best[1]).select(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("v"))
    pairs = texts and 3 * texts  # a link and two ends
    first = stash(fingerprint_links(cells.select("node", "fp"), texts=texts).unionByName(nearest).distinct(), "pairs", rows=pairs)
    passed = similar_texts(stash(likely(first, cells, similarity), "pairs", rows=pairs), sets, similarity)
    apart = postings.join(components(passed, pairs), "node", "left").select("shingle", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    groups = apart.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    apart = stash(apart.join(groups, "shingle", "left_semi"), "apart", rows=texts and POSTINGS * texts)
    rest = stash(meeting_pairs(apart, cells, similarity, most).join(first, ["u", "v"], "left_anti"), "pairs", rows=pairs)
    return passed.unionByName(similar_texts(rest, sets, similarity))


def near_duplicate_components(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, component_id over all pairs whose Jaccard similarity on word shingles is at least `similarity`.

    Exact: pairs come from SimHash links, each verified, and for texts that these leave apart from a prefix
    filter, which no similar pair escapes. Rows of one text (case of A-Z
    and white space aside) are one class. Null text counts as empty; empty texts are one class. Null ids
    are linked too; a component of such rows alone has a null component_id. Repeated rows say the same.
    An empty table gives an empty result. Extra columns are not read.
    """
    with_python_path(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with discarded(docs.sparkSession):
        all_sets = stash(shingle_sets(rows, shingle_words), "sets")
        every = all_sets.count()
        classes = stash(all_sets.groupBy("node").agg(F.min("doc_id").alias("low")), "classes", rows=every)
        texts = classes.count()
        sets = all_sets.where("shingles is not null").select("node", "shingles")
        named = classes.select("node", "low").join(components(similar_pairs(sets, similarity, texts=texts), 3 * texts), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("low").alias("component_id"))
        found = named.join(least, "root").select("node", "component_id")
        return stash(all_sets.select("doc_id", "node").join(found, "node").select("doc_id", "component_id"), "components", outer=True, rows=every)


def simhash_components(docs: DataFrame, shingle_words: int = 5, tau: int = 3, id_col: str = "doc_id", text_col: str = "text", most: int = 2048) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id, the smallest doc_id reachable over links.

    Texts are lower-cased in A-Z only, words are split at ASCII white space, and shingles count as often
    as they stand; a text with fewer words is one shingle, and one without words (null, empty) has
    fingerprint zero and is linked like any other. Rows with null ids are linked too; a component of
    such rows alone has a null component_id. Repeated rows say the same. An empty table gives an empty
    result. Extra columns are not read.
    """
    prints = stash(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nameless = F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 40))
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", F.coalesce("low", nameless).alias("node")), "classes")
    roots = components(similar_classes(classes, tau, most))
    named = classes.join(roots, "node", "left").select(F.col("fp").alias("c_fp"), F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(named, F.col("fp") == F.col("c_fp"))
    return joined.select("doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))
