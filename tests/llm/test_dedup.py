import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup as E
from corpusmill.llm import simhash as S
from corpusmill.llm.common import pick
from corpusmill.llm.exact_dedup import compact, exact_dedup, flush_runs
from corpusmill.llm.line_dedup import dedup_lines, keep_bitmaps, without_shared_lines


def low(i):
    return -1 if i is None else i


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_is_brute_force_even_with_colliding_digests(make_docs, mixed_rows, digest_bytes, keep):
    got = [tuple(r) for r in exact_dedup(make_docs(mixed_rows), keep=keep, digest_bytes=digest_bytes).collect()]
    groups = defaultdict(list)
    for i, t in mixed_rows:
        groups[t or ""].append(i)
    want = []
    for i, t in mixed_rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "largest" else min)(ids, default=None)
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("filtered", [True, False])
def test_exact_dedup_of_a_hot_text_very_long_texts_and_no_filter(make_docs, monkeypatch, filtered):
    """A third of all rows are one text; beyond its size bound there is no filter, and the result is the same."""
    if not filtered:
        monkeypatch.setattr(E, "MAX_FILTER_BITS", 0)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)] + [(5000, "x" * 3_000_000), (5001, "x" * 3_000_000), (5002, "x" * 2_999_999 + "y")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = {(i, max(groups[t]), len(groups[t])) for i, t in rows}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(make_docs(rows)).collect()} == want


def test_stored_digests_are_found(make_docs):
    runs = flush_runs(pick(make_docs([(1, "a"), (2, "b"), (3, "a")]), "doc_id", "text"))
    wanted = [hashlib.sha256(x).digest() for x in (b"a", b"zz")]
    assert sorted(r.doc_id for r in E.stored(runs, wanted).collect()) == [1, 3]


def test_index_takes_in_more_runs(make_docs):
    rows, more = (pick(make_docs(r), "doc_id", "text") for r in ([(1, "a"), (2, "b")], [(9, "a"), (3, "c")]))
    index = compact(flush_runs(more), compact(flush_runs(rows)))
    assert sorted((r.keep_id, r.n) for r in index.collect()) == [(2, 1), (3, 1), (9, 2)]


def line_dedup_by_hand(rows, least):
    first = {}
    keys = {}
    space = " \t\n\x0b\x0c\r"
    for i, t in rows:
        lines = (t or "").split("\n")
        keys[i, t] = [x.strip(space).translate({c: c + 32 for c in range(65, 91)}) for x in lines]
        for k in keys[i, t]:
            if len(k) >= least:
                first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys[i, t], strict=True) if len(k) < least or first[k] == i]
        out[i] = (len(keys[i, t]), len(keys[i, t]) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_is_brute_force(make_docs):
    shared = ["A common line of words", "another shared LINE here", "É unlike é in this line"]
    rows = [(i, "\n".join([f"own line number {i}", shared[i % 3], "short", shared[i % 2].upper(), "  " + shared[0] + "\t", f"own line number {i}"])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A common line of words"), (104, "\n".join(f"line {i} of many in a long text" for i in range(400))), (105, "line 399 of many in a long text\r\n日本語の長い長い長い行です")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(make_docs(rows)).collect()}
    want = line_dedup_by_hand(rows, 10)
    assert got == want
    left = {r[0]: r[1] for r in without_shared_lines(make_docs(rows)).collect()}
    assert {i: t or "" for i, t in left.items()} == {i: t for i, (n, gone, t) in want.items() if gone < n}


def test_line_dedup_of_a_very_long_text(make_docs):
    lines = [f"line {i} of a very long text" for i in range(200_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines)), (3, "w" * 2_000_000), (4, "W" * 2_000_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(make_docs(rows)).collect()}
    assert got == {1: (100_000, 0, rows[0][1]), 2: (200_000, 100_000, "\n".join(lines[1::2])), 3: (1, 0, rows[2][1]), 4: (1, 1, "")}


def test_repeated_rows_are_one_document(make_docs):
    got = keep_bitmaps(make_docs([(1, "a line that is long"), (1, "a line that is long"), (2, "a line that is long")])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (1, 0), (2, 1)]


def fingerprint_by_hand(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, make_docs, mixed_rows):
    got = {(r.doc_id, r.fp & (1 << 64) - 1) for r in S.fingerprints(make_docs(mixed_rows), 3).collect()}
    assert got == {(i, fingerprint_by_hand(t, 3)) for i, t in mixed_rows}
    spark_hash = spark.createDataFrame([("one two three",)], "v string").select(F.xxhash64("v").alias("h")).first().h
    assert spark_hash & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", seed=42)


def components_by_hand(prints, tau):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= tau:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, least.get(find(i))) for i, (doc, _) in enumerate(prints)}


@pytest.mark.parametrize("most", [4096, 4])
def test_components_are_brute_force(make_docs, mixed_rows, most):
    """most=4 sends every bucket of more than four through the splitting of large buckets."""
    got = {(r.doc_id, r.component_id) for r in S.simhash_components(make_docs(mixed_rows), 3, 3, most=most).collect()}
    assert got == components_by_hand([(i, fingerprint_by_hand(t, 3)) for i, t in mixed_rows], 3)


@pytest.mark.parametrize(("tau", "most"), [(3, 4096), (3, 16), (5, 4096), (1, 4096)])
def test_similar_classes_lose_no_link(spark, tau, most):
    rng = np.random.default_rng(tau)
    centres = rng.integers(0, 1 << 62, 12)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 7), replace=False)) for c in centres for _ in range(25)}
    nodes = [(n, fp) for n, fp in enumerate(sorted(prints))]
    edges = S.similar_classes(spark.createDataFrame([(fp, n) for n, fp in nodes], "fp long, node long"), tau, most)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert {(n, roots.get(n, n)) for n, _ in nodes} == components_by_hand(nodes, tau)


def test_large_buckets_of_few_parts_are_split(spark, monkeypatch):
    """Three parts with a radius of 8, as on millions of texts: the last part's ball would have 401,930 values."""
    plan = [(list(range(22)), 2), (list(range(22, 43)), 2), (list(range(43, 64)), 2)]
    monkeypatch.setattr(S, "plan_parts", lambda n, moments, tau: plan)
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(3, 8), replace=False)) for _ in range(60)}
    nodes = [(n, fp) for n, fp in enumerate(sorted(prints))]
    edges = S.similar_classes(spark.createDataFrame([(fp, n) for n, fp in nodes], "fp long, node long").coalesce(1), 8, 30)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert {(n, roots.get(n, n)) for n, _ in nodes} == components_by_hand(nodes, 8)


def jaccard_components_by_hand(rows, least=0.8):
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in words]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if words[i] == words[j] or (a or b) and len(a & b) >= least * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    return {(d, min((x for (x, _), s in zip(rows, root, strict=True) if s == r and x is not None), default=None)) for (d, _), r in zip(rows, root, strict=True)}


def test_near_duplicates_are_those_of_jaccard_similarity(make_docs):
    r = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = list(r.choice(vocabulary, 300))
        for _ in range(6):
            w = list(base)
            for at in r.choice(300, int(r.integers(0, 6)), replace=False):
                w[at] = "changed"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base[:150] + list(r.choice(vocabulary, 150)))))
    rows += [(900, None), (901, ""), (902, " "), (903, "two words"), (904, "Two  words"), (None, rows[0][1])]
    got = {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()}
    want = jaccard_components_by_hand(rows)
    assert got == want
    assert S.near_duplicate_components(make_docs(rows[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["added", "cut", "replaced", "scattered"])
def test_near_duplicates_find_every_kind_of_edit(make_docs, kind):
    """Blocks added, cut off or replaced and scattered changes, at similarities of 0.80 to 0.95: none is missed."""
    r = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        w, share = list(r.choice(vocabulary, 300)), (0.8, 0.85, 0.9, 0.95)[g % 4]
        n = 296  # shingles
        if kind == "added":
            other = w + list(r.choice(vocabulary, int(n / share) - n))
        elif kind == "cut":
            other = w[: 300 - int(n * (1 - share))]
        elif kind == "replaced":
            lost = int(n * (1 - share) / (1 + share))
            other = w[: 300 - lost] + list(r.choice(vocabulary, lost))
        else:
            other = list(w)
            for at in range(10, 10 + 20 * int(n * (1 - share) / (1 + share) / 5), 20):
                other[at] = "changed"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(other))]
    want = jaccard_components_by_hand(rows)
    assert {d for d, c in want if d != c} == set(range(1, 80, 2))
    assert {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()} == want


def test_a_pair_is_found_among_relatives_that_are_not_similar_enough(make_docs):
    """Each pair of 0.82 lies in a family of 30 whose other members are below 0.8 to all."""
    r = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for _ in range(4):
        base = list(r.choice(vocabulary, 300))
        family = [list(base) for _ in range(30)]
        for k, w in enumerate(family):
            for at in range(20 + k % 20, 300, 40 if k > 1 else 56):
                w[at] = f"own{k}"
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(family)]
    want = jaccard_components_by_hand(rows)
    linked = [d for d, c in want if d != c]
    assert len(linked) == 4
    assert {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()} == want


def test_near_duplicates_come_from_fingerprint_links_first(spark, make_docs, monkeypatch):
    prose = lambda seed, n: " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))
    long = prose(5, 400).split()
    edited = [" ".join(["new", "words", *long[2:]]), " ".join([*long[:-1], "end"])]
    rows = [(1, " ".join(long)), (2, edited[0]), (3, edited[1]), (4, prose(6, 400)), (5, "one two")]
    sets = S.shingle_sets(pick(make_docs(rows), "doc_id", "text"), 5).where("shingles is not null")
    prints = {r.doc_id: S.majority_bits(np.array(r.shingles, dtype=np.int64)) for r in sets.collect()}
    table = spark.createDataFrame([*prints.items(), (6, prints[4])], "node long, fp long")
    links = {(r.u, r.v) for r in S.fingerprint_links(table).collect()}
    near = {(a, b) for a in prints for b in prints if a > b and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= S.TAU}
    assert (6, 4) in links and links - {(6, 4)} <= near and {a for a, _ in near} <= {a for link in links for a in link}
    asked = []
    real = S.similar_classes
    monkeypatch.setattr(S, "similar_classes", lambda classes, tau, most=2048: asked.append(classes.count()) or real(classes, tau, most))
    got = {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()}
    assert got == jaccard_components_by_hand(rows) and asked and asked[0] > 0


def test_likely_pairs_lose_none_that_is_similar():
    """Of sets of all sizes, also with cells that overflow, every similar pair is among the likely ones, and most others are not."""
    r = np.random.default_rng(6)
    sets = []
    for size in (1, 2, 5, 30, 31, 33, 64, 200, 3000):
        base = r.integers(-(1 << 62), 1 << 62, size)
        for share in (0.0, 0.05, 0.1, 0.15, 0.3):
            other = base.copy()
            other[: int(share * size)] = r.integers(-(1 << 62), 1 << 62, int(share * size))
            sets += [np.unique(other), np.unique(other[: max(1, int(size * 0.9))])]
    sets += [np.unique(np.append(x, [1024 * i for i in range(400)])) for x in sets[-4:]]
    sets += [np.arange(700_000) * 7, np.arange(60_000, 760_000) * 7]
    n = len(sets)
    size, zero = np.array([len(x) for x in sets]), np.zeros(n, dtype=np.int64)
    similar = {(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    got = {(max(a, b), min(a, b)) for a, b in zip(*S.likely_pairs(size, zero, np.arange(n), [S.occupancy(x) for x in sets], 0.8), strict=True)}
    assert similar <= got and len(got - similar) < 0.1 * n * n
    tile = np.arange(n) % 2
    got = {(max(a, b), min(a, b)) for a, b in zip(*S.likely_pairs(size, zero, np.arange(n), [S.occupancy(x) for x in sets], 0.8, tile), strict=True)}
    assert {(i, j) for i, j in similar if tile[i] != tile[j]} <= got and all(tile[i] != tile[j] for i, j in got)


@pytest.mark.parametrize("most", [2048, 7])
def test_a_large_family_is_linked_as_by_brute_force(make_docs, monkeypatch, most):
    """Copies that are similar to their base and less so to each other, beside relatives of the base; also cut into tiles of seven."""
    monkeypatch.setattr(S, "TILE", most)
    monkeypatch.setattr(S.similar_pairs, "__defaults__", (most,))
    r = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = list(r.choice(vocabulary, 150))
    rows = []
    for k in range(120):
        w = list(base)
        for at in r.choice(145, 2 + k % 6, replace=False):
            w[at] = f"own{k}"
        rows.append((k + 10, " ".join(w)))
    rows.append((500, " ".join(base)))
    assert {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()} == jaccard_components_by_hand(rows)


def test_counts_of_shingles_cover_all_texts(spark):
    sets = spark.createDataFrame([(i, [i % 7, 1000 + i, (1 << 21) + 5]) for i in range(500)], "node long, shingles array<long>").repartition(5)
    counts = S.shingle_counts(sets)
    assert counts[5] == 500 + 500 // 7 and counts[0] == 72 and counts[1000] == 1 and counts.sum() == 1500


def test_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in S.components(chain).collect()}
    assert {roots[i] for i in range(1, 201)} == {0} and roots[501] == 500


def test_plan_covers_the_pigeonhole():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 64))
    for n in (10, 10**5, 10**8, 10**10):
        parts = S.plan_parts(n, x.T @ x / 500, 3)
        assert sorted(b for bits, _ in parts for b in bits) == list(range(64))
        assert sum(t for _, t in parts) == 3 - len(parts) + 1


def test_empty_tables(make_docs):
    none = make_docs([(1, "x")]).limit(0)
    assert exact_dedup(none).count() == keep_bitmaps(none).count() == S.simhash_components(none).count() == 0
