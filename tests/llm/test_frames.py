"""Frames of unequal size through stored Python maps, and buckets split down to the last fine part."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from corpusmill.llm import simhash as S
from corpusmill.llm.common import discarded, shared_dir, stash
from corpusmill.llm.packing import best_fit_pack
from corpusmill.llm.queries import vocabulary_path


def test_a_small_frame_before_a_large_one_is_stored(spark):
    def run(batches):
        for _ in batches:
            for n in (1000, 400_000, 3, 300_000):
                yield pd.DataFrame({"a": np.arange(n), "b": np.arange(n)})

    kept = stash(spark.range(1).coalesce(1).mapInPandas(run, "a long, b long"), "frames")
    assert kept.count() == 700_003 + 1000


def test_the_three_part_plan_of_millions_of_fingerprints(spark, monkeypatch):
    """20,000 fingerprints in one task, under the plan that is chosen at ten million."""
    plan = [(list(range(21)), 0), (list(range(21, 42)), 0), (list(range(42, 64)), 1)]
    monkeypatch.setattr(S, "plan_parts", lambda n, moments, tau: plan)
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 62, 19_000))
    near = fps[:1000] ^ np.array([sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for _ in range(1000)])
    nodes = [(int(fp), n) for n, fp in enumerate(np.append(fps, near))]
    edges = S.similar_classes(spark.createDataFrame(nodes, "fp long, node long").coalesce(1), 3)
    assert {(max(r), min(r)) for r in edges.collect()} == {(len(fps) + i, i) for i in range(1000)}


def labels_by_hand(fps, tau):
    label = np.arange(len(fps))
    for i in range(len(fps)):
        hits = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= tau)
        old = np.unique(label[hits])
        if len(old) > 1:
            label[np.isin(label, old)] = old.min()
    return label


@pytest.mark.parametrize("most", [4, 16])
def test_a_dense_ball_is_split_to_the_last_fine_part(spark, most):
    """All fingerprints within two or three bits of a centre, and some that only chains reach or none does."""
    rng = np.random.default_rng(most)
    centre = int(rng.integers(0, 1 << 62))
    ball = [centre ^ sum(1 << b for b in c) for k in range(4) for c in combinations(range(0, 48, 3), k)]
    far = [centre ^ sum(1 << int(b) for b in rng.choice(62, 7, replace=False)) for _ in range(40)]
    fps = np.array(sorted({*ball, *far}), dtype=np.int64)
    edges = S.similar_classes(spark.createDataFrame([(int(fp), n) for n, fp in enumerate(fps)], "fp long, node long"), 3, most)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert [roots.get(n, n) for n in range(len(fps))] == labels_by_hand(fps, 3).tolist()


def test_the_last_fine_part_has_its_whole_ball(spark):
    plan = [(list(range(i, 64, 3)), 0 if i else 1) for i in range(3)]
    fp = 0x0123456789ABCDEF
    used = 0b111 | 0b0111 << 3  # all coarse parts and three fine ones
    rows = spark.createDataFrame([(7, fp, 1, True, used)], S.BUCKET)
    assert S.signatures(rows, plan, 3).select("key").distinct().count() == 697


def test_a_long_text_after_many_short_ones_is_packed_whole(make_docs):
    rows = [(i, f"short text {i}") for i in range(700)] + [(700, "many words of one long text " * 290_000)]
    docs = make_docs(rows).coalesce(1)
    sizes = Counter()
    for r in best_fit_pack(docs, vocabulary_path(), capacity=2048, ids=True).selectExpr("doc_id", "size(ids) AS n", "length").collect():
        assert r.n == r.length <= 2048
        sizes[r.doc_id] += r.n
    assert len(sizes) == 701 and sizes[700] > 1_000_000


def test_near_duplicates_of_long_texts_after_short_ones(make_docs):
    long = " ".join(f"w{i}" for i in range(900_000))
    rows = [(i, f"a short text with number {i} in it") for i in range(700)] + [(700, long), (701, long + " end")]
    got = dict(S.near_duplicate_components(make_docs(rows).coalesce(1)).collect())
    assert got[701] == 700 and all(got[i] == i for i in range(700))


def test_discarded_tables_of_two_threads_do_not_meet(spark):
    from concurrent.futures import ThreadPoolExecutor

    shared_dir(spark)

    def run(n):
        with discarded(spark):
            kept = stash(spark.range(n), "threads")
            with discarded(spark):
                stash(spark.range(3), "threads")
            return kept.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, range(1, 9))) == list(range(1, 9))


def jaccard_classes(rows, least=0.8):
    words = [t.split() for _, t in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= least * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {(d, min(x for (x, _), k in zip(rows, label, strict=True) if k == mine)) for (d, _), mine in zip(rows, label, strict=True)}


def test_a_third_near_copies_of_one_text_and_a_family_just_below(make_docs):
    """The hub of 150 near copies is split over tasks; 60 relatives at a similarity of some 0.78 to each other stay apart."""
    r = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(4000)]
    base, other = list(r.choice(vocabulary, 200)), list(r.choice(vocabulary, 300))
    rows = []
    for k in range(150):
        w = list(base)
        w[int(r.integers(0, 200))] = f"own{k}"
        rows.append((len(rows), " ".join(w)))
    for k in range(60):
        w = list(other)
        w[k * 4 : k * 4 + 30] = [f"kin{k}x{i}" for i in range(30)]
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(r.choice(vocabulary, 80))) for i in range(200)]
    got = {(x.doc_id, x.component_id) for x in S.near_duplicate_components(make_docs(rows)).collect()}
    assert got == jaccard_classes(rows)
    assert len({c for d, c in got if 150 <= d < 210}) == 60


def test_both_ends_of_hubs_and_leaves(spark):
    pairs = [(1000 + i, 7) for i in range(300)] + [(7, 3), (9, 7), (500, 9)] + [(9, 10 - 9 - i) for i in range(80)]
    nodes = sorted({x for p in pairs for x in p})
    table = spark.createDataFrame([(n, f"s{n}") for n in nodes], "node long, v string")
    found = S.both_ends(spark.createDataFrame(pairs, "u long, v long"), table).collect()
    assert Counter((max(x.leaf, x.hub), min(x.leaf, x.hub)) for x in found) == Counter((max(p), min(p)) for p in pairs)
    assert all(x.a_v == f"s{x.leaf}" and x.b_v == f"s{x.hub}" for x in found)
    assert len({x.part for x in found if x.hub == 7}) > 1


def test_query_blocks_go_in_rounds_of_bounded_bytes():
    from corpusmill.llm.topk import rounds

    assert rounds([(1, 5), (2, 5), (3, 20), (4, 1), (5, 1)], 10) == [[1, 2], [3], [4, 5]]
    assert rounds([], 10) == [] and rounds([(1, 3), (2, 3)], 0) == [[1], [2]]


@pytest.mark.parametrize("setting", ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled"])
def test_small_tables_of_near_duplicates_are_few_files_where_spark_merges_no_partitions(spark, make_docs, monkeypatch, tmp_path, setting):
    prose = lambda seed: " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 3000, 60))
    rows = [(i, prose(i // 3) + f" {i % 2}") for i in range(240)]
    files = {}

    def counted(df, name, *args, **kwargs):
        out = stash(df, name, *args, **kwargs)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(S, "stash", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set(setting, "false")
    try:
        got = {x.doc_id: x.component_id for x in S.near_duplicate_components(make_docs(rows)).collect()}
    finally:
        spark.conf.unset(setting)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: i - i % 3 for i in range(240)}
    assert max(n for name in files.keys() - {"sets", "shingles", "counts"} for n in files[name]) == 1


def test_pairs_of_many_shingles_come_in_bounded_frames(spark, monkeypatch):
    monkeypatch.setattr(S, "FRAME_PAIRS", 100)
    sizes = []
    real = pd.DataFrame.drop_duplicates
    n, keys = 12, 40
    rows = [(k, 100 * k + i, 50, 0, 100 * k + i) for k in range(keys) for i in range(n)]
    postings = spark.createDataFrame(rows, "shingle long, node long, size int, place int, root long").coalesce(1)
    cell = S.occupancy(np.arange(50))
    cells = spark.createDataFrame([(r[1], bytearray(cell)) for r in rows], "node long, cells binary")
    # the map itself, as a task runs it
    kept = {}
    frame = type(postings)
    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, *a, **b: kept.update(f=f) or plain(self, f, *a, **b))
    found = S.meeting_pairs(postings, cells, 0.8)
    batch = pd.DataFrame(rows, columns=["key", "node", "size", "place", "root"]).assign(side=S.WHOLE, cells=[cell] * len(rows))
    monkeypatch.setattr(pd.DataFrame, "drop_duplicates", lambda self, *a, **b: sizes.append(len(self)) or real(self, *a, **b))
    frames = list(kept["f"](iter([batch])))
    each = n * (n - 1) // 2
    assert sum(map(len, frames)) == keys * each and max(sizes) <= 100 + each
    monkeypatch.undo()
    want = {(100 * k + a, 100 * k + b) for k in range(keys) for a in range(n) for b in range(a)}
    assert {tuple(x) for x in found.collect()} == want
