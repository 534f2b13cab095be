import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import mixing as M
from corpusmill.llm import packing as P
from corpusmill.llm import topk as K
from corpusmill.llm import warc as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", " x", "x  ", "<|endoftext|> hi", "hi<|endoftext|>", "a <|endoftext|><|endoftext|> b", "x <|endoftext|>  y", "<|endoftext|", "it's  don't 're", " \n a", "日本 語　x", "a\t\tb c", "    x", "1234 5,6%!?"]


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_encoder_gives_the_tokenizers_ids():
    texts = ODD + [" ".join(ODD), "stone river " * 300]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in P.CachedEncoder(PATH)(texts)]
    assert got == encoded(texts)


def naive_bins(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        i = min(fits, key=bins.__getitem__) if fits else len(bins)
        bins[i:] = bins[i:] or [capacity]
        bins[i] -= s
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([5, 16, 31, 64]))
    sizes = r.integers(1, capacity + 1, int(r.integers(0, 150))).tolist()
    counts = Counter(sizes)
    used = defaultdict(list)
    plan = P.plan_bins(counts, capacity)
    for size, n in counts.items():
        runs = [p for p in plan if p[0] == size]
        for p, stop in zip(runs, [q[1] for q in runs[1:]] + [n], strict=True):
            for step in range(stop - p[1]):
                used[p[2] + step // p[3]].append((p[4] + step % p[3] * size, size))
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
    assert sorted(capacity - sum(s for _, s in v) for v in used.values()) == naive_bins(sizes, capacity)


def test_packing_is_whole_and_gapless(make_docs, mixed_rows):
    capacity = 64
    rows = P.best_fit_pack(make_docs(mixed_rows), PATH, capacity, ids=True, digest=True).collect()
    want = Counter((i, tuple(ids + [0])) for (i, _), ids in zip(mixed_rows, encoded([t or "" for _, t in mixed_rows]), strict=True))
    whole = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= capacity
        whole[r.doc_id].append(r)
    for (i, ids), n in want.items():
        mine = [r for r in whole[i] if list(ids[r.start : r.start + r.length]) == r.ids]
        assert sum(r.length for r in mine) >= n * len(ids)
        assert {r.length for r in mine if r.piece > 0} <= {capacity}
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) and min(v)[0] == 0
    assert sorted(capacity - sum(n for _, n in v) for v in bins.values()) == naive_bins([r.length for r in rows], capacity)


def test_sequences_hold_the_tokens(make_docs):
    packed = P.best_fit_pack(make_docs([(1, "a b"), (2, "c")]), PATH, 16)
    rows = P.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == sum(sum(r.lengths) for r in rows) == 5
    assert P.best_fit_pack(make_docs([(1, "a")]).limit(0), PATH, 16).count() == 0


def test_targets():
    assert M.targets([100, 100, 100]) == [50, 100, 150]
    got = M.targets([10, 1000, 10], (1, 1, 8))
    assert got[2] == 30 and got[0] == 30 and abs(sum(got) - 1020) < 1e-9
    assert M.targets([0, 0]) == [0, 0] and M.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    got = M.permute(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
    assert sorted(got.tolist()) == list(range(n))


def test_mixture(make_docs):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 300))), ["big", "a", "b", None][0 if i % 3 == 0 else i % 4]) for i in range(400)] + [(900, None, "a"), (901, "", "b"), (None, "x y z", None)]
    docs = make_docs(rows)
    got = [tuple(x) for x in M.words_taken(M.mix(docs)).collect()]
    assert Counter(got) == Counter(tuple(x) for x in M.words_taken(M.mix(docs)).collect())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip([sizes[s] for s in order], M.targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for _, size, source_size, target, n in got:
        assert n <= 3 * size and abs(goal[source_size] - target) < 1e-6
        taken[source_size] += n
    for s in sizes.values():
        assert abs(taken[s] - goal[s]) <= max(3 * 64, 0.03 * goal[s])
    assert len(got) == len(rows)


def test_mixed_documents_hold_what_is_taken(make_docs):
    docs = make_docs([(i, f"line {i}\n" + " ".join(f"w{j}" for j in range(100)), "ab"[i % 2]) for i in range(40)])
    texts = M.mixed_documents(docs)
    words = sum(len(r["text"].split()) for r in texts.toDF("doc_id", "text", *"abcd").collect())
    assert texts.columns == docs.columns and abs(words - 40 * 102) <= 3 * 64
    assert M.mixed_documents(docs.limit(0)).count() == 0


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8)], "z") for i in range(730)]
    rows += [(1000, None, "z"), (1100, [float("nan")] * 8, "z"), (1200, [1.0] * 7 + [None], "z"), (1300, [0.5] * 3, "z"), (1301, rows[0][1], "z"), (None, [0.1] * 8, "z"), (1400, [float("inf")] * 8, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Score string")
    valid = [(i, np.floor(np.array(np.array(e, dtype=np.float32), dtype=float) * 1024).astype(int)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    pad = lambda e: np.pad(e, (0, 8 - len(e)))
    want = set()
    for q, e in valid:
        if q % 100 == 0:
            best = sorted(((-int(pad(e) @ pad(v)), i) for i, v in valid if i != q))[:10]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for options in ({}, {"block_rows": 100, "query_rows": 3}, {"low": 0}):
        assert {tuple(x) for x in K.top_k(df, **options).collect()} == want
    few = df.where("vec_id in (100, 101)")
    assert [tuple(x)[:3] for x in K.top_k(few).collect()] == [(100, 1, 101)]
    assert K.top_k(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nx\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a/ b", "x" * 50), (2, "u", "x" * 50), (3, None, trap), (4, "u", None), (5, "u", ""), (6, "u", "日本\r\n\r\n"), (7, "u", "x" * 50), (None, "u", "solo"), (8, "u", "dup"), (8, "u", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Type", F.lit("z"))
    got = W.archive_pages(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.request is not None and r.metadata is not None for r in got)
    seen = defaultdict(list)
    for r in got:
        page = r.metadata.fields.get("page-id")
        original = r.original or r.response
        seen[page].append((r.response.type, original.payload_bytes, original.payload_digest, r.original.page_id if r.original else None))
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert seen["7"] == [("response", 50, digest("x" * 50), None)] and seen["1"] == [("revisit", 50, digest("x" * 50), "7")]
    assert seen["3"] == [("response", len(trap), digest(trap), None)] and seen["4"] == [("revisit", 0, digest(""), "5")]
    assert sorted(x[0] for x in seen["8"]) == ["response", "revisit"] and seen[None][0][0] == "response"
    assert all(r.response.digest_ok for r in got if r.response.type == "response")
    payloads = {bytes(r.payload).decode() for r in W.read_warc(spark, str(tmp_path / "w")).where("type = 'response'").collect()}
    assert payloads == {h or "" for _, _, h in rows}
    big = W.archive_pages(pages, str(tmp_path / "v"), min_bytes=10).collect()
    assert sum(r.response.type == "revisit" for r in big) == 2
    assert W.archive_pages(pages.limit(0), str(tmp_path / "e")).count() == 0
    assert json.dumps(sorted(x for x in seen if x)) == '["1", "2", "3", "4", "5", "6", "7", "8"]'


@pytest.mark.parametrize("seed", range(5))
def test_shard_counts_are_whole_and_any_task_draws_alike(monkeypatch, seed):
    monkeypatch.setattr(M, "SPAN_SLOTS", 1 << 9)
    counts = np.random.default_rng(seed).integers(0, 3000, 7).tolist()
    slots, shards = 64, -(-sum(counts) // 64)
    every = dict(M.shard_counts(counts, slots, seed, 0, shards))
    assert sorted(every) == list(range(shards)) and sum(every.values()).tolist() == counts
    assert all(v.sum() == min(slots, sum(counts) - s * slots) and (v >= 0).all() for s, v in every.items())
    part = dict(M.shard_counts(counts, slots, seed, 3, 9))
    assert sorted(part) == list(range(3, 9)) and all((part[s] == every[s]).all() for s in part)


def test_mixture_is_that_of_blocks_taken_by_hand(make_docs):
    """Streams, blocks, draws and permutations again in plain Python, on the same order of documents."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 200))), "abc"[i % 3]) for i in range(150)]
    docs = make_docs(rows).coalesce(1)
    key = docs.toDF("doc_id", "t", *"wxyz").select("doc_id", F.xxhash64("doc_id", F.xxhash64("t"), F.lit(7)).alias("o"))
    order = {x.doc_id: ((x.o & (1 << 64) - 1) >> 52, x.o) for x in key.collect()}
    taken = Counter()
    sources = ["a", "b", "c"]
    streams = [[d for d, t, _ in sorted((x for x in rows if x[2] == s), key=lambda x: order[x[0]]) for _ in t.split()] for s in sources]
    goals = M.targets([len(x) for x in streams])
    counts = [round(g / 64) for g in goals]
    shards = list(M.shard_counts(counts, 1024, 7, 0, -(-sum(counts) // 1024)))
    for i, stream in enumerate(streams):
        blocks = [stream[a : a + 64] for a in range(0, len(stream), 64)]
        n = sum(int(mine[i]) for _, mine in shards)
        for g in range(n):
            k = np.array([(i + 1) * 0xD6E8FEB86659FD93 % 2**64 ^ (g // len(blocks) + 7) * 0xA0761D6478BD642F % 2**64], dtype=np.uint64)
            taken.update(blocks[int(M.permute(np.array([g % len(blocks)]), np.array([len(blocks)]), k)[0])])
    got = {x.doc_id: x.taken for x in M.words_taken(M.mix(docs)).collect()}
    assert got == {d: taken[d] for d, _, _ in rows}


def test_text_of_words_keeps_what_stands_between(spark):
    text = "  a  b\tc\n d e\r\n f g  "
    runs = [[(0, 2)], [(2, 2), (0, 2)], [(0, 1), (3, 2)], [(0, 4), (4, 3)], [(6, 1)]]
    df = spark.createDataFrame([(text, [{"word": a, "words": b} for a, b in r]) for r in runs], "t string, runs array<struct<word:long,words:long>>")
    got = [x.o for x in df.select(M.text_of_words(F.col("t"), F.col("runs")).alias("o")).collect()]
    assert got == ["a  b", "a  b\tc\n d", "a\nd e", text, "g"]


def test_warc_of_hot_payloads_and_large_pages(spark, tmp_path):
    """A third of all pages have one payload, and archives hold less than the largest page."""
    rows = [(i, f"http://h/{i}", "<p>same</p>" * 20 if i % 3 == 0 else f"<p>{i // 2}</p>" * (1 + i % 50)) for i in range(900)] + [(1000, "u", "x" * 2_000_000), (1001, "u", "x" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write_warc(pages, str(tmp_path / "w"), archive_bytes=20_000)
    got = W.resolve_revisits(W.assemble(W.read_warc(spark, str(tmp_path / "w"), payloads=False))).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h].append(i)
    want = {(str(i), "response" if i == max(groups[h]) else "revisit", None if i == max(groups[h]) else str(max(groups[h])), len(h)) for i, _, h in rows}
    assert {(r.metadata.fields["page-id"], r.response.type, r.original and r.original.page_id, (r.original or r.response).payload_bytes) for r in got} == want
    assert len(list((tmp_path / "w").glob("part-*"))) > 10


def test_top_k_of_odd_widths_and_blocks_by_bytes(spark, monkeypatch):
    """Empty vectors, blocks of a few rows, query blocks too large to broadcast, and scores beyond 32 bits."""
    monkeypatch.setattr(K, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 5000, int(r.integers(0, 12)))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.pad(np.floor(np.array(e) * 1024), (0, 12 - len(e))).astype(np.int64) for i, e in rows}
    want = set()
    for q in range(0, 300, 100):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in K.top_k(df).collect()} == want
    assert K.top_k(df.where("vec_id % 100 > 0")).count() == 0
