"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its hashed embedding beside the mean of its hashed character n-gram embeddings. The
network reads windows of words in both directions and pools its states with learnt attention; all
overlapping windows of a text are scored, and the highest makes the document's score. Labels mark
documents, not windows, so training alternates between finding each document's highest window and
learning from it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, pick, with_python_path
from corpusmill.llm.quality import held_out

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000  # labelled documents that are read for training, at most
MAX_TRAINING_CHARS = 20_000  # longer labelled documents are not read for training, so the sample's size is bounded; all are scored
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]")  # scripts without spaces between words: each character is a word
CACHE_WORDS = 200_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_/\\+=~`^@"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's embedding; rows of all character n-grams of <word>, and where each word's begin."""
    rows = np.array([zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words], dtype=np.int64)
    lengths = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owners, grams = [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(23)
        owners.append(owner[at])
        grams.append((h % np.uint64(CHAR_ROWS)).astype(np.int64))
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    return rows, grams[order], np.searchsorted(owners[order], np.arange(len(words)))


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All windows of a text's words, STRIDE apart; 0 fills up the last one."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Vocabulary:
    """Ids of words as they stand in texts; punctuation around a word and its case are left aside. Id 0 is padding."""

    def __init__(self):
        self.raw: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.fresh: list[str] = []

    def ids(self, text: str) -> np.ndarray:
        raw = self.raw
        words = (text if text.isascii() else UNSPACED.sub(r" \g<0> ", text)).split()
        for w in {*words}.difference(raw):
            plain = w.strip(PUNCTUATION).lower()
            if plain not in self.plain:
                self.plain[plain] = len(self.plain) + 1
                self.fresh.append(plain)
            raw[w] = self.plain[plain]
        return np.fromiter(map(raw.__getitem__, words), dtype=np.int32, count=len(words))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def new(seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": r.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "char": r.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM))}
        for k in "fb":
            p |= {f"W{k}": r.normal(0, d**-0.5, (d, 3 * h)), f"U{k}": r.normal(0, 0.5 * h**-0.5, (h, 3 * h)), f"c{k}": np.zeros(3 * h)}
        p |= {"A": r.normal(0, (2 * h) ** -0.5, (2 * h, ATTENTION)), "a": np.zeros(ATTENTION), "v": r.normal(0, 1, ATTENTION), "o": r.normal(0, 0.5, 2 * h), "q": np.zeros(1)}
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def embed(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        rows, grams, starts = features
        if not len(rows):
            return np.zeros((0, WORD_DIM + CHAR_DIM), dtype=np.float32)
        counts = np.diff(np.append(starts, len(grams)))
        chars = np.zeros((len(rows), CHAR_DIM), dtype=np.float32)
        has = counts > 0
        if has.any():
            chars[has] = np.add.reduceat(self.p["char"][grams], starts[has], axis=0) / counts[has, None]
        return np.concatenate([self.p["word"][rows], chars], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def run(self, table: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows; table: projected words, row 0 for padding. keep: also what backward() needs."""
        n, steps, h = *idx.shape, HIDDEN
        states = np.zeros((steps, n, 2 * h), dtype=np.float32)
        live = idx.T > 0
        trail: dict[str, list] = {"f": [None] * steps, "b": [None] * steps}
        for k, col, order in (("f", 0, range(steps)), ("b", 1, range(steps - 1, -1, -1))):
            u = self.p[f"U{k}"]
            half = np.ascontiguousarray(table[:, col * 3 * h : (col + 1) * 3 * h])
            now = np.zeros((n, h), dtype=np.float32)
            for t in order:
                g = half[idx[:, t]]
                zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + now @ u[:, : 2 * h])))
                z = zr[:, :h] * live[t][:, None]
                r = zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * now) @ u[:, 2 * h :])
                if keep:
                    trail[k][t] = (now, z, r, c)
                now = now + z * (c - now)
                states[t, :, col * h : (col + 1) * h] = now
        s = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(live, s @ self.p["v"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = (w[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["o"] + self.p["q"][0]
        return (logits, (states, s, w, pooled, trail, live)) if keep else logits

    def backward(self, idx: np.ndarray, kept: tuple, dlogit: np.ndarray, words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the embeddings, and of each word's projection."""
        states, s, w, pooled, trail, live = kept
        h, steps = HIDDEN, idx.shape[1]
        g = {"o": pooled.T @ dlogit, "q": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * self.p["o"]
        dw = (states * dpooled).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0)) * live
        ds = de[:, :, None] * self.p["v"] * (1 - s * s)
        g |= {"v": (de[:, :, None] * s).sum(axis=(0, 1)), "A": np.einsum("tni,tnj->ij", states, ds), "a": ds.sum(axis=(0, 1))}
        dstates = w[:, :, None] * dpooled + ds @ self.p["A"].T
        dtable = np.zeros((words, 6 * h), dtype=np.float32)
        for k, col, order in (("f", 0, range(steps - 1, -1, -1)), ("b", 1, range(steps))):
            u = self.p[f"U{k}"]
            du, dnow = np.zeros_like(u), np.zeros((idx.shape[0], h), dtype=np.float32)
            for t in order:
                before, z, r, c = trail[k][t]
                dnow = dnow + dstates[t, :, col * h : (col + 1) * h]
                dc = dnow * z * (1 - c * c)
                dz = dnow * (c - before) * z * (1 - z)
                drh = dc @ u[:, 2 * h :].T
                dr = drh * before * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1) * live[t][:, None]
                du[:, : 2 * h] += before.T @ dg[:, : 2 * h]
                du[:, 2 * h :] += (r * before).T @ dg[:, 2 * h :]
                dnow = dnow * (1 - z) + drh * r * live[t][:, None] + dg[:, : 2 * h] @ u[:, : 2 * h].T
                np.add.at(dtable[:, col * 3 * h : (col + 1) * 3 * h], idx[:, t], dg)
            g[f"U{k}"] = du
        return g, dtable

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.asarray(logits, dtype=np.float64) + self.offset)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def move(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        fix = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.p[k] -= (fix * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)


def _log_odds(positive: np.ndarray, negative: np.ndarray, n1: int, n0: int) -> np.ndarray:
    return np.clip(np.log((positive + 0.5) / (n1 + 1)) - np.log((negative + 0.5) / (n0 + 1)), -4, 4) / 2


def _train_on(net: Network, adam: Adam, features, idx: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 128) -> None:
    rows, grams, starts = features
    counts = np.diff(np.append(starts, len(grams)))
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    order = rng.permutation(len(y))
    for at in range(0, len(y), batch):
        some = order[at : at + batch]
        ids, local = np.unique(idx[some], return_inverse=True)
        if ids[0] != 0:
            ids, local = np.append(0, ids), local + 1
        local = local.reshape(len(some), -1)
        mine = ids[1:] - 1
        spans = [np.arange(starts[i], starts[i] + counts[i]) for i in mine]
        own = (rows[mine], grams[np.concatenate(spans)] if len(spans) else grams[:0], np.append(0, np.cumsum(counts[mine]))[:-1].astype(np.int64))
        x = net.embed(own)
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), dtype=np.float32), net.projected(x)])
        logits, kept = net.run(table, local, keep=True)
        dlogit = ((sigmoid(logits) - y[some]) * share[some] / len(some)).astype(np.float32)
        g, dtable = net.backward(local, kept, dlogit, len(table))
        dtable = dtable[1:]
        h = 3 * HIDDEN
        g |= {"Wf": x.T @ dtable[:, :h], "Wb": x.T @ dtable[:, h:], "cf": dtable[:, :h].sum(axis=0), "cb": dtable[:, h:].sum(axis=0)}
        dx = dtable[:, :h] @ net.p["Wf"].T + dtable[:, h:] @ net.p["Wb"].T
        g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        np.add.at(g["word"], own[0], dx[:, :WORD_DIM])
        per = dx[:, WORD_DIM:] / np.maximum(counts[mine], 1)[:, None]
        np.add.at(g["char"], own[1], np.repeat(per, counts[mine], axis=0))
        adam.move(g)


def train(texts: list[str], labels: list[int], rounds: int = 4, epochs: int = 3, rate: float = 0.01, seed: int = 1) -> Network:
    """Fit a network on labelled texts. Without both classes it scores every text alike."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        net.slope, net.offset = 0.0, 4.0 if n1 else -4.0
        return net
    vocabulary = Vocabulary()
    docs = [vocabulary.ids(t) for t in texts]
    features = word_features(vocabulary.fresh)
    rows, grams, starts = features
    counts = np.diff(np.append(starts, len(grams)))
    seen = np.zeros((2, len(rows) + 1))
    for ids, label in zip(docs, labels, strict=True):
        seen[label][np.unique(ids)] += 1
    seen = seen[:, 1:]
    word_seen = [np.bincount(rows, weights=seen[k], minlength=WORD_ROWS) for k in (0, 1)]
    char_seen = [np.bincount(grams, weights=np.repeat(seen[k], counts), minlength=CHAR_ROWS) for k in (0, 1)]
    net.p["word"][:, 0] = _log_odds(word_seen[1], word_seen[0], n1, n0)
    net.p["char"][:, 0] = _log_odds(char_seen[1], char_seen[0], n1, n0)

    parts = [windows_of(ids) for ids in docs]
    owner = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
    idx = np.concatenate(parts)
    first = np.searchsorted(owner, np.arange(len(docs)))
    x = net.embed(features)
    hint = np.append(-9, x[:, 0] + x[:, WORD_DIM])
    value = hint[idx].max(axis=1)  # the first choice of windows: the most telling word
    adam = Adam(net.p, rate)
    for turn in range(rounds):
        best = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(first, np.append(first[1:], len(idx)), strict=True)])
        some = rng.integers(first, np.append(first[1:], len(idx)))[y == 0]
        picked = np.concatenate([best, some])
        for _ in range(epochs):
            _train_on(net, adam, features, idx[picked], y[owner[picked]], rng)
        adam.rate *= 0.6
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), dtype=np.float32), net.projected(net.embed(features))])
        value = np.concatenate([net.run(table, idx[a : a + 4096]) for a in range(0, len(idx), 4096)])
    top = np.maximum.reduceat(value, first)
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(200):  # a logistic fit of document scores, with both classes smoothed
        p = sigmoid(a * top + b)
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - goal) * top).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        hess = np.array([[(w * top * top).sum() + 1e-3, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
    net.slope, net.offset = float(max(a, 0.05)), float(b)
    return net


class Scorer:
    """Scores whole texts; projections of words are kept from text to text, up to CACHE_WORDS."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.vocabulary = Vocabulary()
        self.table = np.zeros((1024, 6 * HIDDEN), dtype=np.float32)

    def _learn(self) -> None:
        fresh, known = self.vocabulary.fresh, len(self.vocabulary.plain)
        if fresh:
            if known >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(known + 1 - len(self.table), len(self.table)), 6 * HIDDEN), dtype=np.float32)])
            self.table[known + 1 - len(fresh) : known + 1] = self.net.projected(self.net.embed(word_features(fresh)))
            self.vocabulary.fresh = []

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.vocabulary.raw) > CACHE_WORDS:
            self._clear()
        docs = [self.vocabulary.ids(t) for t in texts]
        self._learn()
        parts = [windows_of(ids) for ids in docs]
        first = np.append(0, np.cumsum([len(p) for p in parts]))[:-1]
        idx = np.concatenate(parts)
        values = np.concatenate([self.net.run(self.table, idx[a : a + 2048]) for a in range(0, len(idx), 2048)])
        return self.net.probability(np.maximum.reduceat(values, first))


def training_sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_NEGATIVE, MAX_POSITIVE), most_chars: int = MAX_TRAINING_CHARS) -> DataFrame:
    """doc_id, text, y of labelled rows that are not held out: most[y] of each label at most, the first by a hash of the id, without those of texts longer than most_chars."""
    marks = pick(labels, doc_id="doc_id", y="toxic").where("y in (0, 1)").where(~held_out(1, 3)).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in enumerate(most)]
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= most_chars)
    return short.join(F.broadcast(cut(chosen[0].unionByName(chosen[1]))), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, most: tuple[int, int] = (MAX_NEGATIVE, MAX_POSITIVE)) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learnt from rows that are not held out (crc32 of the id modulo 3 is not 1), from `most`
    documents of either label at most; only the text enters a score. Null and empty texts are one empty
    window and get a score too. Labels that are null or of unknown documents teach nothing; without both
    labels all scores are the same. Repeated rows are scored alike; of rows repeated with one id one is
    learnt from, and a document with both labels counts as toxic. An empty table gives an empty result.
    Extra columns are not read. Training takes place on the driver, on `most` texts of MAX_TRAINING_CHARS at most.
    """
    spark = docs.sparkSession
    with_python_path(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = sorted(training_sample(rows, labels, most).collect(), key=lambda r: r["doc_id"])  # bounded by `most` and MAX_TRAINING_CHARS
    net = train([r["text"] or "" for r in sample], [r["y"] for r in sample])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net)
        for batch in batches:
            texts = [t or "" for t in batch.text]
            scores = np.concatenate([scorer(texts[a : a + 128]) for a in range(0, len(texts), 128)]) if texts else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "held_out": batch.held_out, "score": scores})

    scored = rows.withColumn("held_out", held_out(1, 3)).select("doc_id", "text", "held_out").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
