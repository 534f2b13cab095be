"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Class means and covariances come from sums over all labelled training rows, made in the tasks; the
driver gets one small matrix per class. Each covariance is shrunk towards the pooled one and towards
a multiple of the identity, and scores are differences of Gaussian log-densities, whose Mahalanobis
terms use inverse Cholesky factors that are computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, stash, with_python_path

NAMES = ("words", "word_length", "upper", "symbols", "marks", "bars", "digits", "stops", "repeats", "top_word", "distinct", "line_words", "marked_words")
SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=+", dtype=np.uint8)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, in the order of NAMES; shares are logs, so a small share counts."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    by_word = Counter(words)
    share = lambda x, of: math.log(x / of + 0.003)
    return [
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        share(counts[65:91].sum(), letters),
        share(counts[SYMBOLS].sum(), chars),
        share(counts[33] + counts[63], chars),
        share(counts[124], chars),
        share(counts[48:58].sum(), chars),
        share(counts[46] + counts[44], chars),
        share(sum(map(str.__eq__, words, words[1:])), n),
        share(max(by_word.values(), default=0), n),
        math.log((len(by_word) + 1) / (n + 1)) / (1 + 0.1 * math.log(n)),
        math.log1p(n / (counts[10] + 1)),
        share(sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:")), n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x array<double>; null text counts as empty."""
    with_python_path(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "x": [statistics(t or "") for t in batch.text]})

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class, inverse of the Cholesky factor
    constants: np.ndarray  # class: log prior less log determinant
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        logs = [k - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return logs[1] - logs[0] - self.shift


def fit(stats: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """stats(y, x): labelled rows. With no row of a class, the class is that of the pooled sample."""
    d = len(NAMES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            for y in (0, 1):
                if (batch.y == y).any():
                    x = np.stack(batch.x[batch.y == y].to_numpy())
                    total[y] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"y": [0, 1], "s": list(total)})

    parts = stats.mapInPandas(sums, "y int, s array<double>").select("y", F.posexplode("s").alias("i", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for y, i, v in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        total[y, i] = v
    pooled = total.sum(0)

    def moments(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n = max(t[0], 1.0)
        mean = t[1 : 1 + d] / n
        return t[0], mean, t[1 + d :].reshape(d, d) / n - np.outer(mean, mean)

    _, mean_all, cov_all = moments(pooled)
    scale = np.diag(np.diag(cov_all) + 1e-6)
    means, factors, constants = [], [], []
    for t in total:
        n, mean, cov = moments(t)
        if n < 2:
            mean, cov = mean_all, cov_all
        weight = shrink + (1 - shrink) * d / (d + n)
        cov = (1 - weight) * cov + weight * cov_all + ridge * scale
        factor = np.linalg.inv(np.linalg.cholesky(cov))
        means.append(mean)
        factors.append(factor)
        constants.append(math.log((n + 1) / (pooled[0] + 2)) + np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants))


def held_out(fold: int, folds: int, name: str = "doc_id"):
    """crc32 of the id as text, modulo folds, is fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learnt from rows that are not held out (crc32 of the id modulo 5 is not 0); labels that
    are null or of unknown documents teach nothing, and only the text enters a score. Null text is an
    empty text and gets a score too. Without any label all scores are the same. Repeated rows are scored
    alike, and count as often as they stand in the class moments; a document with both labels counts as 0.
    An empty table gives an empty result. Extra columns are not read.
    """
    stats = stash(document_statistics(docs, id_col, text_col).withColumn("held_out", held_out(0, 5)), "statistics")
    marks = pick(labels, l_id="doc_id", y="quality").where("y in (0, 1)").groupBy("l_id").agg(F.min("y").cast("int").alias("y"))
    model = fit(stats.where("not held_out").join(marks, F.col("doc_id") == F.col("l_id")).select("y", "x"))
    base = math.log(threshold / (1 - threshold))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        z = np.arcsinh(model.logits(np.stack(x.to_numpy()))) if len(x) else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-(z + base))))

    scored = stats.select("doc_id", "held_out", score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
