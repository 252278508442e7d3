"""Quality scores by a regularised quadratic discriminant over document statistics.

Statistics of the whole text (lengths, repetition, character classes, lines) are transformed to
roughly symmetric scales.  Each class is a normal density whose covariance is shrunk towards the
pooled one; a document's score is the logistic of the log-density difference, computed from squared
Mahalanobis distances through Cholesky factors that are built once per model.  Class moments are
plain sums, added up by Spark over all training rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of

SHRINKAGE = 0.1  # weight of the pooled covariance in a class covariance
RIDGE = 1e-3  # added to the diagonal, in units of the pooled variances
TEMPERATURE = 0.5  # log-density differences of dependent statistics overstate the evidence
THRESHOLD = 0.3

_SYMBOLS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"[^\w\s]{2,}")
STATISTICS = (
    "log_words", "mean_word", "sd_word", "distinct", "adjacent", "bigrams", "top_word", "short", "upper",
    "symbols", "symbol_runs", "bars", "digits", "line_copies", "words_per_line", "stops",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; null and empty texts have those of no words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda part, whole: float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = int(sizes.sum())
    lines = [x for x in text.split("\n") if x]
    adjacent = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        float(np.log(sizes.mean())),
        float(np.log1p(sizes.std())),
        float(np.log1p(len(counts)) / np.log1p(n)),
        share(adjacent, n - 1),
        share(n - 1 - len(set(zip(words, words[1:]))), n - 1),
        share(max(counts.values()), n),
        share(int((sizes <= 3).sum()), n),
        share(upper, n),
        share(len(_SYMBOLS.findall(text)), letters),
        share(len(_RUNS.findall(text)), n),
        share(counts.get("|", 0), n),
        share(sum(map(str.isdigit, words)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        share(sum(w[-1] in ".!?" for w in words), n),
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    rows = df.select(col_of(id_col).alias("doc_id"), col_of(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    """Class sizes (2), means (2 x d) and covariances (2 x d x d)."""

    sizes: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """(inverse Cholesky factor, log determinant) of each class's shrunk covariance."""
        weight = self.sizes / max(1.0, self.sizes.sum())
        pooled = np.einsum("k,kij->ij", weight, self.covariances)
        scale = np.diag(np.maximum(np.diag(pooled), 1e-9))
        out = []
        for cov in self.covariances:
            shrunk = (1 - SHRINKAGE) * cov + SHRINKAGE * pooled + RIDGE * scale
            lower = np.linalg.cholesky(shrunk)
            out.append((np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability-like scores (0 to 1) of rows of statistics; higher: class 1 likelier."""
        if not self.sizes.min():  # one class only, or none: its share
            return np.full(len(x), (self.sizes[1] + 1) / (self.sizes.sum() + 2))
        logs = []
        for mean, (inverse, logdet), size in zip(self.means, self.factors, self.sizes):
            z = (x - mean) @ inverse.T
            logs.append(np.log(size) - 0.5 * logdet - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(TEMPERATURE * (logs[1] - logs[0]), -50, 50)))


def fit(rows: DataFrame, x_col: str = "x", label_col: str = "label") -> Model:
    """A model of labelled statistics; rows with a null label teach nothing."""
    d = len(STATISTICS)
    rows = rows.select(col_of(x_col).alias("x"), (col_of(label_col) > 0).cast("int").alias("y")).filter("y is not null")

    def run(batches):
        for b in batches:
            x, y = np.array(b.column(0).to_pylist()).reshape(-1, d), b.column(1).to_numpy()
            z = [np.concatenate(([len(p)], p.sum(axis=0), (p.T @ p).ravel())) for p in (x[y == 0], x[y == 1])]
            size = len(z[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)), pa.array(np.concatenate(z))],
                names=["y", "i", "v"],
            )

    sums = rows.mapInArrow(run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 (1 + d + d^2) numbers
        total[r["y"], r["i"]] = r["v"]
    n = np.maximum(total[:, :1], 1)
    means = total[:, 1 : d + 1] / n
    second = (total[:, d + 1 :] / n).reshape(2, d, d)
    return Model(total[:, 0], means, second - np.einsum("ki,kj->kij", means, means))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
