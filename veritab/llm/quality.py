"""Operator 1: quality by a regularised quadratic discriminant over document statistics.

Every text gives twelve statistics of its characters, words and lines, each brought
to a roughly normal shape by a logarithm.  The moments of the labelled rows (counts,
sums and products for each class) are one aggregation over all of them.  On the
driver each class covariance is shrunk towards the pooled one and towards a multiple
of the identity, and its Cholesky factor is inverted once.  A score is the logistic
of the difference of the Mahalanobis log-densities and the log of the class odds.

Defined results: NULL and empty texts have the statistics of no characters and a
score like any other; NULL labels and ids are not learned from; several label rows of
an id count each; without labels of both classes every score is the share of label 1
(0 without labels); repeated rows and ids give one row each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import map_batches, utf8
from veritab.session import freeze

NAMES = [
    "words", "word_length", "upper", "symbols", "marks", "stops", "digits", "foreign", "newlines", "repeats", "distinct", "lines_again",
]
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.isin(np.arange(256), list(b".,;:'\"-()"))
_MARK = np.isin(np.arange(256), list(b"!?"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_FOREIGN = np.arange(256) >= 0x80


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    n, size, letters = len(words), len(text), int(counts[_LETTER].sum())
    share = lambda count, whole, floor: float(np.log(floor + count / max(1, whole)))
    return [
        float(np.log1p(n)),
        float(np.log1p((size - int(counts[0x20])) / max(1, n))),
        share(counts[_UPPER].sum(), letters, 0.02),
        share(counts[_SYMBOL].sum(), size, 0.005),
        share(counts[_MARK].sum(), size, 0.005),
        share(counts[_STOP].sum(), size, 0.02),
        share(counts[_DIGIT].sum(), size, 0.01),
        share(counts[_FOREIGN].sum(), size, 0.02),
        share(counts[0x0A], size, 0.005),
        share(sum(map(eq, words, words[1:])), n, 0.02),
        float(np.log1p(len(set(words))) / np.log1p(n)) if n else 1.0,
        share(len(lines) - len(set(lines)), len(lines), 0.05),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""

    def work(batch: pa.RecordBatch):
        rows = [statistics(text) for text in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the log odds of label 1."""

    means: np.ndarray
    factors: np.ndarray
    log_determinants: np.ndarray
    log_odds: float

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        z = (x - self.means[label]) @ self.factors[label].T
        return -0.5 * (z * z).sum(axis=1) - 0.5 * self.log_determinants[label]

    def scores(self, x: np.ndarray) -> np.ndarray:
        odds = self.log_density(x, 1) - self.log_density(x, 0) + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float, to_identity: float) -> Discriminant:
    """From the moments of both classes; the arrays are indexed by label."""
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / counts.sum()
    size = len(pooled)
    factors, determinants = [], []
    for label in (0, 1):
        own = scatter[label] / counts[label]
        shrunk = (1 - to_pooled) * own + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + (to_identity * np.trace(shrunk) / size + 1e-6) * np.eye(size)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        determinants.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(determinants), float(np.log(counts[1] / counts[0])))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, to_pooled: float = 0.05, to_identity: float = 0.02, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | float:
    """The discriminant of all labelled rows that `learn` picks, or the share of label 1 if one class is missing."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn).select(id_col, F.col(label_col).alias("label"))
    size = len(NAMES)
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    x = F.col("x")
    rows = (
        stats.join(known, id_col)
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(size)]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"))
        .collect()  # two rows
    )
    found = {row.label: row for row in rows}
    if len(found) < 2:
        return float(sum(found))
    products = np.zeros((2, size, size))
    for label in (0, 1):
        for (i, j), value in zip(pairs, found[label].p, strict=True):
            products[label, i, j] = products[label, j, i] = value
    return discriminant(np.array([found[k].n for k in (0, 1)], float), np.array([found[k].s for k in (0, 1)]), products, to_pooled, to_identity)


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, predicted) of every text; `learn` picks the label rows to learn from."""
    stats = freeze(document_statistics(docs, id_col, text_col))
    model = fit(stats, labels, F.lit(True) if learn is None else learn, id_col=id_col, label_col=label_col)

    def work(batch: pa.RecordBatch):
        x = np.array(batch.column(1).flatten()).reshape(-1, len(NAMES))
        found = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(stats.select(id_col, "x"), work, f"`{id_col}` {kind}, score double, predicted int")
