"""Quality classifier by Bradley-Terry ranking of documents from preference pairs.

A labelled good text is preferred to a labelled poor one. Each text of the smaller class is paired with
``rivals`` texts of the other by position in hash order, never all with all. Scores are linear in the
features of form; the logistic loss of score differences over the pairs is minimised by gradient steps.
The threshold is the quantile of training scores that leaves the labelled share of poor texts below it;
the score is mapped to 0..1 so that this quantile becomes ``threshold``.

Inputs of a score come from the text alone. Texts without a word, null ones too, have score 0: zero noise and zero repeats
are no sign of quality where there is nothing to read. Texts of few words are scored as the labels have them.
Learning reads at most ``max_labelled`` labelled texts, the first in order of the hash of their ids; it needs
both classes and raises ``ValueError`` otherwise. Repeated labelled rows are repeated evidence.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.llm.style import form_of
from prefmine.llm.tables import drawn, with_columns
from prefmine.llm.words import slices

FEATURES = (
    "log_words", "short", "ends", "few_ends", "separators", "nav_lines", "noisy", "caps", "digits", "repeats", "mostly_repeats",
    "distinct", "word_length", "long_words", "line_length",
)


class Ranker(NamedTuple):
    """Coefficients in ``FEATURES`` order, their means and scales, and the map to 0..1."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    spread: float
    threshold: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        at = (self.raw(features) - self.cut) / self.spread + np.log(self.threshold / (1 - self.threshold))
        some = features[:, FEATURES.index("log_words")] != 0
        return np.where(some, 1 / (1 + np.exp(-np.clip(at, -30, 30))), 0.0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    rows = [np.zeros((0, len(FEATURES)))]
    for part in slices(texts):
        f = form_of(part)
        n_docs = len(part.offsets) - 1
        n = np.maximum(f.n_words, 1)
        separators = np.bincount(f.line_doc, f.line_separators, n_docs)
        nav = np.bincount(f.line_doc, f.line_words * (f.line_separators > 1), n_docs)
        lines = np.bincount(f.line_doc, f.line_words > 0, n_docs)
        ends, noisy, caps, repeats = f.n_ends / n, f.n_noisy / n, f.n_caps / n, f.n_repeat_words / n
        length = f.word_chars / n
        rows.append(np.column_stack([
            np.log1p(f.n_words), f.n_words < 5, np.minimum(ends, 0.2), (f.n_ends * 40 < f.n_words), separators / n, nav / n, noisy, caps,
            f.n_digits / np.maximum(f.word_chars, 1), repeats, repeats > 0.4, f.n_distinct / n, np.minimum(length, 20), length > 7,
            np.log1p(n / np.maximum(lines, 1)),
        ]).astype(float))
    return np.concatenate(rows)


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    make = lambda batch: {out: pa.array(list(features(batch.column(text))), pa.list_(pa.float64()))}
    return with_columns(df, make, [T.StructField(out, T.ArrayType(T.DoubleType()))])


def preference_pairs(good: np.ndarray, rivals: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of preferred and other texts: each of the larger class meets ``rivals`` of the smaller."""
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    large, small = (yes, no) if len(yes) >= len(no) else (no, yes)
    step = np.arange(len(large))
    first = np.tile(large, rivals)
    second = np.concatenate([small[(step + i * 7919) % len(small)] for i in range(rivals)])
    return (first, second) if len(yes) >= len(no) else (second, first)


def fit_ranker(x: np.ndarray, good: np.ndarray, rivals: int = 4, threshold: float = 0.7, penalty: float = 1e-3, steps: int = 400) -> Ranker:
    """Bradley-Terry weights from texts' features and labels."""
    if good.all() or not good.any():
        raise ValueError("both good and poor labelled texts are needed")
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -6, 6)
    better, worse = preference_pairs(good, rivals)
    d = z[better] - z[worse]
    w = np.zeros(x.shape[1])
    momentum = w.copy()
    rate = 4.0 / max(1e-9, np.linalg.eigvalsh(d.T @ d / len(d))[-1])
    for step in range(steps):
        ahead = w + step / (step + 3) * momentum
        lost = 1 / (1 + np.exp(np.clip(d @ ahead, -30, 30)))  # chance given to the wrong order
        new = ahead - rate * (penalty * ahead - d.T @ lost / len(d))
        momentum, w = new - w, new
    raw = z @ w
    low, high = raw[~good], raw[good]
    # the quantile of the labelled share of poor texts, halfway to the next score
    ordered = np.sort(raw)
    at = len(low)
    cut = (ordered[at - 1] + ordered[at]) / 2
    return Ranker(w, mean, scale, float(cut), float(max(1e-6, (np.median(high) - np.median(low)) / 8)), threshold)


def learn(labelled: DataFrame, text: str = "text", label: str = "quality", order: str = "doc_id", max_labelled: int = 20_000, **fit) -> Ranker:
    """Fits on labelled rows. Their features, at most ``max_labelled`` short rows, come to the driver."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(order).alias("order"))
    rows = with_features(drawn(rows, F.col("order"), max_labelled), "text").select("label", "__order", "features")
    found = rows.orderBy("__order").limit(max_labelled).toPandas()
    if not len(found):
        raise ValueError("no labelled rows")
    return fit_ranker(np.stack(found["features"].to_numpy()), found["label"].to_numpy() == 1, **fit)


def score(df: DataFrame, ranker: Ranker, text: str = "text", out: str = "score") -> DataFrame:
    """Appends the score; text at or above ``ranker.threshold`` passes."""
    make = lambda batch: {out: pa.array(ranker.score(features(batch.column(text))), pa.float64())}
    return with_columns(df, make, [T.StructField(out, T.DoubleType())])
