"""Mixing sources to target weights by soft membership.

1. A classifier, learned from a labelled table, gives every document a posterior over the domains: softmax
   regression on the presence of hashed words and on the features of form. Soft means that a document
   counts in every domain, by its posterior.
2. Rates are fitted: nonnegative numbers ``r`` per document such that the expected tokens per domain,
   ``sum(r * tokens * posterior)``, match the targets in the least-squares sense, starting from and staying
   near ``r = 1`` (the start). Each pass is a projected gradient step, ``r = max(0, r - posterior . g)``, where ``g`` is the
   gradient of the squared error in the metric of the Gram matrix of the documents with a positive rate.
   A pass needs only the domains' totals, a vector and a matrix of the number of domains, so a
   document's rate is a fold over the passes' vectors: the narrow table of tokens and posteriors is
   written once and only read. A step that doesn't lower the error is halved and turned to the plain gradient.
3. ``copies`` rounds rates to whole numbers of copies by a hash of the id, so that the expected number is
   the rate; rates within ``margin`` of a whole number are rounded to it.

Null texts count as empty: they have no tokens and rate 1. Repeated rows are fitted and sampled each. A
domain that no labelled document has gets posterior 0. A target for a domain without expected tokens
can't be reached and is left out. The rate never depends on a document's length, only on its posteriors.

Learning reads at most ``max_labelled`` labelled documents, the first in order of a hash of their ids.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import hash_uniform
from prefmine.llm.quality import features
from prefmine.llm.tables import drawn, with_columns, written
from prefmine.llm.words import slices, words_of

HASHED = 18  # bits of a hashed word
KEPT = 1024  # hashed words that the classifier weighs


class Domains(NamedTuple):
    """Softmax regression: weights per domain of the kept hashed words, then of the features of form."""

    names: tuple[str, ...]
    column: np.ndarray  # of each hashed word, -1 if it isn't kept
    weights: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hashed lower-case word) pairs, and words per text."""
    rows, words, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(texts):
        found = words_of(part, lower=True)
        keys = np.unique((found.doc.astype(np.int64) << HASHED) + (found.hash >> np.uint64(64 - HASHED)).astype(np.int64))
        rows.append((keys >> HASHED) + part.first)
        words.append(keys & ((1 << HASHED) - 1))
        sizes.append(np.bincount(found.doc, minlength=len(part.offsets) - 1))
    return np.concatenate(rows), np.concatenate(words), np.concatenate(sizes)


def posteriors(texts: pa.Array, domains: Domains) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities per domain, words per text)."""
    row, word, sizes = hashed_words(texts)
    at = domains.column[word]
    row, at = row[at >= 0], at[at >= 0]
    logits = np.clip((features(texts) - domains.mean) / domains.scale, -6, 6) @ domains.weights[KEPT:] + domains.bias
    for d in range(len(domains.names)):
        logits[:, d] += np.bincount(row, domains.weights[at, d], len(sizes))
    return _softmax(logits), sizes


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_domains(words: list[np.ndarray], form: np.ndarray, labels: list[str], penalty: float = 1e-4, steps: int = 200) -> Domains:
    """Softmax regression by accelerated gradient steps, on the hashed words that differ most between domains."""
    names = tuple(sorted(set(labels)))
    if not names:
        raise ValueError("no labelled documents")
    n, k = len(labels), len(names)
    target = np.zeros((n, k))
    target[np.arange(n), [names.index(x) for x in labels]] = 1
    row, word = np.repeat(np.arange(n), [len(w) for w in words]), np.concatenate(words)
    share = target.mean(0)
    total = np.bincount(word, minlength=1 << HASHED)
    gap = np.zeros(1 << HASHED)
    for d in range(k):  # how far the word's documents stray from the domain's share, in standard deviations
        seen = np.bincount(word, target[row, d], 1 << HASHED)
        gap = np.maximum(gap, np.abs(seen - total * share[d]) / np.sqrt(np.maximum(total * share[d] * (1 - share[d]), 1e-9)))
    gap[total < 5] = 0
    best = np.argsort(-gap, kind="stable")[:KEPT]
    column = np.full(1 << HASHED, -1, np.int64)
    column[best[gap[best] > 0]] = np.flatnonzero(gap[best] > 0)
    mean, scale = form.mean(0), form.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.zeros((n, KEPT + form.shape[1]), np.float32)
    known = column[word] >= 0
    x[row[known], column[word[known]]] = 1
    x[:, KEPT:] = np.clip((form - mean) / scale, -6, 6)
    weights, bias = np.zeros((x.shape[1], k)), np.log(share + 1e-6)
    ahead = np.ones(x.shape[1])
    for _ in range(20):  # largest curvature, by power iteration
        ahead = x.T @ (x @ ahead) / n
        largest = np.linalg.norm(ahead)
        ahead = ahead / max(largest, 1e-12)
    rate = 2.0 / max(1.0, float(largest))
    speed, push = np.zeros_like(weights), np.zeros_like(bias)
    for step in range(steps):
        w, b = weights + step / (step + 3) * speed, bias + step / (step + 3) * push
        wrong = (_softmax(x @ w + b) - target) / n
        new, shifted = w - rate * (x.T @ wrong + penalty * w), b - rate * wrong.sum(0)
        speed, push, weights, bias = new - weights, shifted - bias, new, shifted
    return Domains(names, column, weights, bias, mean, scale)


def learn(labelled: DataFrame, text: str = "text", domain: str = "domain", order: str = "doc_id", max_labelled: int = 6_000) -> Domains:
    """Fits on labelled rows. At most ``max_labelled`` of them come to the driver, as hashed words and features."""
    rows = labelled.filter(F.col(domain).isNotNull()).select(F.col(text).alias("text"), F.col(domain).cast("string").alias("domain"), F.col(order).alias("order"))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        row, word, sizes = hashed_words(batch.column("text"))
        bounds = np.searchsorted(row, np.arange(len(sizes) + 1))
        words = [word[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
        return {"words": pa.array(words, pa.list_(pa.int32())), "form": pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))}

    fields = [T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("form", T.ArrayType(T.DoubleType()))]
    found = with_columns(drawn(rows, F.col("order"), max_labelled), make, fields).select("domain", "__order", "words", "form")
    found = found.orderBy("__order").limit(max_labelled).toPandas()
    if not len(found):
        raise ValueError("no labelled documents")
    return fit_domains(list(found["words"]), np.stack(found["form"].to_numpy()), found["domain"].tolist())


def with_posteriors(df: DataFrame, domains: Domains, text: str = "text", tokens: str = "n_tokens", out: str = "posterior") -> DataFrame:
    """Appends the number of words and the posteriors, in the order of ``domains.names``."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p, sizes = posteriors(batch.column(text), domains)
        return {tokens: pa.array(sizes, pa.int64()), out: pa.array(list(p), pa.list_(pa.float64()))}

    return with_columns(df, make, [T.StructField(tokens, T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))])


# --------------------------------------------------------------------------- rates


def rate(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The rate of a document after the given steps."""
    out = F.lit(1.0)
    for step in steps:
        out = F.greatest(F.lit(0.0), out - sum((F.get(posterior, d) * float(g) for d, g in enumerate(step)), F.lit(0.0)))
    return out


def targets_of(present: np.ndarray, names: tuple[str, ...], weights: dict[str, float], anchor: str | None) -> np.ndarray:
    """Target tokens per domain for target weights; -1 where a domain has none present or no weight is given.

    Without an anchor the corpus keeps its number of tokens. With one, this domain keeps its tokens, and the
    others get theirs in proportion, but no more than they have: documents are only taken out.
    """
    wanted = np.array([weights.get(n, np.nan) for n in names], float)
    can = ~np.isnan(wanted) & (present > 0)
    if not can.any() or not wanted[can].sum() > 0:
        return np.full(len(names), -1.0)
    wanted = np.nan_to_num(wanted) / wanted[can].sum()
    if anchor is None:
        return np.where(can, present[can].sum() * wanted, -1.0)
    at = names.index(anchor) if anchor in names else -1
    if at < 0 or not can[at] or not wanted[at] > 0:
        return np.full(len(names), -1.0)
    return np.where(can, np.minimum(present, present[at] / wanted[at] * wanted), -1.0)


def fit_rates(
    narrow: DataFrame, names: tuple[str, ...], weights: dict[str, float], tokens: str = "n_tokens", posterior: str = "posterior",
    anchor: str | None = None, passes: int = 30, tolerance: float = 1e-6,
) -> list[np.ndarray]:
    """Steps whose fold gives every document's rate. ``narrow`` is read once a pass and should be a written table."""
    k = len(names)

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens per domain, and the Gram matrix of posteriors of documents with a positive rate."""
        r, n = F.col("r"), F.col(tokens).cast("double")
        p = [F.get(posterior, d) for d in range(k)]
        live = F.when(r > 0, n).otherwise(0.0)
        sums = [F.sum(n * r * p[d]).alias(f"s{d}") for d in range(k)]
        sums += [F.sum(live * p[d] * p[e]).alias(f"g{d}_{e}") for d in range(k) for e in range(d, k)]
        row = narrow.withColumn("r", rate(F.col(posterior), steps)).agg(*sums).first()
        gram = np.array([[row[f"g{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(k)] for d in range(k)])
        return np.array([row[f"s{d}"] or 0.0 for d in range(k)]), gram

    present, gram = totals([])
    wanted = targets_of(present, names, weights, anchor)
    held = wanted >= 0
    if not held.any():
        return []
    scale = present[held].sum()
    steps: list[np.ndarray] = []
    sums, length, ridge = present, 1.0, 1e-9
    for _ in range(passes):
        error = np.where(held, sums - wanted, 0.0)
        if np.abs(error).max() <= tolerance * scale:
            break
        part = gram[np.ix_(held, held)]
        step = np.zeros(k)
        step[held] = length * np.linalg.solve(part + ridge * scale * np.eye(held.sum()), error[held])
        new, new_gram = totals([*steps, step])
        new_error = np.where(held, new - wanted, 0.0)
        if (new_error**2).sum() < (error**2).sum():
            steps, sums, gram, length, ridge = [*steps, step], new, new_gram, 1.0, max(1e-9, ridge / 10)
        else:
            length, ridge = length / 2, max(1e-4, ridge * 10)
    return steps


def copies(rates: Column, key: Column, margin: float = 0.0, seed: int = 17) -> Column:
    """Whole number of copies: the rate rounded up with the chance of its fraction, stretched past ``margin``."""
    whole, part = F.floor(rates), rates - F.floor(rates)
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (part - margin) / (1 - 2 * margin)))
    return (whole + F.when(hash_uniform(seed, key) < chance, 1).otherwise(0)).cast("int")


def mixed(
    df: DataFrame, domains: Domains, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", anchor: str | None = None, margin: float = 0.0
) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of every document."""
    narrow = with_posteriors(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), domains).drop("text")
    narrow = written(narrow, "posteriors")
    steps = fit_rates(narrow, domains.names, weights, anchor=anchor)
    fitted = F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate(F.col("posterior"), steps))
    return narrow.withColumn("rate", fitted).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), margin))


def resampled(df: DataFrame, domains: Domains, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", anchor: str | None = None, margin: float = 0.0) -> DataFrame:
    """The documents with all columns, each as often as its copies say.

    The rate follows from the text by the fitted steps, so it is worked out again in passing; nothing is joined.
    """
    narrow = written(with_posteriors(df.select(F.col(text).alias("text")), domains).drop("text"), "posteriors")
    steps = fit_rates(narrow, domains.names, weights, anchor=anchor)
    rows = with_posteriors(df, domains, text, "__tokens", "__posterior")
    fitted = F.when(F.col("__tokens") == 0, 1.0).otherwise(rate(F.col("__posterior"), steps))
    n = copies(fitted, F.col(doc_id), margin)
    return rows.withColumn("__n", n).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n"))).select(*df.columns)
