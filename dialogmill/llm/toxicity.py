"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word stands for its character n-grams, marks at its ends included, and for
itself, each hashed to a row of an embedding table; a text is the mean of its
subwords' rows. Embeddings and softmax weights are trained together in numpy, so a
misspelling that no label showed still shares most rows with the word it hides.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import fold, stratified_sample

BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: The mean of many subwords is small, so the softmax is that much steeper.
STEEPNESS = 50.0
#: Toxic texts to fit on, about, twice that of others, and the longest text among them: bounds of the sample.
SAMPLE_TOXIC = 1200
SAMPLE_CHARS = 20_000
#: Each mean also counts that many subwords that say nothing: a short text needs more than one odd letter run.
NEUTRAL = 100
#: Rows of the table met in fewer of those texts (or of a hundredth of them) stay out, as one text would be learned by heart.
MIN_TEXTS = 15
#: Steps, of 32 texts each, taken at least, however few the texts.
MIN_STEPS = 600
#: Words kept with their sums in a worker; emptied when full.
CACHE_WORDS = 400_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, bucket) of all subwords of all words, the words of one length at once."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    owners, hashes = [], []
    for length, places in by_length.items():
        raw = "".join(f"<{words[i]}>" for i in places).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(raw, "<u4").astype(np.uint64).reshape(len(places), length + 2)
        at = np.array(places)
        for n in {*[g for g in GRAMS if g < length + 2], length + 2}:
            count = length + 3 - n
            mixed = np.full((len(places), count), n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ chars[:, k : k + count]) * np.uint64(0x100000001B3)
            mixed ^= mixed >> np.uint64(29)
            hashes.append((mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64).ravel() % buckets)
            owners.append(np.repeat(at, count))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Model:
    """What scoring needs: the log-odds that a subword of each bucket adds, and the intercept."""

    odds: np.ndarray
    bias: float


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text; shares are parts of all its subwords and the neutral ones."""
    counts = [dict(zip(*np.unique(np.array(w, object), return_counts=True))) if (w := words_of(t)) else {} for t in texts]
    vocabulary = sorted({w for c in counts for w in c})
    place = {w: i for i, w in enumerate(vocabulary)}
    owners, hashes = subwords(vocabulary, buckets)
    order = np.argsort(owners, kind="stable")
    hashes = hashes[order].astype(np.int32)
    ends = np.searchsorted(owners[order], np.arange(len(vocabulary) + 1))
    bags = []
    for c in counts:
        if not c:
            bags.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        ids = [place[w] for w in c]
        found = np.concatenate([hashes[ends[i] : ends[i + 1]] for i in ids])
        times = np.repeat(list(c.values()), [ends[i + 1] - ends[i] for i in ids])
        rows, back = np.unique(found, return_inverse=True)
        shares = np.bincount(back, times)
        bags.append((rows.astype(np.int32), (shares / (shares.sum() + NEUTRAL)).astype(np.float32)))
    return bags


def fit(texts: list[str], labels: Iterable[int], seed: int = 0, epochs: int = 6, rate: float = 0.1, buckets: int = BUCKETS) -> Model:
    """Train embeddings and softmax weights together by adaptive gradient steps; texts of both classes or none."""
    y = np.asarray(list(labels), int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(buckets, np.float32), 0.0 if not len(y) else float(8 * y.mean() - 4))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (buckets, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table_sum, weights_sum, bias_sum = (np.full(a.shape, 1e-6, np.float32) for a in (table, weights, bias))
    bags = _bags(texts, buckets)
    spread = np.bincount(np.concatenate([rows for rows, _ in bags]), minlength=buckets)
    usual = spread >= min(MIN_TEXTS, max(2, len(y) // 100))
    bags = [(rows[usual[rows]], shares[usual[rows]]) for rows, shares in bags]
    for _ in range(max(epochs, MIN_STEPS * 32 // len(y))):
        order = rng.permutation(len(y))
        for chosen in np.array_split(order, max(1, len(y) // 32)):
            sizes = [len(bags[i][0]) for i in chosen]
            rows = np.concatenate([bags[i][0] for i in chosen])
            shares = np.concatenate([bags[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            means = np.stack([np.bincount(owner, shares * table[rows, d], len(chosen)) for d in range(DIMENSIONS)], axis=1)
            logits = STEEPNESS * means @ weights + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error /= len(chosen)
            to_means = (STEEPNESS * error @ weights.T).astype(np.float32)
            for value, total, gradient in (
                (weights, weights_sum, STEEPNESS * means.T @ error),
                (bias, bias_sum, error.sum(axis=0)),
            ):
                total += gradient**2
                value -= rate * 0.1 * (gradient / np.sqrt(total)).astype(np.float32)
            touched, back = np.unique(rows, return_inverse=True)
            gradient = np.stack([np.bincount(back, shares * to_means[owner, d], len(touched)) for d in range(DIMENSIONS)], axis=1)
            table_sum[touched] += gradient**2
            table[touched] -= rate * (gradient / np.sqrt(table_sum[touched])).astype(np.float32)
    lean = weights[:, 1] - weights[:, 0]
    return Model(np.where(usual, STEEPNESS * table @ lean, 0).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.sizes = model, {}, {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text; without words that of the intercept."""
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.sizes.clear()
            new = list({w for words in split for w in words})
        for start in range(0, len(new), 50_000):
            some = new[start : start + 50_000]
            owners, hashes = subwords(some, len(self.model.odds))
            sums = np.bincount(owners, self.model.odds[hashes], len(some))
            self.known.update(zip(some, sums.tolist()))
            self.sizes.update(zip(some, np.bincount(owners, minlength=len(some)).tolist()))
        logits = [
            sum(map(self.known.__getitem__, words)) / (NEUTRAL + sum(map(self.sizes.__getitem__, words))) + self.model.bias
            for words in split
        ]
        return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = SAMPLE_TOXIC) -> pd.DataFrame:
    """The bounded sample to fit on: labelled texts whose fold of 5 is not 0, about ``each`` of label 1 and twice that of 0."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    usable = docs.where((fold("doc_id", 5) != 0) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id")
    chosen = stratified_sample(marked.join(usable, "doc_id", "left_semi"), "label", "doc_id", F.when(F.col("label") == 1, each).otherwise(2 * each), 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"])


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 of each whole text; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    workers: dict[int, Scorer] = {}

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = workers.setdefault(0, Scorer(shared.value))
        values = texts.tolist()
        return pd.Series(np.concatenate([scorer.score(values[i : i + 500]) for i in range(0, len(values), 500)] or [np.empty(0)]))

    return docs.withColumn(out, run(F.col(text)))


def judge(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = SAMPLE_TOXIC) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    ``labels`` has doc_id and the label column, 0 or 1; repeated labels count by their
    greatest, null ones not. Documents without an id are neither learned from nor held
    out. With labels of one class, or none, every text has one and the same score.
    Repeated rows are scored each; an empty table gives none.
    """
    sample = training_rows(docs, labels, label, each)
    model = fit(sample["text"].tolist(), sample["label"].tolist())
    scored = score_texts(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
