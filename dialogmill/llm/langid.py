"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes in both directions, gives every
position probabilities of the languages, and a document is the mean over its
positions. It is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import fold, stratified_sample

UNKNOWN = "und"
#: Units of each direction, and bytes read from one starting state.
UNITS = 8
WINDOW = 64
#: Texts of each language to fit on, about, the longest text among them, and most languages: bounds of the sample.
SAMPLE_EACH = 250
SAMPLE_CHARS = 20_000
MAX_LANGUAGES = 256
#: Windows read at once.
BATCH = 4096


def start(languages: int, rng: np.random.Generator, units: int = UNITS) -> dict[str, np.ndarray]:
    """Weights: by direction ``x`` (256, 3 units) per byte and ``u`` (units, 3 units); gates update, reset, new."""
    shapes = {"xf": (256, 3 * units), "xb": (256, 3 * units), "uf": (units, 3 * units), "ub": (units, 3 * units)}
    weights = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    weights |= {"out": rng.normal(0, 0.3, (2 * units, languages)), "bias": np.zeros(languages)}
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _read(x: np.ndarray, u: np.ndarray, codes: np.ndarray, keep: bool):
    """States after each byte of ``codes`` (time, windows), and what the way back needs."""
    units = len(u)
    state = np.zeros((codes.shape[1], units), np.float32)
    states = np.empty((*codes.shape, units), np.float32)
    gates = []
    # sigmoid(x) is (tanh(x / 2) + 1) / 2; each gate has arrays of its own, as slices would be slow
    parts = [(k * units, (k + 1) * units, scale) for k, scale in enumerate((0.5, 0.5, 1.0))]
    xs = [np.ascontiguousarray(x[:, a:b] * np.float32(scale)) for a, b, scale in parts]
    us = [np.ascontiguousarray(u[:, a:b] * np.float32(scale)) for a, b, scale in parts]
    for t, code in enumerate(codes):
        update, reset = state @ us[0], state @ us[1]
        for gate, given in ((update, xs[0]), (reset, xs[1])):
            gate += given.take(code, axis=0)
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
        new = (reset * state) @ us[2]
        new += xs[2].take(code, axis=0)
        np.tanh(new, out=new)
        if keep:
            gates.append((update, reset, new, state))
        state = np.subtract(state, new, out=states[t])
        state *= update
        state += new
    return states, gates


def _read_back(x, u, codes, gates, to_states):
    """Gradients of x and u, given those of the states after each byte."""
    units = len(u)
    dx, du = np.zeros_like(x), np.zeros_like(u)
    carried = np.zeros_like(to_states[0])
    inputs = np.empty((*codes.shape, 3 * units), np.float32)
    for t in range(len(codes) - 1, -1, -1):
        update, reset, new, before = gates[t]
        here = to_states[t] + carried
        d_new = here * (1 - update) * (1 - new**2)
        d_update = here * (before - new) * update * (1 - update)
        held = d_new @ u[:, 2 * units :].T
        d_reset = held * before * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        carried = here * update + held * reset + d_gates @ u[:, : 2 * units].T
        du[:, : 2 * units] += before.T @ d_gates
        du[:, 2 * units :] += (reset * before).T @ d_new
        inputs[t] = np.concatenate([d_gates, d_new], axis=1)
    flat, codes = inputs.reshape(-1, 3 * units), codes.ravel()
    for d in range(3 * units):
        dx[:, d] = np.bincount(codes, flat[:, d], 256)
    return dx, du


def positions(weights: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
    """Probabilities (languages, time, windows) at every position."""
    forward, gf = _read(weights["xf"], weights["uf"], codes, keep)
    backward, gb = _read(weights["xb"], weights["ub"], codes[::-1], keep)
    backward = np.ascontiguousarray(backward[::-1])
    units = forward.shape[2]
    logits = weights["out"][:units].T @ forward.reshape(-1, units).T
    logits += weights["out"][units:].T @ backward.reshape(-1, units).T
    logits += weights["bias"][:, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits.reshape(-1, *codes.shape), forward, backward, gf, gb


def fit_step(weights, codes, labels, moments, step, rate=0.01):
    """One Adam step on windows ``codes`` (time, windows); every position carries its window's label."""
    time, windows = codes.shape
    error, forward, backward, gf, gb = positions(weights, codes, keep=True)
    own = (labels[None, :], np.arange(time)[:, None], np.arange(windows)[None, :])
    loss = -np.log(error[own] + 1e-9).mean()
    error[own] -= 1
    error /= time * windows
    units = forward.shape[2]
    both = np.concatenate([forward, backward], axis=2)
    to_states = np.einsum("ltw,ul->twu", error, weights["out"], optimize=True)
    grads = {
        "out": both.reshape(-1, 2 * units).T @ error.reshape(len(error), -1).T,
        "bias": error.sum(axis=(1, 2)),
    }
    grads["xf"], grads["uf"] = _read_back(weights["xf"], weights["uf"], codes, gf, to_states[:, :, :units])
    grads["xb"], grads["ub"] = _read_back(weights["xb"], weights["ub"], codes[::-1], gb, to_states[::-1, :, units:])
    for name, gradient in grads.items():
        first, second = moments.setdefault(name, (np.zeros_like(gradient), np.zeros_like(gradient)))
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        weights[name] -= (rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return float(loss)


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None
    languages: list[str]


def fit(texts: list[str], languages: list[str], seed: int = 0, steps: int = 400, windows: int = 128) -> Model:
    """Train on random windows of the texts, each language as often as any other."""
    names = sorted(set(languages))
    by_name = {n: [np.frombuffer(t.encode(), np.uint8) for t, lang in zip(texts, languages) if lang == n and t] for n in names}
    names = [n for n in names if by_name[n]]
    if not names:
        return Model(None, [])
    rng = np.random.default_rng(seed)
    weights, moments = start(len(names), rng), {}
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(names), windows)
        codes = np.full((WINDOW, windows), 32, np.int64)
        for column, label in enumerate(labels):
            own = by_name[names[label]]
            text = own[rng.integers(len(own))]
            at = rng.integers(max(1, len(text) - WINDOW + 1))
            part = text[at : at + WINDOW]
            codes[: len(part), column] = part
        fit_step(weights, codes, labels, moments, step, 0.02 if step < 0.7 * steps else 0.004)
    return Model(weights, names)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pooled(model: Model, texts: list[str]) -> np.ndarray:
    """Mean probabilities over all bytes of each text; windows of many texts are read together."""
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    counts = [-(-len(r) // WINDOW) for r in raw]
    owner = np.repeat(np.arange(len(raw)), counts)
    sums = np.zeros((len(raw), len(model.languages)))
    flat = np.full(len(owner) * WINDOW, 32, np.uint8)
    sizes = np.full(len(owner), WINDOW)
    at = 0
    for r, n in zip(raw, counts):
        flat[at : at + len(r)] = r
        at += n * WINDOW
        if n:
            sizes[at // WINDOW - 1] = len(r) - (n - 1) * WINDOW
    grid = flat.reshape(-1, WINDOW)
    for low in range(0, len(grid), BATCH):
        codes = np.ascontiguousarray(grid[low : low + BATCH].T)
        found = positions(model.weights, codes)[0]
        found *= np.arange(WINDOW)[:, None] < sizes[low : low + BATCH]
        for lang, by_window in enumerate(found.sum(axis=1)):
            sums[:, lang] += np.bincount(owner[low : low + BATCH], by_window, len(raw))
    return sums / np.maximum(1, [len(r) for r in raw])[:, None]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    if some:
        found = pooled(model, [texts[i] for i in some])
        for i, row in zip(some, found):
            names[i], scores[i] = model.languages[int(row.argmax())], float(min(1.0, row.max()))
    return names, scores


def training_rows(docs: DataFrame, each: int = SAMPLE_EACH) -> pd.DataFrame:
    """The bounded sample to fit on: texts with a language whose fold of 3 is not 1, about ``each`` of a language."""
    usable = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = stratified_sample(usable.select("doc_id", "text", "lang"), "lang", "doc_id", each, MAX_LANGUAGES)
    return rows.toPandas().sort_values(["doc_id", "text"])


def train(docs: DataFrame) -> Model:
    sample = training_rows(docs)
    return fit(sample["text"].tolist(), sample["lang"].astype(str).tolist())


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang_pred, score); null texts and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        model, values, names, scores = shared.value, texts.tolist(), [], []
        for i in range(0, len(values), 200):
            some = predict(model, values[i : i + 200])
            names += some[0]
            scores += some[1]
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.withColumn(out, run(F.col(text)))


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs`` (with doc_id, text and lang).

    Documents without an id or a language are not learned from. Without any to learn
    from, every text is ``und``. Repeated rows are named each; an empty table gives none.
    """
    named = with_language(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return named.select("doc_id", held, "language.lang_pred", "language.score")


def keep_known(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with at least that score."""
    named = with_language(docs.select(F.struct(*docs.columns).alias("row"), "text"), train(docs.select("doc_id", "text", "lang")))
    return named.where((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= least_score)).select("row.*")
