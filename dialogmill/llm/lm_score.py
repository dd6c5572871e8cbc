"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts the class of a token from the two before it: the commonest
words, a class for all others, and the end of a text. The predicted vector is the
sum of the context words' vectors, each weighted by place; a class's score is its
product with the class's vector, plus a bias. A word outside the common ones has
the other class's probability times its share of their smoothed counts, so a
text's probability is that of its words and all texts' probabilities add up.

Training goes in rounds, each over its own share of all training texts: every task
goes on from the last round's model on its part of the share, and the tasks' models
are averaged by tokens. Counts of all words are gathered over all training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import fold, settled

#: Words with a class of their own, size of the vectors, and noise words for each batch of tokens.
CLASSES = 2000
DIMENSIONS = 16
NOISE = 64
BATCH = 512
#: Size of a step, shares of the training texts learned from between two averages, and tokens of a row of class ids.
RATE = 0.3
ROUNDS = 4
PIECE = 65_536
#: Words whose counts every task has; rarer ones are joined.
COMMON_WORDS = 200_000
#: Different words counted in a task before they are passed on.
FLUSH_WORDS = 300_000
SMOOTHING = 0.1
#: The end of a text as a token; no word holds white space.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over all rows of the string column ``text``; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed_on():
            words = list(counts)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"]
                )
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[END] += 1
                if len(counts) > FLUSH_WORDS:
                    yield from passed_on()
        yield from passed_on()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of the commonest words, most first, and sums over all."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    types: int

    def base_log10(self, count):
        return np.log10((count + SMOOTHING) / (self.tokens + SMOOTHING * (self.types + 1)))


def lexicon(counts: DataFrame, most: int = COMMON_WORDS) -> Lexicon:
    """The words above the lowest count that leaves at most ``most`` of them.

    Counts are taken in steps of a sixteenth of a doubling, so the driver gets at
    most ``most`` words and some hundred step sizes.
    """
    level = F.floor(F.log2("n") * 16)
    steps = counts.where(F.col("word") != END).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens")).collect()
    ends = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    least, held = None, 0
    for step in sorted(steps, reverse=True):
        held += step.types
        if held > most:
            break
        least = step.level
    common = [] if least is None else counts.where((F.col("word") != END) & (level >= least)).collect()
    common.sort(key=lambda r: (-r.n, bytes(r.word)))
    return Lexicon(
        [bytes(r.word) for r in common],
        np.array([r.n for r in common], np.int64),
        ends,
        ends + sum(s.tokens for s in steps),
        (ends > 0) + sum(s.types for s in steps),
    )


def class_shares(lex: Lexicon, classes: int) -> np.ndarray:
    """Smoothed shares of the classes: words, other, end."""
    own = lex.counts[:classes]
    n = np.concatenate([own, [lex.tokens - lex.ends - own.sum(), lex.ends]]) + 1.0
    return n / n.sum()


class LogBilinear:
    """``context`` (classes + 3, d), ``place`` (2, d), ``target`` (classes + 2, d), ``bias``.

    Class ids: words from 0, then other, end, and, as context only, start.
    """

    NAMES = ("context", "place", "target", "bias")

    def __init__(self, shares: np.ndarray, seed: int | tuple[int, ...] = 0, dimensions: int = DIMENSIONS, start: LogBilinear | None = None):
        rng = np.random.default_rng(seed)
        outputs = len(shares)
        self.shares = shares
        if start:
            self.take({n: getattr(start, n).copy() for n in self.NAMES})
        else:
            self.context = rng.normal(0, 0.1, (outputs + 1, dimensions)).astype(np.float32)
            self.place = np.ones((2, dimensions), np.float32)
            self.target = rng.normal(0, 0.1, (outputs, dimensions)).astype(np.float32)
            self.bias = np.log(shares).astype(np.float32)[:, None]
        self.noise = rng
        self.edges = np.cumsum(shares)
        self.squares = {n: np.full(getattr(self, n).shape, 1e-3, np.float32) for n in self.NAMES}

    def take(self, arrays: dict[str, np.ndarray]) -> None:
        for name, value in arrays.items():
            setattr(self, name, value)

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in self.NAMES}

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """Adaptive step on some rows; gradients of one row add up."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        summed = np.add.reduceat(gradient[order], first, axis=0)
        rows = rows[first]
        self.squares[name][rows] += summed**2
        getattr(self, name)[rows] += rate * summed / np.sqrt(self.squares[name][rows])

    def learn(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One step of noise-contrastive estimation: ``first`` is two tokens before the target, ``second`` one."""
        n = len(target)
        noise = np.minimum(np.searchsorted(self.edges, self.noise.random(NOISE)), len(self.shares) - 1)
        log_odds = np.log(NOISE * self.shares).astype(np.float32)
        one, two = self.context[first], self.context[second]
        predicted = one * self.place[0] + two * self.place[1]
        own = self.target[target]
        true = np.einsum("nd,nd->n", predicted, own) + self.bias[target, 0] - log_odds[target]
        false = predicted @ self.target[noise].T + (self.bias[noise, 0] - log_odds[noise])
        up = (0.5 - 0.5 * np.tanh(0.5 * true))[:, None] / n
        down = (0.5 + 0.5 * np.tanh(0.5 * false)) / n
        to_predicted = up * own - down @ self.target[noise]
        places = np.stack([(to_predicted * one).sum(axis=0), (to_predicted * two).sum(axis=0)])
        contexts = np.concatenate([to_predicted * self.place[0], to_predicted * self.place[1]])
        targets = np.concatenate([up * predicted, -down.T @ predicted])
        biases = np.concatenate([up, -down.sum(axis=0)[:, None]])
        self._move("context", np.concatenate([first, second]), contexts, rate)
        self._move("place", np.arange(2), places, 0.2 * rate)
        both = np.concatenate([target, noise])
        self._move("target", both, targets, rate)
        self._move("bias", both, biases, rate)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score parts by (first, target) and (second, target), and the log sum over targets by (first, second).

        The sum of exp(a + b) over targets is a product of two matrices of exponents.
        """
        early = (self.context * self.place[0]) @ self.target.T
        late = (self.context * self.place[1]) @ self.target.T + self.bias[:, 0]
        top_early, top_late = early.max(axis=1, keepdims=True), late.max(axis=1, keepdims=True)
        sums = np.exp(early - top_early) @ np.exp(late - top_late).T
        return early, late, np.log(sums) + top_early + top_late.T


def contexts(ids: list[np.ndarray], outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, target, text) of every token of texts given as word classes, their ends included."""
    start, end = np.array([outputs, outputs]), np.array([outputs - 1])
    line = np.concatenate([part for own in ids for part in (start, own, end)]) if ids else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(own) + 3 for own in ids])
    at = np.flatnonzero(line != outputs)
    return line[at - 2], line[at - 1], line[at], owner[at]


def class_ids(texts: DataFrame, words: list[bytes], outputs: int, piece: int = PIECE) -> DataFrame:
    """Rows (round, ids) of the columns round and text: a text's classes, two starts before and the end after.

    Long texts are several rows of at most ``piece`` predicted tokens, each led by the two tokens before them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        other = len(place)
        for batch in batches:
            held, rounds = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_of(text.as_py())
                line = np.full(len(found) + 3, outputs, "<i4")
                line[2:-1] = np.fromiter(map(place.get, found, repeat(other)), "<i4", len(found))
                line[-1] = outputs - 1
                pieces = [line[i : i + piece + 2].tobytes() for i in range(0, len(line) - 2, piece)]
                held += pieces
                rounds += [number] * len(pieces)
            for i in range(0, len(held), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(rounds[i : i + 1000], pa.int32()), pa.array(held[i : i + 1000], pa.binary())], ["round", "ids"])

    return texts.select("round", "text").mapInArrow(run, "round int, ids binary")


def train_round(lines: DataFrame, model: LogBilinear, number: int) -> LogBilinear:
    """Average of the models that the tasks train from ``model`` on all rows of the column ``ids``; ``model`` if there are none."""
    shared = lines.sparkSession.sparkContext.broadcast((model.shares, model.arrays()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, arrays = shared.value
        start = LogBilinear(shares)
        start.take(arrays)
        mine = LogBilinear(shares, (number, TaskContext.get().partitionId()), start=start)
        seen, held, waiting = 0, [], 0

        def learn():
            first, second, target = (np.concatenate([line[i : len(line) - 2 + i] for line in held]) for i in range(3))
            for i in range(0, len(target), BATCH):
                mine.learn(first[i : i + BATCH], second[i : i + BATCH], target[i : i + BATCH])
            return len(target)

        for batch in batches:
            for ids in batch.column(0):
                held.append(np.frombuffer(ids.as_buffer(), "<i4"))
                waiting += len(held[-1]) - 2
                if waiting > 64 * BATCH:
                    seen += learn()
                    held, waiting = [], 0
        if held:
            seen += learn()
        if seen:
            for kind, name in enumerate(LogBilinear.NAMES):
                value = getattr(mine, name).astype(float) * seen
                yield pa.RecordBatch.from_pydict(
                    {"kind": [kind] * len(value), "row": list(range(len(value))), "value": value.tolist(), "seen": [seen] * len(value)},
                    schema=pa.schema([("kind", pa.int32()), ("row", pa.int32()), ("value", pa.list_(pa.float64())), ("seen", pa.int64())]),
                )

    trained = lines.select("ids").mapInArrow(run, "kind int, row int, value array<double>, seen long")
    parts = [F.coalesce(F.sum(F.get("value", F.lit(d))), F.lit(0.0)).alias(f"v{d}") for d in range(DIMENSIONS)]
    averaged = LogBilinear(model.shares, start=model)
    for row in trained.groupBy("kind", "row").agg(F.sum("seen").alias("seen"), *parts).collect():
        value = getattr(averaged, LogBilinear.NAMES[row.kind])
        value[row.row] = np.array(row[3 : 3 + value.shape[1]]) / row.seen
    return averaged


def train(texts: DataFrame, lex: Lexicon, classes: int = CLASSES, rounds: int = ROUNDS) -> LogBilinear:
    """The model after ``rounds`` rounds over the columns doc_id and text; each text is learned from in one of them.

    Texts are turned into class ids once, in a settled table that all rounds read.
    """
    model = LogBilinear(class_shares(lex, classes))
    dealt = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(rounds)).cast("int").alias("round")
    lines = settled(class_ids(texts.select(dealt, "text"), lex.words[:classes], len(model.shares)), "classes")
    for number in range(rounds):
        model = train_round(lines.where(F.col("round") == number), model, number)
    return model


def score_texts(docs: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """Rows of texts and of their rare words, of the columns doc_id, held_out and text.

    A text's row has its sums over the common words; a rare word's row (word not
    null) has how often the text has it. ``row`` numbers the texts and is only
    good as written, so the result has to be settled before it is used twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lex, model.shares, model.arrays()))
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("times", pa.int64())]
        + [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_other", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, shares, arrays = shared.value
        own = LogBilinear(shares)
        own.take(arrays)
        early, late, sums = own.tables()
        classes, outputs = len(shares) - 2, len(shares)
        place = {w: i for i, w in enumerate(lex.words)}
        logs = np.log10(lex.counts + SMOOTHING)
        end_log = np.log10(lex.ends + SMOOTHING)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, held_outs, texts = (batch.column(i).to_pylist() for i in range(3))
            for low in range(0, len(texts), 500):
                part = slice(low, low + 500)
                found, rare = [], []
                for i, text in enumerate(texts[part]):
                    words = words_of(text)
                    ids = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    found.append(ids)
                    counted = Counter(words[j] for j in np.flatnonzero(ids < 0))
                    rare += [(row + i, w, n) for w, n in counted.items()]
                n = len(found)
                lengths = np.array([len(ids) for ids in found])
                flat, owner = np.concatenate(found), np.repeat(np.arange(n), lengths)
                common = flat >= 0
                values = np.where(common, logs[flat], 0.0) if len(logs) else np.zeros(len(flat))
                other = (flat < 0) | (flat >= classes)
                base = np.bincount(owner, values, n) + end_log
                of_other = np.bincount(owner, values * other, n)
                first, second, target, text_of = contexts([np.where((ids < 0) | (ids >= classes), classes, ids) for ids in found], outputs)
                token = early[first, target] + late[second, target] - sums[first, second]
                score = np.bincount(text_of, token.astype(float), n) / np.log(10) + of_other
                nulls = [None] * n
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": np.arange(row, row + n), "doc_id": doc_ids[part], "held_out": held_outs[part], "word": nulls, "times": nulls,
                        "n_tokens": lengths + 1, "n_known": np.bincount(owner, common, n).astype(int) + (lex.ends > 0),
                        "base": base, "score": score, "n_other": np.bincount(owner, other, n).astype(int),
                    },
                    schema=schema,
                )
                for i in range(0, len(rare), 50_000):
                    rows, words, times = zip(*rare[i : i + 50_000])
                    nulls = [None] * len(rows)
                    yield pa.RecordBatch.from_pydict(
                        {"row": rows, "word": words, "times": times} | {c: nulls for c in schema.names if c not in ("row", "word", "times")},
                        schema=schema,
                    )
                row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, score double, n_other long",
    )


def judge(docs: DataFrame, classes: int = CLASSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

    Texts whose fold of 10 is not 0 are learned from; those without an id are
    neither learned from nor held out. Null and empty texts are their end alone.
    Scores are log10 probabilities of whole texts. Repeated rows count, and are
    scored each. Without training texts all words are unknown. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learned = rows.where(fold("doc_id", 10) != 0)
    counts = settled(count_words(learned), "counts")
    lex = lexicon(counts)
    model = train(learned, lex, classes)
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    scored = settled(score_texts(rows.select("doc_id", held, "text"), lex, model), "scored")
    known = F.coalesce("n", F.lit(0))
    rare = (
        scored.where("word IS NOT NULL").select("row", "word", "times").join(counts, "word", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10(known + SMOOTHING)).alias("rare_base"),
            F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    own = lex.counts[:classes]
    # smoothed counts of all words of the other class, an unseen one included
    others = lex.tokens - lex.ends - int(own.sum()) + SMOOTHING * (lex.types - (lex.ends > 0) - len(own) + 1)
    every = float(np.log10(lex.tokens + SMOOTHING * (lex.types + 1)))
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return scored.where("word IS NULL").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base - F.col("n_tokens") * every).alias("base_score"),
        (F.col("score") + rare_base - F.col("n_other") * float(np.log10(others))).alias("score"),
    )
