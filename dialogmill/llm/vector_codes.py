"""Vector code compression: parts of integer vectors as indexes of codebook entries, exactly.

Components are integers, and all distances are exact: they are taken as matrix
products in float64, with the integers broken into limbs so short that no sum of
products reaches 2^53, and the products of limbs are put together in int64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import settled

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors that are compared with a codebook at once.
BLOCK = 4096
#: Different labels up to which their sums are sent to all executors.
MAX_BROADCAST = 100_000
LONGEST = (1 << 63) - 1


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as limbs of ``bits`` bits, lowest first; the last one has the sign."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        high = x >> bits
        out.append(x - (high << bits))
        x = high
    return [*out, x]


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact if the result fits int64."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    lows = [y.astype(float) for y in limbs(b, bits)]
    for i, x in enumerate(limbs(a, bits)):
        x = x.astype(float)
        for j, y in enumerate(lows):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the first nearest entry to each row, and the squared distance.

    Where a distance could leave int64, Python's integers are taken.
    """
    most = max((int(abs(int(v))) for m in (x, book) if m.size for v in (m.max(), m.min())), default=0)
    if 4 * max(1, x.shape[1]) * most * most > LONGEST:
        x, book = x.astype(object), book.astype(object)
        apart = np.array([[sum((p - q) ** 2 for p, q in zip(row, entry)) for entry in book] for row in x], object).reshape(len(x), len(book))
        best = np.array([min(range(len(book)), key=row.__getitem__) for row in apart], np.int64)
        return best, np.array([row[k] for row, k in zip(apart, best)], object)
    score = (book * book).sum(axis=1) - 2 * dot(x, book)
    best = score.argmin(axis=1)
    return best, score[np.arange(len(x)), best] + (x * x).sum(axis=1)


def cuts(width: int, parts: int) -> list[slice]:
    edges = [k * width // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _integers(vectors: pd.Series, scale: int) -> np.ndarray:
    return np.floor(np.stack(vectors.to_numpy()).astype(float) * scale).astype(np.int64)


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows (vec_id, label, v) of vectors with finite components only, whose multiples fit a long."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 63) / scale))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return rows.where(F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """One codebook a part position from the vectors with the smallest ids; null ids come last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toPandas()
    if first.empty:
        return []
    width = len(first["v"][0])
    x = _integers(first["v"][first["v"].map(len) == width], scale)
    return [x[:, cut] for cut in cuts(width, parts)]


def improved(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floor of its parts' mean, unused ones as they were.

    Tasks add up their own rows, so that what is shuffled is a row per entry and task.
    """
    width, positions = sum(b.shape[1] for b in books), cuts(sum(b.shape[1] for b in books), len(books))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = _integers(batch["v"][at : at + BLOCK], scale)
                for k, cut in enumerate(positions):
                    best, _ = nearest(x[:, cut], books[k])
                    counts[k] += np.bincount(best, minlength=len(books[k]))
                    order = np.argsort(best, kind="stable")
                    starts = np.flatnonzero(np.diff(best[order], prepend=-1))
                    # halves, whose sums over a block fit a long
                    for half, weight in ((x[:, cut] >> 32, 1 << 32), (x[:, cut] & 0xFFFFFFFF, 1)):
                        sums[k][best[order][starts]] += np.add.reduceat(half[order], starts, axis=0).astype(object) * weight
        for k, book in enumerate(books):
            used = np.flatnonzero(counts[k])
            if len(used):
                yield pd.DataFrame({"part": k, "entry": used, "n": counts[k][used], "sums": [[Decimal(int(v)) for v in sums[k][e]] for e in used]})

    found = rows.select("v").mapInPandas(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    most = max((b.shape[1] for b in books), default=0)
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(most)]).alias("sums"))
    books = [b.copy() for b in books]
    for r in totals.collect():  # an entry each
        books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"][: books[r["part"]].shape[1]]]
    return books


def coded(rows: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """Rows (vec_id, label, code, error)."""
    positions = cuts(sum(b.shape[1] for b in books), len(books))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.iloc[at : at + BLOCK]
                x = _integers(some["v"], scale)
                found = [nearest(x[:, cut], book) for cut, book in zip(positions, books)]
                codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                errors = sum(apart.astype(object) for _, apart in found)
                yield pd.DataFrame({"vec_id": some["vec_id"], "label": some["label"], "code": [c.tobytes().hex() for c in codes], "error": [min(e, LONGEST) for e in errors]})

    kind = rows.schema["label"].dataType.simpleString()
    # ids and labels as text, which stays exact where some are null
    text = rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), "v")
    out = text.mapInPandas(run, "vec_id string, label string, code string, error long")
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast(kind).alias("label"), "code", "error")


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one per kept row.

    A component x is the integer floor(scale * x). Codebooks start as the parts of
    the ``entries`` (256 at most) smallest ids, fewer if there are fewer; equal ids count by
    their vectors. Left out are vectors that are null or hold null or not
    finite numbers, or such as do not fit a long when scaled, and vectors of another
    length than the one of the smallest id. Parts are as equal as the length
    allows. Rows without id are kept and come last; without label they are one label. An error
    past the largest long is given as that. Repeated rows count each. An empty
    table gives none.
    """
    rows = settled(usable(vectors, vec_id, vector, label, scale), "kept")
    books = first_books(rows, parts, entries, scale)
    if not books:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.where(F.size("v") == sum(b.shape[1] for b in books))
    for _ in range(rounds):
        books = improved(rows, books, scale)
    told = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    scored = settled(coded(rows, books, scale), "codes")
    sums = scored.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = settled(sums, "label-errors")
    # a label may hold a third of all rows: few labels are sent, more are joined, which Spark may split
    sums = F.broadcast(sums) if sums.count() <= MAX_BROADCAST else sums
    return scored.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256")
    )
