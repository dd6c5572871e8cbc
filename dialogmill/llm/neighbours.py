"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and assigned to the nearest signed axis. A table joins several
such hashes, each with a rotation of its own, into the number of one cell; how many
grows with the logarithm of the rows, so a cell keeps few rows at any size. A query
probes the cells nearest to it in each table. Neighbouring cells are stored as one
bucket; its vectors and the queries that probe some of its cells meet in a task of
bounded size, which returns the nearest by exact distance; no pair of a query and a
candidate is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import settled

TABLES = 8
#: Cells a query probes in each table, by the number of hashes; from there on eight times more with each hash.
PROBES = (14, 400, 3200)
#: Vectors and queries of a bucket that meet in one task, on average, at most; buckets hold half of it on average.
CHUNK = 4096
#: Numbers in a block of a task's arrays.
BLOCK = 4_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs, turned = x.reshape(n, d // (2 * step), 2, step), np.empty((n, d // (2 * step), 2, step))
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=turned[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=turned[:, :, 1])
        x, step = turned.reshape(n, d), 2 * step
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int = 0) -> np.ndarray:
    """Unit vectors after the pseudo-rotation of a table, padded by zeros to a power of two."""
    width = 1 << (x.shape[1] - 1).bit_length()
    # scaled first, so that tiny and huge vectors keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def hashes_for(n: int, width: int) -> int:
    """How many hashes a table joins: the most whose cells, ``width`` to their power, are not more than the rows."""
    hashes = 1
    while width ** (hashes + 1) <= n:
        hashes += 1
    return hashes


def probes_for(hashes: int) -> int:
    return PROBES[hashes - 1] if hashes <= len(PROBES) else PROBES[-1] * 8 ** (hashes - len(PROBES))


def cells(x: np.ndarray, table: int, hashes: int, probes: int, seed: int = 0, tables: int = TABLES) -> np.ndarray:
    """The ``probes`` nearest cells of each row (all, if fewer), in no order.

    A cell's distance is the sum, over its hashes, of the squared gap between the nearest axis
    and the cell's own. The nearest so far, joined with all axes of the next hash, hold the nearest.
    """
    width = 2 << (x.shape[1] - 1).bit_length()
    found = []
    # few rows at a time: their transforms stay in the processor's cache
    for some in np.array_split(x, max(1, -(-len(x) // 1000), -(-len(x) * width * (probes if hashes > 1 else 1) // BLOCK))):
        cell, cost = np.zeros((len(some), 1), np.int64), np.zeros((len(some), 1))
        for turn in range(hashes):
            turned = rotate(some, table + tables * turn, seed)
            both = np.concatenate([turned, -turned], axis=1)
            if probes == 1:
                cell = cell * width + both.argmax(axis=1)[:, None]
                continue
            gaps = (both.max(axis=1, keepdims=True) - both) ** 2
            cost = (cost[:, :, None] + gaps[:, None, :]).reshape(len(some), -1)
            cell = (cell[:, :, None] * width + np.arange(width)).reshape(len(some), -1)
            if cost.shape[1] > probes:
                kept = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                cost, cell = np.take_along_axis(cost, kept, 1), np.take_along_axis(cell, kept, 1)
        found.append(cell)
    return np.concatenate(found)


def buckets(cell: np.ndarray, n: int, hashes: int, width: int) -> np.ndarray:
    """The bucket of each cell: cells that differ in their last hash only share one."""
    return (cell // width if hashes > 1 else cell) % -(-2 * n // CHUNK)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct rows (vec_id, v) without null ids and null, empty, zero, or not finite vectors."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False))).distinct()


def _placed(rows: DataFrame, tables: int, hashes: int | None, asking: bool, probes: int | None, seed: int) -> DataFrame:
    """Rows (dim, table_no, bucket, cells, vec_id, v), from rows (vec_id, v, n): a vector's own cell in
    each table, or, when ``asking``, one row for each bucket that holds cells to probe."""
    kind = rows.schema["v"].dataType.simpleString()

    def place(x: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Row number, bucket and cells of each row to give out."""
        width = 2 << (x.shape[1] - 1).bit_length()
        joined = hashes or hashes_for(n, width)
        near = cells(x, table, joined, (probes or probes_for(joined)) if asking else 1, seed)
        cell, row = near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])
        bucket = buckets(cell, n, joined, width)
        if not asking:
            return row, bucket, list(near)
        order = np.lexsort((cell, bucket, row))
        cell, row, bucket = cell[order], row[order], bucket[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])
        return row[first], bucket[first], np.split(cell, first[1:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for dim in np.unique(sizes):
                part = batch[sizes == dim]
                n = int(part["n"].iloc[0])
                for some in np.array_split(np.arange(len(part)), -(-len(part) // (100 if asking else 10_000))):
                    piece = part.iloc[some]
                    x = np.stack(piece["v"].to_numpy()).astype(float)
                    for table in range(tables):
                        row, bucket, within = place(x, table, n)
                        yield pd.DataFrame(
                            {
                                "dim": int(dim),
                                "table_no": table,
                                "bucket": bucket,
                                "cells": within,
                                "vec_id": piece["vec_id"].to_numpy()[row],
                                "v": piece["v"].to_numpy()[row],
                            }
                        )

    return rows.mapInPandas(run, f"dim int, table_no int, bucket long, cells array<long>, vec_id long, v {kind}")


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest to each query of the vectors in its cells, by exact distance, ties to the smaller id."""
    own = np.concatenate(vectors["cells"].to_numpy())
    order = np.argsort(own, kind="stable")
    own, ids = own[order], vectors["vec_id"].to_numpy()[order]
    x, asked = np.stack(vectors["v"].to_numpy()[order]).astype(float), queries["vec_id"].to_numpy()
    most = max(1, BLOCK // x.shape[1])
    found: list[tuple] = []
    for at, (query, v, probed) in enumerate(zip(asked, queries["v"], queries["cells"])):
        start, end = np.searchsorted(own, probed, "left"), np.searchsorted(own, probed, "right")
        length = end - start
        # the places of all vectors in the probed cells, one cell after the other
        some = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        some = some[ids[some] != query]
        if len(some):
            q = np.asarray(v, float)
            exact = np.concatenate([np.sqrt(((x[part] - q) ** 2).sum(axis=1)) for part in np.array_split(some, -(-len(some) // most))])
            best = np.lexsort((ids[some], exact))[:k]
            found += zip([asked[at]] * len(best), ids[some][best], exact[best])
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def _search(queries: DataFrame, vectors: DataFrame, k: int, tables: int, hashes: int | None, probes: int | None, seed: int) -> DataFrame:
    """Rows (query_id, vec_id, score): of each task the k nearest, each pair once."""
    place = ("dim", "table_no", "bucket")
    stored = settled(_placed(vectors, tables, hashes, False, None, seed), "index")
    asked = settled(_placed(queries, tables, hashes, True, probes, seed), "probes")
    # one row a bucket, that is for some 2,048 vectors
    sizes = stored.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("v_chunks")).join(
        asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("q_chunks")), list(place)
    )
    sizes = settled(sizes, "sizes")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, list(place)).withColumn("q_chunk", own("q_chunks")).withColumn("v_chunk", each("v_chunks"))
    right = stored.join(sizes, list(place)).withColumn("v_chunk", own("v_chunks")).withColumn("q_chunk", each("q_chunks"))
    group = (*place, "q_chunk", "v_chunk")
    columns = (*group, "cells", "vec_id", "v")

    def run(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _nearest(asked, stored, k)

    met = left.select(*columns).groupBy(*group).cogroup(right.select(*columns).groupBy(*group))
    return met.applyInPandas(run, "query_id long, vec_id long, score double").distinct()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; of ids met with several vectors the nearest counts."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    tables: int = TABLES,
    probes: int | None = None,
    seed: int = 0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each id divisible by ``every``.

    Candidates are all rows of other ids with vectors of the same length; ``score``
    is the Euclidean distance in double precision. Hashes and, unless given, ``probes``
    follow from the number of vectors of a length. A query that finds fewer than
    ``k`` is searched again through all cells of one table, that is against every row.
    Null ids, and vectors null, empty, zero or holding null or non-finite numbers
    take no part. Repeated rows count once; of different vectors with one id the
    nearest counts. An empty table gives none.
    """
    usables = settled(usable(vectors, vec_id, vector), "vectors")
    counts = settled(usables.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    rows = usables.join(counts, F.size("v") == F.col("dim")).drop("dim")
    queries = rows.where(F.col("vec_id") % every == 0)
    found = settled(_search(queries, rows, k, tables, None, probes, seed), "found")
    short = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n_found"))
    few = queries.join(short, queries["vec_id"] == short["query_id"], "left").where(F.coalesce("n_found", F.lit(0)) < k).select("vec_id", "v", "n")
    if not few.isEmpty():
        found = found.union(_search(few, rows, k, 1, 1, 1 << 31, seed))
    return _ranked(found, k)
