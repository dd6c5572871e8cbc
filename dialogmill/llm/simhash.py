"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are three segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits agree in one segment, and in the
next segment they differ in at most two. Padded to 23 bits, that next segment is
decoded by the perfect binary Golay code, with each of its bits flipped in turn
too: one codeword if it lies within two bits of one, else six. Segments that
differ in at most two bits share such a codeword, that of the word between them.
So (exact segment, codeword of the next) are at most 18 keys of 33 bits that lose
no link; pairs that share one are verified by counting differing bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import settled
from dialogmill.llm.components import components

# Generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1,
# and the (lowest bit, width) of the segments of a fingerprint.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most bits by which two linked fingerprints differ; the keys are built for it.
MAX_BITS = 2
#: Fingerprints of one key above which they are linked by their neighbouring words instead.
MAX_BUCKET = 256


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Bits set in more than half of the shingles' hashes; 0 without a word.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; repeats count.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), "<u8", len(ends))
    counts = np.zeros(64, np.int64)
    for part in np.split(hashes, range(1 << 16, len(hashes), 1 << 16)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle_words: int = 3, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the 64-bit fingerprint of each whole text as a signed long; null texts count as empty."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, run(F.col(text)))


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit head after division by the code, and the error for each remainder."""
    heads = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        heads = np.where((heads >> bit) & 1, heads ^ (GOLAY << (bit - 11)), heads)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            errors[(heads[error >> 11] ^ error) & 2047] = error
    return heads, errors


def codewords(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword within three bits of each 23-bit word."""
    heads, errors = golay_tables()
    return (words ^ errors[(heads[words >> 11] ^ words) & 2047]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of every fingerprint, each once."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    marks = fingerprints.view(np.uint64)
    parts = [((marks >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    positions, keys = [], []
    for number, part in enumerate(parts):
        near = np.sort(codewords(parts[(number + 1) % 3][:, None] ^ flips), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        rows, columns = np.nonzero(first)
        positions.append(rows)
        keys.append(number << 40 | part[rows] << 12 | near[rows, columns])
    return np.concatenate(positions), np.concatenate(keys)


def links(fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Edges (u, v) between different fingerprints with at most two differing bits.

    ``fingerprints`` holds distinct longs. Pairs that share a key are joined and
    verified in one step. The fingerprints of a key with over ``MAX_BUCKET`` of them
    are not paired: each is put beside the 64 words one bit away and itself, and
    whatever meets at such a word, 65 at most, differs in two bits at most. Linking
    it to the least there keeps all of them connected, so components are the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = batch["f"].to_numpy(np.int64)
            for part in np.split(marks, range(1 << 13, len(marks), 1 << 13)):
                at, keys = fuzzy_keys(np.ascontiguousarray(part))
                yield pd.DataFrame({"key": keys, "f": part[at]})

    keyed = settled(fingerprints.select(F.col(column).alias("f")).mapInPandas(run, "key long, f long"), "keys")
    # a key of one fingerprint has no pair: with it go most rows before the join
    sizes = settled(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    some = keyed.join(sizes.where(F.col("n") <= MAX_BUCKET).select("key"), "key")
    u, v = some.select("key", F.col("f").alias("u")), some.select("key", F.col("f").alias("v"))
    pairs = u.join(v, "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
    many = keyed.join(sizes.where(F.col("n") > MAX_BUCKET).select("key"), "key", "left_semi").select("f").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    around = many.withColumn("flip", F.explode(flips)).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("word"))
    least = around.groupBy("word").agg(F.min("f").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(least, "word").where("f <> v").select(F.col("f").alias("u"), "v")
    return pairs.select("u", "v").union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    ``component_id`` is the least doc_id that can be reached by links, itself
    included. Copies are one fingerprint. Null and empty texts, and texts of white
    space, have fingerprint 0, which is linked like any other. Repeated rows give
    repeated rows; a null doc_id has a row and is never the least, so a component
    of null ids alone has a null id. An empty table gives an empty result.
    """
    marked = settled(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle_words).drop("text"), "fingerprints")
    groups = settled(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(links(groups))
    placed = groups.join(roots, groups["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) without all but one document of each component.

    The one with the least doc_id stays. Rows of one doc_id and one text are one
    document and stay together; rows without a doc_id in a component with ids go.
    """
    found = near_duplicates(docs, shingle_words)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
