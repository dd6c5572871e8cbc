"""Text to token ids, and ids to fixed-length training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.operators.skew import spread_join
from dialogmill.operators.vocab import SpecialTokens, words
from dialogmill.session import settled

MAX_LENGTH = 256  # fixed value: row length of the reference set-up
IGNORE_LABEL = -100
MAX_BROADCAST_VOCAB = 500_000
HOT_WORDS = 100_000  # of a joined vocabulary, looked up in the tasks
LOOK_UP_ROWS = 1000


def _split_words(rows: DataFrame, text: str, max_tokens: int | None) -> DataFrame:
    """Add ``n_tokens`` of the whole text and ``_words``, the first ``max_tokens``.

    Two projections, so that the regular expression runs once for both columns.
    """
    split = rows.withColumn("_all", words(F.col(text)))
    kept = F.col("_all") if max_tokens is None else F.slice("_all", 1, max_tokens)
    return split.withColumns({"n_tokens": F.size("_all"), "_words": kept}).drop("_all")


def encode(
    rows: DataFrame,
    text: str,
    vocab: DataFrame,
    key: str,
    special: SpecialTokens = SpecialTokens(),
    max_tokens: int | None = None,
    max_broadcast_vocab: int = MAX_BROADCAST_VOCAB,
    keep_text: bool = True,
) -> DataFrame:
    """Add ``n_tokens`` (of the whole text) and ``ids`` by looking up each word.

    ``max_tokens`` keeps the first ids only, which is the truncation rule, and
    then only those words leave the JVM. A vocabulary of at most
    ``max_broadcast_vocab`` entries is sent to the tasks and looked up there,
    without any shuffle. Of a larger one the tasks get so many of the first ids,
    the frequent words, and the other words are joined; see ``encode_by_join``.
    The vocabulary is worked out once, into the shared folder. Without
    ``keep_text`` the text is dropped before rows are stored or shuffled.
    """
    known = settled(vocab.select("token", "token_id"), "vocab")
    if known.count() > max_broadcast_vocab:
        return _encode_joined(rows, text, known, special, max_tokens, max_broadcast_vocab, keep_text)
    look_up = _look_up(known.toArrow(), special.unk)
    return _unless(keep_text, text, _split_words(rows, text, max_tokens)).withColumn("ids", look_up("_words")).drop("_words")


def encode_by_join(
    rows: DataFrame,
    text: str,
    vocab: DataFrame,
    key: str,
    special: SpecialTokens = SpecialTokens(),
    max_tokens: int | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """The same result for a vocabulary of any size, by a join.

    Frequent words are hot join keys and most of a text, so the first ids, an
    eighth of the vocabulary and at most ``HOT_WORDS``, go to the tasks. Each row
    then asks once for each other word it has.
    """
    known = settled(vocab.select("token", "token_id"), "vocab")
    return _encode_joined(rows, text, known, special, max_tokens, min(HOT_WORDS, known.count() // 8), keep_text)


def _unless(keep: bool, column: str, rows: DataFrame) -> DataFrame:
    return rows if keep else rows.drop(column)


def _first_ids(vocab: DataFrame, entries: int) -> pa.Table:
    """At most ``entries`` of the vocabulary, which are the smallest ids where ids are dense."""
    ids = vocab.filter(F.col("token_id") >= 0)
    first = ids.agg(F.min("token_id")).first()[0] or 0
    return ids.filter(F.col("token_id") < first + entries).limit(entries).toArrow()


def _by_token(table: pa.Table) -> dict[str, int]:
    """The vocabulary as the tasks get it: made once here and unpacked once a worker, as
    an Arrow look-up would hash all of it again for every batch."""
    pairs = zip(table["token"].to_pylist(), table["token_id"].to_pylist())
    return {token: i for token, i in pairs if i is not None}


def _coded(words: pa.Array, known: dict[str, int], missing: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the place of each word among them, and their ids; each is looked up once."""
    coded = words.dictionary_encode(null_encoding="encode")
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = np.fromiter((known.get(w, missing) for w in different), np.int32, len(different))
    return coded.dictionary, coded.indices.to_numpy(), found


def _look_up(table: pa.Table, unk: int) -> Callable[..., Column]:
    known = SparkSession.active().sparkContext.broadcast(_by_token(table))

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        _, which, found = _coded(lists.flatten(), known.value, unk)
        offsets = pc.subtract(lists.offsets, lists.offsets[0])
        return type(lists).from_arrays(offsets, pa.array(found[which]), mask=lists.is_null())

    return look_up


def _look_up_first(table: pa.Table) -> Callable[..., Column]:
    """``ids``, and ``rest``, the row's words not in ``table``, once each; such a word's
    id is -1 minus its place in ``rest``. Ids in ``table`` are not negative."""
    known = SparkSession.active().sparkContext.broadcast(_by_token(table))

    @F.arrow_udf("ids array<int>, rest array<string>")
    def look_up(lists: pa.Array) -> pa.Array:
        offsets = pc.subtract(lists.offsets, lists.offsets[0])
        words, which, found = _coded(lists.flatten(), known.value, -1)
        ids = found[which]
        missing = np.flatnonzero(ids < 0)
        row = np.searchsorted(offsets.to_numpy(), missing, side="right") - 1
        different = max(1, len(words))
        asked, place = np.unique(row * different + which[missing], return_inverse=True)
        starts = np.searchsorted(asked, np.arange(len(lists) + 1) * different)
        ids[missing] = -1 - (place - starts[row])
        rest = words.take(pa.array(asked % different))
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(ids), mask=lists.is_null()),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rest),
            ],
            ["ids", "rest"],
        )

    return look_up


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets ``LOOK_UP_ROWS`` rows at a time at most, as whole texts of words are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(int(usual), LOOK_UP_ROWS) if int(usual) > 0 else LOOK_UP_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _encode_joined(
    rows: DataFrame, text: str, vocab: DataFrame, special: SpecialTokens, max_tokens: int | None, first: int, keep_text: bool
) -> DataFrame:
    """Ids of the vocabulary's first ``first`` entries looked up in the tasks, the others joined.

    Looked-up rows are written once and numbered there, so keys may repeat or be
    null, and words are split once. Only other words, once a row, meet the
    vocabulary; rows without any are not shuffled.
    """
    look_up = _look_up_first(_first_ids(vocab, first))
    split = _unless(keep_text, text, _split_words(rows, text, max_tokens)).withColumn("_found", look_up("_words"))
    with _short_batches(rows.sparkSession):
        sized = settled(
            split.withColumns({"ids": "_found.ids", "_rest": "_found.rest", "_row": F.monotonically_increasing_id()})
            .drop("_words", "_found"),
            "encoded",
        )
    asks = sized.select("_row", F.posexplode("_rest").alias("_pos", "token"))
    answer = F.struct("_pos", F.coalesce("token_id", F.lit(special.unk)).cast("int").alias("id"))
    answers = (
        spread_join(asks, vocab, "token", ["_row"])
        .groupBy("_row")
        .agg(F.transform(F.array_sort(F.collect_list(answer)), lambda a: a["id"]).alias("_answers"))
    )
    open_rows = F.size("_rest") > 0
    filled = (
        sized.filter(open_rows).drop("_rest")
        .join(answers, "_row")
        .withColumn("ids", F.transform("ids", lambda i: F.when(i >= 0, i).otherwise(F.get(F.col("_answers"), -1 - i))))
        .drop("_row", "_answers")
    )
    return sized.filter(~open_rows).drop("_row", "_rest").unionByName(filled)


def truncate(ids: Column, length: int = MAX_LENGTH) -> Column:
    return F.slice(ids, 1, length)


def pad_right(ids: Column, pad_id: int, length: int = MAX_LENGTH) -> Column:
    """Pad ids of at most ``length`` entries up to exactly ``length``."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(ids)))


def attention_mask(ids: Column, length: int = MAX_LENGTH) -> Column:
    """1 for each id of an unpadded row, 0 for the padding to come."""
    real = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def masked_labels(ids: Column, pad_id: int, length: int = MAX_LENGTH, mask_by: str = "id") -> Column:
    """Labels of an unpadded row: its ids, with padding set to -100.

    ``mask_by="id"`` masks every pad id, so when pad is the eos a true eos goes
    too; ``"position"`` masks the padding only.
    """
    if mask_by == "id":
        masked = F.transform(ids, lambda x: F.when(x == pad_id, IGNORE_LABEL).otherwise(x))
        own = F.when(F.array_contains(ids, pad_id), masked).otherwise(ids)
    elif mask_by == "position":
        own = ids
    else:
        raise ValueError(f"mask_by is 'id' or 'position', not {mask_by!r}")
    return pad_right(own, IGNORE_LABEL, length)


def fixed_length(
    rows: DataFrame,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
    mask_by: str = "id",
) -> DataFrame:
    """Replace ``ids`` by ``input_ids``, ``attention_mask`` and ``labels``, each
    ``length`` long."""
    cut = rows.withColumn("ids", truncate(F.col("ids"), length))
    ids = F.col("ids")
    return cut.withColumns(
        {
            "input_ids": pad_right(ids, special.pad_id, length),
            "attention_mask": attention_mask(ids, length),
            "labels": masked_labels(ids, special.pad_id, length, mask_by),
        }
    ).drop("ids")


def copy_labels(rows: DataFrame) -> DataFrame:
    """``labels`` as a plain copy of ``input_ids``, before any masking."""
    return rows.withColumn("labels", F.col("input_ids"))
