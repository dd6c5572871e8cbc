import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialogmill.operators.tokens import (
    attention_mask,
    copy_labels,
    encode,
    encode_by_join,
    fixed_length,
    masked_labels,
    pad_right,
    truncate,
)
from dialogmill.operators.vocab import SpecialTokens, learn_vocab, vocab_size

TEXTS = ["the cat, the dog", "a cat 42 cats.", "", None, "the the the the the", "zebra ?"]
WORD = re.compile(r"[^\W\d_]+|\d+|[^\s\w]")


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS)], "row_key string, text string")


def expected_vocab(k):
    counts = Counter(w for t in TEXTS if t for w in WORD.findall(t))
    ranked = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:k]
    return {w: (i + 3, n) for i, (w, n) in enumerate(ranked)}


def test_vocab_is_the_top_k(spark, corpus):
    vocab = learn_vocab(corpus, "text", 5)
    assert {r.token: (r.token_id, r.n) for r in vocab.collect()} == expected_vocab(5)
    assert vocab_size(vocab).first()[0] == 8


@pytest.mark.parametrize("max_tokens", [None, 2])
def test_both_encoders_agree_with_a_plain_loop(spark, corpus, max_tokens):
    vocab = learn_vocab(corpus, "text", 5)
    ids = {w: i for w, (i, _) in expected_vocab(5).items()}
    want = {
        f"k{i}": (-1 if t is None else len(WORD.findall(t)),
                  None if t is None else [ids.get(w, 0) for w in WORD.findall(t)][:max_tokens])
        for i, t in enumerate(TEXTS)
    }
    for rows in (
        encode(corpus, "text", vocab, "row_key", max_tokens=max_tokens),
        encode(corpus, "text", vocab, "row_key", max_tokens=max_tokens, max_broadcast_vocab=2),
        encode_by_join(corpus, "text", vocab, "row_key", max_tokens=max_tokens),
    ):
        got = {r.row_key: (-1 if r.n_tokens is None else r.n_tokens, r.ids) for r in rows.collect()}
        assert got == want


def test_both_encoders_agree_on_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([("k", "a b"), ("k", "c"), (None, "b a"), (None, None), ("k", "c"), ("z", "")], "row_key string, text string")
    vocab = learn_vocab(rows, "text")
    # each of a, b, c twice: equal counts, so in the tokens' order
    assert [(r.token_id, r.n) for r in vocab.orderBy("token").collect()] == [(3, 2), (4, 2), (5, 2)]
    got = [
        sorted(map(repr, (tuple(r) for r in out.select("row_key", "text", "n_tokens", "ids").collect())))
        for out in (encode(rows, "text", vocab, "row_key"), encode_by_join(rows, "text", vocab, "row_key"))
    ]
    assert got[0] == got[1] and len(got[0]) == 6


def test_rows_have_one_length(spark):
    special = SpecialTokens()
    lists = [[], [5], [5, special.eos, 7], [4] * 8, list(range(3, 20))]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, ids array<int>")
    for mask_by in ("id", "position"):
        out = fixed_length(rows, special, 8, mask_by).orderBy("i").collect()
        for r, ids in zip(out, lists):
            cut = ids[:8]
            pad = 8 - len(cut)
            assert r.input_ids == cut + [special.pad_id] * pad
            assert r.attention_mask == [1] * len(cut) + [0] * pad
            own = [-100 if mask_by == "id" and x == special.pad_id else x for x in cut]
            assert r.labels == own + [-100] * pad
    with pytest.raises(ValueError):
        masked_labels(F.col("ids"), 2, 8, "other")
    padded = rows.select(pad_right(truncate(F.col("ids"), 8), 0, 8).alias("input_ids"))
    assert all(r.labels == r.input_ids for r in copy_labels(padded).collect())
    assert [sum(r[0]) for r in rows.orderBy("i").select(attention_mask(F.col("ids"), 8)).collect()] == [0, 1, 3, 8, 8]
