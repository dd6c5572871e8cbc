"""Odd texts through the tokenizers, and learned quality limits against exact ones."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialogmill.llm import bpe, quality, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_of_any_characters_like_the_library():
    pieces = ["İ", "i", "̇", "a", "B", "ß", "é", "é", ".", ",", "'s", "'", "1", "2", " ", "\t", "\n", "ǅ", "Σ", "ﬁ", "中", "😀", "-", "!", "\x85", "\xa0", "‍", "\x1c", "<|", "ΑΣ", "word", "Other"]
    rng, tokenizer = random.Random(1), Tokenizer.from_file(WORDS)
    texts = ["".join(rng.choices(pieces, k=rng.randrange(25))) for _ in range(8000)] + ["DİYARBAKİ. x", "", "<|endoftext|> a."]
    got = token_files.encode_words(texts, WORDS)
    want = [c.ids for c in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_word_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 3)
    monkeypatch.setattr(token_files, "CHUNK_CHARS", 10)
    texts = ["one two, three.", "two, four", "", "five six seven eight one."]
    tokenizer = Tokenizer.from_file(WORDS)
    got = token_files.encode_words(texts, WORDS)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def library():
    return bpe.encoding(RANKS, public_tokenizers.PATTERN)


def test_white_space_is_split_as_by_the_pattern(monkeypatch, library: tiktoken.Encoding):
    import re

    monkeypatch.setattr(bpe, "LONG_RUN", re.compile(bpe.LONG_RUN.pattern.replace("4096", "3")))
    rng = random.Random(2)
    pieces = ["a", "1", " ", "  ", "\t", "\n", "\r\n", "　", "\xa0", " ", "é", ".", "'s", "\x1c", "​", "    "]
    for _ in range(8000):
        text = "".join(rng.choices(pieces, k=rng.randrange(30)))
        assert bpe.encode_text(text, library).tolist() == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\t" * 2_000_000 + "y", "　" * 2_000_000 + " z", "a" * 2_000_000, " \n" * 1_000_000 + "."])
def test_very_long_runs_encode(library, text):
    assert library.decode_bytes(bpe.encode_text(text, library).tolist()) == text.encode()


def measured(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m, _, _ in quality.MEASURES[::1] if m != "word_length") + ", word_length double")


def test_sketches_tell_quartiles_to_their_error(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.choice(["s", "t", None]), 0.0, rng.random() ** 3, 0.0, rng.expovariate(0.2)) for _ in range(3000)]
    values = measured(spark, rows)
    names = ["word_length", "copy_line_share"]
    got = {(r.grain, r.lang, r.source, r.measure): (r.n, r.q1, r.q3) for r in quality.quartiles(quality.sketches(values, names)).collect()}
    for measure, at in (("word_length", 5), ("copy_line_share", 3)):
        groups = {}
        for r in rows:
            for key in ((0, r[0], r[1]), (1, r[0], None), (2, None, None)):
                groups.setdefault(key, []).append(r[at])
        for key, xs in groups.items():
            xs.sort()
            n, q1, q3 = got[(*key, measure)]
            assert n == len(xs)
            for q, found in ((0.25, q1), (0.75, q3)):
                exact = xs[max(0, -(-int(len(xs) * q * 4) // 4) - 1)]
                assert exact / quality.GAMMA <= found <= exact * quality.GAMMA**2, (key, measure)


def test_small_groups_take_wider_limits(spark):
    rows = [("a", "big", 0.0, 0.0, 0.0, 4.0)] * 300 + [("a", "small", 0.0, 0.0, 0.0, 40.0)] * 5 + [("b", "rare", 0.0, 0.0, 0.0, 90.0)] * 5
    limits = {(r.lang, r.source): r.limits["high_word_length"] for r in quality.thresholds(measured(spark, rows)).collect()}
    assert limits["a", "big"] == limits["a", "small"] == limits["b", "rare"] < 40


def test_kept_follows_the_limits_of_the_group(spark):
    plain, odd = "some plain words of a usual length in every text here", "enormouslylongwordswithoutanyblank " * 12
    rows = [(i, plain, "en", "s") for i in range(300)] + [(1000, odd + " ".join(str(i) for i in range(40)), "en", "s"), (1001, "too few", "en", "s")]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i].kept for i in range(300))
    assert not found[1001].kept and found[1001].base_failed
    plan = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
