"""Byte-level BPE with a local rank file: encoding to ids and decoding to raw bytes."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts above this many characters are encoded piece by piece.
PIECE_CHARS = 1 << 16
# Fixed value: the characters that ``\s`` of the split pattern stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on never reach the pattern, which fails on those of a million.
LONG_RUN = re.compile(f"[{WHITE}]{{4096,}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about ``size`` characters that encode on their own.

    A cut lies before a blank that follows a letter or digit. No match of the
    split pattern reaches across such a place, as its matches hold blanks only
    in front, and nothing left of it looks ahead to the right of it.
    """
    pieces, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        pieces.append(text[start:cut])
        start = cut
    pieces.append(text[start:])
    return pieces


def encode_text(text: str | None, bpe: tiktoken.Encoding) -> np.ndarray:
    r"""Ids of a whole text, without special tokens; a null text has none.

    The pattern splits a run of white space by ``\s+(?!\S)``: at the end of the text it
    is one match, and before anything else all of it but its last character is one.
    Long runs are cut by that rule here. No match begins before a run and reaches
    into it, and what follows is split as if it began there.
    """
    if not text:
        return np.empty(0, "<u4")
    parts, start = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts += [bpe.encode_ordinary(piece) for piece in safe_pieces(text[start : run.start()])]
        parts.append(bpe._encode_single_piece(text[run.start() : end]))
        start = end
    parts += [bpe.encode_ordinary(piece) for piece in safe_pieces(text[start:])]
    return np.concatenate([np.array(ids, "<u4") for ids in parts])


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text as little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts give an empty value. Other columns and rows, repeated
    ones too, stay as they are; a column named ``ids`` is replaced.
    """

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        bpe = encoding(rank_file, pattern)
        return pd.Series([encode_text(t, bpe).tobytes() for t in texts], dtype=object)

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes that the ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        bpe = encoding(rank_file, pattern)
        return pd.Series(
            [None if v is None else bpe.decode_bytes(np.frombuffer(v, "<u4").tolist()) for v in values], dtype=object
        )

    return docs.withColumn(out, run(F.col(ids)))


def id_count(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
