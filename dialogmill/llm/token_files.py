"""Token ids in bit-packed binary files with block offsets.

A shard ``part-NNNNN.tok`` holds, all little-endian:

    blocks   ids in ``bits`` bits each, lowest bit first, ``BLOCK_IDS`` ids a block;
             each block starts at a byte
    offsets  uint64, byte at which each block starts, and the end of the last
    doc ids  int64, and one byte per document: 1 if its id is null
    starts   uint64, first id of each document in the shard, and the end of the last
    footer   FOOTER: bits, ids, documents, blocks, byte of ``offsets``, magic

A block can be read and unpacked by numpy without any other. ``manifest.json``
lists the shards in document order with the ids before each.
"""

from __future__ import annotations

import functools
import json
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BLOCK_IDS = 1 << 16
FOOTER = struct.Struct("<IQQQQ8s")
MAGIC = b"TOKBITS1"
#: Words kept with their ids in a worker, so that each is tokenized once; emptied when full.
CACHE_WORDS = 1_500_000
#: Words of letters encoded as one text.
JOINED_WORDS = 2000
#: Characters of texts whose words are looked up at once.
CHUNK_CHARS = 1 << 21


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(lanes[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    lanes = np.zeros((count, 32), np.uint8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    lanes[:, :bits] = flat[: count * bits].reshape(count, bits)
    return np.packbits(lanes, axis=1, bitorder="little").view("<u4").ravel()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> tuple[Tokenizer, np.ndarray, dict[str, bytes]]:
    """The tokenizer, which of its ids end a word, and the ids of words met so far."""
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, ends, {}


def _cut_end(word: str) -> tuple[str, str]:
    """Full stops and commas behind an ASCII letter or digit, which is never in one token with them.

    Other letters are left alone: some change into several characters when the
    tokenizer folds case, and the last of those may go with the full stop.
    """
    stem = word.rstrip(".,")
    return (stem, word[len(stem) :]) if stem[-1:].isascii() and stem[-1:].isalnum() else (word, "")


def _encode_parts(parts: list[str], tokenizer: Tokenizer, ends: np.ndarray) -> list[bytes]:
    """Ids of each part. Words of ASCII letters are encoded many at once, as each ends in one id of a word's end."""
    plain = [p for p in parts if p.isascii() and p.isalpha()]
    other = [p for p in parts if not (p.isascii() and p.isalpha())]
    groups = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
    coded = tokenizer.encode_batch_fast([" ".join(g) for g in groups] + other, add_special_tokens=False)
    found = {p: array("I", c.ids).tobytes() for p, c in zip(other, coded[len(groups) :])}
    for group, code in zip(groups, coded):
        ids = np.array(code.ids, "<u4")
        cuts = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(cuts) == len(group):
            data, starts = ids.tobytes(), [0, *cuts.tolist()]
            found.update((p, data[a:b]) for p, a, b in zip(group, starts, starts[1:]))
        else:  # a vocabulary without all letters
            alone = tokenizer.encode_batch_fast(group, add_special_tokens=False)
            found.update((p, array("I", c.ids).tobytes()) for p, c in zip(group, alone))
    return [found[p] for p in parts]


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, as the tokenizer would give them, as uint32 bytes.

    For a tokenizer that drops white space and folds case, as the given one does:
    ids of a text are those of its words one after the other. A word's ids are
    looked up where the worker has met it, and so are full stops and commas behind
    it. Texts with ``<|`` may hold special tokens and are encoded whole.
    """
    tokenizer, ends, known = word_tokenizer(path)
    out: list[bytes] = []
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and chars < CHUNK_CHARS:
            chars += len(texts[stop])
            stop += 1
        some = texts[start:stop]
        special = ["<|" in text for text in some]
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if s else t for s, t in zip(special, some)], pa.large_string())))
        words = split.flatten().dictionary_encode()
        if len(known) > CACHE_WORDS:
            known.clear()
        met = words.dictionary.to_pylist()
        new = [(w, *_cut_end(w)) for w in met if w not in known]
        parts = [p for p in {p for _, a, b in new for p in (a, b)} if p not in known]
        known.update(zip(parts, _encode_parts(parts, tokenizer, ends)))
        known.update((w, known[a] + known[b]) for w, a, b in new if b)

        coded = [known[w] for w in met]
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begins = np.cumsum(sizes) - sizes
        place = words.indices.to_numpy()
        lengths = sizes[place]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        found = ids[np.repeat(begins[place] - upto[:-1], lengths) + np.arange(upto[-1])]
        cuts = upto[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for text, whole, a, b in zip(some, special, cuts, cuts[1:]):
            out.append(array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if whole else found[a:b].tobytes())
        start = stop
    return out


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard block by block; holds one block of ids at most besides the document table."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.rest, self.waiting = [], 0
        self.offsets, self.starts, self.doc_ids, self.nulls = [0], [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            ids = np.concatenate(self.rest)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(ids[at : at + BLOCK_IDS])
            self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        for table in (
            np.array(self.offsets, "<u8"),
            np.array(self.doc_ids, "<i8"),
            np.array(self.nulls, np.uint8),
            np.array(self.starts, "<u8"),
        ):
            self.sink.write(table.tobytes())
        blocks = len(self.offsets) - 1
        self.sink.write(FOOTER.pack(self.bits, self.starts[-1], len(self.doc_ids), blocks, self.offsets[-1], MAGIC))


class ShardReader:
    """Random access to one shard: any range of ids costs the blocks it touches."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.bits, self.n_ids, n_docs, n_blocks, at, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        tables = self.file.read_at(size - FOOTER.size - at, at)
        self.offsets = np.frombuffer(tables, "<u8", n_blocks + 1)
        self.doc_ids = np.frombuffer(tables, "<i8", n_docs, self.offsets.nbytes)
        self.nulls = np.frombuffer(tables, np.uint8, n_docs, self.offsets.nbytes + 8 * n_docs)
        self.starts = np.frombuffer(tables, "<u8", n_docs + 1, self.offsets.nbytes + 9 * n_docs).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, "<u4")
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        at = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - at, at)
        parts = []
        for block in range(first, last + 1):
            count = min(BLOCK_IDS, self.n_ids - block * BLOCK_IDS)
            low, high = (int(self.offsets[b]) - at for b in (block, block + 1))
            parts.append(unpack(data[low:high], self.bits, count))
        return np.concatenate(parts)[start - first * BLOCK_IDS : end - first * BLOCK_IDS]


def write_token_files(
    docs: DataFrame,
    folder: str,
    encode: Callable[[list[str]], list[bytes]],
    vocabulary: int,
    end_id: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[dict]:
    """Encode whole texts and write them in ascending ``doc_id`` order; returns the manifest.

    One shard per range of ids; null ids come first, rows of one id in the order
    of their texts, a null text is an empty one. A shard is written under a name
    of its own attempt and then moved, so a task run again replaces it by the same
    bytes. The manifest has one line per shard. An empty table gives empty shards.
    """
    bits = bits_for(vocabulary)
    last = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, base = filesystem(folder)
        name = f"{base}/part-{task.partitionId():05d}.tok"
        attempt = f"{base}/_attempt-{task.partitionId():05d}-{task.taskAttemptId()}"
        with store.open_output_stream(attempt) as sink:
            shard = ShardWriter(sink, bits)
            for batch in batches:
                for key, ids in zip(batch["key"], encode(batch["text"].tolist())):
                    shard.add(None if pd.isna(key) else int(key), np.frombuffer(ids + last, "<u4"))
            shard.close()
        store.move(attempt, name)
        yield pd.DataFrame({"shard": [task.partitionId()], "n_docs": [len(shard.doc_ids)], "n_ids": [shard.starts[-1]]})

    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
        # keys stay exact where some are null
        .select(F.col("key").cast("string").alias("key"), "text")
    )
    shards = rows.mapInPandas(write, "shard int, n_docs long, n_ids long").collect()
    manifest, before = [], 0
    for shard in sorted(shards):
        manifest.append({"shard": shard.shard, "n_docs": shard.n_docs, "n_ids": shard.n_ids, "before": before})
        before += shard.n_ids
    store, base = filesystem(folder)
    with store.open_output_stream(f"{base}/manifest.json") as sink:
        sink.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): ids as uint32 bytes, start the ids of all documents before."""
    store, base = filesystem(folder)
    with store.open_input_stream(f"{base}/manifest.json") as source:
        manifest = [m for m in json.loads(source.read()) if m["n_docs"]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(folder)
        for batch in batches:
            for number, before in zip(batch["shard"], batch["before"]):
                shard = ShardReader(store, f"{base}/part-{number:05d}.tok")
                first = 0
                while first < len(shard.doc_ids):
                    # documents that start within the next few blocks
                    end = int(np.searchsorted(shard.starts, shard.starts[first] + 4 * BLOCK_IDS))
                    end = min(max(end, first + 1), len(shard.doc_ids))
                    starts = shard.starts[first : end + 1]
                    ids = shard.ids(int(starts[0]), int(starts[-1]))
                    cuts = starts - starts[0]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(shard.doc_ids[first:end], "Int64"),
                            "missing": shard.nulls[first:end].astype(bool),
                            "start": starts[:-1] + before,
                            "n_tokens": np.diff(starts),
                            "ids": [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
                        }
                    )
                    first = end

    rows = [(m["shard"], m["before"]) for m in manifest]
    # one task per shard: adaptive execution would put rows this small into one
    shards = spark.createDataFrame(
        spark.sparkContext.parallelize(rows, max(1, len(rows))), "shard int, before long"
    )
    return shards.mapInPandas(read, "doc_id long, missing boolean, start long, n_tokens long, ids binary").select(
        F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids"
    )
