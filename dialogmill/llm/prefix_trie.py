"""Conversation prefix trie by whole-sequence collapse.

Identical conversations are one weighted sequence with a list of the conversations
that end there. Sequences that are proper prefixes of others are dropped by an anti-join,
which leaves the leaves; prefixes of the weighted sequences are then added up into
nodes. A turn is carried as a digest and a word count, and a prefix as the digest of
the prefix before it and its last turn, so no text is gathered or shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import WORD, settled

#: Conversation ids in a row of an end list, at most.
ENDS_PER_ROW = 1 << 16
ROOT = hashlib.md5(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a turn; nulls are empty strings."""
    both = F.concat(F.md5(F.coalesce(role, F.lit("")).cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.unhex(F.md5(both.cast("binary")))


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turns): an array of (digest, words), by turn (null first), turns of one number by digest.

    Rows without ``conv_id`` are left out. Some 40 bytes a turn are gathered.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), words.alias("words")).alias("t")
    )
    gathered = narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def shared_starts(ordered: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the start of the first of their group of ``group`` ids.

    Conversation c takes the first h turns of conversation c - c % group, of which
    there may be fewer or none, and then its own after its first h; h is the crc32
    of c in decimal, modulo ``most``. All conversations stay, some without a turn.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = ordered.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    own = ordered.select("conv_id", "turns", (c - c % group).alias("base"), h.alias("h"))
    start = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(start, rest).alias("turns"))


def _with_prefixes(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, prefixes, below): digests of all prefixes, the empty one first, and the words from each one's last turn on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prefixes, below = [], []
            for turns in batch["turns"]:
                now, chain = ROOT, [ROOT]
                for t in turns:
                    now = hashlib.md5(now + t["digest"]).digest()
                    chain.append(now)
                prefixes.append(chain)
                words = [0, *(t["words"] for t in turns)]
                below.append([*accumulate(reversed(words))][::-1])
            yield pd.DataFrame({"conv_id": batch["conv_id"], "prefixes": prefixes, "below": below})

    return rows.mapInPandas(run, "conv_id long, prefixes array<binary>, below array<long>")


def collapse(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences and their end lists, both written, from rows (conv_id, turns).

    Sequences: (seq, conv_id, weight, prefixes, below), with the least id and the
    number of the conversations that are this sequence. End lists: (seq, chunk,
    ids), ids ascending within a chunk and chunks ascending, so that a sequence
    which a third of all conversations share is many rows.
    """
    rows = settled(_with_prefixes(conversations).select("conv_id", F.element_at("prefixes", -1).alias("seq"), "prefixes", "below"), "prefixes")
    # weights first, from two narrow columns, combined before the shuffle
    weights = rows.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    sequences = rows.select("conv_id", "prefixes", "below").join(weights, "conv_id").select("seq", "conv_id", "weight", "prefixes", "below")
    chunk = F.floor(F.col("conv_id") / ENDS_PER_ROW)
    ends = rows.groupBy("seq", chunk.alias("chunk")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    return settled(sequences, "sequences"), settled(ends, "ends")


def leaves(sequences: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another one."""
    proper = sequences.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("seq")).distinct()
    return sequences.join(proper, "seq", "left_anti")


def nodes(sequences: DataFrame) -> DataFrame:
    """Rows (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens).

    One row per different prefix of the weighted sequences. ``saved_tokens`` adds,
    over a node's subtree, the words of a node's last turn times its conversations
    but one. That is the words of all conversations below, less those of each node
    once; a node counts once where the sequence of its least conversation owns it,
    and the nodes that a sequence owns are its last ones.
    """
    first = leaves(sequences).select("seq", F.lit(1).alias("leaf"))
    marked = sequences.join(first, "seq", "left")
    steps = marked.select(
        "conv_id", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.lit(None).cast("binary").alias("none"),
        F.posexplode(F.arrays_zip(F.col("prefixes").alias("node"), F.col("below").alias("below"), F.concat(F.array(F.lit(None).cast("binary")), F.col("prefixes")).alias("parent"))).alias("depth", "p"),
    ).where("p.node IS NOT NULL")
    found = settled(
        steps.groupBy(F.col("p.node").alias("node")).agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.min("p.parent").alias("parent"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("p.below")).alias("all_words"),
        ),
        "nodes",
    )
    owned = found.groupBy("conv_id").agg(F.min("depth").alias("owned"))
    own_words = F.transform("below", lambda _, d: F.get("below", F.greatest(d, F.col("owned"))))
    own = sequences.join(owned, "conv_id").select(F.explode(F.arrays_zip(F.col("prefixes").alias("node"), own_words.alias("once"))).alias("p"))
    once = own.groupBy(F.col("p.node").alias("node")).agg(F.sum("p.once").alias("once"))
    children = found.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = settled(
        found.join(once, "node").join(children, "node", "left").select(
            "node", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("all_words") - F.col("once")).alias("saved_tokens")
        ),
        "counted",
    )
    # a node may have a third of all as its children: the last join, which Spark may split
    parents = counted.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return counted.join(parents, "parent", "left").select("node", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256): the digest of each sequence's ids in decimal, ascending, joined by commas.

    Rows of a list follow each other in a task, which holds one of them at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, digest = None, None
        for batch in batches:
            done = []
            for now, ids in zip(batch["seq"], batch["ids"]):
                if now != seq:
                    if seq is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids)).encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if seq is not None:
            yield pd.DataFrame([(seq, digest.hexdigest())], columns=["node", "ends_sha256"])

    return ends.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "ids").mapInPandas(run, "node binary, ends_sha256 string")


def build(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    ``conversations`` has (conv_id, turns), one row each, as from ``ordered_turns``.
    A node is named by its least conversation and its depth. The root is there if
    there is a conversation; an empty table gives none. Null and empty turn texts
    have no words. Conversations without a turn are members of the root only.
    """
    sequences, ends = collapse(conversations)
    none = hashlib.sha256(b"").hexdigest()
    return nodes(sequences).join(end_digests(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
