"""Chat formatting, the prefix trie and vector codes against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogmill.llm import chat_format, prefix_trie, vector_codes

TURNS = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "\\s", "\\h", "\\t", "\\c", "#", "###", "### assistant: ", "</turn>", "</turn>\n", "</tur", "n>", "\n", ":", ": ", "a", "é😀", " "]


def odd_turns(rng, conversations, most):
    for conv in range(conversations):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "assistant", "a: b", "#", "", "\\c"])
            yield conv, turn, role, "".join(rng.choices(PIECES, k=rng.randrange(6)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("turns_per_part", [1024, 3])  # the second writes nearly all in parts
def test_formatted_turns_read_back(spark, turns_per_part):
    rng = random.Random(turns_per_part)
    rows = [*odd_turns(rng, 40, 14), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (99, None, None, None), (99, -5, "assistant", "n"), (98, 0, "assistant", "t")]
    rows += [(98, 0, "assistant", "t")] * 5
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS + ", part string, n int")
    parts = chat_format.format_turns(frame, turns_per_part=turns_per_part)
    assert (parts.where("part > 0").count() > 0) == (turns_per_part == 3)
    found = {r.conv_id: r for r in chat_format.digests(parts).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns))), turns
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), turns
    whole = defaultdict(str)
    for r in parts.orderBy("conv_id", "part").collect():
        whole[r.conv_id] += r.formatted
    for conv, text in whole.items():
        turns = sorted(by_conv[conv])
        blocks = sum(i == 0 or turns[i][2] != turns[i - 1][2] for i in range(len(turns)))
        assert text.count("###") == blocks and text.count("</turn>") == len(turns)
        assert found[conv].formatted_chars == len(text)


def test_formatting_of_no_turns_and_long_texts(spark):
    long = "### x </turn> \\" * 20_000
    rows = spark.createDataFrame([(1, 0, "assistant", long)], TURNS)
    found = chat_format.digests(chat_format.format_turns(rows)).collect()
    assert (found[0].loss_chars, found[0].loss_sha256) == (len(long), sha(long))
    assert chat_format.digests(chat_format.format_turns(rows.limit(0))).count() == 0


def test_chat_formatting_stays_in_the_jvm(spark):
    parts = chat_format.digests(chat_format.format_turns(spark.createDataFrame([(1, 0, "user", "x")], TURNS)))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Nested"))


def trie(rebuilt):
    """Nodes by brute force from {conv_id: [(role, text), ...]}."""
    nodes = defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    inner = {node[:-1] for node in nodes if node}
    want = {}
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(node))
        want[min(members), len(node)] = (
            min(nodes[node[:-1]]) if node else None, len(members), sum(n[:-1] == node for n in nodes if n),
            sum(n not in inner for n in below), saved, sha(ends),
        )
    return want


@pytest.mark.parametrize("ends_per_row", [1 << 16, 7])
def test_trie_against_all_prefixes(spark, monkeypatch, ends_per_row):
    monkeypatch.setattr(prefix_trie, "ENDS_PER_ROW", ends_per_row)
    rng = random.Random(ends_per_row)
    rows = []
    for conv in [*range(60), -1, -40, 10_000_000_019, 233]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["one", "two words", " \t", None])))
    rows += [(100, 0, "user", "one"), (100, None, None, "first of all"), (None, 0, "user", "no conversation")]
    rows += [(120 + i, 0, "user", "the same in many") for i in range(40)]
    rows += [(501 + i, 0, "user", "its group has no first one") for i in range(9)]
    frame = spark.createDataFrame([(*r, "n") for r in rows], TURNS + ", node string")
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in by_conv.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    assert not all(rebuilt.values())  # some have no turn left
    found = prefix_trie.build(prefix_trie.shared_starts(prefix_trie.ordered_turns(frame))).collect()
    want = trie(rebuilt)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(found) == len(got) and got == want
    none = prefix_trie.build(prefix_trie.shared_starts(prefix_trie.ordered_turns(frame.limit(0))))
    assert none.count() == 0


def test_trie_of_a_long_conversation_and_repeated_rows(spark):
    rows = [(20, i, "user", f"word {i}") for i in range(3000)] + [(40, 1, "user", "x"), (40, 1, "user", "x")]
    found = prefix_trie.build(prefix_trie.ordered_turns(spark.createDataFrame(rows, TURNS))).collect()
    depths = defaultdict(int)
    for r in found:
        depths[r.conv_id] = max(depths[r.conv_id], r.depth)
    assert depths == {20: 3000, 40: 2} and len(found) == 1 + 3000 + 2


@pytest.mark.parametrize("most", [10, 1 << 23, 1 << 28, 1 << 45])
def test_dot_products_and_nearest_are_exact(most):
    rng = np.random.default_rng(most)
    x, book = (rng.integers(-most, most + 1, (n, 16)) for n in (50, 20))
    book[7] = book[3]  # a tie
    if most <= 1 << 28:
        assert (vector_codes.dot(x, book) == x.astype(object) @ book.astype(object).T).all()
    far = [[sum((int(p) - int(q)) ** 2 for p, q in zip(row, entry)) for entry in book] for row in x]
    best, apart = vector_codes.nearest(x, book)
    assert best.tolist() == [min(range(20), key=row.__getitem__) for row in far]
    assert [int(a) for a in apart] == [min(row) for row in far]


def plain_codes(rows, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1])
    cuts = [(k * width // 4, (k + 1) * width // 4) for k in range(4)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cuts]

    def assign(part, book):
        far = [sum((p - q) ** 2 for p, q in zip(part, entry)) for entry in book]
        return min(range(len(book)), key=far.__getitem__), min(far)

    for _ in range(rounds):
        for book, (a, b) in zip(books, cuts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[assign(v[a:b], book)[0]].append(v[a:b])
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members)]
    found = []
    for i, v, label in kept:
        pairs = [assign(v[a:b], book) for book, (a, b) in zip(books, cuts)]
        found.append((i, "".join(f"{k:02x}" for k, _ in pairs), sum(e for _, e in pairs), label))
    told = ",".join(str(x) for book in books for entry in book for x in entry)
    sums = defaultdict(int)
    for _, _, error, label in found:
        sums[label] += min(error, 2**63 - 1)
    most = 2**63 - 1  # an error past the largest long is given as that
    return sorted(((i, c, min(e, most), min(sums[label], most), sha(told)) for i, c, e, label in found), key=repr)


@pytest.mark.parametrize("kind,scale,width", [("float", 1.0, 8), ("double", 2.0**15, 8), ("double", 3.0, 10), ("double", 2.0**40, 4)])
def test_codes_against_plain_python(spark, monkeypatch, kind, scale, width):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rng = np.random.default_rng(width)
    rows = []
    for i in range(150):
        v = [float(np.float32(x)) for x in rng.normal(0, scale, width)]
        rows.append((i if i % 50 else None, v, [None, 1, 2][i % 3]))
    rows += [rows[5], rows[5], (7, [0.0] * width, 1)]
    odd = [(-3, None, 1), (-2, [None] + [1.0] * (width - 1), 1), (-1, [float("nan")] * width, 1), (-4, [float("-inf")] * width, 1), (-5, [1e300 if kind == "double" else 1e38] * width, 2), (9_000, [1.0], 1)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows + odd], f"vec_id long, embedding array<{kind}>, label int, code string, part int")
    found = vector_codes.compress(frame.repartition(3), entries=12, rounds=3).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_codes(rows, 12, 3)
    assert vector_codes.compress(frame.limit(0)).count() == 0
    assert vector_codes.compress(frame.where(F.col("vec_id") < 0)).count() == 0
