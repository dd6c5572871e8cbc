"""Operators with exact results against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialogmill.llm import line_dedup, mixing, queries, quality, simhash, token_files
from dialogmill.llm.bpe import safe_pieces

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(rng, line, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(line)), rng.randrange(3)
        line = line[:at] + rng.choice(["", "xy"[rng.randrange(2)], line[at] + "z"])[: kind + 1] + line[at + 1 :]
    return line


def make_lines(rng, stems, each):
    lines = []
    for _ in range(stems):
        stem = "".join(rng.choice("abcdef gé😀") for _ in range(rng.randrange(40, 60)))
        lines += [edited(rng, stem, rng.randrange(4)) for _ in range(each)]
    return lines


# the second and third fill segments over MAX_BUCKET, the last one with blocks of few lines
@pytest.mark.parametrize("stems,each,mask", [(12, 6, 62), (1, 90, 62), (3, 40, 5)])
def test_line_dedup_against_all_pairs(spark, monkeypatch, stems, each, mask):
    monkeypatch.setattr(line_dedup, "MASK", mask)
    rng = random.Random(stems)
    lines = make_lines(rng, stems, each) + ["short", "short", "", "", " \t", "shore", "once"]
    rng.shuffle(lines)
    docs = [(i // 3, lines[i : i + 3]) for i in range(0, len(lines), 3)]
    docs = [(i, "\n".join(part)) for i, (_, part) in enumerate(docs)]
    found = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()

    places = [((d, n), line) for d, text in docs for n, line in enumerate(text.split("\n"))]
    long = sorted({line for _, line in places if len(line) >= line_dedup.MIN_CHARS})
    linked = [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    root, degree = roots(long, linked), defaultdict(int)
    # shorter ones are compared for equality, blank ones not at all
    root |= {line: line for _, line in places if len(line) < line_dedup.MIN_CHARS and line.strip()}
    for pair in linked:
        for line in pair:
            degree[line] += 1
    head = {}
    for place, line in sorted(places):
        head.setdefault(root.get(line, place), place)
    want = {p: (*head[root.get(line, p)], degree[line], head[root.get(line, p)] == p) for p, line in places}
    assert linked
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in found} == want


def test_many_near_copies_make_few_rows(spark):
    """600 different lines within two edits of one: classes and numbers of links are exact."""
    rng, stem = random.Random(8), "a line of some sixty letters and blanks that many texts share"
    lines = set()
    while len(lines) < 600:
        at = rng.sample(range(len(stem)), 2)
        lines.add("".join(rng.choice("xyz") if i in at[: rng.randrange(1, 3)] else c for i, c in enumerate(stem)))
    lines = sorted(lines)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    found = line_dedup.near_lines(docs).collect()

    # of one length: two letters differ at most, or one goes and another comes, and what lies between is shifted
    def near(a, b):
        at = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        i, j = at[0], at[-1]
        return len(at) <= 2 or a[i + 1 : j + 1] == b[i:j] or a[i:j] == b[i + 1 : j + 1]

    linked = [(a, b) for a in range(600) for b in range(a) if near(lines[a], lines[b])]
    root, degree = roots(range(600), linked), defaultdict(int)
    for pair in linked:
        for i in pair:
            degree[i] += 1
    assert {r.doc_id: (r.class_doc_id, r.n_links) for r in found} == {i: (root[i], degree[i]) for i in range(600)}
    assert len(linked) > 10_000


def test_edit_band_against_the_full_matrix(spark):
    rng, rows = random.Random(3), []
    while len(rows) < 300:
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 12)))
        b = edited(rng, a, rng.randrange(4))
        if abs(len(a) - len(b)) <= 2:
            rows.append((a, b))
    found = spark.createDataFrame(rows, "a string, b string").withColumn("near", line_dedup.within_edits("a", "b")).collect()
    assert [r.near for r in found] == [distance(r.a, r.b) <= 2 for r in found]


def test_dropped_lines_leave_the_text(spark):
    line = "a line of more than forty characters that repeats"
    docs = spark.createDataFrame(
        [(1, f"{line}\nown", 0), (2, f"x\n{line}!\ny", 0), (3, line, 0), (4, None, 0), (5, "", 0)], "doc_id long, text string, n_chars long"
    )
    found = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_near_lines(docs).collect()}
    assert found == {1: (f"{line}\nown", len(line) + 4), 2: ("x\ny", 3), 4: (None, None), 5: ("", 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, 2**bits - 1), max_size=300))))
def test_packed_bits_round_trip(case):
    bits, ids = case
    data = token_files.pack(np.array(ids, dtype=np.uint32), bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert token_files.unpack(data, bits, len(ids)).tolist() == ids


def test_token_files_query_against_the_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for doc_id, text in sorted(documents(spark)):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    found = queries.op2_token_files(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want)


def test_bpe_query_against_the_library(spark):
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc_id, text in documents(spark):
        ids = bpe.encode_ordinary(text)
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    found = queries.op9_bpe(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want and len(found) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t'.é😀", max_size=200))
def test_pieces_are_the_text_and_split_no_match(text):
    import regex

    pieces = safe_pieces(text, 8)
    assert "".join(pieces) == text
    cut = [m for p in pieces for m in regex.findall(public_tokenizers.PATTERN, p)]
    assert cut == regex.findall(public_tokenizers.PATTERN, text)


def plain_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_against_all_pairs(spark):
    prints = {d: plain_fingerprint(t) for d, t in documents(spark)}
    ids = sorted(prints)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    found = queries.op8_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{prints[d]:016x}", root[d]) for d in ids}


@pytest.mark.parametrize("bucket", [256, 3])  # the second takes the way of crowded keys
def test_golay_keys_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "MAX_BUCKET", bucket)
    rng, prints = random.Random(5), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(8)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in edges)
    assert roots(signed, [(r.u, r.v) for r in edges]) == roots(signed, near)


def test_quality_counts_against_plain_python(spark):
    texts = documents(spark) + [(-1, "a b c d e f\na b c d e f\n\n x\n x\n#* <|>"), (-2, "é " * 30)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(d, t, "en", "s") for d, t in texts], "doc_id long, text string, lang string, source string")).collect()}
    for doc_id, text in texts:
        words, seen, again = WORDS.findall(text), set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                again += line in seen
                seen.add(line)
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        r = found[doc_id]
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed,
        ), doc_id
        assert not (failed and r.kept)


def test_mix_meets_its_targets(spark):
    rows = queries.op3_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect():
        assert abs(r.taken - r.target) <= r.most and r.copies <= 2


def test_mix_gives_documents_of_a_source_their_own_chances(spark):
    rows = [(i, " ".join(["w"] * (1 + 37 * i % 1500)), "ab"[i % 4 == 0]) for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in mixed if r.source == source and r.chance is not None]
        total, target = sum(r.size for r in own), own[0].target
        rest = target - int(target / total) * total
        # expected words are the target, longer documents are likelier, and both kinds are taken
        assert 0 < rest < total and math.isclose(sum(r.chance * r.size for r in own), rest, rel_tol=1e-9)
        by_size = sorted(own, key=lambda r: r.size)
        assert all(a.chance <= b.chance for a, b in zip(by_size, by_size[1:])) and by_size[0].chance < by_size[-1].chance
        taken = lambda some: sum(r.copies - int(target / total) for r in some) / len(some)
        half = len(own) // 2
        for some in (by_size[:half], by_size[half:]):
            assert abs(taken(some) - sum(r.chance for r in some) / len(some)) < 0.05
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
