"""Learned and searched operators, edge cases of all, and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from dialogmill.llm import bpe, langid, line_dedup, lm_score, mixing, neighbours, quality, queries, simhash, token_files, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, hash string, row string, "
    "size long, n long, u long, v long, word string, score double, measures string, line string, gone string, ids string"
)
LONG = "a word and another one. " * 20_000


def edge_rows():
    rows = [
        (0, None, None, None), (None, "a text without an id, of some more words than ten in all of it", "en", "s"),
        (2, "", "en", "s"), (3, " \t\n", "xx", ""), (4, LONG, "en", "s"), (5, "1 2 3 !", None, "s"),
        (6, "same text, same id, twice over here and there", "en", "s"), (6, "same text, same id, twice over here and there", "en", "s"),
        (7, "same text, same id, twice over here and there", "fr", None), (8, "é" * 3000, "fr", "s"),
    ]
    return [(*r, 0, 1, "k", "h", "r", 9, 9, 1, 2, "w", 0.5, "m", "l", "g", "i") for r in rows]


OPERATORS = {
    "mix": lambda docs: mixing.mix(docs),
    "toxicity": lambda docs: toxicity.judge(docs, docs.sparkSession.createDataFrame([(2, 1), (4, 0), (6, None), (99, 1)], "doc_id long, toxic int")),
    "quality": lambda docs: quality.judge(docs),
    "lm": lambda docs: lm_score.judge(docs, classes=20),
    "simhash": lambda docs: simhash.near_duplicates(docs, 3),
    "langid": lambda docs: langid.identify(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_whatever_it_holds(spark, name):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    rows = OPERATORS[name](docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name == "langid":
        assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {0, 2, 3, 5}
    if name == "simhash":
        assert {r.doc_id: r.component_id for r in rows if r.doc_id in (0, 2, 3, 6, 7)} == {0: 0, 2: 0, 3: 0, 6: 6, 7: 6}
    if name == "lm":
        assert all(r.n_tokens == 1 for r in rows if r.doc_id in (0, 2, 3))


def test_files_lines_and_bytes_of_edge_rows(spark, tmp_path):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    lines = line_dedup.near_lines(docs).collect()
    assert len(lines) == sum(len(r[1].split("\n")) for r in edge_rows() if r[1] is not None)
    kept = line_dedup.drop_near_lines(docs)
    assert kept.columns == docs.columns
    # the row without its line left is the copy under another id
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, None, 2, 3, 4, 5, 6, 6, 8])
    for at, rows in (("full", docs), ("none", docs.limit(0))):
        encode = lambda texts: [np.frombuffer((t or "").encode()[:50], np.uint8).astype("<u4").tobytes() for t in texts]
        token_files.write_token_files(rows, str(tmp_path / at), encode, 256, end_id=1)
        found = token_files.read_token_files(spark, str(tmp_path / at)).orderBy("start").collect()
        assert [r.doc_id for r in found] == ([None, 0, 2, 3, 4, 5, 6, 6, 7, 8] if at == "full" else [])
        assert all(len(r.ids) == 4 * r.n_tokens for r in found)
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", "ids"), ranks, pattern), ranks, pattern).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == 10
    assert line_dedup.near_lines(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0), 3).count() == 0


def test_neighbours_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows if r.embedding is not None}
    vectors = {i: v for i, v in vectors.items() if v.size and np.isfinite(v).all() and v.any()}
    found, hits, wanted = queries.op5_neighbours(spark, SF).collect(), 0, 0
    for q in (i for i in vectors if i % 100 == 0):
        exact = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(math.isclose(r.score, np.linalg.norm(vectors[r.vec_id] - vectors[q]), rel_tol=1e-12) for r in mine)
        hits, wanted = hits + len({i for _, i in exact} & {r.vec_id for r in mine}), wanted + 10
    assert wanted and hits >= 0.9 * wanted


def test_neighbours_of_joined_hashes(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(9000, 32)), np.repeat(rng.normal(size=(1, 32)), 3000, axis=0)])
    assert neighbours.hashes_for(len(x), 64) == 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(rows, every=400).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert sorted(found) == list(range(0, 12000, 400)) and all(len(f) == 10 and f == sorted(f) for f in found.values())
    hits = 0
    for q, mine in found.items():
        apart = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(len(x)), apart)) if i != q][:10]
        hits += len(set(best) & {i for _, i in mine})
    assert hits >= 0.9 * 10 * len(found)


def test_probed_cells_are_the_nearest():
    x = np.random.default_rng(3).normal(size=(20, 5))
    for hashes in (1, 2, 3):
        every = neighbours.cells(x, 0, hashes, 16**hashes)
        assert all(sorted(row) == list(range(16**hashes)) for row in every.tolist())
        own, some = neighbours.cells(x, 0, hashes, 1), neighbours.cells(x, 0, hashes, 9)
        for row, cell, near in zip(x, own[:, 0], some):
            gaps = []
            for turn in range(hashes):
                turned = neighbours.rotate(row[None], neighbours.TABLES * turn)[0]
                both = np.concatenate([turned, -turned])
                gaps.append((both.max() - both) ** 2)
            cost = lambda c: sum(gaps[t][c // 16 ** (hashes - 1 - t) % 16] for t in range(hashes))  # noqa: E731, B023
            assert cost(int(cell)) == 0
            assert math.isclose(max(cost(int(c)) for c in near), sorted(cost(c) for c in range(16**hashes))[8], abs_tol=1e-12)


def test_neighbours_of_odd_vectors(spark):
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [None, 1.0]),
           (None, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(rows).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.nearest(rows.limit(0)).count() == 0


def test_lm_base_against_plain_python(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = {d: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + ["\n"] for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    found = queries.op7_lm_score(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ws = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_lm_scores_against_a_plain_softmax(spark):
    raw = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    docs = spark.createDataFrame([*raw, (1000, None), (1001, "NeverSeenBefore " * 3)], "doc_id long, text string").coalesce(1)
    learned = docs.where(lm_score.fold("doc_id", 10) != 0)
    classes = 50
    lex = lm_score.lexicon(lm_score.count_words(learned))
    model = lm_score.train(learned, lex, classes)
    place = {w: i for i, w in enumerate(lex.words)}
    counts = dict(zip(lex.words, lex.counts.tolist()))
    # smoothed counts of the words that share the other class, one for all unseen ones
    spread = sum(n + 0.1 for w, n in counts.items() if place[w] >= classes) + 0.1
    for r in lm_score.judge(docs, classes).collect():
        text = next(t for d, t in [*raw, (1000, None), (1001, "NeverSeenBefore " * 3)] if d == r.doc_id)
        words = lm_score.words_of(text)
        ids = [classes + 2] * 2 + [min(place.get(w, classes), classes) for w in words] + [classes + 1]
        want = 0.0
        for i in range(2, len(ids)):
            vector = model.context[ids[i - 2]] * model.place[0] + model.context[ids[i - 1]] * model.place[1]
            logits = (model.target @ vector + model.bias[:, 0]).astype(float)
            chances = np.exp(logits - logits.max())
            want += math.log10(chances[ids[i]] / chances.sum())
        want += sum(math.log10((counts.get(w, 0) + 0.1) / spread) for w in words if place.get(w, classes) >= classes)
        assert math.isclose(r.score, want, rel_tol=1e-4), (r.doc_id, r.score, want)


def test_lm_probabilities_of_every_context_add_up():
    shares = np.array([0.4, 0.3, 0.2, 0.1])
    model = lm_score.LogBilinear(shares, seed=3)
    model.learn(np.array([4, 0, 1, 2]), np.array([0, 1, 2, 0]), np.array([1, 2, 0, 3]), 0.5)
    early, late, sums = model.tables()
    every = np.exp(early[:, None, :] + late[None, :, :] - sums[:, :, None]).sum(axis=2)
    assert every.shape == (5, 5) and np.allclose(every, 1, atol=1e-5)


def test_lm_class_rows_of_long_texts_join_up(spark):
    texts = ["a b c a b c a zz", "", None, "a a a", "a b c"]
    docs = spark.createDataFrame([(0, t) for t in texts], "round int, text string").coalesce(1)
    rows = [np.frombuffer(bytes(r.ids), "<i4").tolist() for r in lm_score.class_ids(docs, [b"a", b"b", b"c"], 5, piece=4).collect()]
    assert rows == [[5, 5, 0, 1, 2, 0], [2, 0, 1, 2, 0, 3], [0, 3, 4], [5, 5, 4], [5, 5, 4], [5, 5, 0, 0, 0, 4], [5, 5, 0, 1, 2, 4]]


def test_lm_context_tells_more_than_counts_on_held_out_texts(spark):
    for sf, least in (("0.001", 0.03), ("0.01", 0.05)):
        held = queries.op7_lm_score(spark, f"/root/testdata/sf{sf}").where("held_out").collect()
        gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
        assert held and gain > least


def test_languages_and_toxic_texts_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = queries.op10_langid(spark, sf).join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in named) >= 0.95 * len(named) > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    judged = queries.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic = [r.score for r in judged if r.toxic]
    clean = [r.score for r in judged if not r.toxic]
    above = np.mean([np.mean(np.array(clean) < s) for s in toxic])
    assert toxic and clean and above >= 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in judged)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encode_bpe":
            assert docs.columns == columns
        if name == "line_dedup":
            assert line_dedup.near_lines(docs).where("NOT kept").count() == 0
        if name == "simhash_dedup":
            assert simhash.near_duplicates(docs, 3).where("doc_id <> component_id").count() == 0
            texts = {tuple(r) for r in before.collect()}
            assert all(tuple(r) in texts for r in docs.collect())
        if name == "encode_bpe":
            want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
            assert Counter((r.doc_id, r.decoded_sha256) for r in docs.collect()) == want
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, map(tuple, run))) == sorted(map(repr, map(tuple, docs.collect())))


def test_pipeline_of_edge_rows(spark, tmp_path):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for at, rows in (("full", docs), ("none", docs.limit(0))):
        (tmp_path / at).mkdir()
        rows.write.parquet(str(tmp_path / at / "documents.parquet"))
        corpus_pipeline.run(spark, str(tmp_path / at)).collect()
