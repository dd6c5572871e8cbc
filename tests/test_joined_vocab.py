"""A vocabulary too large for the tasks: what is shuffled, and how often it is worked out."""

import time

import oracle
import pytest
from pyspark.sql import functions as F

from dialogmill.operators.skew import spread_join
from dialogmill.operators.tokens import encode, encode_by_join
from dialogmill.plans import catalog, training

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]  # 64
HOT = [f"hot{c}" for c in "abcdefgh"]


def shuffled_rows(frame):
    """Rows that exchanges have written in this frame's own run."""
    frame.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.fixture()
def texts(spark):
    """100 rows of 300 words, nearly all of them among eight frequent ones; each rare word comes twice."""
    rows = []
    for i in range(100):
        words = [HOT[(i + j) % 8] for j in range(296)] + [WORDS[i % 64], WORDS[(i + 9) % 64]] * 2
        rows.append((f"k{i}", " ".join(words)))
    return spark.createDataFrame(rows, "row_key string, text string").repartition(4)


@pytest.fixture()
def vocab(spark):
    return spark.createDataFrame([(w, i + 3) for i, w in enumerate(HOT + WORDS)], "token string, token_id int")


@pytest.mark.parametrize("encoder", ["lookup", "join"])
def test_words_of_a_large_vocabulary_are_not_shuffled_one_by_one(spark, texts, vocab, encoder):
    if encoder == "lookup":
        rows = encode(texts, "text", vocab, "row_key", max_broadcast_vocab=8)
    else:
        rows = encode_by_join(texts, "text", vocab, "row_key")
    got = rows.select("row_key", "ids")
    # 30,000 words: a row asks for two rare ones, comes back and meets its text
    assert shuffled_rows(got) < 2000
    ids = {w: i + 3 for i, w in enumerate(HOT + WORDS)}
    want = {r.row_key: [ids[w] for w in r.text.split()] for r in texts.collect()}
    assert {r.row_key: r.ids for r in got.collect()} == want


def test_a_large_vocabulary_is_worked_out_once(spark, texts, vocab):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(i):
        seen.add(1)
        return i

    learned = vocab.withColumn("token_id", counted("token_id"))
    rows = encode(texts, "text", learned, "row_key", max_tokens=200, max_broadcast_vocab=8)
    assert rows.count() == 100 and rows.select(F.sum(F.size("ids"))).first()[0] == 20_000
    assert seen.value == 72


def test_spread_join_salts_heavy_keys_only(spark):
    many = spark.range(1000).selectExpr("if(id % 2 = 0, 'hot', string(id % 50)) AS k", "id")
    one = many.select("k").distinct().filter("k <> '7'").selectExpr("k", "k || '!' AS v")
    got = spread_join(many, one, "k", ["id"], heavy=100, salts=8).select("k", "id", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, many.join(one, "k", "left").select("k", "id", "v").collect()))


def test_unknown_words_nulls_and_sparse_ids_in_the_joined_part(spark):
    rows = spark.createDataFrame([("k", "a b a z z"), ("k", None), (None, ""), ("m", "c q c"), ("m", "c q c")], "row_key string, text string")
    vocab = spark.createDataFrame([("a", -5), ("b", 2_000_000_000), ("c", 7), ("d", None)], "token string, token_id int")
    for first in (0, 1, 2, 4):
        got = encode(rows, "text", vocab, "row_key", max_broadcast_vocab=first).select("row_key", "ids").collect()
        want = [("k", [-5, 2_000_000_000, -5, 0, 0]), ("k", None), (None, []), ("m", [7, 0, 7]), ("m", [7, 0, 7])]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("first", [500_000, 300_000])
def test_a_small_batch_does_not_pay_for_the_whole_vocabulary(spark, first):
    vocab = spark.range(400_000).selectExpr("string(id) AS token", "int(id + 3) AS token_id")
    rows = spark.range(500).selectExpr("string(id) AS row_key", "string(id * 799) AS text").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, "1")
    try:
        start = time.monotonic()
        got = encode(rows, "text", vocab, "row_key", max_broadcast_vocab=first).select("row_key", "ids").collect()
    finally:
        spark.conf.set(size, usual)
    assert {int(r.row_key): r.ids for r in got} == {i: [i * 799 + 3] for i in range(500)}
    assert time.monotonic() - start < 35  # 500 batches; 50 to 74 s when each hashed the vocabulary


def test_a_full_epoch_shuffles_ids_and_no_texts(spark):
    slices = spark.sparkContext.defaultParallelism

    def rows(items, schema):
        return spark.createDataFrame(spark.sparkContext.parallelize(items, slices), schema)

    documents = rows([(i, f"a b {i}") for i in range(40)], "doc_id long, text string")
    lines = rows([(f"{i}", "c d", "style") for i in range(40)], "line_key string, text string, type string")
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate("abcd")], "token string, token_id int")
    batches = training.collated_batches(documents, lines, "s", vocab)
    assert batches.count() == 40

    def exchanged(node):
        own = [node.output().apply(i).name() for i in range(node.output().size())] if node.nodeName() == "Exchange" else []
        return own + [n for i in range(node.children().size()) for n in exchanged(node.children().apply(i))]

    names = exchanged(batches._jdf.queryExecution().executedPlan().initialPlan())
    assert "ids" in names and "text" not in names


@pytest.mark.parametrize("name", ["collated_from_steps", "collated", "labels", "pad_trunc", "token_shards", "tokenized"])
def test_queries_keep_to_their_sql_with_a_joined_vocabulary(spark, monkeypatch, name):
    special, max_tokens, _, keep_text = encode.__defaults__
    monkeypatch.setattr(encode, "__defaults__", (special, max_tokens, 1000, keep_text))
    assert oracle.compare(spark, "/root/testdata/sf0.001", name, catalog.QUERIES[name], catalog.ORACLE[name])
