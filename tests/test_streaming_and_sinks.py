import time

import pytest
from pyspark.sql import functions as F

from dialogmill.operators import runlog
from dialogmill.operators.mapping import map_batches
from dialogmill.operators.tokens import fixed_length
from dialogmill.operators.vocab import learn_vocab, vocab_size
from dialogmill.plans.prepare import prepare
from dialogmill.plans.tables import logged_steps, table_stream
from dialogmill.session import shared_folder
from dialogmill.sources import sinks
from dialogmill.sources.csv_files import read_style_csv
from dialogmill.streaming.callbacks import LifecycleListener
from dialogmill.streaming.runstate import latest_state, stream_run_state

SCHEMA = "run string, step long, loss double"


def test_stream_ends_in_the_batch_result(spark, tmp_path):
    rows = [(f"r{i % 3}", i // 3 + 1, (i * 37 % 100) / 100 if i % 4 == 0 else None) for i in range(300)]
    for part in range(5):  # several files, late steps among them
        spark.createDataFrame(rows[part::5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    begun, ended = [], []
    listener = LifecycleListener(begun.append, lambda name, error: ended.append((name, error)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream_run_state(stream, 200, f"{tmp_path}/out", name="state_test")
        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    saved = spark.read.parquet(f"{tmp_path}/out/state")
    assert saved.select("batch_id").distinct().count() == 5
    want = runlog.run_state(spark.createDataFrame(rows, SCHEMA), 200)
    assert sorted(map(tuple, latest_state(saved).collect())) == sorted(map(tuple, want.collect()))
    assert begun == ["state_test"] and ended == [("state_test", None)]


def test_token_shards_round_trip(spark, tmp_path):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("int")).alias("ids"))
    tokens = fixed_length(rows, length=16).coalesce(1)
    limit = 100 * (3 * 4 * 16 + 64)
    sinks.write_tokens(tokens, f"{tmp_path}/t", 16, max_bytes=limit)
    back = spark.read.parquet(f"{tmp_path}/t")
    sizes = back.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 10 and all(r["count"] <= 100 for r in sizes)
    assert back.exceptAll(tokens).count() == 0 and back.count() == 1000


def test_text_csv_and_metrics_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("a", 'x "y"\nz'), ("b", "  blanks  ")], "row_key string, text string")
    sinks.write_text(texts, f"{tmp_path}/j", max_rows=1)
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/j").select("row_key", "text").collect())) == sorted(
        map(tuple, texts.collect())
    )
    lines = spark.createDataFrame(
        [("s", 'He said "hi",\r\nthen\\ left', "style"), ("s", "  padded ", "info")], "speaker string, text string, type string"
    )
    sinks.write_style_csv(lines, f"{tmp_path}/c.csv")
    got = read_style_csv(spark, [f"{tmp_path}/c.csv"]).select("speaker", "text", "type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.collect()))
    sinks.write_metrics(vocab_size(learn_vocab(texts, "text", 100)), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").first()[0] == 3 + 5


def test_whole_preparation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("speaker,text,type\nm,one two,style\nm,,info\nm,two -éveré x,info\n")
    (tmp_path / "b.txt").write_text("two facts\r\n")
    out = f"{tmp_path}/out"
    skipped = prepare(
        spark, [f"{tmp_path}/b.txt", f"{tmp_path}/a.csv", f"{tmp_path}/c.doc"], "Be kind.", out, vocab_entries=10, length=12
    )
    assert skipped == [f"{tmp_path}/c.doc"]
    rows = sinks.read_shards(spark, f"{out}/text", "row_key string, text string", "parquet").orderBy("place").collect()
    texts = {r.row_key: r.text for r in rows}
    # the key has the place of the path, a digest of the file and the row
    assert [r.row_key.split(":")[0] for r in rows] == ["0", "1", "1"] and len(texts) == 3
    assert rows[0].text.endswith("ASSISTANT: two facts\n")
    assert rows[1].text == "Be kind.\nUSER: Generate a response\nASSISTANT: one two\n"
    assert rows[2].text.endswith("ASSISTANT: two\n")
    assert [r.reason for r in spark.read.parquet(f"{out}/rejected").collect()] == ["missing_text"]
    assert spark.read.parquet(f"{out}/metrics").first()[0] == 13
    tokens = spark.read.parquet(f"{out}/tokens").collect()
    assert {r.row_key for r in tokens} == set(texts)
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 12 for r in tokens)
    assert {r.row_key: r.truncated for r in tokens}[rows[0].row_key]


def test_keys_are_unique_over_folders(spark, tmp_path):
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.txt").write_text(f"text {i}")
    prepare(spark, [f"{tmp_path}/one.txt", f"{tmp_path}/two.txt"], "Be kind.", f"{tmp_path}/out", length=12)
    keys = [r.row_key for r in spark.read.parquet(f"{tmp_path}/out/text").collect()]
    assert len(keys) == len(set(keys)) == 6


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_shards_keep_the_order_and_the_bound(spark, tmp_path, kind):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.when(F.col("id") == 77, F.repeat(F.lit("x"), 5000)).otherwise(F.repeat(F.lit("é"), (F.col("id") % 50).cast("int"))).alias("text"))
    sinks.write_shards(rows.repartition(5), f"{tmp_path}/s", ("id",), 2000, kind)
    back = sinks.read_shards(spark, f"{tmp_path}/s", "id long, text string", kind)
    got = back.orderBy("place").collect()
    assert [r.place for r in got] == [r.id for r in got] == list(range(5000))
    assert sorted((r.id, r.text) for r in got) == sorted(map(tuple, rows.collect()))
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(len(f'{{"id":{r.id},"text":"{r.text}"}}\n'.encode()))
    assert all(sum(s) <= 2000 or len(s) == 1 for s in sizes.values())
    # filled: two neighbours of one task are together over the bound
    names = sorted(sizes)
    assert all(sum(sizes[a]) + sizes[b][0] > 2000 for a, b in zip(names, names[1:]) if a[:6] == b[:6])
    assert [s for s in sizes.values() if sum(s) > 2000] == [[5000 + len('{"id":,"text":""}\n') + len(str(77 * 7919 % 5000))]]
    files = [p for p in (tmp_path / "s").rglob("part-*")]
    assert len(files) == len(sizes)


def test_shards_of_no_rows(spark, tmp_path):
    sinks.write_shards(spark.range(0).select("id"), f"{tmp_path}/s", ("id",))
    assert sinks.read_shards(spark, f"{tmp_path}/s", "id long").count() == 0


def test_size_is_counted_while_writing(spark, tmp_path):
    assert sinks.write_with_size(spark.range(70), f"{tmp_path}/r", f"{tmp_path}/n", "size", 3) == 73
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/n").collect()] == [(73,)]
    assert spark.read.parquet(f"{tmp_path}/r").count() == 70


def test_table_streams_of_a_file_a_folder_and_nothing(spark, tmp_path):
    for name, parts in (("one", 1), ("many", 5), ("none", 0)):
        events = spark.range(parts * 50).selectExpr("id AS event_id", "double(id) AS value")
        if parts == 1:
            events.coalesce(1).write.parquet(f"{tmp_path}/written")
            (tmp_path / name).mkdir()
            next((tmp_path / "written").glob("part-*")).rename(tmp_path / name / "events.parquet")
        else:
            events.repartition(max(1, parts)).write.parquet(f"{tmp_path}/{name}/events.parquet")
        out = f"{tmp_path}/{name}-out"
        stream_run_state(logged_steps(table_stream(spark, f"{tmp_path}/{name}", "events")), 2000, out, name=f"of_{name}")
        state = latest_state(spark.read.parquet(f"{out}/state")).collect()
        assert [r.current_step for r in state] == ([parts * 50] if parts else [])


def test_user_function_over_batches(spark):
    rows = spark.createDataFrame([(1, "ab", "x"), (2, "c", "y")], "id long, text string, other string")
    out = map_batches(rows, lambda p: p.assign(n=p["text"].str.len())[["id", "n"]], "id long, n long", ["id", "text"])
    assert out.columns == ["id", "n"] and sorted(map(tuple, out.collect())) == [(1, 2), (2, 1)]


def test_shared_folder_follows_the_session(tmp_path):
    class Session:
        def __init__(self, **values):
            self.conf = {k.replace("_", "."): v for k, v in values.items()}

    named = shared_folder(Session(spark_checkpoint_dir="/shared/ck/"), "x")
    assert named.startswith("/shared/ck/x-")
    with pytest.raises(ValueError):
        shared_folder(Session(spark_master="yarn"), "x")
    local = Session(spark_master="local[2]")
    assert shared_folder(local, "x") != shared_folder(local, "x")
