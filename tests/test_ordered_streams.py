import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dialogmill.operators import runlog
from dialogmill.operators.mapping import add_columns
from dialogmill.operators.vocab import learn_vocab
from dialogmill.plans import training
from dialogmill.streaming.callbacks import EventLog
from dialogmill.streaming.ordered import latest_attempts, stream_attempts, stream_loss_asof
from dialogmill.streaming.runstate import latest_state, stream_run_state

ATTEMPTS = "run long, seq long, step long, loss double"


def replay(rows):
    """What a trainer knows of each run, row by row; step 1 begins anew."""
    state = {}
    for run, _, step, loss in sorted(rows, key=lambda r: r[1]):
        attempt, at, last, stop = state.get(run, (0, 0, None, None))
        if step == 1:
            attempt, at, last, stop = attempt + 1, 0, None, None
        at = max(at, step)
        if loss is not None:
            last = loss
            stop = step if loss <= 0.26 and stop is None else stop
        state[run] = (attempt, at, last, stop)
    return state


def attempts(rng):
    rows, seq = [], 0
    for run in (1, 2, 1, 3, 1, 2):
        for step in range(1, rng.randrange(20, 60)):
            rows.append((run, seq, step, rng.random() if step % 5 == 0 else None))
            seq += 1
    return rows


def write_files(spark, rows, schema, folder, files):
    """One file after the other, so that the stream takes them in this order."""
    for part in files(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_run_that_begins_again_starts_empty(spark, tmp_path):
    rng = random.Random(4)
    rows = attempts(rng)
    thirds = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    for part in thirds:
        rng.shuffle(part)
    write_files(spark, rows, ATTEMPTS, f"{tmp_path}/in", lambda _: thirds)
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_attempts(stream, 60, f"{tmp_path}/out")
    saved = spark.read.parquet(f"{tmp_path}/out/attempts")
    assert saved.where("batch_id >= 0").select("batch_id").distinct().count() == 3
    found = {r.run: (r.attempt, r.current_step, r.last_loss, r.stop_logged_step) for r in latest_state(saved).collect()}
    assert found == replay(rows) and found[1][0] == 3
    table = latest_attempts(spark.createDataFrame(rows, ATTEMPTS), 60).collect()
    assert {r.run: (r.attempt, r.current_step, r.last_loss, r.stop_logged_step) for r in table} == found


def test_state_of_an_old_run_goes(spark, tmp_path):
    schema = ATTEMPTS + ", ts timestamp"
    hour = lambda h: datetime(2020, 1, 1) + timedelta(hours=h)
    parts = [
        [(1, 0, 1, None, hour(0)), (1, 1, 2, 0.5, hour(1)), (2, 2, 1, None, hour(1))],
        [(2, 3, 2, 0.4, hour(30))],
        [(2, 4, 3, None, hour(31))],
        # no step 1: were the run known, this would go on from there
        [(1, 5, 9, None, hour(40))],
    ]
    write_files(spark, None, schema, f"{tmp_path}/in", lambda _: parts)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_attempts(stream, 60, f"{tmp_path}/out", expire_hours=10, name="old_runs")
    found = {r.run: (r.attempt, r.current_step, r.last_loss) for r in latest_state(spark.read.parquet(f"{tmp_path}/out/attempts")).collect()}
    assert found == {1: (0, 9, None), 2: (1, 3, 0.4)}


def test_rows_after_later_ones_are_counted(spark, tmp_path):
    early, late = [(1, 0, 1, None), (1, 5, 6, 0.5)], [(1, 3, 4, 0.1), (1, 6, 7, None)]
    write_files(spark, None, ATTEMPTS, f"{tmp_path}/in", lambda _: [early, late])
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_attempts(stream, 60, f"{tmp_path}/out", name="late_rows")
    (r,) = latest_state(spark.read.parquet(f"{tmp_path}/out/attempts")).collect()
    assert (r.current_step, r.last_loss, r.stop_logged_step, r.n_late) == (7, 0.5, None, 1)


LOG = "run long, step long, loss double, ts timestamp"


@pytest.mark.parametrize("order", ["shuffled", "in_order"])
def test_loss_as_of_late_and_shuffled_files(spark, tmp_path, order):
    rng = random.Random(order)
    rows = [(run, step, rng.random() if step % 7 == 0 else None) for run in (1, 2, 5) for step in range(1, 200)]
    if order == "shuffled":
        rng.shuffle(rows)
    else:  # by time, so that the watermark passes rows while files still come
        rows.sort(key=lambda r: r[1])
    frame = spark.createDataFrame(rows, "run long, step long, loss double")
    timed = frame.withColumn("ts", F.timestamp_seconds(F.col("step") * 60))
    size = -(-len(rows) // 5)
    for at in range(0, len(rows), size):
        part = spark.createDataFrame(rows[at : at + size], "run long, step long, loss double").withColumn("ts", F.timestamp_seconds(F.col("step") * 60))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, 0, None)], "run long, step long, loss double").withColumn("ts", F.lit("2100-01-01").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    delay = "300 minutes" if order == "shuffled" else "10 minutes"
    stream_loss_asof(stream, f"{tmp_path}/out", delay, name=f"asof_{order}")
    saved = spark.read.parquet(f"{tmp_path}/out/asof").where("run >= 0")
    if order == "in_order":
        assert saved.select("batch_id").distinct().count() > 2
    found = sorted((r.run, r.step, r.loss, r.loss_seen) for r in saved.collect())
    want = sorted(map(tuple, runlog.loss_asof(frame).collect()))
    assert found == want
    stops = {r.run: r.step for r in saved.where("stops").collect()}
    seen = {r.run: r.stop_seen_step for r in runlog.early_stop(frame).collect() if r.stop_seen_step}
    assert stops == seen and seen


def test_events_of_a_stream_become_rows(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i + 1, 0.5)], "run long, step long, loss double").write.mode("append").parquet(f"{tmp_path}/in")
    log = EventLog({"told"})
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("run long, step long, loss double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream_run_state(stream, 10, f"{tmp_path}/a", name="told")
        stream_run_state(stream, 10, f"{tmp_path}/b", name="untold")
        log.write(spark, f"{tmp_path}/log")
    finally:
        spark.streams.removeListener(log)
    rows = spark.read.parquet(f"{tmp_path}/log").collect()
    assert {r.name for r in rows} == {"told"} and [r.kind for r in rows][0] == "begin" and [r.kind for r in rows][-1] == "end"
    steps = [r for r in rows if r.kind == "step"]
    assert sum(r.n_rows for r in steps) == 3 and len({r.step for r in steps}) == len(steps)


def conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), " ".join(rng.choices(["one", "two", "three."], k=rng.randrange(9)))) for c in range(12) for t in range(rng.randrange(1, 30))]
    return spark.createDataFrame([*rows, (99, 0, "user", "")], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("part", [1, 2, 7])
def test_the_cut_is_that_of_the_conversation(spark, part):
    turns = conversations(spark)
    vocab = learn_vocab(turns, "text")
    whole = {r.conv_id: tuple(r)[1:] for r in training.conversation_rows(turns, vocab, length=20).collect()}
    parts = {r.conv_id: tuple(r)[1:] for r in training.conversation_rows(turns, vocab, length=20, turns_per_part=part).collect()}
    assert parts == whole and any(v[0] > 20 for v in whole.values()) and any(v[0] < 20 for v in whole.values())


def test_batches_of_laid_out_steps_need_no_exchange(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    lines = spark.createDataFrame([("a", "one", "style")], "line_key string, text string, type string")
    vocab = learn_vocab(docs, "text")
    want = training.collated_batches(docs, lines, "S", vocab)
    used = training._used_rows(docs, lines, "S", vocab, 42, None, training.SpecialTokens(), 256)
    name = training.write_steps(used, f"{tmp_path}/steps")
    got = training.collate_steps(spark.table(name))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    some = training.collate_steps(spark.table(name).where("step BETWEEN 2 AND 3"))
    assert {r.step for r in some.select("step").collect()} == {2, 3}
    spark.sql(f"DROP TABLE {name}")


def test_columns_are_added_and_removed(spark):
    rows = spark.createDataFrame([(1, "ab", "x"), (2, None, "y")], "id long, text string, n string")
    out = add_columns(rows, lambda b: b.assign(n=b["text"].str.len().fillna(-1).astype(int))[["n"]], "n long", ["text"], ["text"])
    assert out.columns == ["id", "n"] and sorted(map(tuple, out.collect())) == [(1, 2), (2, -1)]
    with pytest.raises(Exception, match="rows for"):
        add_columns(rows, lambda b: b[["n"]].iloc[:0], "n string", ["n"]).collect()
