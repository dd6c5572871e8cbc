import json
import random

import pytest

from dialogmill.operators import runlog


def log_rows():
    """One run with most of the rows, a short one, and one without any loss."""
    rng = random.Random(3)
    rows = [("hot", s, rng.choice([None, None, None, round(rng.random(), 3)])) for s in range(1, 601)]
    rows += [("short", s, 0.5 if s == 10 else None) for s in range(1, 13)]
    return rows + [("silent", s, None) for s in range(1, 5)]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(log_rows(), "run string, step long, loss double").repartition(5)


def replay():
    """Loss known at each step when a step's own log comes after its check."""
    out, last = {}, {}
    for run, step, loss in log_rows():
        out[run, step] = last.get(run)
        if loss is not None:
            last[run] = loss
    return out


@pytest.mark.parametrize("block", [7, 64, 65_536])
def test_loss_asof_like_a_replay(log, block):
    got = {(r.run, r.step): r.loss_seen for r in runlog.loss_asof(log, block).collect()}
    assert got == replay()


@pytest.mark.parametrize("block", [7, 65_536])
def test_series(log, block):
    series = runlog.loss_series(log, steps_per_block=block)
    got = sorted((r.run, r.idx, r.step, r.loss) for r in runlog.series_rows(series).collect())
    want, n = [], {}
    for run, step, loss in log_rows():
        if loss is not None:
            want.append((run, n.get(run, 0), step, loss))
            n[run] = n.get(run, 0) + 1
    assert got == sorted(want)
    chart = json.loads(runlog.chart_json(series).filter("run = 'short'").first().chart)
    assert chart == {"data": [{"x": [10], "y": [0.5], "type": "line"}]}


def test_loss_blocks(log):
    got = {(r.run, r.block_end): (r.mean_loss, r.n) for r in runlog.loss_blocks(log).collect()}
    groups = {}
    for run, step, loss in log_rows():
        groups.setdefault((run, -(-step // 10) * 10), []).append(loss)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        mean, n = got[key]
        assert n == len(known)
        assert mean == (pytest.approx(sum(known) / n) if known else None)


def test_early_stop_is_seen_one_step_later(spark):
    rows = [("r", s, {10: 0.9, 20: 0.3, 40: 0.20}.get(s)) for s in range(1, 51)]
    rows += [("end", s, 0.26 if s == 10 else None) for s in range(1, 11)]
    rows += [("never", 1, 0.27)]
    log = spark.createDataFrame(rows, "run string, step long, loss double")
    got = {r.run: (r.stop_logged_step, r.stop_seen_step) for r in runlog.early_stop(log).collect()}
    assert got == {"r": (40, 41), "end": (10, None), "never": (None, None)}
    done = {}
    for r in runlog.steps_until_stop(log).collect():
        done.setdefault(r.run, []).append(r.step)
    assert {k: sorted(v) for k, v in done.items()} == {
        "r": list(range(1, 42)), "end": list(range(1, 11)), "never": [1],
    }
    seen = runlog.loss_asof(log).filter("loss_seen <= 0.26").groupBy("run").min("step").collect()
    assert {r[0]: r[1] for r in seen} == {"r": 41}


def test_final_loss_and_fallback(spark, log):
    got = {r.run: (r.final_loss, r.status) for r in runlog.final_loss(log).collect()}
    last = [x for run, _, x in log_rows() if run == "hot" and x is not None][-1]
    assert got["hot"] == (last, f"Training completed: Final loss {last:.4f}")
    assert got["silent"] == (None, "Training completed (loss not recorded)")
    tracked = spark.createDataFrame(
        [("a", 1, None, 0.7), ("a", 2, None, None), ("b", 1, 0.4, 0.9)],
        "run string, step long, loss double, kept double",
    )
    assert {r.run: r.final_loss for r in runlog.final_loss(tracked, "kept").collect()} == {"a": 0.7, "b": 0.4}


def test_latest_stage_progress_and_state(spark, log):
    writes = spark.createDataFrame(
        [("a", "one", 0.1, 1, 1), ("a", "three", 0.3, 2, 9), ("a", "two", 0.2, 2, 5)],
        "run string, stage string, progress double, ts long, id long",
    )
    assert [tuple(r) for r in runlog.latest_stage(writes).collect()] == [("a", "three", 0.3)]
    state = {r.run: r for r in runlog.run_state(log, 600).collect()}
    assert state["hot"].current_step == 600 and state["hot"].progress == 0.3 + 1.0 * 0.4
    assert state["silent"].last_loss is None and state["silent"].stop_logged_step is None
    lines = {r.step: r.status for r in runlog.run_status(runlog.loss_asof(log), 2000).filter("run = 'short'").collect()}
    assert lines == {11: "Step 11/2000 | Loss: 0.5000", 12: "Step 12/2000 | Loss: 0.5000"}
