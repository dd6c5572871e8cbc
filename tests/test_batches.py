import hashlib
import math

import pytest
from pyspark.sql import functions as F

from dialogmill.operators.batches import batch_plan, collate, planned_rows


def plain_plan(keys, seed, max_steps, epochs, per_step=32, micro_rows=2):
    steps = math.ceil(len(keys) / per_step)
    out = []
    for e in range(epochs):
        order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{e}:{k}".encode()).hexdigest(), k))
        for pos, k in enumerate(order):
            step = e * steps + pos // per_step
            if max_steps is None or step < max_steps:
                out.append((k, e, pos, step, pos % per_step // micro_rows, pos % micro_rows))
    return sorted(out)


def keys(spark, n):
    return spark.range(n).select(F.concat(F.lit("kb:"), F.col("id").cast("string")).alias("row_key"), "id")


@pytest.mark.parametrize("n,max_steps,bucket", [(500, 40, 30), (500, 40, 100_000), (33, 5, 1), (3, 4, 2), (1000, 7, 10)])
def test_plan_with_a_step_cap(spark, n, max_steps, bucket):
    rows = keys(spark, n)
    epochs = math.ceil(max_steps / math.ceil(n / 32))
    got = sorted(tuple(r) for r in batch_plan(rows, "row_key", 7, max_steps, rows_per_bucket=bucket).collect())
    assert got == plain_plan([f"kb:{i}" for i in range(n)], 7, max_steps, epochs)


def test_plan_without_a_cap_uses_each_row_once_per_epoch(spark):
    plan = batch_plan(keys(spark, 300), "row_key", 1, None, epochs=3, rows_per_bucket=17)
    got = sorted(tuple(r) for r in plan.collect())
    assert got == plain_plan([f"kb:{i}" for i in range(300)], 1, None, 3)
    assert plan.groupBy("row_key", "epoch").count().filter("count <> 1").count() == 0


def test_empty_input_and_missing_bounds(spark):
    assert batch_plan(keys(spark, 0), "row_key", 1, 10).count() == 0
    # no bound stands for one epoch
    assert batch_plan(keys(spark, 3), "row_key", 1, None).count() == 3


@pytest.mark.parametrize("max_steps", [3, None])
def test_collated_records(spark, max_steps):
    rows = keys(spark, 70).withColumn("ids", F.array(F.col("id").cast("int")))
    epochs = 1 if max_steps is None else None
    plan = batch_plan(rows, "row_key", 5, max_steps, epochs)
    used = planned_rows(rows, plan, "row_key", max_steps)
    got = {
        (r.step, r.micro_batch): [(x.slot, x.input_ids, x.labels, x.attention_mask) for x in r.rows]
        for r in collate(used, length=3).collect()
    }
    want = {}
    for k, _, _, step, micro, slot in plain_plan([f"kb:{i}" for i in range(70)], 5, max_steps, 1):
        i = int(k[3:])
        label = -100 if i == 2 else i  # 2 is the pad id
        want.setdefault((step, micro), []).append((slot, [i, 2, 2], [label, -100, -100], [1, 0, 0]))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_default_plan_uses_every_row_once_and_zero_is_empty(spark):
    plan = batch_plan(keys(spark, 100), "row_key", 1)
    assert plan.count() == 100 and plan.select("row_key").distinct().count() == 100
    assert batch_plan(keys(spark, 5), "row_key", 1, epochs=0).count() == 0
    assert batch_plan(keys(spark, 5), "row_key", 1, max_steps=0).count() == 0
