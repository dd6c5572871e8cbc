"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as spark_entry
from dialogmill.operators.batches import batch_plan
from dialogmill.operators.skew import salted_join
from dialogmill.plans import catalog, training
from dialogmill.plans.tables import table

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_no_cross_join_anywhere(spark, name):
    plan = plan_of(spark_entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_training_text_and_tokens_do_not_shuffle(spark):
    texts = catalog._texts(spark, SF)
    vocab = spark.createDataFrame([("the", 3)], "token string, token_id int")
    for frame in (texts, training.tokenized_rows(texts, vocab)):
        assert "Exchange" not in plan_of(frame)


def test_batch_plan_reads_keys_only(spark):
    documents = table(spark, SF, "documents")
    plan = plan_of(batch_plan(documents, "doc_id"))
    assert "text" not in plan
    assert "BroadcastHashJoin" in plan


def test_error_filter_reaches_the_scan(spark):
    plan = plan_of(spark_entry.queries()["classify_errors"](spark, SF))
    assert "EqualTo(event_type,error)" in plan
    assert "ReadSchema: struct<event_type:string,props:string>" in plan


def test_salted_join_keeps_every_row(spark):
    many = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', string(id % 7)) AS k", "id")
    one = many.groupBy("k").count().withColumnRenamed("count", "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = salted_join(many, one, ["k"], ["id"], salts=8)
        assert "_salt" in plan_of(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
