from pyspark.sql import functions as F

from dialogmill.operators.vocab import SpecialTokens, default_pad
from dialogmill.operators.validate import count_errors, error_class, missing_fields, row_reason, split_quarantine


def test_row_reason_and_quarantine(spark):
    rows = spark.createDataFrame(
        [
            (0, "ok", "style", "headers"),
            (1, None, "style", "headers"),
            (2, "", "info", "headers"),
            (3, "bytes", "info", "headers"),
            (4, "ok", "style ", "headers"),
            (5, "ok", None, "headers"),
            (6, "ok", "info", "nowhere"),
            (7, "ok", "info", None),
            (8, "a written \ufffd", "info", "headers"),
        ],
        "id int, text string, type string, template string",
    ).withColumn("text", F.when(F.col("id") == 3, F.unhex(F.lit("636166E9")).cast("string")).otherwise(F.col("text")))
    c = F.col
    good, bad = split_quarantine(rows, row_reason(c("text"), c("type"), c("template"), ["headers"]))
    assert sorted(r.id for r in good.collect()) == [0, 8]
    assert {r.id: r.reason for r in bad.select("id", "reason").collect()} == {
        1: "missing_text", 2: "missing_text", 3: "bad_encoding", 4: "bad_type",
        5: "bad_type", 6: "no_template", 7: "no_template",
    }
    relaxed, _ = split_quarantine(rows, row_reason(c("text"), c("type"), strict_type=False))
    assert sorted(r.id for r in relaxed.select("id").collect()) == [0, 4, 5, 6, 7, 8]


def test_missing_fields_and_default_pad(spark):
    rows = spark.createDataFrame(
        [(0, "b", "e", "p"), (1, None, "e", None), (2, None, None, None)], "id int, bos string, eos string, pad string"
    )
    got = rows.orderBy("id").select(
        missing_fields(["pad", "bos", "eos"]).alias("m"), default_pad(F.col("pad"), F.col("eos")).alias("p")
    ).collect()
    assert [r.m for r in got] == ["", "bos, pad", "bos, eos, pad"]
    assert [r.p for r in got] == ["p", "e", None]
    assert SpecialTokens().pad_id == SpecialTokens().eos and SpecialTokens(pad=9).pad_id == 9


def test_error_class_order(spark):
    rows = spark.createDataFrame([("x 401 then 404",), ("401",), ("boom",), (None,)], "m string")
    assert [r[0] for r in rows.select(error_class(F.col("m"))).collect()] == [
        "not_found", "bad_token", "other", "other",
    ]
    assert {r.error_class: r.n for r in count_errors(rows, "m").collect()} == {
        "not_found": 1, "bad_token": 1, "other": 2,
    }
