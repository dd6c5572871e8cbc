import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogmill.functions import text as t
from dialogmill.functions.progress import final_line, progress_fraction, status_line, stop_line

MARK = t.DEFAULT_MARKER
CHARS = st.sampled_from(list(t.PY_WHITESPACE) + list("aéb-E.​﻿") + [MARK, "-éveré", "\r\n"])
TEXTS = st.lists(st.lists(CHARS, max_size=12).map("".join), min_size=1, max_size=80)


def evaluate(spark, values, column, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_whitespace_is_what_python_strips():
    assert len(t.PY_WHITESPACE) == 29


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_clean_response_like_python(spark, values):
    want = [v.split(MARK)[0].strip() for v in values]
    assert evaluate(spark, values, t.clean_response(F.col("v"))) == want


def test_clean_response_cases(spark):
    values = ["hello -éveré tail", "hello -ÉVERÉ tail", "hello -éveré x", "　a \u0085", "​b", None]
    assert evaluate(spark, values, t.clean_response(F.col("v"))) == [
        "hello", "hello -ÉVERÉ tail", "hello -éveré x", "a", "​b", None,
    ]


def test_newlines(spark):
    assert evaluate(spark, ["a\r\nb\rc\nd\r\r\n"], t.normalize_newlines(F.col("v"))) == ["a\nb\nc\nd\n\n"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab<|x\n", max_size=14), min_size=1, max_size=60))
def test_cut_at_earliest_stop_even_when_stops_overlap(spark, values):
    stops = ("ab", "b", "<|x", "\n<|")

    def cut(v):
        at = [v.find(s) for s in stops if s in v]
        return v[: min(at)] if at else v

    assert evaluate(spark, values, t.cut_at_stop(F.col("v"), stops)) == [cut(v) for v in values]


def test_default_stops(spark):
    values = ["yes<|eot_id|>\n<|start_header_id|>", "a\n<|start_header_id|>b", "plain"]
    assert evaluate(spark, values, t.cut_at_stop(F.col("v"))) == ["yes", "a", "plain"]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.floats(min_value=-1e6, max_value=1e6),
            st.integers(0, 10**7).map(lambda n: (2 * n + 1) / 20000),  # decimal ties
            st.integers(0, 10**6).map(lambda n: n / 32),
        ),
        min_size=1,
        max_size=200,
    )
)
def test_fixed4_like_python(spark, values):
    values = values + [0.03125, 0.00135, 0.00125, 2.675, 0.0, -0.0, math.inf, -math.inf, 123456789.00005]
    assert evaluate(spark, values, t.fixed4(F.col("v")), "double") == [f"{v:.4f}" for v in values]


def test_progress_and_status(spark):
    got = evaluate(spark, [0, 500, 2000, 2500], progress_fraction(F.col("v"), 2000), "int")
    assert got == [0.3 + min(s / 2000, 1.0) * 0.4 for s in (0, 500, 2000, 2500)]
    line = evaluate(spark, [0.03125], status_line(F.lit(7), 2000, F.col("v")), "double")
    assert line == ["Step 7/2000 | Loss: 0.0312"]
    assert evaluate(spark, [None], final_line(F.col("v")), "double") == ["Training completed (loss not recorded)"]
    assert evaluate(spark, [0.2], stop_line(F.col("v"), 0.26), "double") == ["Loss 0.2000 below threshold 0.26"]
