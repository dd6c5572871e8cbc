from pyspark.sql import functions as F

from dialogmill.operators.conversations import messages_from_turns, render_turns
from dialogmill.operators.prompts import INFO_PROMPT, STYLE_PROMPT, user_prompt
from dialogmill.operators.templates import (
    HEADER_TOKENS,
    TEMPLATES,
    USER_ASSISTANT,
    render,
    render_by_template,
)

SCHEMA = "id int, messages array<struct<role:string,content:string>>"
CASES = [
    [("system", "S"), ("user", "U"), ("assistant", "A")],
    [("user", "U0"), ("tool", "T")],
    [("system", "only")],
    [("system", "S"), ("system", "again")],
    [("user", "lost")],
    [],
]
PLAIN = ["S\nUSER: U\nASSISTANT: A\n", "ASSISTANT: T\n", "only\n", "S\nASSISTANT: again\n", "", ""]


def header(role, content):
    return f"<|start_header_id|>{role}<|end_header_id|>\n{content}<|eot_id|>"


OPEN = "\n<|start_header_id|>assistant<|end_header_id|>\n"


def table(spark, cases=CASES):
    return spark.createDataFrame(list(enumerate(cases)), SCHEMA)


def texts(rows):
    return [r.text for r in rows.orderBy("id").select("text").collect()]


def test_user_assistant_form(spark):
    got = table(spark).select("id", render(F.col("messages"), USER_ASSISTANT).alias("text"))
    assert texts(got) == PLAIN


def test_header_form_and_generation_prompt(spark):
    ms = F.col("messages")
    first_two = table(spark, CASES[:2])
    want = [
        "\n".join(header(r, c) for r, c in CASES[0]),
        header("user", "U0") + "\n" + header("assistant", "T"),
    ]
    assert texts(first_two.select("id", render(ms, HEADER_TOKENS, False).alias("text"))) == want
    assert texts(first_two.select("id", render(ms, HEADER_TOKENS).alias("text"))) == [w + OPEN for w in want]


def test_template_chosen_per_row(spark):
    rows = table(spark).withColumn(
        "template", F.when(F.col("id") == 0, "headers").when(F.col("id") == 1, "nowhere")
    )
    got = texts(render_by_template(rows, TEMPLATES, "user_assistant"))
    assert got == ["\n".join(header(r, c) for r, c in CASES[0]) + OPEN, None, *PLAIN[2:]]


def turns(spark, n=1):
    """Short conversations and a long one, turns not starting at 0."""
    rows = [(c, 5 + t, r, x) for c, case in enumerate(CASES) for t, (r, x) in enumerate(case)]
    rows += [(99, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(3, 60)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_messages_in_turn_order(spark):
    got = {r.conv_id: r for r in messages_from_turns(turns(spark)).collect()}
    assert [tuple(m) for m in got[0].messages] == CASES[0]
    assert len(got[99].messages) == 57 and got[99].is_first and got[99].is_last


def test_long_conversation_in_parts_is_the_same_text(spark):
    for spec in (USER_ASSISTANT, HEADER_TOKENS):
        whole = {r.conv_id: r.text for r in render_turns(turns(spark), spec).collect()}
        parts = render_turns(turns(spark), spec, turns_per_part=7).orderBy("conv_id", "part").collect()
        joined = {}
        for r in parts:
            joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
        assert joined == whole
        assert len(parts) > len(whole)
    sizes = messages_from_turns(turns(spark), 7).select(F.max(F.size("messages"))).first()[0]
    assert sizes <= 7


def test_prompt_by_type(spark):
    kinds = ["style", "info", "style ", None, "other"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "id int, k string")
    got = rows.orderBy("id").select(user_prompt(F.col("k")), user_prompt(F.col("k"), True)).collect()
    assert [r[0] for r in got] == [STYLE_PROMPT] + [INFO_PROMPT] * 4
    assert [r[1] for r in got] == [STYLE_PROMPT, INFO_PROMPT, STYLE_PROMPT, INFO_PROMPT, INFO_PROMPT]


def test_a_message_without_content_gives_no_text(spark):
    rows = spark.sql("SELECT array(named_struct('role', 'system', 'content', 'S'), "
                     "named_struct('role', 'user', 'content', CAST(NULL AS STRING))) AS m")
    assert [rows.select(render(F.col("m"), s)).first()[0] for s in (USER_ASSISTANT, HEADER_TOKENS)] == [None, None]
