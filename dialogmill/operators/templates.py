"""Chat templates as data, compiled to one Column expression.

A template is a set of literals per role. There is no template interpreter:
the expression below covers the two forms in use, and Spark generates the code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Affix = tuple[str, str]  # text before and after a message's content


@dataclass(frozen=True)
class TemplateSpec:
    """``roles`` maps a role to its affix, other roles take ``default_role``.

    ``lead_system`` is the affix of a system message in first place when the
    template treats it apart. ``skip_first`` leaves the first message out of
    the loop whatever its role, so a first user turn is lost: that is how the
    USER/ASSISTANT form is defined.
    """

    name: str
    roles: Mapping[str, Affix]
    default_role: Affix
    lead_system: Affix | None = None
    skip_first: bool = False
    separator: str = ""
    generation_prompt: str = ""


# The two template forms.
USER_ASSISTANT = TemplateSpec(
    name="user_assistant",
    roles={"user": ("USER: ", "\n")},
    default_role=("ASSISTANT: ", "\n"),
    lead_system=("", "\n"),
    skip_first=True,
)
HEADER_TOKENS = TemplateSpec(
    name="headers",
    roles={
        role: (f"<|start_header_id|>{role}<|end_header_id|>\n", "<|eot_id|>")
        for role in ("system", "user", "assistant")
    },
    default_role=("<|start_header_id|>assistant<|end_header_id|>\n", "<|eot_id|>"),
    separator="\n",
    generation_prompt="\n<|start_header_id|>assistant<|end_header_id|>\n",
)
TEMPLATES = {t.name: t for t in (USER_ASSISTANT, HEADER_TOKENS)}


def _render(
    messages: Column,
    affix: Callable[[Column], tuple[Column, Column]],
    lead: tuple[Column, Column],
    has_lead: Column,
    skip_first: Column,
    separator: Column,
    generation_prompt: Column,
    is_first: Column,
    is_last: Column,
) -> Column:
    first = F.get(messages, F.lit(0))
    head = F.when(
        is_first & has_lead & (first["role"] == "system"),
        F.concat(lead[0], first["content"], lead[1]),
    ).otherwise("")
    start = F.when(is_first & skip_first, 2).otherwise(1)
    count = F.greatest(F.size(messages) - start + 1, F.lit(0))

    def block(m: Column) -> Column:
        before, after = affix(m["role"])
        return F.concat(before, m["content"], after)

    blocks = F.transform(F.slice(messages, start, count), block)
    # array_join takes a literal delimiter only, so the separator is put in
    # front of every block but the very first.
    body = F.array_join(
        F.transform(
            blocks,
            lambda b, i: F.concat(F.when(is_first & (i == 0), "").otherwise(separator), b),
        ),
        "",
    )
    tail = F.when(is_last, generation_prompt).otherwise("")
    # array_join passes over nulls: a message without content makes the whole text null, never shorter
    complete = ~F.exists(messages, lambda m: m["content"].isNull())
    return F.when(complete, F.concat(head, body, tail))


def render(
    messages: Column,
    spec: TemplateSpec,
    add_generation_prompt: bool = True,
    is_first: Column | None = None,
    is_last: Column | None = None,
) -> Column:
    """Render one conversation, or one part of a long one, to text."""

    def affix(role: Column) -> tuple[Column, Column]:
        before, after = F.lit(spec.default_role[0]), F.lit(spec.default_role[1])
        for name, (b, a) in spec.roles.items():
            before = F.when(role == name, b).otherwise(before)
            after = F.when(role == name, a).otherwise(after)
        return before, after

    lead = spec.lead_system or ("", "")
    return _render(
        messages,
        affix,
        (F.lit(lead[0]), F.lit(lead[1])),
        F.lit(spec.lead_system is not None),
        F.lit(spec.skip_first),
        F.lit(spec.separator),
        F.lit(spec.generation_prompt if add_generation_prompt else ""),
        F.lit(True) if is_first is None else is_first,
        F.lit(True) if is_last is None else is_last,
    )


_AFFIX = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
_SPEC_SCHEMA = T.StructType(
    [
        T.StructField("template", T.StringType()),
        T.StructField("roles", T.MapType(T.StringType(), _AFFIX)),
        T.StructField("default_role", _AFFIX),
        T.StructField("lead_system", _AFFIX),
        T.StructField("skip_first", T.BooleanType()),
        T.StructField("separator", T.StringType()),
        T.StructField("generation_prompt", T.StringType()),
    ]
)


def template_table(spark: SparkSession, specs: Mapping[str, TemplateSpec]) -> DataFrame:
    """The templates as a table, one row each; its size is that of ``specs``."""
    rows = [
        (name, dict(s.roles), s.default_role, s.lead_system, s.skip_first, s.separator, s.generation_prompt)
        for name, s in specs.items()
    ]
    return spark.createDataFrame(rows, _SPEC_SCHEMA)


MAX_BROADCAST_TEMPLATES = 10_000


def render_by_template(
    conversations: DataFrame,
    specs: Mapping[str, TemplateSpec],
    default: str,
    template: str = "template",
    messages: str = "messages",
    add_generation_prompt: bool = True,
    is_first: Column | None = None,
    is_last: Column | None = None,
) -> DataFrame:
    """Add ``text``, rendered with the template each row names.

    A null name takes ``default``; an unknown name gives a null text (see
    ``validate.no_template`` for routing such rows away). ``specs`` is a driver
    dict, so the broadcast is bounded by it and checked all the same.
    """
    table = template_table(conversations.sparkSession, specs).select(
        F.col("template").alias("_template"), F.struct("*").alias("_spec")
    )
    if len(specs) <= MAX_BROADCAST_TEMPLATES:
        table = F.broadcast(table)
    named = conversations.withColumn("_template", F.coalesce(F.col(template), F.lit(default)))
    joined = named.join(table, "_template", "left")
    spec = F.col("_spec")

    def affix(role: Column) -> tuple[Column, Column]:
        chosen = F.coalesce(F.try_element_at(spec["roles"], role), spec["default_role"])
        return chosen["before"], chosen["after"]

    text = _render(
        F.col(messages),
        affix,
        (spec["lead_system"]["before"], spec["lead_system"]["after"]),
        spec["lead_system"].isNotNull(),
        spec["skip_first"],
        spec["separator"],
        spec["generation_prompt"] if add_generation_prompt else F.lit(""),
        F.lit(True) if is_first is None else is_first,
        F.lit(True) if is_last is None else is_last,
    )
    return joined.withColumn("text", F.when(spec.isNotNull(), text)).drop("_template", "_spec")
