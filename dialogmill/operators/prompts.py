"""System, user and assistant messages from style lines and knowledge texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions.text import DEFAULT_MARKER, clean_response, strip

# The wording that goes into the training text.
STYLE_PROMPT = "Generate a response"
INFO_PROMPT = "Tell me about yourself"
KNOWLEDGE_PREFIX = "You know the following information: "
KNOWLEDGE_QUESTION = "What do you know about this topic?"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(kind: Column, normalize_type: bool = False) -> Column:
    """Prompt by line type; anything but an exact ``style`` is info, null too."""
    value = strip(kind) if normalize_type else kind
    return F.when(value == "style", STYLE_PROMPT).otherwise(INFO_PROMPT)


def style_messages(
    text: Column,
    kind: Column,
    system_prompt: str,
    marker: str = DEFAULT_MARKER,
    normalize_type: bool = False,
) -> Column:
    return F.array(
        message("system", F.lit(system_prompt)),
        message("user", user_prompt(kind, normalize_type)),
        message("assistant", clean_response(text, marker)),
    )


def knowledge_messages(body: Column) -> Column:
    """Messages from a cleaned text (``clean_document``), which appears twice."""
    return F.array(
        message("system", F.concat(F.lit(KNOWLEDGE_PREFIX), body)),
        message("user", F.lit(KNOWLEDGE_QUESTION)),
        message("assistant", body),
    )
