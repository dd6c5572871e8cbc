"""From tables to training rows: the steps above put together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.functions.text import DEFAULT_MARKER, clean_document
from dialogmill.operators.batches import batch_plan, collate, planned_rows
from dialogmill.operators.conversations import TURNS_PER_PART, render_turns
from dialogmill.operators.prompts import knowledge_messages, style_messages
from dialogmill.operators.templates import USER_ASSISTANT, TemplateSpec, render
from dialogmill.operators.tokens import MAX_LENGTH, encode, fixed_length
from dialogmill.operators.vocab import SpecialTokens
from dialogmill.plans.tables import spread_small


def knowledge_rows(documents: DataFrame) -> DataFrame:
    """``(row_key, text)`` from documents ``(doc_id, text)``, text as it is."""
    return documents.select(
        F.concat(F.lit("kb:"), F.col("doc_id").cast("string")).alias("row_key"), "text"
    )


def style_rows(lines: DataFrame) -> DataFrame:
    """``(row_key, text, type)`` from style lines ``(line_key, text, type)``."""
    return lines.select(F.concat(F.lit("style:"), F.col("line_key")).alias("row_key"), "text", "type")


def knowledge_text(rows: DataFrame, spec: TemplateSpec = USER_ASSISTANT) -> DataFrame:
    """Replace ``text`` by the rendered conversation; other columns stay.

    One projection per step: a column used more than once is then computed once.
    """
    kept = [c for c in rows.columns if c != "text"]
    return (
        rows.select(*kept, clean_document(F.col("text")).alias("_body"))
        .select(*kept, knowledge_messages(F.col("_body")).alias("_messages"))
        .select(*kept, render(F.col("_messages"), spec).alias("text"))
    )


def style_text(
    rows: DataFrame,
    system_prompt: str,
    spec: TemplateSpec = USER_ASSISTANT,
    marker: str = DEFAULT_MARKER,
) -> DataFrame:
    """Replace ``text`` and ``type`` by the rendered conversation."""
    kept = [c for c in rows.columns if c not in ("text", "type")]
    messages = style_messages(F.col("text"), F.col("type"), system_prompt, marker)
    return rows.select(*kept, messages.alias("_messages")).select(
        *kept, render(F.col("_messages"), spec).alias("text")
    )


def train_text(
    documents: DataFrame,
    lines: DataFrame,
    system_prompt: str,
    spec: TemplateSpec = USER_ASSISTANT,
    marker: str = DEFAULT_MARKER,
) -> DataFrame:
    """All training texts ``(row_key, text)``. Duplicates stay; ``row_key``
    tells rows apart."""
    return knowledge_text(knowledge_rows(documents), spec).unionByName(
        style_text(style_rows(lines), system_prompt, spec, marker)
    )


def tokenized_rows(
    texts: DataFrame,
    vocab: DataFrame,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
) -> DataFrame:
    """Fixed-length rows with masked labels; ``truncated`` tells whether text
    beyond ``length`` tokens is lost. One narrow stage, no shuffle."""
    encoded = encode(texts, "text", vocab, "row_key", special, max_tokens=length, keep_text=False)
    return fixed_length(
        encoded.withColumn("truncated", F.col("n_tokens") > length), special, length
    )


def conversation_rows(
    turns: DataFrame,
    vocab: DataFrame,
    spec: TemplateSpec = USER_ASSISTANT,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """Fixed-length rows of whole conversations ``(conv_id, turn, role, text)``.

    A long conversation is rendered and encoded in parts. The cut at ``length`` is
    that of the conversation: a running sum of its parts' token counts tells how
    many ids of a part are still inside, and only parts with ids inside are put
    together. The result is the same for any ``turns_per_part``, as a part ends
    between two words. ``n_tokens`` counts the whole conversation.
    """
    parts = render_turns(turns, spec, True, turns_per_part)
    encoded = encode(parts, "text", vocab, "conv_id", special, max_tokens=length, keep_text=False)
    order = Window.partitionBy("conv_id").orderBy("part")
    room = F.greatest(F.lit(length) - F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0)).cast("int")
    kept = encoded.withColumn("_room", room).select("conv_id", "part", "n_tokens", F.slice("ids", F.lit(1), F.col("_room")).alias("ids"))
    whole = kept.groupBy("conv_id").agg(
        F.sum("n_tokens").cast("int").alias("n_tokens"),
        # collected are at most ``length`` parts, as each has an id
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("ids") > 0, F.struct("part", "ids")))), lambda p: p["ids"])).alias("ids"),
    )
    return fixed_length(whole.withColumn("truncated", F.col("n_tokens") > length), special, length)


def _used_rows(documents: DataFrame, lines: DataFrame, system_prompt: str, vocab: DataFrame, seed: int, max_steps: int | None, special: SpecialTokens, length: int) -> DataFrame:
    """Rows of the plan with their ``uses`` and at most ``length`` unpadded ``ids``.

    The plan is made from keys alone. With a step cap it is joined to the raw
    rows, so only rows it uses are cleaned, rendered and tokenized, each once.
    Without one it uses all of them, and meets their ids, so no text is shuffled.
    """
    knowledge, style = knowledge_rows(documents), style_rows(lines)
    plan = batch_plan(
        knowledge.select("row_key").unionByName(style.select("row_key")), "row_key", seed, max_steps
    )
    spread = spread_small(knowledge, "row_key")
    if max_steps is None:
        texts = knowledge_text(spread).unionByName(style_text(style, system_prompt))
        encoded = encode(texts, "text", vocab, "row_key", special, max_tokens=length, keep_text=False)
        return planned_rows(encoded, plan, "row_key")
    used = knowledge_text(planned_rows(spread, plan, "row_key", max_steps)).unionByName(
        style_text(planned_rows(style, plan, "row_key", max_steps), system_prompt)
    )
    return encode(used, "text", vocab, "row_key", special, max_tokens=length, keep_text=False)


def write_steps(used: DataFrame, path: str, buckets: int | None = None) -> str:
    """Write rows with ``uses`` and ``ids`` laid out by step and micro-batch; returns the table's name.

    One exchange here puts each micro-batch into one bucket, and reading it again
    by ``collate_steps`` needs none, however often. One file a bucket below
    ``path``; ``buckets`` is by default the session's number of shuffle partitions.
    """
    spark = used.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"steps_{uuid.uuid4().hex}"
    rows = used.select("ids", F.explode("uses").alias("_use")).select("_use.step", "_use.micro_batch", "_use.slot", "ids")
    laid = rows.repartition(n, "step", "micro_batch")
    laid.write.option("path", path).bucketBy(n, "step", "micro_batch").sortBy("step", "micro_batch", "slot").saveAsTable(name)
    return name


def collate_steps(rows: DataFrame, special: SpecialTokens = SpecialTokens(), length: int = MAX_LENGTH) -> DataFrame:
    """``collate`` of the rows of ``write_steps``, or of a range of their steps, without an exchange."""
    uses = F.array(F.struct("step", "micro_batch", "slot"))
    return collate(rows.select(uses.alias("uses"), "ids", "step", "micro_batch"), special, length, laid_out=True)


def collated_batches(
    documents: DataFrame,
    lines: DataFrame,
    system_prompt: str,
    vocab: DataFrame,
    seed: int = 42,
    max_steps: int | None = None,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
) -> DataFrame:
    """Micro-batches in training order."""
    used = _used_rows(documents, lines, system_prompt, vocab, seed, max_steps, special, length)
    return collate(used, special, length)


def collated_from_steps(
    documents: DataFrame,
    lines: DataFrame,
    system_prompt: str,
    vocab: DataFrame,
    path: str,
    seed: int = 42,
    max_steps: int | None = None,
    special: SpecialTokens = SpecialTokens(),
    length: int = MAX_LENGTH,
) -> DataFrame:
    """The same read from rows laid out by step below ``path``."""
    used = _used_rows(documents, lines, system_prompt, vocab, seed, max_steps, special, length)
    return collate_steps(used.sparkSession.table(write_steps(used, path)), special, length)
