"""Registered queries over the given tables, each with the SQL that checks it.

Arrays leave a query as an md5 of their joined items, so that results compare
without depending on how an engine prints nested values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.functions.text import (
    PY_WHITESPACE,
    clean_document,
    clean_response,
    cut_at_stop,
    has_marker,
)
from dialogmill.operators import runlog
from dialogmill.operators.batches import batch_plan
from dialogmill.operators.conversations import TURNS_PER_PART, messages_from_turns, render_turns
from dialogmill.operators.mapping import add_columns, map_batches
from dialogmill.operators.prompts import (
    INFO_PROMPT,
    KNOWLEDGE_PREFIX,
    KNOWLEDGE_QUESTION,
    STYLE_PROMPT,
    knowledge_messages,
    style_messages,
)
from dialogmill.operators.templates import HEADER_TOKENS, TEMPLATES, USER_ASSISTANT, render, render_by_template
from dialogmill.operators.tokens import (
    MAX_LENGTH,
    copy_labels,
    encode,
    encode_by_join,
    fixed_length,
)
from dialogmill.operators.validate import count_errors, missing_fields, row_reason
from dialogmill.operators.vocab import WORD_PATTERN, SpecialTokens, learn_vocab
from dialogmill.plans import training
from dialogmill.plans.tables import STEPS_PER_RUN, logged_steps, spread_small, step_log, style_lines, table, table_stream
from dialogmill.session import shared_folder
from dialogmill.sources import files, sinks
from dialogmill.sources.csv_files import read_style_csv, read_style_records
from dialogmill.sources.listing import list_files
from dialogmill.streaming.callbacks import EventLog
from dialogmill.streaming.ordered import latest_attempts, stream_attempts, stream_loss_asof
from dialogmill.streaming.runstate import latest_state, stream_run_state

Query = Callable[[SparkSession, str], DataFrame]

SYSTEM_PROMPT = "You are a friendly assistant."
SEED = 42
MARKER = ". "
STOPS = ("\n", ". ", "?")
ERROR_NEEDLES = (("9", "not_found"), ("4", "bad_token"))
SPECIAL = SpecialTokens()

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function ``<name>_query`` under ``<name>``."""

    def register(fn: Query) -> Query:
        name = fn.__name__.removesuffix("_query")
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return register


# --- SQL fragments -----------------------------------------------------------


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = _quote(PY_WHITESPACE)
NL = "chr(10)"
PAT = _quote(WORD_PATTERN)
CLEAN_DOC = f"trim(regexp_replace(text, '\\r\\n?', {NL}, 'g'), {WS})"
KB_SYSTEM = f"{_quote(KNOWLEDGE_PREFIX)} || {CLEAN_DOC}"
KB_TEXT = (
    f"{KB_SYSTEM} || {NL} || 'USER: ' || {_quote(KNOWLEDGE_QUESTION)} || {NL}"
    f" || 'ASSISTANT: ' || {CLEAN_DOC} || {NL}"
)
LINE_PROMPT = f"CASE WHEN role = 'assistant' THEN {_quote(STYLE_PROMPT)} ELSE {_quote(INFO_PROMPT)} END"
LINE_CLEAN = f"trim(split_part(text, '-éveré', 1), {WS})"
LINE_TEXT = (
    f"{_quote(SYSTEM_PROMPT)} || {NL} || 'USER: ' || {LINE_PROMPT} || {NL}"
    f" || 'ASSISTANT: ' || {LINE_CLEAN} || {NL}"
)
TRAIN_SQL = f"""
SELECT 'kb:' || doc_id AS row_key, {KB_TEXT} AS text FROM documents
UNION ALL
SELECT 'style:' || conv_id || ':' || turn AS row_key, {LINE_TEXT} AS text FROM conversations
"""
VOCAB_CTE = f"""
counts AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, {PAT})) AS token FROM documents)
  GROUP BY token),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + {SPECIAL.reserved - 1} AS INTEGER) AS token_id, token, n
  FROM counts)
"""
ENCODED_CTE = f"""
{VOCAB_CTE},
texts AS ({TRAIN_SQL}),
pieces AS (
  SELECT row_key, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT row_key, regexp_extract_all(text, {PAT}) AS w FROM texts)),
encoded AS (
  SELECT row_key, CAST(count(*) AS INTEGER) AS n_tokens,
         list(coalesce(token_id, {SPECIAL.unk}) ORDER BY pos) AS ids
  FROM pieces LEFT JOIN vocab USING (token) GROUP BY row_key)
"""
FIXED_CTE = f"""
{ENCODED_CTE},
fixed AS (
  SELECT row_key, n_tokens, n_tokens > {MAX_LENGTH} AS truncated,
         list_resize(ids[1:{MAX_LENGTH}], {MAX_LENGTH}, {SPECIAL.pad_id}) AS input_ids,
         list_transform(range(1, {MAX_LENGTH + 1}), lambda i: CASE WHEN i <= n_tokens THEN 1 ELSE 0 END) AS attention_mask
  FROM encoded),
labelled AS (
  SELECT *, list_transform(input_ids, lambda x: CASE WHEN x = {SPECIAL.pad_id} THEN -100 ELSE x END) AS labels
  FROM fixed)
"""
PLAN_CTE = f"""
keys AS (
  SELECT 'kb:' || doc_id AS row_key FROM documents
  UNION ALL SELECT 'style:' || conv_id || ':' || turn FROM conversations),
size AS (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS steps FROM keys),
uses AS (SELECT row_key, 0 AS epoch, steps FROM keys, size),
placed AS (
  SELECT row_key, epoch, steps,
         row_number() OVER (PARTITION BY epoch ORDER BY md5('{SEED}:' || epoch || ':' || row_key), row_key) - 1 AS pos
  FROM uses),
plan AS (
  SELECT row_key, CAST(epoch AS INTEGER) AS epoch, pos, epoch * steps + pos // 32 AS step,
         CAST(pos % 32 // 2 AS INTEGER) AS micro_batch, CAST(pos % 2 AS INTEGER) AS slot
  FROM placed)
"""
STEPS_CTE = f"""
steps AS (
  SELECT event_id // {STEPS_PER_RUN} AS run, event_id % {STEPS_PER_RUN} + 1 AS step, value AS loss
  FROM events),
log AS (SELECT run, step, CASE WHEN step % 10 = 0 THEN loss END AS loss FROM steps)
"""
SEEN_CTE = f"""
{STEPS_CTE},
seen AS (
  SELECT run, step, loss, last_value(loss IGNORE NULLS) OVER (
           PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loss_seen
  FROM log)
"""
STATE_SQL = f"""
WITH {STEPS_CTE}
SELECT run, max(step) AS current_step, max_by(loss, CASE WHEN loss IS NOT NULL THEN step END) AS last_loss,
       min(CASE WHEN loss <= 0.26 THEN step END) AS stop_logged_step,
       0.3::DOUBLE + least(max(step)::DOUBLE / {float(STEPS_PER_RUN)}::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE AS progress
FROM log GROUP BY run
"""


def _list_md5(name: str) -> str:
    return f"md5(array_to_string({name}, ' '))"


def _md5(array: str | Column) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.md5(F.array_join(column.cast("array<string>"), " "))


# --- shared inputs -----------------------------------------------------------


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return learn_vocab(spread_small(table(spark, sf, "documents"), "doc_id"), "text")


def _texts(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    documents = table(spark, sf, "documents")
    return training.train_text(
        spread_small(documents, "doc_id") if spread else documents,
        style_lines(table(spark, sf, "conversations")),
        SYSTEM_PROMPT,
    )


def _contents(messages: Column) -> list[Column]:
    return [messages[i]["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))]


# --- text and messages -------------------------------------------------------


@query(f"SELECT doc_id, contains(text, {_quote(MARKER)}) AS has_marker, "
       f"trim(split_part(text, {_quote(MARKER)}, 1), {WS}) AS cleaned FROM documents")
def clean_text_query(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", has_marker(text, MARKER).alias("has_marker"), clean_response(text, MARKER).alias("cleaned")
    )


@query(f"SELECT doc_id, {KB_SYSTEM} AS system, {_quote(KNOWLEDGE_QUESTION)} AS user, "
       f"{CLEAN_DOC} AS assistant FROM documents")
def kb_documents_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", clean_document(F.col("text")).alias("body"))
    return docs.select("doc_id", knowledge_messages(F.col("body")).alias("m")).select(
        "doc_id", *_contents(F.col("m"))
    )


@query(f"SELECT conv_id, turn, {_quote(SYSTEM_PROMPT)} AS system, {LINE_PROMPT} AS user, "
       f"trim(split_part(text, {_quote(MARKER)}, 1), {WS}) AS assistant FROM conversations")
def style_messages_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "style").otherwise("info")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", style_messages(F.col("text"), kind, SYSTEM_PROMPT, MARKER).alias("m")
    )
    return turns.select("conv_id", "turn", *_contents(F.col("m")))


# --- validation --------------------------------------------------------------


@query("""
SELECT conv_id, turn, CASE WHEN length(text) < 40 THEN 'missing_text'
       WHEN role = 'system' THEN 'bad_type' WHEN conv_id % 3 = 2 THEN 'no_template' END AS reason
FROM conversations
""")
def validate_turns_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.length("text") >= 40, F.col("text")).alias("text"),
        F.when(F.col("role") == "assistant", "style").when(F.col("role") == "user", "info")
        .otherwise("style ").alias("type"),
        F.when(F.col("conv_id") % 3 == 0, "user_assistant").when(F.col("conv_id") % 3 == 1, "headers")
        .otherwise("nowhere").alias("template"),
    )
    reason = row_reason(F.col("text"), F.col("type"), F.col("template"), TEMPLATES)
    return turns.select("conv_id", "turn", reason.alias("reason"))


@query("""
SELECT d.doc_id, concat_ws(', ', CASE WHEN lang IS NULL THEN 'lang' END,
       CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def missing_fields_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", missing_fields(["toxic", "quality", "lang"]).alias("missing")
    )


@query("""
SELECT CASE WHEN contains(props, '9') THEN 'not_found' WHEN contains(props, '4') THEN 'bad_token'
       ELSE 'other' END AS error_class, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY 1
""")
def classify_errors_query(spark: SparkSession, sf: str) -> DataFrame:
    errors = table(spark, sf, "events").filter(F.col("event_type") == "error")
    return count_errors(errors, "props", ERROR_NEEDLES)


# --- templates ---------------------------------------------------------------

_PART = f"turn // {TURNS_PER_PART}"
_FIRST = "turn = min(turn) OVER (PARTITION BY conv_id)"
_UA_PIECE = (
    f"CASE WHEN is_first THEN CASE WHEN role = 'system' THEN text || {NL} ELSE '' END "
    f"WHEN role = 'user' THEN 'USER: ' || text || {NL} ELSE 'ASSISTANT: ' || text || {NL} END"
)
_HEADER_PIECE = (
    f"'<|start_header_id|>' || CASE WHEN role IN ('system', 'user') THEN role ELSE 'assistant' END"
    f" || '<|end_header_id|>' || {NL} || text || '<|eot_id|>'"
)
_TURNS_CTE = f"turns AS (SELECT *, {_PART} AS part, {_FIRST} AS is_first FROM conversations)"
_HEADER_END = f"{NL} || '<|start_header_id|>assistant<|end_header_id|>' || {NL}"


@query(f"""
WITH {_TURNS_CTE}
SELECT conv_id, part, CAST(count(*) AS INTEGER) AS n_messages,
       md5(string_agg(role || ':' || text, {NL} ORDER BY turn)) AS digest
FROM turns GROUP BY conv_id, part
""")
def conv_messages_query(spark: SparkSession, sf: str) -> DataFrame:
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return messages_from_turns(table(spark, sf, "conversations")).select(
        "conv_id", "part", F.size("messages").alias("n_messages"), F.md5(joined).alias("digest")
    )


@query(f"""
WITH {_TURNS_CTE}
SELECT conv_id, part, string_agg({_UA_PIECE}, '' ORDER BY turn) AS text FROM turns GROUP BY conv_id, part
""")
def render_user_assistant_query(spark: SparkSession, sf: str) -> DataFrame:
    return render_turns(table(spark, sf, "conversations"), USER_ASSISTANT)


@query(f"""
WITH {_TURNS_CTE}
SELECT conv_id, part, string_agg({_HEADER_PIECE}, {NL} ORDER BY turn) || {_HEADER_END} AS text
FROM turns GROUP BY conv_id, part
""")
def render_headers_query(spark: SparkSession, sf: str) -> DataFrame:
    return render_turns(table(spark, sf, "conversations"), HEADER_TOKENS)


@query(f"""
WITH {_TURNS_CTE}
SELECT conv_id, part, CASE conv_id % 3 WHEN 0 THEN 'user_assistant' WHEN 1 THEN 'headers' END AS template,
       CASE WHEN conv_id % 3 = 1 THEN string_agg({_HEADER_PIECE}, {NL} ORDER BY turn) || {_HEADER_END}
            ELSE string_agg({_UA_PIECE}, '' ORDER BY turn) END AS text
FROM turns GROUP BY conv_id, part
""")
def render_by_template_query(spark: SparkSession, sf: str) -> DataFrame:
    conversations = messages_from_turns(table(spark, sf, "conversations")).withColumn(
        "template",
        F.when(F.col("conv_id") % 3 == 0, "user_assistant").when(F.col("conv_id") % 3 == 1, "headers"),
    )
    rendered = render_by_template(
        conversations, TEMPLATES, "user_assistant", is_first=F.col("is_first"), is_last=F.col("is_last")
    )
    return rendered.select("conv_id", "part", "template", "text")


@query(f"""
SELECT doc_id, split_part(split_part(split_part(text, {NL}, 1), '. ', 1), '?', 1) AS text FROM documents
""")
def cut_at_stop_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", cut_at_stop(F.col("text"), STOPS).alias("text"))


@query(TRAIN_SQL)
def train_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf)


# --- tokens ------------------------------------------------------------------


@query(f"WITH {VOCAB_CTE} SELECT token_id, token, n FROM vocab")
def vocab_query(spark: SparkSession, sf: str) -> DataFrame:
    return _vocab(spark, sf)


@query(f"WITH {VOCAB_CTE} SELECT count(*) + {SPECIAL.reserved} AS vocab_size FROM vocab")
def vocab_size_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "vocab")
    sinks.write_with_size(_vocab(spark, sf), f"{folder}/vocab", f"{folder}/size", "vocab_size", SPECIAL.reserved)
    return spark.read.parquet(f"{folder}/size")


_TOKENIZED_SQL = f"WITH {ENCODED_CTE} SELECT row_key, n_tokens, {_list_md5('ids')} AS ids_md5 FROM encoded"


@query(_TOKENIZED_SQL)
def tokenized_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode(_texts(spark, sf, spread=True), "text", _vocab(spark, sf), "row_key", keep_text=False)
    return rows.select("row_key", "n_tokens", _md5("ids").alias("ids_md5"))


@query(_TOKENIZED_SQL)
def tokenized_by_join_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode_by_join(_texts(spark, sf, spread=True), "text", _vocab(spark, sf), "row_key", keep_text=False)
    return rows.select("row_key", "n_tokens", _md5("ids").alias("ids_md5"))


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode(_texts(spark, sf, spread=True), "text", _vocab(spark, sf), "row_key", max_tokens=MAX_LENGTH, keep_text=False)
    return fixed_length(rows)


@query(f"""
WITH {FIXED_CTE}
SELECT row_key, n_tokens, truncated, {_list_md5('input_ids')} AS input_md5,
       {_list_md5('attention_mask')} AS mask_md5 FROM fixed
""")
def pad_trunc_query(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).select(
        "row_key",
        "n_tokens",
        (F.col("n_tokens") > MAX_LENGTH).alias("truncated"),
        _md5("input_ids").alias("input_md5"),
        _md5("attention_mask").alias("mask_md5"),
    )


@query(f"""
WITH {FIXED_CTE}
SELECT row_key, {_list_md5('input_ids')} AS copied_md5, {_list_md5('labels')} AS masked_md5 FROM labelled
""")
def labels_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixed(spark, sf)
    return rows.select("row_key", _md5("labels").alias("masked_md5"), "input_ids").transform(
        copy_labels
    ).select("row_key", _md5("labels").alias("copied_md5"), "masked_md5")


@query(f"""
WITH {VOCAB_CTE},
turns AS (SELECT *, {_FIRST} AS is_first FROM conversations),
whole AS (SELECT conv_id, string_agg({_UA_PIECE}, '' ORDER BY turn) AS text FROM turns GROUP BY conv_id),
pieces AS (
  SELECT conv_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT conv_id, regexp_extract_all(text, {PAT}) AS w FROM whole)),
encoded AS (
  SELECT conv_id, CAST(count(*) AS INTEGER) AS n_tokens, list(coalesce(token_id, {SPECIAL.unk}) ORDER BY pos) AS ids
  FROM pieces LEFT JOIN vocab USING (token) GROUP BY conv_id)
SELECT conv_id, n_tokens, n_tokens > {MAX_LENGTH} AS truncated,
       md5(array_to_string(list_resize(ids[1:{MAX_LENGTH}], {MAX_LENGTH}, {SPECIAL.pad_id}), ' ')) AS input_md5
FROM encoded
""")
def conv_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations encoded in parts of two turns; the SQL knows of no parts."""
    rows = training.conversation_rows(table(spark, sf, "conversations"), _vocab(spark, sf), turns_per_part=2)
    return rows.select("conv_id", "n_tokens", "truncated", _md5("input_ids").alias("input_md5"))


# --- batches -----------------------------------------------------------------


@query(f"WITH {PLAN_CTE} SELECT row_key, epoch, pos, step, micro_batch, slot FROM plan")
def batch_plan_query(spark: SparkSession, sf: str) -> DataFrame:
    return batch_plan(_texts(spark, sf), "row_key", SEED)


_COLLATED_SQL = f"""
WITH {FIXED_CTE}, {PLAN_CTE},
digests AS (SELECT row_key, {_list_md5('input_ids')} AS i, {_list_md5('labels')} AS l FROM labelled)
SELECT step, micro_batch, CAST(count(*) AS INTEGER) AS n_rows,
       string_agg(i, ' ' ORDER BY slot) AS inputs, string_agg(l, ' ' ORDER BY slot) AS labels
FROM plan JOIN digests USING (row_key) GROUP BY step, micro_batch
"""


def _batch_digests(batches: DataFrame) -> DataFrame:
    return batches.select(
        "step",
        "micro_batch",
        F.size("rows").alias("n_rows"),
        F.array_join(F.transform("rows", lambda r: _md5(r["input_ids"])), " ").alias("inputs"),
        F.array_join(F.transform("rows", lambda r: _md5(r["labels"])), " ").alias("labels"),
    )


def _batch_inputs(spark: SparkSession, sf: str) -> tuple:
    return table(spark, sf, "documents"), style_lines(table(spark, sf, "conversations")), SYSTEM_PROMPT, _vocab(spark, sf)


@query(_COLLATED_SQL)
def collated_query(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_digests(training.collated_batches(*_batch_inputs(spark, sf), SEED))


@query(_COLLATED_SQL)
def collated_from_steps_query(spark: SparkSession, sf: str) -> DataFrame:
    return _batch_digests(training.collated_from_steps(*_batch_inputs(spark, sf), shared_folder(spark, "steps"), SEED))


# --- run logs ----------------------------------------------------------------


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return step_log(table(spark, sf, "events"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return logged_steps(table(spark, sf, "events"))


@query(f"""
WITH {STEPS_CTE}
SELECT run, CAST(ceil(step / 10.0) * 10 AS BIGINT) AS block_end, round(avg(loss), 6) AS mean_loss, count(loss) AS n
FROM steps GROUP BY 1, 2
""")
def loss_blocks_query(spark: SparkSession, sf: str) -> DataFrame:
    # rounded, as the order of a floating sum is not fixed
    return runlog.loss_blocks(_steps(spark, sf)).withColumn("mean_loss", F.round("mean_loss", 6))


@query(f"WITH {SEEN_CTE} SELECT run, step, loss, loss_seen FROM seen")
def loss_asof_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.loss_asof(_log(spark, sf))


@query(f"""
WITH {SEEN_CTE}
SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS idx, step, loss_seen AS loss
FROM seen WHERE loss_seen IS NOT NULL
""")
def loss_series_query(spark: SparkSession, sf: str) -> DataFrame:
    seen = runlog.loss_asof(_log(spark, sf))
    return runlog.series_rows(runlog.loss_series(seen, "loss_seen"))


_STOP_CTE = f"""
{STEPS_CTE},
stops AS (
  SELECT run, min(CASE WHEN loss <= 0.26 THEN step END) AS stop_logged_step, max(step) AS last_step
  FROM log GROUP BY run),
seen_stops AS (
  SELECT run, stop_logged_step,
         CASE WHEN stop_logged_step < last_step THEN stop_logged_step + 1 END AS stop_seen_step, last_step
  FROM stops)
"""


@query(f"WITH {_STOP_CTE} SELECT run, stop_logged_step, stop_seen_step, last_step FROM seen_stops")
def early_stop_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.early_stop(_log(spark, sf))


@query(f"""
WITH {_STOP_CTE}
SELECT log.run, step, loss FROM log JOIN seen_stops s ON log.run = s.run
WHERE s.stop_seen_step IS NULL OR step <= s.stop_seen_step
""")
def steps_until_stop_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.steps_until_stop(_log(spark, sf)).select("run", "step", "loss")


@query(f"""
WITH {STEPS_CTE},
f AS (SELECT run, max_by(loss, CASE WHEN loss IS NOT NULL THEN step END) AS final_loss FROM log GROUP BY run)
SELECT run, final_loss, coalesce('Training completed: Final loss ' || printf('%.4f', final_loss),
       'Training completed (loss not recorded)') AS status FROM f
""")
def final_loss_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.final_loss(_log(spark, sf))


@query(f"""
WITH {STEPS_CTE}
SELECT run, step, 0.3::DOUBLE + least(step::DOUBLE / {float(STEPS_PER_RUN)}::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE AS progress
FROM steps
""")
def run_progress_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_progress(_steps(spark, sf), STEPS_PER_RUN).select("run", "step", "progress")


@query(f"""
WITH {SEEN_CTE}
SELECT run, step, printf('Step %d/{STEPS_PER_RUN} | Loss: %.4f', step, loss_seen) AS status
FROM seen WHERE loss_seen IS NOT NULL
""")
def run_status_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_status(runlog.loss_asof(_log(spark, sf)), STEPS_PER_RUN)


@query("""
SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS stage, arg_max(value, (ts, event_id)) AS progress
FROM events GROUP BY user_id
""")
def latest_stage_query(spark: SparkSession, sf: str) -> DataFrame:
    writes = table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("progress"),
        "ts",
        F.col("event_id").alias("id"),
    )
    return runlog.latest_stage(writes)


@query(STATE_SQL)
def run_state_query(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_state(_log(spark, sf), STEPS_PER_RUN)


@query(STATE_SQL)
def stream_run_state_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "run-state")
    events = table_stream(spark, sf, "events")
    stream_run_state(logged_steps(events), STEPS_PER_RUN, folder)
    return latest_state(spark.read.parquet(f"{folder}/state"))


ATTEMPT_STEPS, ATTEMPT_RUNS = 200, 7


def _attempts(events: DataFrame) -> DataFrame:
    """Events as attempts of a few runs, whose ids come again and again."""
    return events.select(
        F.expr(f"event_id div {ATTEMPT_STEPS} % {ATTEMPT_RUNS}").alias("run"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % ATTEMPT_STEPS + 1).alias("step"),
        F.when(F.col("event_id") % 10 == 9, F.col("value")).alias("loss"),
    )


_ATTEMPTS_SQL = f"""
WITH e AS (
  SELECT event_id // {ATTEMPT_STEPS} % {ATTEMPT_RUNS} AS run, event_id AS seq, event_id % {ATTEMPT_STEPS} + 1 AS step,
         CASE WHEN event_id % 10 = 9 THEN value END AS loss FROM events),
b AS (SELECT run, max(seq) FILTER (step = 1) AS begins, count(*) FILTER (step = 1) AS attempt FROM e GROUP BY run)
SELECT e.run, any_value(attempt) AS attempt, max(step) AS current_step, max_by(loss, CASE WHEN loss IS NOT NULL THEN step END) AS last_loss,
       min(CASE WHEN loss <= 5.0 THEN step END) AS stop_logged_step,
       0.3::DOUBLE + least(max(step)::DOUBLE / {float(ATTEMPT_STEPS)}::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE AS progress
FROM e JOIN b ON e.run = b.run WHERE begins IS NULL OR seq >= begins GROUP BY e.run
"""


@query(_ATTEMPTS_SQL)
def run_attempts_query(spark: SparkSession, sf: str) -> DataFrame:
    return latest_attempts(_attempts(table(spark, sf, "events")), ATTEMPT_STEPS, 5.0)


@query(_ATTEMPTS_SQL)
def stream_attempts_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "attempts")
    stream_attempts(_attempts(table_stream(spark, sf, "events")), ATTEMPT_STEPS, folder, 5.0)
    return latest_state(spark.read.parquet(f"{folder}/attempts")).drop("n_late")


@query(f"""
WITH {SEEN_CTE}
SELECT run, step, loss, loss_seen, coalesce(step = min(step) FILTER (loss_seen <= 5.0) OVER (PARTITION BY run), false) AS stops FROM seen
""")
def stream_loss_asof_query(spark: SparkSession, sf: str) -> DataFrame:
    """The log as files in no order, and a row of the far future behind them that lets all of it go."""
    folder = shared_folder(spark, "asof")
    rows = logged_steps(table(spark, sf, "events").withColumn("event_id", F.col("event_id").cast("long"))).withColumn(
        "ts", F.timestamp_seconds(F.col("run") * STEPS_PER_RUN + F.col("step"))
    )
    rows.repartition(3, "step").write.parquet(f"{folder}/in")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("step"), F.lit(None).cast("double").alias("loss"), F.lit("2200-01-01").cast("timestamp").alias("ts"))
    end.write.mode("append").parquet(f"{folder}/in")
    log = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stream_loss_asof(log, folder, "50000 days", 5.0)
    return spark.read.parquet(f"{folder}/asof").drop("batch_id").where("run >= 0")


@query("""
SELECT 'begin' AS kind, 1::BIGINT AS n, CAST(NULL AS BIGINT) AS n_rows, true AS fine UNION ALL
SELECT 'step', 1, count(*), true FROM events HAVING count(*) > 0 UNION ALL SELECT 'end', 1, NULL, true
""")
def stream_events_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "events")
    name = f"events_{folder.rsplit('-', 1)[1]}"
    log = EventLog({name})
    spark.streams.addListener(log)
    try:
        stream_run_state(logged_steps(table_stream(spark, sf, "events")), STEPS_PER_RUN, folder, name=name)
        log.write(spark, f"{folder}/log")
    finally:
        spark.streams.removeListener(log)
    return spark.read.parquet(f"{folder}/log").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"), F.every(F.col("error").isNull()).alias("fine"))


# --- files and user functions ------------------------------------------------

_LINE_TYPE = "CASE WHEN role = 'assistant' THEN 'style' ELSE 'info' END"


def _csv_folder(spark: SparkSession, sf: str) -> str:
    folder = f"{shared_folder(spark, 'style')}.csv"
    sinks.write_style_csv(style_lines(table(spark, sf, "conversations")), folder)
    return folder


@query(f"SELECT role AS speaker, text, {_LINE_TYPE} AS type FROM conversations")
def src_style_csv_query(spark: SparkSession, sf: str) -> DataFrame:
    return read_style_csv(spark, [_csv_folder(spark, sf)]).select("speaker", "text", "type")


@query(f"SELECT role AS speaker, text, {_LINE_TYPE} AS type FROM conversations")
def src_style_csv_unsplit_query(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_style_csv_unsplit(spark, [_csv_folder(spark, sf)]).select("speaker", "text", "type")


def _knowledge_folder(spark: SparkSession, sf: str, text: Column | None = None) -> str:
    """The benchmark's texts as files, one below a folder ``item_id=N`` each."""
    folder = f"{shared_folder(spark, 'knowledge')}.txt"
    rows = table(spark, sf, "benchmark").select("item_id", (F.col("text") if text is None else text).alias("value"))
    rows.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(folder)
    return folder


def _item_id() -> Column:
    return F.regexp_extract("source_path", "item_id=(-?[0-9]+)", 1).try_cast("long")


@query(f"""
SELECT 0 AS source_no, item_id, {KB_TEXT} AS text FROM benchmark
UNION ALL SELECT 1 AS source_no, NULL AS item_id, {LINE_TEXT} AS text FROM conversations
""")
def src_mixed_query(spark: SparkSession, sf: str) -> DataFrame:
    conversations, _, _ = files.read_conversations(
        spark, [_knowledge_folder(spark, sf), _csv_folder(spark, sf), "notes.md"], SYSTEM_PROMPT
    )
    return conversations.select("source_no", _item_id().alias("item_id"), render(F.col("messages"), USER_ASSISTANT).alias("text"))


@query("""
SELECT 0 AS source_no, item_id FROM benchmark WHERE item_id % 10 = 3 UNION ALL
SELECT 1, item_id FROM benchmark UNION ALL
SELECT 2, item_id FROM benchmark WHERE CAST(item_id AS VARCHAR) LIKE '_'
""")
def src_paths_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = _knowledge_folder(spark, sf)
    return list_files(spark, [f"{folder}/item_id=*3", folder, f"{folder}/item_id=?/part-*"]).select("source_no", _item_id().alias("item_id"))


BROKEN = {0: "FF", 2: "61C3"}  # a byte that no text has, and a character cut short


@query(f"""
SELECT item_id, CASE WHEN item_id % 4 IN (0, 2) THEN 'bad_encoding' END AS reason,
       CASE WHEN item_id % 4 IN (1, 3) THEN md5({CLEAN_DOC}) END AS text_md5
FROM (SELECT item_id, CASE WHEN item_id % 4 = 1 THEN text || chr(65533) ELSE text END AS text FROM benchmark)
""")
def src_bytes_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("item_id") % 4
    tail = F.when(kind == 0, F.unhex(F.lit(BROKEN[0]))).when(kind == 2, F.unhex(F.lit(BROKEN[2]))).when(kind == 1, F.encode(F.lit("\ufffd"), "UTF-8")).otherwise(F.unhex(F.lit("")))
    folder = _knowledge_folder(spark, sf, F.concat(F.encode("text", "UTF-8"), tail).cast("string"))
    texts = files.read_text_files(spark, [folder])
    reason = F.when(~F.col("valid"), "bad_encoding")
    return texts.select(_item_id().alias("item_id"), reason.alias("reason"), F.when(F.col("valid"), F.md5("content")).alias("text_md5"))


@query("""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id DESC, turn DESC) = 1 AS last_one FROM conversations),
r AS (
  SELECT *, CASE WHEN last_one THEN 'unclosed_quote' WHEN conv_id % 10 = 3 THEN 'too_many_fields' WHEN conv_id % 10 = 5 THEN 'bad_encoding' END AS reason FROM t)
SELECT conv_id || ':' || turn AS speaker, reason, CASE WHEN reason IS NULL THEN md5(text) END AS text_md5, CASE WHEN reason IS NULL THEN role END AS type
FROM r
""")
def src_csv_rejects_query(spark: SparkSession, sf: str) -> DataFrame:
    """Files of twenty columns, each hundred conversations a file, with faults in some records and an open quote at each end."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.expr("conv_id div 100").alias("file"))
    fault = F.col("conv_id") % 10
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')))
    tail = F.when(fault == 5, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))).cast("string")
    start = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn"), F.lit("," * 18), quoted)
    end = F.concat(tail, F.lit('",'), F.col("role"), F.when(fault == 3, ",more").otherwise(""))
    record = F.struct("conv_id", "turn", start.alias("start"), end.alias("end"))
    # (conv_id, turn) is a key, so a file's records are those of a hundred conversations
    gathered = turns.groupBy("file").agg(F.array_sort(F.collect_list(record)).alias("r"))
    header = ",".join(["speaker", *(f"c{i}" for i in range(17)), "text", "type"])
    lines = F.transform("r", lambda x, i: F.concat(x["start"], F.when(i < F.size("r") - 1, x["end"]).otherwise("")))
    folder = f"{shared_folder(spark, 'faulty')}.csv"
    gathered.select("file", F.concat(F.lit(header + "\n"), F.array_join(lines, "\n")).alias("value")).repartition("file").write.partitionBy("file").option("lineSep", "\n").text(folder)
    good = F.col("reason").isNull()
    return read_style_records(spark, [folder]).select("speaker", "reason", F.when(good, F.md5("text")).alias("text_md5"), F.when(good, F.col("type")).alias("type"))


@query("SELECT doc_id, lang, CAST(length(nfc_normalize(text)) AS BIGINT) AS n_chars, md5(nfc_normalize(text)) AS nfc_md5 FROM documents")
def map_batches_query(spark: SparkSession, sf: str) -> DataFrame:
    """Composed characters, which Spark has no function for; only the text goes to Python and is taken away behind it."""

    def compose(batch: pd.DataFrame) -> pd.DataFrame:
        composed = batch["text"].str.normalize("NFC")
        return pd.DataFrame({"n_chars": composed.str.len(), "nfc": composed})

    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    made = add_columns(documents, compose, "n_chars long, nfc string", ["text"], ["text"])
    return made.select("doc_id", "lang", "n_chars", F.md5("nfc").alias("nfc_md5"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def map_groups_query(spark: SparkSession, sf: str) -> DataFrame:
    """A function that returns fewer rows than it gets: counts of each batch, added up behind it."""
    counted = map_batches(
        table(spark, sf, "documents"),
        lambda pdf: pdf.groupby("lang", dropna=False).size().rename("n").reset_index(),
        "lang string, n bigint",
        ["lang"],
    )
    return counted.groupBy("lang").agg(F.sum("n").alias("n"))


@query(f"WITH {FIXED_CTE} SELECT row_key, {_list_md5('input_ids')} AS input_md5, "
       f"{_list_md5('labels')} AS label_md5 FROM labelled")
def token_shards_query(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    rows = training.tokenized_rows(_texts(spark, sf, spread=True), _vocab(spark, sf))
    sinks.write_tokens(rows, folder, MAX_LENGTH)
    return spark.read.parquet(folder).select(
        "row_key", _md5("input_ids").alias("input_md5"), _md5("labels").alias("label_md5")
    )


SHARD_TEST_BYTES = 1 << 18


@query(f"SELECT row_key, md5(text) AS text_md5, true AS in_bound FROM ({TRAIN_SQL})")
def text_shards_query(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in shards of few bytes; ``in_bound``: the shard is no larger, or is one row."""
    folder = shared_folder(spark, "texts")
    sinks.write_shards(_texts(spark, sf), folder, max_bytes=SHARD_TEST_BYTES)
    rows = spark.read.schema("row_key string, text string, shard string").json(folder).withColumn("_size", F.col("_metadata.file_size"))
    shards = rows.groupBy("shard").agg(F.countDistinct("_metadata.file_path").alias("files"), F.max("_size").alias("size"), F.count(F.lit(1)).alias("n"))
    bound = (F.col("files") == 1) & ((F.col("size") <= SHARD_TEST_BYTES) | (F.col("n") == 1))
    return rows.join(shards.select("shard", bound.alias("in_bound")), "shard").select("row_key", F.md5("text").alias("text_md5"), "in_bound")


@query(f"""
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, md5({LINE_TEXT}) AS text_md5 FROM conversations
""")
def ordered_shards_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("type", F.when(F.col("role") == "assistant", "style").otherwise("info"))
    texts = training.style_text(turns.drop("role"), SYSTEM_PROMPT)
    folder = shared_folder(spark, "ordered")
    sinks.write_shards(texts, folder, ("conv_id", "turn"), SHARD_TEST_BYTES)
    return sinks.read_shards(spark, folder, "conv_id long, turn long, text string").select("conv_id", "turn", "place", F.md5("text").alias("text_md5"))
