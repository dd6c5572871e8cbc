"""Chat formatting as relations: turns become one marked text with a loss mask, and back.

The template writes a block for each run of turns of one role,

    ### role: text</turn>
    text</turn>

with a ``</turn>`` line end after every turn. Control strings inside texts and roles
are escaped, so that neither ``###`` nor ``</turn>`` occurs in them, and reading the
text back gives the same turns. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import settled

HEAD = "### "
HEAD_END = ": "
TURN_END = "</turn>\n"
#: What is escaped, in this order. All codes begin with the escape sign, which is
#: escaped first, so each one found in an escaped text is a whole code.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
#: A role ends where its first colon stands.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Turns of a conversation gathered in one array.
TURNS_PER_PART = 1024
LONG_TO_BROADCAST = 100_000


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns: adjacent turns of one role become one."""
    block = "struct<role:string,texts:array<string>>"
    start = F.struct(F.array().cast(f"array<{block}>").alias("done"), F.lit(None).cast(block).alias("last"))

    def step(state: Column, turn: Column) -> Column:
        own = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        longer = F.struct(turn["role"].alias("role"), F.concat(state["last"]["texts"], F.array(turn["text"])).alias("texts"))
        same = state["last"]["role"] == turn["role"]
        closed = F.when(state["last"].isNull() | same, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        return F.struct(closed.alias("done"), F.when(same, longer).otherwise(own).alias("last"))

    return F.aggregate(turns, start, step, lambda s: F.concat(s["done"], F.array(s["last"])))


def _spans(blocks: Column, headless: Column, loss_role: str) -> Column:
    """Spans (start, length) of the texts under the loss, in characters of the written part."""
    sizes = F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    F.when((k > 0) | ((i == 0) & headless), 0).otherwise(F.length(b["role"]) + len(HEAD) + len(HEAD_END)).alias("head"),
                    F.length(t).alias("length"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + t["head"]).alias("start"), t["length"].alias("length"))
        return F.struct(
            (state["at"] + t["head"] + t["length"] + len(TURN_END)).alias("at"),
            F.when(t["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(sizes, start, step, lambda s: s["spans"])


def _written(blocks: Column, headless: Column) -> Column:
    body = lambda b: F.concat(F.array_join(b["texts"], TURN_END), F.lit(TURN_END))
    head = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(HEAD_END))
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.when((i == 0) & headless, "").otherwise(head(b)), body(b))), "")


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "n")))
    repeated = F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(t["role"].alias("role"), t["text"].alias("text")), t["n"].cast("int"))))
    return rows.groupBy(*keys).agg(turns.alias("turns")).select(*keys, _merged(repeated).alias("blocks"))


def format_turns(
    turns: DataFrame,
    loss_role: str = "assistant",
    turns_per_part: int = TURNS_PER_PART,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows (conv_id, part, formatted, loss_spans): each conversation as one marked text.

    Turns are sorted by number (null first), then role, then text; null roles and
    texts are empty. Spans are places in ``formatted`` of the texts of ``loss_role``.
    A conversation of more than ``turns_per_part`` rows is written in parts by turn
    number, which put together in order are the whole text; rows that are equal in all are
    counted first, so no task gathers more than the different rows of a part. A
    null ``conv_id`` is a conversation of its own. Repeated rows are turns of
    their own; other columns are left out. An empty table gives none.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        escape(F.coalesce(F.col(role), F.lit("")), ROLE_ESCAPES).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        F.lit(1).cast("long").alias("n"),
    )
    own_role = loss_role
    for old, new in ROLE_ESCAPES:
        own_role = own_role.replace(old, new)
    sizes = turns.groupBy(F.col(conv_id).alias("_long")).agg(F.count(F.lit(1)).alias("_n"))
    long = settled(sizes.where(F.col("_n") > turns_per_part).select("_long"), "long-conversations")
    n_long = long.count()
    headless = F.lit(False)
    if not n_long:
        short = _gathered(rows, "conv_id")
        return short.select("conv_id", F.lit(0).cast("long").alias("part"), _written(F.col("blocks"), headless).alias("formatted"), _spans(F.col("blocks"), headless, own_role).alias("loss_spans"))

    long = F.broadcast(long) if n_long <= LONG_TO_BROADCAST else long
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = _gathered(rows.join(long, same, "left_anti"), "conv_id").withColumns({"part": F.lit(0).cast("long"), "headless": headless})
    counted = rows.join(long, same, "left_semi").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # null turns come first and so do negative ones before others
    parts = _gathered(counted.withColumn("part", F.floor(F.col("turn") / turns_per_part)), "conv_id", "part")
    parts = settled(parts, "parts")
    ends = parts.select("conv_id", "part", F.col("blocks")[0]["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"))
    order = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first())
    ends = ends.select(
        F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
        F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)).alias("headless"),
        (F.row_number().over(order) - 1).cast("long").alias("place"),
    )
    numbered = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part")))
    every = short.select("conv_id", "part", "headless", "blocks").unionByName(numbered.select("conv_id", F.col("place").alias("part"), "headless", "blocks"))
    return every.select("conv_id", "part", _written(F.col("blocks"), F.col("headless")).alias("formatted"), _spans(F.col("blocks"), F.col("headless"), own_role).alias("loss_spans"))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns (role, text) of a whole formatted text, as they were before formatting."""
    blocks = F.filter(F.split(F.col(formatted), "###", -1), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        written = F.substring_index(block, HEAD_END, 1)
        body = F.substring(block, F.length(written) + len(HEAD_END) + 1, F.length(block))
        role = unescape(F.substring(written, F.lit(len(HEAD) - 2), F.length(written)), ROLE_ESCAPES)
        texts = F.split(body, TURN_END, -1)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), s["start"] + 1, s["length"]))), "")


def digests(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from ``format_turns``.

    A digest needs its conversation as one value, so parts are put together here;
    a conversation of one part, as nearly all are, is not shuffled again.
    """
    lossy = parts.select("conv_id", "part", "formatted", loss_text().alias("loss"))
    split = settled(parts.where("part > 0").select(F.col("conv_id").alias("_long")).distinct(), "split")
    if not split.isEmpty():
        same = F.col("conv_id").eqNullSafe(F.col("_long"))
        lossy = settled(lossy, "lossy")
        whole = (
            lossy.join(split, same, "left_semi")
            .groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("part", "formatted", "loss"))).alias("p"))
            .select("conv_id", F.array_join(F.col("p.formatted"), "").alias("formatted"), F.array_join(F.col("p.loss"), "").alias("loss"))
        )
        lossy = lossy.join(split, same, "left_anti").select("conv_id", "formatted", "loss").unionByName(whole)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return lossy.withColumn("turns", read_turns()).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
