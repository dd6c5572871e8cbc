"""Style lines from CSV files by Spark's reader; what it cannot read well is a rejected record.

Files may have any headers. The readers of all of them share one schema, as wide as the widest
header and one column more, so that each record comes with its own text, and columns
are picked by each file's header. Bytes are read as they are and checked
field by field. A file whose quoted fields may hold line ends cannot be split, so a
file is one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogmill.session import shared_folder
from dialogmill.sources.listing import READ

STYLE_COLUMNS = ("speaker", "text", "type")
# A doubled quote stands for a quote; Spark's default escape is the backslash.
CSV_OPTIONS = {"quote": '"', "escape": '"', "sep": ",", "multiLine": "true"}
#: One character a byte, so that no byte is lost; fields become UTF-8 again afterwards.
BYTES = "ISO-8859-1"
MARK = "﻿"


def unclosed(record: Column) -> Column:
    """Whether a record ends inside a quoted field.

    Follows the text in front of each quote. State 0 is outside, 1 inside, 2 just after a
    quote met inside, which closes the field unless a quote comes next. Outside, a
    quote opens a field only at its start, that is after a comma.
    """
    pieces = F.split(F.concat(F.lit(","), record), '"', -1)

    def step(state: Column, piece: Column) -> Column:
        opens = F.when(F.endswith(piece, F.lit(",")), 1).otherwise(0)
        return F.when(state == 1, 2).when((state == 2) & (piece == ""), 1).otherwise(opens)

    last = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(0), step)
    return F.when(F.contains(record, F.lit('"')), last == 1).otherwise(False)


def read_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows (source_path, head, width, late): each file's first line that is not blank and its number of columns.

    ``late``: a line of nothing but a carriage return stands before it, which the reader takes for the header.
    """
    line = F.regexp_replace("value", r"\r\z", "")
    lines = (
        spark.read.options(lineSep="\n", **READ).text(list(dict.fromkeys(paths)))
        .where(F.col("_metadata.file_block_start") == 0)
        .select(F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("id"), "value", line.alias("line"))
    )
    place = F.when(F.col("line") != "", F.col("id"))
    first = lines.groupBy("source_path").agg(F.min_by("line", place).alias("head"), F.min(place).alias("at"), F.min(F.when(F.col("value") == "\r", F.col("id"))).alias("cr"))
    head = F.regexp_replace("head", f"^{MARK}", "")
    plain = F.regexp_replace("head", r'"(?:[^"]|"")*"', "")
    return first.where("head IS NOT NULL").select(
        "source_path", head.alias("head"), (F.regexp_count(plain, F.lit(",")) + 1).alias("width"), F.coalesce(F.col("cr") < F.col("at"), F.lit(False)).alias("late")
    )


def _places(head: Column, width: int, columns: Sequence[str] | None) -> list[Column]:
    """Where each style column stands in a header, from 1; 0 when absent."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    fields = F.from_csv(head, F.lit(schema), CSV_OPTIONS)
    cells = F.array(*[fields[f"c{i}"] for i in range(width)])
    found = [F.array_position(cells, F.lit(c)).cast("int") for c in STYLE_COLUMNS]
    if columns:
        same = (F.slice(cells, 1, len(columns)) == F.array(*map(F.lit, columns))) & (F.size(F.array_compact(cells)) == len(columns))
        wrong = F.raise_error(F.concat(F.lit("CSV header does not match in "), F.col("source_path")))
        found = [F.when(F.coalesce(same, F.lit(False)), at).otherwise(wrong.cast("int")) for at in found]
    return [at.alias(f"_at_{c}") for at, c in zip(found, STYLE_COLUMNS)]


def _text(cell: Column) -> Column:
    return F.encode(cell, BYTES).cast("string")


def read_style_records(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (source_path, row_id, speaker, text, type, record, reason), one per record; blank lines are left out.

    ``reason`` is null for a good record. Others, with their text in ``record``, are
    ``unclosed_quote`` (the quoted field goes on to the end of the file),
    ``too_many_fields`` (a field that is not empty beyond the header) and ``bad_encoding``. A
    record of fewer fields than the header has nulls in their place, and so have
    columns that a file lacks. With ``columns`` given, every header must be just
    that, and any other fails the read.

    ``row_id`` rises with the order of records in a file and is unique over all
    files, with gaps. Lines end in LF or CRLF, also mixed.
    """
    headers = read_headers(spark, paths)
    # one row a file, written so that the files' first lines are looked for once
    kept = shared_folder(spark, "headers")
    headers.write.parquet(kept)
    headers = spark.read.schema(headers.schema).parquet(kept)
    widest, late = headers.agg(F.max("width"), F.max("late")).first()
    width = widest or 1
    names = [f"c{i}" for i in range(width + 1)]
    # no header is named like this
    own = f"record_{uuid.uuid4().hex}"
    rows = (
        spark.read.schema(", ".join(f"{n} string" for n in [*names, own]))
        .options(header=True, encoding=BYTES, lineSep="\n", mode="PERMISSIVE", columnNameOfCorruptRecord=own, maxColumns=max(20_480, width + 2), **CSV_OPTIONS, **READ)
        .csv(list(dict.fromkeys(paths)))
        .select(F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("row_id"), F.array(*names).alias("cells"), F.col(own).alias("record"))
        # a record as wide as the schema has no text of its own
        .withColumn("record", F.coalesce("record", F.array_join("cells", ",", "")))
        .where(F.regexp_replace("record", r"[\r\n]+\z", "") != "")
    )
    placed = headers.select("source_path", "width", "late", "head", *_places(F.col("head"), width, columns))
    rows = rows.join(placed, "source_path")
    if late:
        # of such a file the header is among the records
        past = Window.partitionBy("source_path").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
        marked = rows.where("late").withColumn("_head", _text(F.regexp_replace("record", r"\r\z", "")) == F.col("head"))
        after = marked.withColumn("_seen", F.max("_head").over(past)).where("_seen").drop("_head", "_seen")
        rows = rows.where("NOT late").unionByName(after)
    # the carriage return of a line end stands behind the last field, unless that is quoted
    last = ~F.endswith("record", F.lit('"'))

    def field(name: str) -> Column:
        at = F.col(f"_at_{name}")
        cell = F.when(at > 0, F.get("cells", at - 1))
        return _text(F.when((at == F.col("width")) & last, F.nullif(F.regexp_replace(cell, r"\r\z", ""), F.lit(""))).otherwise(cell))

    beyond = F.exists(F.slice("cells", F.col("width") + 1, F.lit(width + 1)), lambda c: F.coalesce(F.regexp_replace(c, r"\r\z", "") != "", F.lit(False)))
    out = rows.select("source_path", "row_id", *[field(c).alias(c) for c in STYLE_COLUMNS], F.encode("record", BYTES).cast("string").alias("record"), unclosed(F.col("record")).alias("_open"), beyond.alias("_beyond"))
    reason = F.when(F.col("_open"), "unclosed_quote").when(F.col("_beyond"), "too_many_fields").when(~F.is_valid_utf8("record"), "bad_encoding")
    return out.withColumn("reason", reason).drop("_open", "_beyond")


def read_style_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The good records of ``read_style_records``: (source_path, row_id, speaker, text, type)."""
    return read_style_records(spark, paths, columns).where("reason IS NULL").select("source_path", "row_id", *STYLE_COLUMNS)
