"""Style lines from CSV files and knowledge texts from whole TXT files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.functions.text import DEFAULT_MARKER, clean_document
from dialogmill.operators.prompts import knowledge_messages, style_messages
from dialogmill.operators.validate import row_reason, split_quarantine
from dialogmill.sources.csv_files import CSV_OPTIONS, STYLE_COLUMNS, read_style_records
from dialogmill.sources.listing import READ, empty_files, list_files


def split_paths(paths: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """TXT paths, CSV paths, and the skipped rest. Suffixes are case-sensitive."""
    txt = [p for p in paths if p.endswith(".txt")]
    csv = [p for p in paths if p.endswith(".csv")]
    return txt, csv, [p for p in paths if not p.endswith((".txt", ".csv"))]


def read_style_csv_unsplit(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = STYLE_COLUMNS
) -> DataFrame:
    """``(source_path, row_id, speaker, text, type)`` by Spark's own CSV reader.

    No shuffle, but one task per file: for many files of moderate size that
    share the header ``columns`` (another fails the read) and end every line
    the same way. Otherwise use ``read_style_csv``. ``row_id`` rises with the
    row order inside a file and is unique over all files, with gaps.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, encoding="UTF-8", **CSV_OPTIONS)
        .csv(list(paths))
    )
    return rows.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.monotonically_increasing_id().alias("row_id"),
        *[
            F.col(c) if c in columns else F.lit(None).cast("string").alias(c)
            for c in STYLE_COLUMNS
        ],
    )


def read_text_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(source_path, content, valid)``: one row per file, newlines normalised, stripped.

    A byte order mark stays, and so does a written U+FFFD. Bytes that are not UTF-8
    make a file not ``valid``; its content then has U+FFFD in their place.
    """
    raw = F.col("content").cast("string")
    return (
        spark.read.format("binaryFile").options(**READ).load(list(dict.fromkeys(paths)))
        .select(F.col("_metadata.file_path").alias("source_path"), clean_document(raw).alias("content"), F.is_valid_utf8(raw).alias("valid"))
    )


def texts_from_rows(spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """A ``text`` column from a few rows at hand; none give an empty table."""
    return spark.createDataFrame([(r["text"],) for r in rows], "text string")


_MESSAGES = "array<struct<role:string,content:string>>"
CONVERSATION_SCHEMA = f"source_no int, source_path string, row_id bigint, messages {_MESSAGES}"
REJECT_SCHEMA = "source_no int, source_path string, row_id bigint, text string, reason string"


def read_conversations(
    spark: SparkSession,
    paths: Sequence[str],
    system_prompt: str,
    marker: str = DEFAULT_MARKER,
    normalize_type: bool = False,
    keep_empty_files: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Conversations from files of both kinds, rejected rows, skipped paths.

    ``(source_no, source_path, row_id)`` names a row and is the order of the paths
    given, of the files in a folder or glob, and of the rows in each file, however the
    work is split. Rows without text, with broken bytes, or of a record that cannot be
    read are rejected with a reason, so each record is in one of the two tables. A
    path given twice counts twice. No readable path gives empty tables of the same schema.

    Spark's file sources pass over files of zero bytes. They are found in the listing
    and added as empty knowledge texts, unless ``keep_empty_files`` is false.
    """
    txt, csv, skipped = split_paths(paths)
    good, bad = [], []

    def numbered(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.join(list_files(spark, paths, suffix), "source_path", "left")

    if txt:
        files = numbered(read_text_files(spark, txt), ".txt")
        if keep_empty_files:
            empty = empty_files(spark, paths, ".txt")
            files = files.unionByName(empty.select("source_path", F.lit("").alias("content"), F.lit(True).alias("valid"), "source_no"))
        files = files.withColumn("row_id", F.lit(0).cast("long"))
        # a blank file is a valid, if useless, knowledge text
        broken = F.when(F.col("source_no").isNull(), "unlisted_file").when(~F.col("valid"), "bad_encoding")
        ok, rejected = split_quarantine(files, broken)
        good.append(ok.withColumn("messages", knowledge_messages(F.col("content"))))
        bad.append(rejected.withColumnRenamed("content", "text"))
    if csv:
        lines = numbered(read_style_records(spark, csv).withColumnRenamed("reason", "unread"), ".csv")
        why = F.when(F.col("source_no").isNull(), "unlisted_file").otherwise(F.coalesce("unread", row_reason(F.col("text"))))
        ok, rejected = split_quarantine(lines, why)
        good.append(
            ok.withColumn(
                "messages",
                style_messages(F.col("text"), F.col("type"), system_prompt, marker, normalize_type),
            )
        )
        # a record that was not read is kept as it stands in its file
        bad.append(rejected.withColumn("text", F.when(F.col("unread").isNull(), F.col("text")).otherwise(F.col("record"))))

    def union(tables: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema)
        names = out.columns
        picked = [t.select(*names) for t in tables]
        if not picked:
            return out
        return picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])

    return union(good, CONVERSATION_SCHEMA), union(bad, REJECT_SCHEMA), skipped
