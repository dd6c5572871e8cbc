"""Row checks that tag rows instead of failing the job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_TYPES = ("style", "info")


def row_reason(
    text: Column,
    kind: Column | None = None,
    template: Column | None = None,
    known_templates: Iterable[str] = (),
    strict_type: bool = True,
) -> Column:
    """Why a row cannot be used, or null when it can; the first reason wins.

    Bytes that are not UTF-8 are a reason; U+FFFD, which is a character like any
    other, is not. With ``strict_type=False`` a wrong line type passes, and is prompted as info.
    """
    reason = F.when(text.isNull() | (text == ""), "missing_text").when(
        ~F.is_valid_utf8(text), "bad_encoding"
    )
    if kind is not None and strict_type:
        reason = reason.when(kind.isNull() | ~kind.isin(*LINE_TYPES), "bad_type")
    if template is not None:
        reason = reason.when(template.isNull() | ~template.isin(*known_templates), "no_template")
    return reason


def split_quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with their ``reason``. Both are lazy filters."""
    tagged = rows.withColumn("reason", reason)
    return (
        tagged.filter(F.col("reason").isNull()).drop("reason"),
        tagged.filter(F.col("reason").isNotNull()),
    )


def missing_fields(required: Sequence[str]) -> Column:
    """Names of the required columns that are null, sorted, joined with ``, ``."""
    return F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in sorted(required)])


# Fixed values: (needle, class), tried in this order.
ERROR_CLASSES = (("404", "not_found"), ("401", "bad_token"))


def error_class(
    msg: Column, classes: Sequence[tuple[str, str]] = ERROR_CLASSES, other: str = "other"
) -> Column:
    """Class of a message by the first needle it contains."""
    (needle, name), *rest = classes
    chosen = F.when(F.contains(msg, F.lit(needle)), name)
    for needle, name in rest:
        chosen = chosen.when(F.contains(msg, F.lit(needle)), name)
    return chosen.otherwise(other)


def count_errors(
    log: DataFrame,
    msg: str,
    classes: Sequence[tuple[str, str]] = ERROR_CLASSES,
    other: str = "other",
) -> DataFrame:
    return (
        log.select(error_class(F.col(msg), classes, other).alias("error_class"))
        .groupBy("error_class")
        .agg(F.count("*").alias("n"))
    )
