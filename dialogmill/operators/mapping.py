"""A user function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(
    rows: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``fn`` gets each Arrow batch as a pandas frame and returns one of
    ``schema``; columns left out of ``schema`` are removed. Only ``columns``
    are read and sent to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return (rows if columns is None else rows.select(*columns)).mapInPandas(run, schema)


def add_columns(
    rows: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    adds: str,
    columns: Sequence[str],
    remove: Sequence[str] = (),
) -> DataFrame:
    """Add what ``fn`` makes of each batch of ``columns``, and take ``remove`` away.

    ``fn`` returns a frame of the schema ``adds`` with a row for each row it gets.
    Only ``columns`` are sent to Python, once; all others stay where they are, and a column
    of a name in ``adds`` is replaced.
    """

    @F.pandas_udf(adds)
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        made = fn(batch)
        if len(made) != len(batch):
            raise ValueError(f"{len(made)} rows for {len(batch)}")
        return made

    names = [f.name for f in run.returnType.fields]
    kept = [c for c in rows.columns if c not in remove and c not in names]
    made = rows.withColumn("_made", run(F.struct(*columns)))
    return made.select(*kept, *[F.col("_made")[n].alias(n) for n in names])
