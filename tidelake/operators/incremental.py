"""Cursors and the rows beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_cursor(df: DataFrame, column: str) -> str | None:
    """The greatest value as text; None for an empty table.

    Timestamps with a zone become microseconds since the epoch: their text would be in the session's
    zone, where an hour comes twice when clocks go back. All other types keep their text.
    """
    top = F.max(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        top = F.unix_micros(top)
    return df.agg(top.cast("string")).first()[0]


#: Types whose greatest value Parquet's footers tell. Not so for texts (cut), timestamps (kept without order) and numbers with NaN.
IN_FOOTERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def cursor_plan(spark: SparkSession, path: str, column: str) -> DataFrame | None:
    """The greatest value of a column of a Parquet table as text, from the files' footers without reading rows; None if its type
    does not allow it. A session of its own holds the settings, so that others keep theirs."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = own.read.parquet(path)
    if column not in table.columns or not isinstance(table.schema[column].dataType, IN_FOOTERS):
        return None
    return table.agg(F.max(column).alias("last")).select(F.col("last").cast("string").alias("last"))


def last_cursor_at(spark: SparkSession, path: str, column: str, fmt: str = "parquet") -> str | None:
    """last_cursor() of a stored table: from its footers where they tell it, else by reading the column."""
    plan = cursor_plan(spark, path, column) if fmt == "parquet" else None
    return plan.first()[0] if plan is not None else last_cursor(spark.read.format(fmt).load(path), column)


def _limit(kind: T.DataType, last: str) -> Column:
    """The cursor's text as a literal of the column's type."""
    if isinstance(kind, T.TimestampType) and last.lstrip("-").isdigit():
        return F.timestamp_micros(F.lit(int(last)))
    return F.lit(last).cast(kind)


def newer_than(df: DataFrame, column: str, last: str | None, lookback: str | None = None) -> DataFrame:
    """Rows whose cursor is greater than last. None takes all rows.

    lookback (an SQL expression such as "interval 1 hour" or "10") also takes rows that far below,
    or equal to last; the caller drops those that it has. The limit is a literal of the column's
    type, so files and databases get it as a pushed filter.
    """
    if last is None:
        return df
    limit = _limit(df.schema[column].dataType, last)
    if lookback is None:
        return df.filter(F.col(column) > limit)
    return df.filter(F.col(column) >= (limit - F.expr(lookback)).cast(df.schema[column].dataType))


def drop_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of new that are not in old: a null-safe anti join on all columns of new.

    Duplicates within new stay.
    """
    renamed = old.select(*[F.col(f"`{c}`").alias(f"old_{i}") for i, c in enumerate(new.columns)])
    same = F.lit(True)
    for i, c in enumerate(new.columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"old_{i}"))
    return new.join(renamed, same, "left_anti")
