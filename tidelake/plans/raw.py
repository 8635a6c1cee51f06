"""Loads of the raw layer: the source's rows, by one of three strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import last_cursor_at, newer_than
from ..sources import store
from .spec import TableSpec


def load_table(spark: SparkSession, spec: TableSpec, source: DataFrame, path: str) -> str:
    """Load one table and say how: full, appended or unchanged.

    A full reload replaces the table in every run. The other strategies copy all rows if there is no
    table yet, and later append the rows beyond the table's greatest cursor: new rows, and new
    versions of changed ones. An empty table has no cursor and takes all rows.
    """
    store.recover(spark, path)
    found = store.format_of(spark, path)
    if found not in (None, spec.fmt):
        raise RuntimeError(f"{path} holds a {found} table, not {spec.fmt}; convert it first")
    if spec.strategy == "full_reload" or found is None:
        store.overwrite(source, path, spec.fmt)
        return "full"
    # the source is read once, beside the table
    new = newer_than(source, spec.cursor, last_cursor_at(spark, path, spec.cursor, spec.fmt))
    staging = store.scratch(spark, f"raw-{spec.name}")
    new.write.parquet(staging)
    staged = spark.read.schema(new.schema).parquet(staging)
    some = not staged.isEmpty()
    if some:
        store.append(staged, path, spec.fmt)
    store.delete(spark, staging)
    return "appended" if some else "unchanged"


def load_all(spark: SparkSession, specs: list[TableSpec], source: Callable[[str], DataFrame], root: str) -> dict[str, str]:
    """Load all tables in order."""
    return {s.name: load_table(spark, s, source(s.name), f"{root}/{s.name}") for s in specs}
