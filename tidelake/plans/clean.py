"""Loads of the clean layer: validated, normalised, without exact duplicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import drop_existing, last_cursor_at, newer_than
from ..operators.rules import clean, exact_distinct
from ..sources import buckets, store
from .spec import TableSpec


@dataclass(frozen=True)
class LoadMetrics:
    table_name: str
    mode: str
    last_cursor: str | None
    read: int
    accepted: int
    inserted: int


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _seen(observed: Observation, df: DataFrame) -> int:
    """The observed number of rows. The optimiser drops observations with parts of a plan that turn out to be empty: then df is counted."""
    try:
        return observed.get["n"]
    except Py4JJavaError:
        return df.count()


def read_table(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """The clean table, whatever its layout."""
    return buckets.read(spark, path) if buckets.buckets_of(spark, path) else store.read(spark, path, spec.fmt)


def create_table(spark: SparkSession, spec: TableSpec, rows: DataFrame, path: str) -> None:
    if spec.buckets and spec.clean_mode == "append" and not store.exists(spark, path):
        buckets.create(rows, path, spec.buckets)
    else:
        store.overwrite(rows, path, spec.fmt)


def add_new(spark: SparkSession, spec: TableSpec, rows: DataFrame, path: str, window: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append the rows that the table does not have, and return their number: the step that batch and stream share.

    The rows are computed once, beside the table, which is not touched if there is nothing new. A run that is repeated after
    a failure adds what is missing and no more. window narrows the table's rows to those that could be among the new ones.
    """
    in_buckets, used = buckets.buckets_of(spark, path) > 0, []

    def staged(df: DataFrame, name: str) -> DataFrame:
        used.append(store.scratch(spark, f"{name}-{spec.name}"))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    if in_buckets:  # the rows are read twice, for the hashes that are looked up and for what is new
        rows = staged(rows, "given")
        c = spec.clean_cursor
        low, high, none = rows.agg(F.min(c), F.max(c), F.count(F.when(F.col(c).isNull(), 1))).first()
        old = buckets.same_rows(rows, path, None if none or low is None else F.col(c).between(low, high))
    else:
        old = store.read(spark, path, spec.fmt)
        old = window(old) if window else old
    fresh, n_rows = _counted(drop_existing(rows, old), "inserted")
    fresh = staged(fresh, "new")
    inserted = _seen(n_rows, fresh)
    if inserted:
        if in_buckets:
            buckets.append(fresh, path)
        else:
            store.append(fresh, path, spec.fmt)
    for staging in used:
        store.delete(spark, staging)
    return inserted


def load_table(spark: SparkSession, spec: TableSpec, raw: DataFrame, path: str) -> LoadMetrics:
    """Load one table. Counts are observed while the rows are written, without passes of their own unless there are none.

    First, or in mode replace, the whole raw table is cleaned. Later the rows beyond the clean
    table's cursor are, and those that it has already are dropped.
    """
    store.recover(spark, path)
    first = not store.exists(spark, path) or spec.clean_mode == "replace"
    last = None if first else last_cursor_at(spark, path, spec.clean_cursor, spec.fmt)
    new = raw if first else newer_than(raw, spec.clean_cursor, last, spec.lookback)
    read, n_read = _counted(new, "read")
    accepted, n_accepted = _counted(clean(read, spec.rules), "accepted")
    rows = exact_distinct(accepted)
    if first:
        rows, n_rows = _counted(rows, "inserted")
        create_table(spark, spec, rows, path)
        return LoadMetrics(spec.name, "full", last, _seen(n_read, new), _seen(n_accepted, clean(new, spec.rules)), _seen(n_rows, read_table(spark, spec, path)))
    # rows of the clean table below the cursor's window cannot be among the new ones
    window = None if last is None else lambda old: newer_than(old, spec.clean_cursor, last, spec.lookback)
    inserted = add_new(spark, spec, rows, path, window)
    return LoadMetrics(spec.name, "appended" if inserted else "unchanged", last, _seen(n_read, new), _seen(n_accepted, clean(new, spec.rules)), inserted)


def load_all(spark: SparkSession, specs: list[TableSpec], raw_root: str, clean_root: str) -> DataFrame:
    """Load all tables in order; one row of metrics for each."""
    done = [load_table(spark, s, store.read(spark, f"{raw_root}/{s.name}", s.fmt), f"{clean_root}/{s.name}") for s in specs]
    return spark.createDataFrame([tuple(asdict(m).values()) for m in done],
                                 "table_name string, mode string, last_cursor string, read long, accepted long, inserted long")
