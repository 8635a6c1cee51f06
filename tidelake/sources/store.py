"""Tables as directories of files, on any file system that Spark can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder: spark.checkpoint.dir, else the context's; a temporary folder of this machine in
    plain local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def format_of(spark: SparkSession, path: str) -> str | None:
    """delta, orc, parquet, or None where there is no table. An empty folder counts as parquet."""
    if not exists(spark, path):
        return None
    if exists(spark, f"{path}/_delta_log"):
        return "delta"
    fs, p = _fs(spark, path)
    return "orc" if any(x.getPath().getName().endswith(".orc") for x in fs.listStatus(p)) else "parquet"


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def _require(spark: SparkSession, path: str, fmt: str) -> None:
    found = format_of(spark, path)
    if found not in (None, fmt):
        raise RuntimeError(f"{path} holds a {found} table, not {fmt}; convert it first")


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", replace_schema: bool = True) -> None:
    """Replace the table, by two moves at the end: a run that fails before them leaves it as it was, and recover() finishes
    them. With replace_schema false, another schema is an error."""
    spark = df.sparkSession
    recover(spark, path)
    _require(spark, path, fmt)
    if not replace_schema and exists(spark, path):
        _same_schema(df, read(spark, path, fmt), path)
    if fmt == "delta":
        df.write.format(fmt).mode("overwrite").option("overwriteSchema", str(replace_schema).lower()).save(path)
    else:
        staged_overwrite(df, path, fmt)


def _same_schema(df: DataFrame, old: DataFrame, path: str) -> None:
    shape = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema]
    if shape(df) != shape(old):
        raise ValueError(f"{path} has columns {shape(old)}, the rows have {shape(df)}")


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows; the schema has to be the table's, which Parquet itself would not check."""
    spark = df.sparkSession
    _require(spark, path, fmt)
    if exists(spark, path):
        _same_schema(df, read(spark, path, fmt), path)
    df.write.format(fmt).mode("append").save(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back a table that a run has left between the two moves of a replacement. True if there was something to put back.

    The new rows are complete by then, so they become the table if their files are whole, else the old ones come back.
    What a dead run has left beside a table that is in place goes.
    """
    fs, p = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    parent = p.getParent()
    if parent is None or not fs.exists(parent):
        return False
    beside = {x.getPath().getName(): x.getPath() for x in fs.listStatus(parent)}
    old = [v for k, v in sorted(beside.items()) if k.startswith(f"{p.getName()}.old-")]
    if not old:
        return False
    if not fs.exists(p):
        token = old[-1].getName().rsplit(".old-", 1)[1]
        fresh = beside.get(f"{p.getName()}.staging-{token}")
        whole = fresh is not None and fs.exists(path_of(fresh, "_SUCCESS"))
        if not fs.rename(fresh if whole else old[-1], p):
            raise OSError(f"cannot put back {path}")
        old = old if whole else old[:-1]
        spark.catalog.refreshByPath(path)
    for x in old:
        fs.delete(x, True)
    return True


def staged_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table by rows that may be computed from it: write beside it, then swap."""
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).save(staging)
    except Exception:
        delete(df.sparkSession, staging)
        raise
    _swap(df.sparkSession, staging, path)


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """Two moves; recover() finishes them if the run ends between them."""
    old = f"{path}.old-{staging.rsplit('.staging-', 1)[1]}"
    fs, p = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p) and not fs.rename(p, path_of(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(path_of(staging), p):
        fs.rename(path_of(old), p)
        raise OSError(f"cannot move {staging} to {path}")
    fs.delete(path_of(old), True)
    spark.catalog.refreshByPath(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions (of the columns by) that the rows have; the files of all others stay. The rows may be computed from
    the table: they are written beside it first. Each partition is replaced by a delete and a move."""
    spark = df.sparkSession
    staging = scratch(spark, "partitions")
    df.write.parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    (staged.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    delete(spark, staging)
    spark.catalog.refreshByPath(path)


def convert(spark: SparkSession, source: str, target: str, from_fmt: str, to_fmt: str) -> int:
    """Write a table in another format and return its rows; a target that has the format is left alone.

    With target = source it is converted in place: written beside, counted, then swapped.
    """
    if format_of(spark, target) == to_fmt:
        return read(spark, target, to_fmt).count()
    _require(spark, source, from_fmt)
    df, staging = read(spark, source, from_fmt), f"{target}.staging-{uuid.uuid4().hex}"
    df.write.format(to_fmt).save(staging)
    before, after = df.count(), read(spark, staging, to_fmt).count()
    if before != after:
        delete(spark, staging)
        raise RuntimeError(f"{source} has {before} rows, {target} would have {after}")
    _swap(spark, staging, target)
    return after


def profile(df: DataFrame, order: str, rows: int = 10) -> tuple[str, int, DataFrame]:
    """Schema, number of rows, and the first rows in the order of a column."""
    return df.schema.treeString(), df.count(), df.orderBy(order).limit(rows)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows for all tables, in one DataFrame."""
    each = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out
