"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of words: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where the setting is absent, a temporary folder of this machine serves in local mode (tests); on
    a cluster its executors would each write to a disk of their own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives the planner the true size,
    so that it broadcasts what is below spark.sql.autoBroadcastJoinThreshold and nothing else.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def slices(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows and bytes of the (text) column at most, or of one row that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (held + size > most_bytes or i - first == most_rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables that materialise() wrote, when what was made of them is written too."""
    for df in tables:
        path = getattr(df, "written_at", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def buckets_for(df: DataFrame, bytes_each: int) -> int:
    """How many hash buckets to deal df into: one for so many bytes of its files, as many as shuffle partitions at least.

    Where the planner does not know a size (rows that are not files), the shuffle partitions decide.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // bytes_each)


def in_file_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table's rows in the order of its files' names and of the rows in them, dealt out by ranges.

    Spark's own read packs files by size. Rows that do not come from files stay as they are.
    """
    rows = df.select(*columns)
    if not df.inputFiles():
        return rows
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return df.select(*columns, *place).repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row").select(*columns)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of tables that are written and no longer referred to.

    It acts when the driver collects garbage, which a driver with a large heap may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # the cleaner works beside the driver


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. translate() is slow, so it gets only what lower() would change beyond A-Z."""
    more = text.rlike("[\\P{ASCII}&&[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}]]")
    plain = (F.octet_length(text) == F.length(text)) | ~more
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space; an empty array where there are none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def key128(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, a key for a whole text."""
    return F.xxhash64(text), F.xxhash64(F.lit("#"), text)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct named row, so that columns that an operator adds cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
