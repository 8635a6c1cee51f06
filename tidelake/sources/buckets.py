"""Tables whose files are dealt by a hash of the whole row, so that rows can be looked for without shuffling them.

The hash is a column of its own, ROW, which read() leaves out. A small file beside the data tells the
number of buckets, so any session can take the table up by its path.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW = "_row"
LAYOUT = "_layout.json"
#: A side of a join of at most so many bytes for each bucket is hashed in memory; a larger one is sorted.
HASHED_BYTES = 64 << 20


def row_hash(columns: list[str]) -> Column:
    """Equal for rows that are equal column by column, nulls included."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def _layout(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def buckets_of(spark: SparkSession, path: str) -> int:
    """The number of buckets, 0 for a table without any."""
    fs, p = _layout(spark, path)
    if not fs.exists(p):
        return 0
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["buckets"]
    finally:
        stream.close()


def _registered(spark: SparkSession, path: str, schema: StructType, buckets: int) -> str:
    """The session's name of the table at a path."""
    name = "tidelake_" + hashlib.sha1(path.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({ROW}) into {buckets} buckets location '{path}'")
    return name


def _table(spark: SparkSession, path: str) -> DataFrame:
    """The table with its hash, known as bucketed."""
    schema = spark.read.parquet(path).schema
    name = _registered(spark, path, schema, buckets_of(spark, path))
    spark.catalog.refreshTable(name)
    return spark.table(name)


def create(df: DataFrame, path: str, buckets: int) -> None:
    """Write the rows as a new table at a path that does not exist."""
    spark = df.sparkSession
    hashed = df.withColumn(ROW, row_hash(df.columns))
    name = _registered(spark, path, hashed.schema, buckets)
    fs, p = _layout(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps({"buckets": buckets}).encode()))
    stream.close()
    hashed.repartition(buckets, ROW).write.insertInto(name)


def append(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    old = _table(spark, path)
    name = _registered(spark, path, old.schema, buckets_of(spark, path))
    columns = [c for c in old.columns if c != ROW]
    df.select(*columns).withColumn(ROW, row_hash(columns)).select(*old.columns).repartition(buckets_of(spark, path), ROW).write.insertInto(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path).drop(ROW)


def same_rows(new: DataFrame, path: str, window: Column | None = None) -> DataFrame:
    """The table's rows whose hash a row of new has, within a window. The table is neither shuffled nor sorted; new is dealt to its
    buckets, and held in memory there if its size is known and small enough."""
    spark = new.sparkSession
    old = _table(spark, path)
    if window is not None:
        old = old.filter(window)
    keys = new.select(row_hash([c for c in old.columns if c != ROW]).alias(ROW))
    size = int(new._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size <= HASHED_BYTES * buckets_of(spark, path):
        keys = keys.hint("shuffle_hash")
    return old.join(keys, ROW, "left_semi").drop(ROW)

