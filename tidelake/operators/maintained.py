"""Stored results that new rows change in place, without computing them from all rows again.

Each table is partitioned, by a column of its own or by PART, a hash of the key. A batch rewrites the partitions of what it
touches; the files of all others stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .sales import AMOUNTS, roll_up, update_headers, validity

PART = "_part"


def part_of(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def _touched(stored: DataFrame, changes: DataFrame, by: str) -> DataFrame:
    """The stored rows of the partitions that changes have. Their values, as many as a table has partitions at most, are literals, so
    that no other partition is listed or read."""
    values = [r[0] for r in changes.select(by).distinct().collect()]
    return stored.filter(F.col(by).isin([v for v in values if v is not None]) | (F.col(by).isNull() if None in values else F.lit(False)))


# ---- headers

def write_back_headers(spark: SparkSession, path: str, sums: DataFrame, by: str) -> int:
    """Update stored headers, partitioned by a column, with the sums of their lines; returns how many change.

    Only partitions with a header whose amounts differ are read in full and rewritten.
    """
    headers = spark.read.parquet(path)
    new = sums.select(F.col("factura_id").alias("_id"), *[F.col(a).alias(f"new_{a}") for a in AMOUNTS])
    differs = reduce(lambda a, b: a | b, [~F.col(f"new_{a}").cast(headers.schema[a].dataType).eqNullSafe(F.col(a)) for a in AMOUNTS])
    staging = store.scratch(spark, "changed-headers")
    headers.join(new, F.col("factura_id") == F.col("_id")).filter(differs).select("factura_id", by).write.parquet(staging)
    changed = spark.read.schema(headers.select("factura_id", by).schema).parquet(staging)
    n = changed.count()
    if n:
        store.replace_partitions(update_headers(_touched(headers, changed, by), sums).select(*headers.columns), path, [by])
    store.delete(spark, staging)
    return n


# ---- sums

def maintain_roll_up(spark: SparkSession, path: str, added: DataFrame, retracted: DataFrame | None = None, parts: int = 64) -> None:
    """Keep the sums and the number of lines of each invoice: lines that are added count, retracted ones (the old versions of changed
    or deleted lines) count no more. An invoice whose last line goes has no row.

    Batches in any order and cut give the sums of all lines at once, as sums of decimals are exact.
    """
    lines = added.withColumn("_sign", F.lit(1))
    if retracted is not None:
        lines = lines.unionByName(retracted.withColumn("_sign", F.lit(-1)))
    signed = lines.withColumn("cantidad", F.col("cantidad") * F.col("_sign")).withColumn("total_linea", F.col("total_linea") * F.col("_sign"))
    change = roll_up(signed).join(lines.groupBy("factura_id").agg(F.sum("_sign").cast("long").alias("lineas")), "factura_id")
    change = change.withColumn(PART, part_of(["factura_id"], parts))
    columns = ["factura_id", *AMOUNTS, "lineas", PART]
    if not store.exists(spark, path):
        store.replace_partitions(change.filter("lineas > 0").select(*columns), path, [PART])
        return
    staging = store.scratch(spark, "sums-change")
    change.select(*columns).write.parquet(staging)
    change = spark.read.schema(change.select(*columns).schema).parquet(staging)
    stored = _touched(spark.read.parquet(path), change, PART).select(*columns)
    total = stored.unionByName(change).groupBy("factura_id", PART).agg(
        *[F.sum(a).cast("decimal(14,2)").alias(a) for a in AMOUNTS], F.sum("lineas").alias("lineas"))
    # a partition whose invoices are all gone keeps a row without lines, or it would not be replaced
    store.replace_partitions(total.filter("lineas <> 0").select(*columns).unionByName(
        change.select(F.lit(None).cast(change.schema["factura_id"].dataType).alias("factura_id"), *[F.lit(None).cast("decimal(14,2)").alias(a) for a in AMOUNTS],
                      F.lit(0).cast("long").alias("lineas"), PART).distinct()), path, [PART])
    store.delete(spark, staging)


def sums_of(spark: SparkSession, path: str) -> DataFrame:
    """The maintained sums: factura_id and the amounts."""
    return spark.read.parquet(path).filter("lineas <> 0").select("factura_id", *AMOUNTS)


# ---- validity ranges

def maintain_ranges(spark: SparkSession, path: str, versions: DataFrame, key: list[str], cursor: str, parts: int = 64) -> None:
    """Merge versions, late and repeated ones included, into stored ranges (valid_from, valid_to): a version that falls into a range
    splits it, and one after the last closes it. Versions of a key are told apart by their cursor and columns.

    Only keys that the batch has are ordered anew, in the partitions that hold them; all other rows of these go through as they are.
    """
    columns = versions.columns
    new = versions.dropDuplicates().withColumn(PART, part_of(key, parts))
    if not store.exists(spark, path):
        store.replace_partitions(validity(new, key, cursor), path, [PART])
        return
    stored = _touched(spark.read.parquet(path), new, PART).select(*columns, "valid_from", "valid_to", PART)
    keys = new.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)]).distinct()
    mine = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(key)])
    again = validity(stored.join(keys, mine, "left_semi").drop("valid_from", "valid_to").unionByName(new).dropDuplicates(), key, cursor)
    store.replace_partitions(stored.join(keys, mine, "left_anti").unionByName(again.select(*stored.columns)), path, [PART])


def ranges_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)
