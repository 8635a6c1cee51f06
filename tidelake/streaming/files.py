"""The incremental load as a stream over a folder of files: the same step as the batch load's, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.rules import clean, exact_distinct
from ..plans.clean import add_new, create_table
from ..plans.spec import TableSpec
from ..sources import store


def add_batch(spark: SparkSession, spec: TableSpec, batch: DataFrame, path: str) -> int:
    """Clean a batch and append the rows that the table does not have; returns their number.

    A batch that is given again, because its commit failed after all or some of its rows were written, adds what is missing.
    Rows that an earlier file had as well add nothing. Late rows are taken, whatever their cursor: a file comes once.
    """
    rows = exact_distinct(clean(batch, spec.rules))
    if store.exists(spark, path):
        return add_new(spark, spec, rows, path)
    staging = store.scratch(spark, f"first-{spec.name}")
    rows.write.parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    n = staged.count()
    if n:
        create_table(spark, spec, staged, path)
    store.delete(spark, staging)
    return n


def load_new_files(spark: SparkSession, spec: TableSpec, folder: str, schema: StructType, path: str, checkpoint: str,
                   files_each: int | None = None) -> None:
    """Clean the files that earlier runs have not seen and append what is new in them; ends when there are no more.

    files_each: so many files at most in a batch, so that a large backlog is taken in parts.
    """
    store.recover(spark, path)
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    query = (reader.parquet(folder).writeStream.foreachBatch(lambda batch, _: add_batch(spark, spec, batch, path) and None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
