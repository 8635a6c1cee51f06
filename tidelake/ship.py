"""The library's code for executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def archive(folder: str) -> str:
    """A zip of the package in a folder."""
    package = Path(__file__).parent
    return shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers of a session, once at its start. Spark serves the file from the driver. The packages
    that pyproject.toml names have to be on the executors."""
    spark.sparkContext.addPyFile(archive(tempfile.mkdtemp(prefix="tidelake-")))
