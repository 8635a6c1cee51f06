"""Loads of many tables side by side, with a ledger of what each run did."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..sources import store
from .clean import LoadMetrics
from .clean import load_table as load_clean
from .raw import load_table as load_raw
from .spec import TableSpec

LEDGER = ("run string, started timestamp, layer string, table_name string, status string, mode string, last_cursor string, "
          "read long, accepted long, inserted long, seconds double, error string")


def parents(specs: list[TableSpec]) -> dict[str, set[str]]:
    """The tables of the list that each refers to, itself left out. A circle of references is an error."""
    names = {s.name for s in specs}
    out = {s.name: {r.table for r in s.constraints.references if r.table in names and r.table != s.name} for s in specs}
    left = dict(out)
    while left:
        free = [n for n, p in left.items() if not p & left.keys()]
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {sorted(left)}")
        for n in free:
            del left[n]
    return out


def run(spark: SparkSession, layer: str, specs: list[TableSpec], load: Callable[[TableSpec], LoadMetrics | str], ledger: str,
        side_by_side: int = 4, run_id: str | None = None) -> DataFrame:
    """Load tables, so many at a time, each after those that it refers to; append a row for each to the ledger and return these.

    A table that fails does not stop the others; those that refer to it are skipped, as their rows would have no parents. Each
    table's jobs have its name as a tag and as their scheduler pool, which shares executors out if the session's scheduler is FAIR.
    status: loaded, failed or skipped.
    """
    run_id, started, before = run_id or uuid.uuid4().hex, datetime.now(timezone.utc), parents(specs)
    done: dict[str, tuple] = {}

    def one(spec: TableSpec) -> tuple:
        began, context = time.time(), spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", spec.name)
        context.addJobTag(f"load-{layer}-{spec.name}")
        try:
            m = load(spec)
            m = m if isinstance(m, LoadMetrics) else LoadMetrics(spec.name, m, None, None, None, None)
            return "loaded", m.mode, m.last_cursor, m.read, m.accepted, m.inserted, time.time() - began, None
        except Exception as error:  # kept in the ledger; the other tables go on
            return "failed", None, None, None, None, None, time.time() - began, f"{type(error).__name__}: {error}"[:2000]
        finally:
            context.removeJobTag(f"load-{layer}-{spec.name}")
            context.setLocalProperty("spark.scheduler.pool", None)

    waiting = {s.name: s for s in specs}
    with ThreadPoolExecutor(side_by_side) as pool:
        running = {}
        while waiting or running:
            for name in [n for n in waiting if before[n] <= done.keys()]:
                spec = waiting.pop(name)
                lost = sorted(p for p in before[name] if done[p][0] != "loaded")
                if lost:
                    done[name] = ("skipped", None, None, None, None, None, 0.0, f"without {', '.join(lost)}")
                else:
                    running[pool.submit(inheritable_thread_target(spark)(one), spec)] = name
            for f in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                done[running.pop(f)] = f.result()
    rows = [(run_id, started, layer, s.name, *done[s.name]) for s in specs]
    out = spark.createDataFrame(rows, LEDGER)
    out.coalesce(1).write.mode("append").parquet(ledger)
    return out


def run_raw(spark: SparkSession, specs: list[TableSpec], source: Callable[[str], DataFrame], root: str, ledger: str, **options) -> DataFrame:
    return run(spark, "raw", specs, lambda s: load_raw(spark, s, source(s.name), f"{root}/{s.name}"), ledger, **options)


def run_clean(spark: SparkSession, specs: list[TableSpec], raw_root: str, clean_root: str, ledger: str, **options) -> DataFrame:
    return run(spark, "clean", specs, lambda s: load_clean(spark, s, store.read(spark, f"{raw_root}/{s.name}", s.fmt), f"{clean_root}/{s.name}"), ledger, **options)


def last_runs(spark: SparkSession, ledger: str, runs: int = 2) -> DataFrame:
    """The ledger's rows of the last runs; a ledger has a few rows for each run."""
    df = spark.read.schema(LEDGER).parquet(ledger)
    return df.join(df.groupBy("run").agg({"started": "max"}).orderBy("max(started)", ascending=False).limit(runs).select("run"), "run", "left_semi")
