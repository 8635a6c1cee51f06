"""Streams, buckets, recovery and declared constraints on small fixtures."""

import pytest
from pyspark.sql import functions as F
from test_retail import rows

from tidelake.operators import checks
from tidelake.operators.checks import Constraints, Reference
from tidelake.operators.incremental import drop_existing
from tidelake.operators.rules import AtLeast, Normalise, NotNull
from tidelake.plans import clean as clean_layer
from tidelake.plans.registry import INVOICE_STATES, TABLES
from tidelake.plans.spec import TableSpec
from tidelake.sources import buckets, store
from tidelake.streaming.files import add_batch, load_new_files

RULES = (NotNull("id"), Normalise("upper", "x"), AtLeast("n"))
PLAIN = TableSpec("t", ("id",), "incremental_id", RULES, cursor="id", clean_cursor="id")
BUCKETS = TableSpec("t", ("id",), "incremental_id", RULES, cursor="id", clean_cursor="id", buckets=3)
SCHEMA = "id long, x string, n int"


@pytest.mark.parametrize("spec", [PLAIN, BUCKETS])
def test_a_replayed_batch_adds_what_is_missing(spark, tmp_path, spec):
    """The append ended, or got half way, and the batch's commit did not: the batch is given again."""
    path = f"{tmp_path}/clean"
    first = spark.createDataFrame([(1, "a ", 1), (2, None, 2), (2, None, 2)], SCHEMA)
    batch = spark.createDataFrame([(3, "c", 1), (4, "d", 2), (1, "A", 1), (5, "e", -1)], SCHEMA)
    assert add_batch(spark, spec, first, path) == 2
    half = spark.createDataFrame([(3, "C", 1)], SCHEMA)
    buckets.append(half, path) if spec.buckets else store.append(half, path)
    assert add_batch(spark, spec, batch, path) == 1
    assert add_batch(spark, spec, batch, path) == 0
    assert rows(clean_layer.read_table(spark, spec, path)) == [(1, "A", 1), (2, None, 2), (3, "C", 1), (4, "D", 2)]


@pytest.mark.parametrize("spec", [PLAIN, BUCKETS])
def test_rows_of_an_earlier_file_add_nothing(spark, tmp_path, spec):
    folder, path, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "clean", "checkpoint"))
    for part in ([(1, "a", 1)], [(2, "b", 1), (1, " a", 1)], [(None, "x", 1)], [(0, "late", 1), (2, "b", 1)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        load_new_files(spark, spec, folder, spark.createDataFrame([], SCHEMA).schema, path, checkpoint, files_each=1)
    assert rows(clean_layer.read_table(spark, spec, path)) == [(0, "LATE", 1), (1, "A", 1), (2, "B", 1)]


def test_a_backlog_is_taken_in_parts(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame([(i, "a", 1), (9, "same", 1)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    load_new_files(spark, BUCKETS, folder, spark.createDataFrame([], SCHEMA).schema, f"{tmp_path}/clean", f"{tmp_path}/checkpoint", files_each=1)
    assert rows(clean_layer.read_table(spark, BUCKETS, f"{tmp_path}/clean")) == [(0, "A", 1), (1, "A", 1), (2, "A", 1), (9, "SAME", 1)]


def test_a_stream_without_good_rows_makes_no_table(spark, tmp_path):
    assert add_batch(spark, PLAIN, spark.createDataFrame([(None, "a", 1)], SCHEMA), f"{tmp_path}/clean") == 0
    assert not store.exists(spark, f"{tmp_path}/clean")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_old_side_of_a_bucketed_table_is_not_shuffled(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("x"), F.lit(0.0).alias("d"))
    buckets.create(old, path, 5)
    assert buckets.buckets_of(spark, path) == 5 and buckets.read(spark, path).columns == ["id", "x", "d"]
    new = spark.range(900, 1100).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("x"), F.lit(0.0).alias("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = buckets.same_rows(new, path, F.col("id") >= 900)
        plan = plan_of(same)
        scan = next(x for x in plan.split("\n") if "FileScan" in x)
        assert "Bucketed: true" in scan and "GreaterThanOrEqual(id,900)" in scan
        assert plan.count("Exchange") == 1 and plan.index("FileScan") < plan.index("Exchange")  # the exchange is the new rows'
        assert "ShuffledHashJoin" in plan
        assert sorted(r.id for r in same.collect()) == list(range(900, 1000))
        assert sorted(r.id for r in drop_existing(new, same).collect()) == list(range(1000, 1100))
        buckets.append(new.filter("id >= 1000"), path)
        assert drop_existing(new, buckets.same_rows(new, path)).isEmpty()
        assert buckets.read(spark, path).count() == 1100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_takes_a_bucketed_table_up(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(spark.range(10).toDF("id"), path, 2)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("tidelake_")]:
        spark.sql(f"drop table {name}")  # as in a session of its own; the table is external
    buckets.append(spark.range(10, 12).toDF("id"), path)
    assert buckets.buckets_of(spark, path) == 2 and buckets.read(spark, path).count() == 12
    files = [p.name for p in (tmp_path / "t").glob("part-*")]
    assert all("_0000" in f for f in files)  # named by bucket


def test_a_load_that_dies_between_the_moves_is_finished(spark, tmp_path):
    path, fs = f"{tmp_path}/t", tmp_path
    store.overwrite(spark.range(3).toDF("id"), path)
    # the new rows are whole: they become the table
    spark.range(5).toDF("id").write.parquet(f"{path}.staging-abc")
    (fs / "t").rename(fs / "t.old-abc")
    assert store.recover(spark, path) and store.read(spark, path).count() == 5
    assert not [p for p in fs.iterdir() if p.name != "t"]
    # they are not: the old ones come back
    spark.range(7).toDF("id").write.parquet(f"{path}.staging-def")
    (fs / "t.staging-def" / "_SUCCESS").unlink()
    (fs / "t").rename(fs / "t.old-def")
    assert store.recover(spark, path) and store.read(spark, path).count() == 5
    # the table is in place and its predecessor was not deleted
    spark.range(2).write.parquet(f"{path}.old-xyz")
    assert store.recover(spark, path) and not (fs / "t.old-xyz").exists() and store.read(spark, path).count() == 5
    assert not store.recover(spark, path)


def test_a_dead_replacement_is_no_first_load(spark, tmp_path):
    """The next incremental run keeps the history, of which the source has only the last row."""
    path = f"{tmp_path}/t"
    history = spark.createDataFrame([(1, "A", 1), (2, "B", 1)], SCHEMA)
    store.overwrite(history, path)
    (tmp_path / "t").rename(tmp_path / "t.old-abc")
    clean_layer.load_table(spark, PLAIN, spark.createDataFrame([(3, "c", 1)], SCHEMA), path)
    assert rows(store.read(spark, path)) == [(1, "A", 1), (2, "B", 1), (3, "C", 1)]


# ---- constraints

def test_report_over_declared_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "p int")
    child = spark.createDataFrame([(1, 1, "A", 5), (2, 2, "B", None), (3, 9, None, -1), (4, 9, "C", 0), (None, None, "C", 1)], "id int, p long, state string, n int")
    spec = Constraints(not_null=("state", "absent"), unique=(("state",), ("absent",)), references=(Reference("p", "parent", "p"), Reference("p", "nowhere", "p")),
                       checks=(("n", "n >= 0"), ("absent", "absent > 0")), domains=(("state", ("A", "B")),))
    got = checks.report(spark, {"parent": parent, "child": child}, {"parent": (("p",), Constraints()), "child": (("id",), spec)})
    assert rows(got) == sorted([
        ("child", "chk_n", "check", 1), ("child", "dom_state", "domain", 2), ("child", "fk_p", "reference", 2), ("child", "nn_id", "not null", 1),
        ("child", "nn_state", "not null", 1), ("child", "pk_id", "primary key", 0), ("child", "uq_state", "unique", 1),
        ("parent", "nn_p", "not null", 1), ("parent", "pk_p", "primary key", 1)], key=str)
    bad = {(r.id, r.p): r.broken for r in checks.flagged(child, ("id",), spec).collect()}
    assert bad == {(3, 9): ["nn_state", "chk_n"], (4, 9): ["dom_state"], (None, None): ["nn_id", "dom_state"]}


def test_references_scan_a_table_once(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 as a", "id % 5 as b").write.parquet(f"{tmp_path}/child")
    spark.range(2).write.parquet(f"{tmp_path}/parent")
    child, parent = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("child", "parent"))
    refs = [Reference("a", "parent", "id"), Reference("b", "parent", "id")]
    df = checks._reference_report(child, refs, {"parent": parent})
    assert sum("child" in x and "FileScan" in x for x in plan_of(df).split("\n")) == 1
    assert rows(df) == [("fk_a", "reference", 6), ("fk_b", "reference", 12)]


def test_the_registry_declares_what_the_source_promises():
    refs = [(t.name, r.column, r.table) for t in TABLES.values() for r in t.constraints.references]
    assert len(refs) == 8 and all(TABLES[t].key == (r.key,) for s in TABLES.values() for r in s.constraints.references for t in [r.table])
    assert TABLES["facturas"].constraints.domains == (("estado", INVOICE_STATES),)
    assert sum(len(t.constraints.unique) for t in TABLES.values()) == 6
    assert sum(len(t.constraints.checks) + len(t.constraints.domains) for t in TABLES.values()) == 15


# ---- the package

def test_the_archive_holds_the_package(tmp_path):
    import subprocess
    import sys

    from tidelake.ship import archive

    path = archive(str(tmp_path))
    code = f"import sys; sys.path.insert(0, {path!r}); import tidelake.operators.rules as r; assert {path!r} in r.__file__"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_the_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidelake", tmp_path / "tidelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
