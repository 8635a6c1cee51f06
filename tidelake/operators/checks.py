"""Constraint reports: what a database would have refused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """Values of column are keys of another table."""

    column: str
    table: str
    key: str


@dataclass(frozen=True)
class Constraints:
    """not_null: columns; unique: keys, where nulls are exempt; checks: name and SQL predicate, which null passes; domains:
    column and its values, which null passes."""

    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, violations: in one pass over the table."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "violations")


def unique(df: DataFrame, key: list[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once, with how often. Nulls are exempt unless the key is primary."""
    known = df if primary else df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))
    bad = F.col("occurrences") > 1
    if primary:
        bad = bad | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return known.groupBy(*key).agg(F.count("*").alias("occurrences")).filter(bad)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose reference has no parent. Null references are exempt."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def check(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is false; null passes."""
    return df.filter(~(F.expr(predicate) if isinstance(predicate, str) else predicate))


def domain(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows with a value outside the list; null passes."""
    return check(df, F.col(column).isin(values))


# ---- declared constraints

def _columns(predicate: str, df: DataFrame) -> bool:
    """Whether df has all columns that the predicate names."""
    names = F.expr(predicate)
    try:
        df.select(names)
    except Exception as error:  # of the analyser only
        if "UNRESOLVED_COLUMN" not in str(error):
            raise
        return False
    return True


def row_tests(df: DataFrame, key: tuple[str, ...], c: Constraints) -> dict[tuple[str, str], Column]:
    """(constraint, kind) to a column that is true where a row breaks it. Only constraints of columns that df has."""
    has = set(df.columns)
    out: dict[tuple[str, str], Column] = {}
    for name in dict.fromkeys((*key, *c.not_null)):
        if name in has:
            out[f"nn_{name}", "not null"] = F.col(name).isNull()
    for name, predicate in c.checks:
        if _columns(predicate, df):
            out[f"chk_{name}", "check"] = F.coalesce(~F.expr(predicate), F.lit(False))
    for name, values in c.domains:
        if name in has:
            out[f"dom_{name}", "domain"] = F.coalesce(~F.col(name).isin(*values), F.lit(False))
    return out


def flagged(df: DataFrame, key: tuple[str, ...], c: Constraints) -> DataFrame:
    """Rows that break a NOT NULL, check or domain constraint, with the names of all that they break in the column broken."""
    tests = [F.when(test, F.lit(name)) for (name, _), test in row_tests(df, key, c).items()]
    if not tests:
        return df.withColumn("broken", F.array().cast("array<string>")).limit(0)
    return df.withColumn("broken", F.array_compact(F.array(*tests))).filter(F.size("broken") > 0)


def _row_report(df: DataFrame, key: tuple[str, ...], c: Constraints) -> DataFrame | None:
    """One pass for all constraints on single rows."""
    tests = row_tests(df, key, c)
    if not tests:
        return None
    each = [F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count(F.when(test, 1)).alias("violations")) for (name, kind), test in tests.items()]
    return df.agg(F.array(*each).alias("all")).select(F.inline("all"))


def _unique_report(df: DataFrame, name: str, key: tuple[str, ...], kind: str) -> DataFrame:
    return unique(df.select(*key), list(key)).agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "violations")


def _reference_report(df: DataFrame, references: list[Reference], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows without a parent, for all references of a table. The table is scanned once and its distinct values are counted before
    they meet the parents' keys, so a value that a third of the rows has is one row of the join."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(f"fk_{r.column}").alias("name"), F.col(r.column).cast("string").alias("value")) for r in references])).alias("v"))
    counted = values.select("v.*").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("rows"))
    parents = [tables[r.table].select(F.lit(f"fk_{r.column}").alias("name"), F.col(r.key).cast(df.schema[r.column].dataType).cast("string").alias("value"))
               for r in references]
    lonely = counted.join(reduce(DataFrame.unionByName, parents), ["name", "value"], "left_anti")
    return lonely.groupBy("name").agg(F.sum("rows").alias("violations")).select("name", F.lit("reference").alias("kind"), "violations")


def report(spark: SparkSession, tables: Mapping[str, DataFrame], declared: Mapping[str, tuple[tuple[str, ...], Constraints]]) -> DataFrame:
    """table_name, name, kind, violations: a row for each constraint of each table, also if it holds, in one plan.

    declared: key and constraints of each table. Violations are rows, for keys the values that occur more than once. Constraints
    of columns that a table lacks, and references to tables that are not given, are not in the report.
    """
    parts, names = [], []
    for table, (key, c) in declared.items():
        df = tables[table]
        has = lambda *columns: set(columns) <= set(df.columns)  # noqa: B023, E731
        own = []
        if (rows := _row_report(df, key, c)) is not None:
            own.append(rows)
        if has(*key):
            own.append(_unique_report(df, "pk_" + "_".join(key), key, "primary key"))
        own += [_unique_report(df, "uq_" + "_".join(u), u, "unique") for u in c.unique if has(*u)]
        references = [r for r in c.references if has(r.column) and r.table in tables and r.key in tables[r.table].columns]
        if references:
            own.append(_reference_report(df, references, tables))
            names += [(table, f"fk_{r.column}") for r in references]
        parts += [x.select(F.lit(table).alias("table_name"), "name", "kind", F.col("violations").cast("long").alias("violations")) for x in own]
    found = reduce(DataFrame.unionByName, parts)
    if not names:
        return found
    # references without an orphan have no row yet
    zero = spark.createDataFrame(names, "table_name string, name string").select("*", F.lit("reference").alias("kind"), F.lit(0).cast("long").alias("violations"))
    return found.unionByName(zero).groupBy("table_name", "name", "kind").agg(F.sum("violations").alias("violations"))
