"""Declarative cleaning: rules compile to one projection and one predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NORMALISE


@dataclass(frozen=True)
class Normalise:
    """Replace a text column by its normal form, or write that to another column."""

    kind: str
    column: str
    into: str | None = None


@dataclass(frozen=True)
class NotNull:
    column: str

    def test(self) -> Column:
        return F.col(self.column).isNotNull()


@dataclass(frozen=True)
class NonBlank:
    column: str

    def test(self) -> Column:
        return F.length(self.column) > 0


@dataclass(frozen=True)
class Matches:
    """Null, or matching the pattern."""

    column: str
    pattern: str

    def test(self) -> Column:
        return F.col(self.column).isNull() | F.col(self.column).rlike(self.pattern)


@dataclass(frozen=True)
class AtLeast:
    column: str
    bound: int = 0

    def test(self) -> Column:
        return F.col(self.column) >= self.bound


@dataclass(frozen=True)
class Above:
    column: str
    bound: int = 0

    def test(self) -> Column:
        return F.col(self.column) > self.bound


@dataclass(frozen=True)
class NotBelow:
    """column >= other."""

    column: str
    other: str

    def test(self) -> Column:
        return F.col(self.column) >= F.col(self.other)


Check = NotNull | NonBlank | Matches | AtLeast | Above | NotBelow
Rule = Normalise | Check


def checks(rules: Sequence[Rule]) -> list[Check]:
    """The rules that can reject a row: NOT NULL first, then the others in their order."""
    own = [r for r in rules if not isinstance(r, Normalise)]
    return [r for r in own if isinstance(r, NotNull)] + [r for r in own if not isinstance(r, NotNull)]


def rule_name(rule: Check) -> str:
    return f"{type(rule).__name__}({rule.column})"


def normalise(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    own = [r for r in rules if isinstance(r, Normalise)]
    return df.withColumns({r.into or r.column: NORMALISE[r.kind](F.col(r.column)) for r in own}) if own else df


def clean(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Normalised rows for which every check is true; a check that is null rejects.

    Normal forms are null only for null, so NOT NULL may be tested after them, and one projection
    and one predicate do for all rules.
    """
    tests = [c.test() for c in checks(rules)]
    out = normalise(df, rules)
    return out.filter(F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))) if tests else out


def rejects(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that clean() drops, normalised, with the first rule that failed."""
    failed = F.coalesce(*[F.when(~F.coalesce(c.test(), F.lit(False)), F.lit(rule_name(c))) for c in checks(rules)])
    return normalise(df, rules).withColumn("failed_rule", failed).filter("failed_rule is not null")


def exact_distinct(df: DataFrame) -> DataFrame:
    """Rows without exact duplicates."""
    return df.dropDuplicates()
