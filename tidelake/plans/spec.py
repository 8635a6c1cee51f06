"""What is declared of a table."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.checks import Constraints
from ..operators.rules import Rule

STRATEGIES = ("full_reload", "incremental_id", "incremental_timestamp")


@dataclass(frozen=True)
class TableSpec:
    """strategy: how the raw layer loads it; cursor: by which column (of the source, then of the clean layer)."""

    name: str
    key: tuple[str, ...]
    strategy: str
    rules: tuple[Rule, ...]
    cursor: str | None = None
    clean_cursor: str | None = None
    fmt: str = "parquet"
    #: append what is new, or replace the clean table by the whole raw one.
    clean_mode: str = "append"
    #: How far below the cursor late rows are looked for, as an SQL expression.
    lookback: str | None = None
    #: What the source promises of the table, beside its key.
    constraints: Constraints = Constraints()
    #: Buckets of the clean table by a hash of the row, so that looking for rows that it has does not shuffle it; 0 for none.
    buckets: int = 0

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"{self.name}: unknown strategy {self.strategy!r}")
        if self.strategy != "full_reload" and not self.cursor:
            raise ValueError(f"{self.name}: {self.strategy} needs a cursor")
        if self.clean_mode not in ("append", "replace"):
            raise ValueError(f"{self.name}: unknown clean mode {self.clean_mode!r}")
