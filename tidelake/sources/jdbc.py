"""Tables in a database."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import newer_than

#: Counted parts of a range that is split, at most; the only rows of a split that reach the driver.
PARTS = 256


@dataclass(frozen=True)
class JdbcSource:
    """Where the database is. Give user, password and such as properties."""

    url: str
    driver: str
    properties: dict[str, str] = field(default_factory=dict)

    @classmethod
    def postgres(cls, host: str, port: int, database: str, user: str, password: str) -> JdbcSource:
        return cls(f"jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", {"user": user, "password": password})

    def reader(self, spark: SparkSession):
        return spark.read.format("jdbc").options(url=self.url, driver=self.driver, **self.properties)

    def asked(self, spark: SparkSession, sql: str) -> DataFrame:
        """What the database answers to a query of its own."""
        return self.reader(spark).option("query", sql).load()

    def column(self, spark: SparkSession, table: DataFrame, name: str) -> str:
        """A column's name as the database has it, in its quotes."""
        found = next((c for c in table.columns if c.lower() == name.lower()), name)
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(found)

    def table(self, spark: SparkSession, name: str, split_by: str | None = None, partitions: int = 1) -> DataFrame:
        """The table; with split_by, an integer column, it is read in about that many ranges of about as many rows, at once."""
        return self._read(spark, name, split_by, partitions, None)

    def newer(self, spark: SparkSession, name: str, cursor: str, last: str | None, split_by: str | None = None, partitions: int = 1) -> DataFrame:
        """Rows beyond a cursor; the database gets the comparison. With split_by, the new rows are read in ranges of that column."""
        whole = self.reader(spark).option("dbtable", name).load()
        if last is None:
            return self._read(spark, name, split_by, partitions, None)
        kind = next(f.dataType for f in whole.schema if f.name.lower() == cursor.lower())
        return newer_than(self._read(spark, name, split_by, partitions, beyond(self.column(spark, whole, cursor), kind, last)), cursor, last)

    def _read(self, spark: SparkSession, name: str, split_by: str | None, partitions: int, where: str | None) -> DataFrame:
        reader = self.reader(spark).option("dbtable", name)
        if split_by is None or partitions < 2:
            return reader.load()
        ranges, split_by = self.ranges(spark, name, split_by, partitions, where), self.column(spark, reader.load(), split_by)
        if len(ranges) < 2:
            return reader.load()
        over = [f"{split_by} >= {x}" for x in ranges[1:]]
        under = [f"{split_by} < {x}" for x in ranges[1:]]
        tests = [under[0], *[f"{x} and {y}" for x, y in zip(over, under[1:])], over[-1]]
        tests[0] = f"({tests[0]} or {split_by} is null)"  # rows without the column are read as well
        return spark.read.jdbc(self.url, name, predicates=tests, properties={**self.properties, "driver": self.driver})

    def ranges(self, spark: SparkSession, name: str, split_by: str, partitions: int, where: str | None = None) -> list[int]:
        """Lower bounds of ranges of about as many rows each, the first one's being the least value.

        The database counts rows by equal parts of the range, and parts that hold too much are counted again by finer ones, down
        to single values; no row of the table is read here.
        """
        test, split_by = f" and {where}" if where else "", self.column(spark, self.reader(spark).option("dbtable", name).load(), split_by)
        low, high, rows = self.asked(spark, f"select min({split_by}) as lo, max({split_by}) as hi, count({split_by}) as n from {name} where {split_by} is not null{test}").first()
        if low is None:
            return []
        low, high, share = int(low), int(high), max(1, -(-int(rows) // partitions))
        counts, todo = [], [(low, high + 1)]
        while todo:
            a, b = todo.pop()
            width = max(1, -(-(b - a) // PARTS))
            found = self.asked(spark, f"select part, count(*) as n from (select ({split_by} - {a}) / {width} as part from {name} "
                                      f"where {split_by} >= {a} and {split_by} < {b}{test}) counted group by part").collect()
            for part, n in sorted((int(r[0]), int(r[1])) for r in found):
                first = a + part * width
                if n > share and width > 1:
                    todo.append((first, min(first + width, b)))
                else:
                    counts.append((first, n))
        out, held = [], share
        for first, n in sorted(counts):
            if held + n > share and held:
                out.append(first)
                held = 0
            held += n
        return [low, *out[1:]]


def beyond(column: str, kind: T.DataType, last: str) -> str:
    """The database's comparison for rows beyond a cursor's text (see last_cursor)."""
    if isinstance(kind, T.NumericType):
        return f"{column} > {last}"
    if isinstance(kind, T.TimestampType) and last.lstrip("-").isdigit():
        return f"{column} > {{ts '{datetime.fromtimestamp(int(last) // 10**6).isoformat(' ')}.{int(last) % 10**6:06d}'}}"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"{column} > {{ts '{last}'}}"
    if isinstance(kind, T.DateType):
        return f"{column} > {{d '{last}'}}"
    return f"{column} > '{last.replace(chr(39), 2 * chr(39))}'"
