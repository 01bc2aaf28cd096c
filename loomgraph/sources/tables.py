"""Triples from tables with the columns subject, predicate, object."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAMES = {"subject": "s", "predicate": "p", "object": "o"}


def from_table(df: DataFrame, nulls: str = "empty") -> DataFrame:
    """nulls: "empty" turns a null into the empty string; "drop" leaves out rows that have one."""
    if nulls not in ("empty", "drop"):
        raise ValueError("nulls is empty or drop")
    out = df.select(*[F.col(c).cast("string").alias(n) for c, n in NAMES.items()])
    return out.na.fill("") if nulls == "empty" else out.dropna()


def read_jdbc(spark: SparkSession, url: str, table: str, nulls: str = "empty", partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, predicates: list[str] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table; with a numeric partition_column and bounds, or disjoint predicates, it is read in parallel.

    A part that fails ends the job; no page is skipped. Credentials come in properties.
    """
    props = properties or {}
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=props)
    elif partition_column and bounds:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=props)
    else:
        df = spark.read.jdbc(url, table, properties=props)
    return from_table(df, nulls)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, size: int):
        self.path, self.size = path, size
        self.table = '"' + table.replace('"', '""') + '"'

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [] if low is None else [_Rows(a, min(a + self.size, high + 1)) for a in range(low, high + 1, self.size)]

    def read(self, part):
        with self._open() as db:
            yield from db.execute(f"SELECT subject, predicate, object FROM {self.table} WHERE rowid >= ? AND rowid < ?", (part.low, part.high))


class SQLiteSource(DataSource):
    """format("sqlite_triples") with options path, table and rows (row ids a partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_triples"

    def schema(self) -> str:
        return "subject string, predicate string, object string"

    def reader(self, schema):
        return SQLiteReader(self.options["path"], self.options["table"], int(self.options.get("rows", 100_000)))


def read_sqlite(spark: SparkSession, path: str, table: str, nulls: str = "drop", rows: int = 100_000) -> DataFrame:
    """An SQLite file that all executors can open, read by ranges of row ids."""
    spark.dataSource.register(SQLiteSource)
    return from_table(spark.read.format("sqlite_triples").option("path", path).option("table", table).option("rows", rows).load(), nulls)
