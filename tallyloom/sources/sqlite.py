"""A DataSource for SQLite files, opened read-only.

Filters of the form column = value and column >= value are passed down into the query, and a table is split into ranges of rowid. The
file must be readable by every executor at the same path.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SqliteSource(DataSource):
    """format("tallyloom_sqlite"), options path, table and rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "tallyloom_sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "BLOB": "binary"}
        with _open(self.options["path"]) as db:
            rows = db.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in rows)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema.names)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.each, self.names = options["path"], options["table"], int(options.get("rows_per_task", 100_000)), names
        self.where, self.values = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThanOrEqual) and len(f.attribute) == 1 and isinstance(f.value, str | int | float):
                self.where.append(f'"{f.attribute[0]}" {"=" if isinstance(f, EqualTo) else ">="} ?')
                self.values.append(f.value)
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        with _open(self.path) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [RowRange(0, -1)]
        return [RowRange(a, min(high, a + self.each - 1)) for a in range(low, high + 1, self.each)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        columns = ", ".join(f'"{n}"' for n in self.names)
        where = " and ".join(["rowid between ? and ?", *self.where])
        with _open(self.path) as db:
            yield from db.execute(f'select {columns} from "{self.table}" where {where}', [partition.first, partition.last, *self.values])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def sessions(spark: SparkSession, path: str, workdir: str, since_ms: int):
    """Sessions of one working folder since a time."""
    from pyspark.sql import functions as F

    register(spark)
    rows = spark.read.format("tallyloom_sqlite").option("path", path).option("table", "session").load()
    return rows.filter((F.col("directory") == workdir) & (F.col("time_created") >= since_ms))
