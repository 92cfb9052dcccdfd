"""SQLite tables as a partitioned source and sink: ranges of row ids are read in parallel, filters reach the query.

    register(spark)
    spark.read.format("sqlite").option("table", "run_logs").option("rows", 100_000).load(path)
    df.write.format("sqlite").option("table", "run_logs").mode("append").save(folder)

``path`` is a database file, or a folder of them (``*.db``), which the driver and all tasks see at the same place. A partition is a range of
row ids of one file. Whole numbers, floats, texts and blobs map to long, double, string and binary; other columns take a
``schema``. A save puts one file for each task into a folder; files appear when the save is complete; one that fails is taken back, but for parts of killed tasks, which no reader takes.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Row ids in a partition unless the option ``rows`` says otherwise.
ROWS = 250_000
_TO_SQL = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
_COMPARE = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    place = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in place:
        raise ValueError(f"SQLite needs a folder that all tasks can open, not {path}")
    return place


def _files(path: str) -> list[str]:
    place = _local(path)
    return sorted(glob.glob(os.path.join(glob.escape(place), "*.db"))) if os.path.isdir(place) else [place]


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


@dataclass
class Range(D.InputPartition):
    """Row ids from ``low`` to ``high`` (inclusive) of one file."""

    file: str
    low: int
    high: int


def _condition(f: D.Filter, booleans: set[str]) -> tuple[str, list] | None:
    """A filter as SQL with its values; None for one that is left to Spark."""
    if isinstance(f, D.Not):
        return None  # nulls differ
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] in booleans:
        return None
    name = quoted(column[0])
    plain = lambda v: isinstance(v, (int, float, str, bytes)) and not isinstance(v, bool)
    if type(f) in _COMPARE and plain(f.value):
        return f"{name} {_COMPARE[type(f)]} ?", [f.value]
    if isinstance(f, D.In) and all(map(plain, f.value)) and len(f.value) <= 500:
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, D.IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{name} IS NOT NULL", []
    return None


class SqliteReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.table, self.rows = schema, options["path"], options["table"], int(options.get("rows", ROWS))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        booleans = {f.name for f in self.schema if isinstance(f.dataType, T.BooleanType)}
        for f in filters:
            found = _condition(f, booleans)
            if found is None:
                yield f
            else:
                self.where.append(found)

    def partitions(self) -> Sequence[Range]:
        out = []
        for file in _files(self.path):
            with _open(file) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if low is not None:
                out += [Range(file, at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)]
        return out or [Range("", 0, -1)]

    def statement(self, part: Range) -> tuple[str, list]:
        """The query of a partition and its values."""
        columns = ", ".join(quoted(f.name) for f in self.schema) or "NULL"
        terms = ["rowid BETWEEN ? AND ?", *(sql for sql, _ in self.where)]
        return f"SELECT {columns} FROM {quoted(self.table)} WHERE {' AND '.join(terms)} ORDER BY rowid", [part.low, part.high, *(v for _, values in self.where for v in values)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        flags = [k for k, f in enumerate(self.schema) if isinstance(f.dataType, T.BooleanType)]
        db = _open(partition.file)
        try:
            for row in db.execute(*self.statement(partition)):
                if flags:
                    row = tuple(None if x is None else bool(x) if k in flags else x for k, x in enumerate(row))
                yield row
        finally:
            db.close()


@dataclass
class Written(D.WriterCommitMessage):
    file: str


class SqliteWriter(D.DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.folder, self.table = schema, _local(options["path"]), options["table"]
        self.old = _files(self.folder) if overwrite and os.path.isdir(self.folder) else []
        if missing := [f.name for f in schema if type(f.dataType) not in _TO_SQL]:
            raise ValueError(f"no SQLite type for {', '.join(missing)}")

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        file = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.db")
        db = sqlite3.connect(file + ".part")
        columns = ", ".join(f"{quoted(f.name)} {_TO_SQL[type(f.dataType)]}" for f in self.schema)
        try:
            with db:
                db.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
                db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", map(tuple, iterator))
        except BaseException:
            db.close()
            os.remove(file + ".part")
            raise
        db.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            os.replace(m.file + ".part", m.file)
        for file in self.old:
            os.remove(file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file + ".part"):
                os.remove(m.file + ".part")


class Sqlite(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        """Columns and types as the first file declares them."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no SQLite file in {self.options['path']}")
        with _open(files[0]) as db:
            declared = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not declared:
            raise ValueError(f"no table {self.options['table']} in {files[0]}")

        def kind(text: str) -> T.DataType:
            text = text.upper()
            return T.LongType() if "INT" in text else T.BinaryType() if "BLOB" in text else T.DoubleType() if any(x in text for x in ("REAL", "FLOA", "DOUB")) else T.StringType()

        return T.StructType([T.StructField(name, kind(text)) for _, name, text, *_ in declared])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format "sqlite" known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sqlite)


def read_sqlite(spark: SparkSession, path: str, name: str, rows: int = ROWS) -> DataFrame:
    """A table of a database file or of a folder of them."""
    register(spark)
    return spark.read.format("sqlite").option("table", name).option("rows", rows).load(path)


def write_sqlite(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """One database file for each task, in a folder; ``mode`` is append or overwrite."""
    register(df.sparkSession)
    df.write.format("sqlite").option("table", name).mode(mode).save(path)
