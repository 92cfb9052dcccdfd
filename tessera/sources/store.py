"""Stored tables that are merged and appended to: bucketed files, and manifests that say which of them count.

A version of a store is a manifest, one row for each folder of files: table, bucket, folder, rows, the least and greatest
key. New data goes to new folders, and becomes visible at once with the manifest of the next version, which counts when its
``_SUCCESS`` file is there; a load that fails before leaves the store as it was, with files that nothing names. Merges rewrite the
buckets that new rows fall into and keep the others' folders; appends add folders, and read only those whose keys may
collide. Several writers at a time are noticed, not queued: the one that finds another version published raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table unless it asks for others, and rows of a bucket from which the next merge deals the table out anew.
BUCKETS, MOST_ROWS = 64, 4_000_000
_ENTRY = "name string, bucket int, buckets int, folder string, n long, low string, high string, columns string"
_Entry = Row(*(field.split(" ")[0] for field in _ENTRY.split(", ")))


class Conflict(RuntimeError):
    """Another writer published a version meanwhile."""


class Store:
    """Tables below one folder; ``part`` columns are dealt to buckets by their hash."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests --------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def names(self, folder: str = "") -> list[str]:
        """What lies directly in a folder below the store's, if it is there."""
        return self._names(f"{self.path}/{folder}".rstrip("/"))

    def mark(self, file: str) -> None:
        """Leave an empty file below the store's folder."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{file}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True).close()

    def versions(self) -> tuple[list[int], int]:
        """The published versions in order, and the highest number that any writer took."""
        found = sorted(int(n) for n in self._names(f"{self.path}/_manifest") if n.isdigit())
        return [v for v in found if "_SUCCESS" in self._names(f"{self.path}/_manifest/{v:09d}")], max(found, default=0)

    def entries(self, version: int | None = None) -> tuple[int, list[Row]]:
        """A version (the last; 0 before the first) and the folders that it names: a row for each bucket and segment."""
        if version is None:
            done, _ = self.versions()
            version = done[-1] if done else 0
        return version, self.spark.read.schema(_ENTRY).json(f"{self.path}/_manifest/{version:09d}").collect() if version else []

    def publish(self, base: int, entries: list[Row]) -> int:
        """Make ``entries`` the version after ``base``; raises if that is no longer the last."""
        done, taken = self.versions()
        if (done[-1] if done else 0) != base:
            raise Conflict(f"version {done[-1]} came after {base}")
        self.spark.createDataFrame([tuple(e) for e in entries], _ENTRY).coalesce(1).write.mode("error").json(f"{self.path}/_manifest/{taken + 1:09d}")
        if self.versions()[0][-1] != taken + 1:
            raise Conflict(f"another writer published after {taken + 1}")
        return taken + 1

    # -- tables -----------------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table, of the last version unless one is asked for; None if it has none."""
        return self._rows([e for e in self.entries(version)[1] if e.name == name])

    def lookup(self, name: str, keys: DataFrame, column: str) -> DataFrame | None:
        """Rows of a table dealt by ``column`` that have one of ``keys`` (a frame with that column); only the buckets of these keys are read."""
        mine = [e for e in self.entries()[1] if e.name == name]
        if not mine:
            return None
        wanted = self._touched(keys, [column], mine[0].buckets)
        rows = self._rows([e for e in mine if e.bucket in wanted])
        return self._rows(mine).limit(0) if rows is None else rows.join(keys.select(column).distinct(), column, "left_semi")

    def _rows(self, entries: list[Row]) -> DataFrame | None:
        if not entries:
            return None
        by_schema: dict[str, list[str]] = {}
        for e in entries:
            by_schema.setdefault(e.columns, []).append(f"{self.path}/{e.folder}")
        frames = [self.spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(*folders) for columns, folders in by_schema.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    @staticmethod
    def _bucket(part: list[str], buckets: int):
        return F.pmod(F.xxhash64(*part), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, part: list[str], buckets: int) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(part, buckets)).distinct().collect()}  # as many as buckets at most

    def write(self, name: str, rows: DataFrame, part: list[str], buckets: int, key: str) -> list[Row]:
        """Write rows to new folders, one for each bucket; the entries that would make them count."""
        segment = f"data/table={name}/segment={uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(part, buckets))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{segment}")
        schema = T.StructType([*rows.schema, T.StructField("_bucket", T.IntegerType())])
        value = F.col(f"`{key}`").cast("string")
        sizes = self.spark.read.schema(schema).parquet(f"{self.path}/{segment}").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min(_sortable(value)).alias("low"), F.max(_sortable(value)).alias("high"))
        return [_Entry(name, r["_bucket"], buckets, f"{segment}/_bucket={r['_bucket']}", r.n, r.low, r.high, rows.schema.json()) for r in sizes.collect()]

    def staged_merge(self, entries: list[Row], name: str, rows: DataFrame, part: list[str], combine: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[Row]:
        """Entries after ``rows`` are merged into a table: buckets that they fall into are combined and rewritten, the rest stay.

        ``combine(stored, rows)`` gives the new content of the touched buckets. A table with more than MOST_ROWS to a bucket is dealt out anew.
        """
        mine, others = [e for e in entries if e.name == name], [e for e in entries if e.name != name]
        now = mine[0].buckets if mine else buckets
        rows_now = sum(e.n for e in mine)
        if rows_now > MOST_ROWS * now:
            while rows_now > MOST_ROWS * now // 2:
                now *= 2
            return others + self.write(name, combine(self._rows(mine), rows), part, now, part[0])
        touched = self._touched(rows, part, now)
        stored = self._rows([e for e in mine if e.bucket in touched])
        return others + [e for e in mine if e.bucket not in touched] + self.write(name, combine(stored, rows), part, now, part[0])

    def append(self, name: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int:
        """Append the rows whose keys are not stored yet, one for each key; the new version (the old one if nothing is new).

        Keys are compared only with folders of the buckets that rows fall into whose range of the first key meets that of the rows: a log
        with growing ids reads nothing back.
        """
        base, entries = self.entries()
        mine = [e for e in entries if e.name == name]
        now = mine[0].buckets if mine else buckets
        fresh = rows.dropDuplicates(keys)
        if mine:
            value = _sortable(F.col(f"`{keys[0]}`").cast("string"))
            ranges = fresh.groupBy(self._bucket(keys, now).alias("b")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(value.isNull()).alias("nulls")).collect()
            by_bucket = {r.b: r for r in ranges}
            may = [e for e in mine if (r := by_bucket.get(e.bucket)) and (r.nulls or e.low is None or r.low is None or (e.low <= r.high and r.low <= e.high))]
            if may:
                stored = self._rows(may).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)))
                fresh = fresh.join(stored, reduce(lambda a, b: a & b, (fresh[k].eqNullSafe(stored[f"_k{i}"]) for i, k in enumerate(keys))), "left_anti")
        added = self.write(name, fresh, keys, now, keys[0])
        return self.publish(base, [*entries, *added]) if added else base


def _sortable(value):
    """Text whose order is that of whole numbers, for values that are such; others stay as they are."""
    return F.when(value.rlike(r"^[0-9]{1,19}$"), F.lpad(value, 20, "0")).otherwise(value)
