"""The run ledger, log tails and resumable segment jobs, as batch operators and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.sources.tables import append_new

LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("node_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType())])


def latest_runs(runs: DataFrame, key: str = "node_id", order: str = "id") -> DataFrame:
    """The latest row of every node, by one aggregate."""
    rest = [c for c in runs.columns if c not in (key, order)]
    last = runs.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(key, order, *(F.col(f"_r.{c}").alias(c) for c in rest))


def log_after(logs: DataFrame, cursor: int, limit: int | None = 200, node: str | None = None) -> DataFrame:
    """Rows after a cursor by id; filtered before the limit, so that a node's rows are not missed."""
    out = logs.where(F.col("id") > cursor)
    if node is not None:
        out = out.where(F.col("node_id") == node)
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def matching(df: DataFrame, order: list[str], limit: int | None = None, **given) -> DataFrame:
    """Rows that equal every filter that is given (None: not asked for), filtered before the limit, in a total order."""
    for c, v in given.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(*order) if limit is None else df.orderBy(*order).limit(limit)


def changes(states: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key; the first row of a key counts as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    n = F.row_number().over(w)
    return states.withColumn("_b", before).withColumn("_n", n).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_n")


def pending(segments: DataFrame, done: DataFrame, mode: str) -> DataFrame:
    """Segments (key, ...) still to do: not done in the same mode without failure; another mode runs all again."""
    ok = done.where((F.col("mode") == mode) & ~F.col("failed")).select("key").distinct()
    return segments.join(ok, "key", "left_anti")


def read_through(keys: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): responses (cache_key, response) from the cache, computed where missing, and the cache with them.

    Of rows with one key in the cache (cache_key, response, ts) the last wins.
    """
    last = cache.groupBy("cache_key").agg(F.max_by("response", "ts").alias("response"), F.max("ts").alias("ts"))
    asked = keys.select("cache_key", *[c for c in keys.columns if c != "cache_key"]).dropDuplicates(["cache_key"])
    fresh = compute(asked.join(last.select("cache_key"), "cache_key", "left_anti")).select("cache_key", "response")
    hits = asked.select("cache_key").join(last.select("cache_key", "response"), "cache_key")
    return hits.unionByName(fresh), last.unionByName(fresh.withColumn("ts", F.current_timestamp()))


def ledger(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, node_id, status, started_at, finished_at, stats): one row for each run; without an end it is running."""
    return starts.join(ends, "id", "left").select("id", "node_id", F.coalesce("status", F.lit("running")).alias("status"), "started_at", "finished_at", "stats")


# -- streams --------------------------------------------------------------------------------------


def tail(spark: SparkSession, path: str, schema: T.StructType = LOG, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream: rows of files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append a stream to a Parquet folder, once for each key: a row whose key is stored is skipped, so a replayed batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Changes(StatefulProcessor):
    """Rows of one key whose value is not that of the row before; with event times, rows wait in the state until the watermark has passed them."""

    def __init__(self, order: str, value: str, names: list[str], types: T.StructType, timed: bool):
        self.order, self.value, self.names, self.types, self.timed = order, value, names, types, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([self.types[c] for c in (*([_AT] if self.timed else []), self.order, self.value)]))
        self.waiting = handle.getListState("waiting", self.types)

    def _changed(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """The changes among rows in their order; a row that is not after the last one of its key came too late and is left out."""
        place = self.names.index
        by = [place(_AT), place(self.order)] if self.timed else [place(self.order)]
        value, out = place(self.value), []
        last = tuple(self.last.get()) if self.last.exists() else None
        for row in sorted(rows, key=lambda r: [r[i] for i in by]):
            at = tuple(row[i] for i in by)
            if last is not None and at <= last[:-1]:
                continue
            if last is None or last[-1] != row[value]:
                out.append((*key, *row))
            last = (*at, row[value])
        if last is not None:
            self.last.update(last)
        if out:
            yield pd.DataFrame(out, columns=[_KEY, *self.names], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if x is pd.NA or x is None or x != x else x for x in row) for part in rows for row in part[self.names].astype(object).itertuples(index=False)]
        if not self.timed:
            yield from self._changed(key, fresh)
            return
        self.waiting.appendList(fresh)
        self.handle.registerTimer(-(-min(row[self.names.index(_AT)] for row in fresh) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        at = self.names.index(_AT)
        rows = [tuple(r) for r in self.waiting.get()]
        due, later = [r for r in rows if r[at] <= reached], [r for r in rows if r[at] > reached]
        if not due:
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-min(r[at] for r in later) // 1000))
        else:
            self.waiting.clear()
        yield from self._changed(key, due)

    def close(self) -> None:
        pass


#: Columns beside those of the caller: the key, the event time, and the same in microseconds. No underscore comes first, which Python's named tuples refuse.
_KEY, _TIME, _AT = "state_key_", "state_time_", "state_at_"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def changes_stream(stream: DataFrame, key: str, order: str, value: str, checkpoint: str, path: str, event_time: str | None = None, delay: str = "0 seconds") -> StreamingQuery:
    """State changes of a stream as Parquet files, each once: the last value of every key is kept in the state store of the query.

    Without ``event_time`` a batch's rows are taken in ``order``; a row that is not after the last one of its key is too late and left out. With it, rows
    are in the order of event time and ``order``, whatever the order they come in: a row waits in the state until the watermark (the latest time seen,
    less ``delay``) has passed it, and one that comes when the watermark has passed its time is too late and left out.
    Only keys of the batch, or with rows due, are touched. A restart goes on from the checkpoint.
    """
    spark, timed = stream.sparkSession, event_time is not None
    at = F.col(event_time).cast("timestamp") if timed else None
    extra = [F.unix_micros(at).alias(_AT), at.alias(_TIME)] if timed else []
    rows = stream.select(F.col(key).alias(_KEY), order, value, *extra)
    if timed:
        rows = rows.withWatermark(_TIME, delay)
    names = [order, value, *([_AT] if timed else [])]
    types = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names])
    out = T.StructType([T.StructField(_KEY, rows.schema[_KEY].dataType), *types])
    found = rows.groupBy(_KEY).transformWithStateInPandas(_Changes(order, value, names, types, timed), out, "append", "EventTime" if timed else "None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query takes the settings it is started with
        return found.select(F.col(_KEY).alias(key), order, value).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
