"""Calls of models and services from tasks that survive failure: retries, a shared rate, and a durable record."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import count
from random import Random

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import Store
from tessera.sources.tables import materialise

#: Requests that are asked before their answers are published; what a lost job may have to ask again.
WAVE = 100_000
#: Tasks of one job at most; more requests are asked by several jobs.
JOB_TASKS = 4_096
#: Batches of a task that wait to be asked again while others are asked; with so many, the task waits too.
AHEAD = 64


class Refused(Exception):
    """A provider's answer that asking again would not change."""


def waits(attempts: int, first: float, random: Random) -> Iterator[float]:
    """Seconds before each further attempt: doubled each time, and up to half as long again by chance."""
    for k in range(attempts - 1):
        yield first * 2**k * (1 + random.random() / 2)


def _asked(part: DataFrame, provider: Callable[[list[str]], list[str]], batch: int, attempts: int, first_wait: float, pause: float) -> DataFrame:
    """(key, response, error, calls) of requests (key, text): the answer of each, or the last error of its batch."""
    schema = T.StructType([part.schema["key"], T.StructField("response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, next_call, waiting, number, done, kind = Random(TaskContext.get().partitionId()), time.monotonic() + pause, [], count(), [], None

        def ask(keys: list, texts: list[str], delays: Iterator[float], calls: int) -> None:
            nonlocal next_call
            time.sleep(max(0.0, next_call - time.monotonic()))
            next_call = time.monotonic() + pause
            try:
                answers, error = provider(texts), None
                if len(answers) != len(texts):
                    raise Refused(f"{len(answers)} answers to {len(texts)} requests")
            except Exception as e:  # whatever a provider raises is kept with the rows
                answers, error = [None] * len(texts), f"{type(e).__name__}: {e}"
                delay = None if isinstance(e, Refused) else next(delays, None)
                if delay is not None:
                    heappush(waiting, (time.monotonic() + delay, next(number), keys, texts, delays, calls))
                    return
            done.extend((k, a, error, calls) for k, a in zip(keys, answers, strict=True))

        def again(most: int) -> None:
            """Ask what has waited long enough, and the next ones until no more than ``most`` wait."""
            while waiting and (len(waiting) > most or waiting[0][0] <= time.monotonic()):
                due, _, keys, texts, delays, calls = heappop(waiting)
                time.sleep(max(0.0, due - time.monotonic()))
                ask(keys, texts, delays, calls + 1)

        def given() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([],) * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string(), pa.int32()), strict=True)], names=schema.names)
            done.clear()
            return out

        for whole in batches:
            kind, all_keys, all_texts = whole.column(0).type, whole.column(0).to_pylist(), whole.column(1).to_pylist()
            for at in range(0, whole.num_rows, batch):
                ask(all_keys[at : at + batch], all_texts[at : at + batch], waits(attempts, first_wait, random), 1)
                again(AHEAD)
            yield given()
        again(0)
        if done:
            yield given()

    return part.select("key", "text").mapInArrow(run, schema)


def _added(store: Store) -> None:
    """Add to the tables ``responses`` and ``failures`` of a store the answers that runs published and that are not there yet, all at once.

    Nothing changes if that is done again, so a run that was lost, or is still going on, does no harm; how many of its files were added is marked in its folder.
    """
    found = {}
    for run in store.names("runs"):
        names = store.names(f"runs/{run}")
        n = sum(name.startswith("part-") for name in names)
        if n and f"_ADDED-{n}" not in names:
            found[run] = n
    if not found:
        return
    folders, spark = [f"{store.path}/runs/{run}" for run in found], store.spark
    schema = spark.read.parquet(folders[0]).schema
    answered = materialise(spark.read.schema(schema).parquet(*folders).coalesce(max(spark.sparkContext.defaultParallelism, sum(found.values()) // 64)), "answered")  # from very small files
    store.append("responses", answered.where("error is null").select("key", "response"), ["key"])
    store.append("failures", answered.where("error is not null").select("key", "error", "calls", "at"), ["key", "at"])
    for run, n in found.items():
        store.mark(f"runs/{run}/_ADDED-{n}")


def call_through(requests: DataFrame, provider: Callable[[list[str]], list[str]], store: Store, batch: int = 16, attempts: int = 4, first_wait: float = 1.0, rate: float | None = None, wave: int = WAVE) -> DataFrame:
    """(key, response, error): the answer to each request (key, text), asked for only if ``store`` does not have it.

    The provider is a function from a list of texts to as many answers, and runs in the tasks on ``batch`` texts at a time. A call that raises is tried
    again after growing waits with jitter, ``attempts`` times in all, unless it raises ``Refused``; other batches are asked while it waits. ``rate`` is that of all calls
    in a second, shared out over the tasks that run at once. A task asks its share of a wave and publishes it when it ends: its file is moved to the run's folder at once (by the second
    algorithm of Hadoop's file committer), not when the job ends. What the folder of a run holds goes into the tables of the store when the run ends, or when the next one
    begins. So a job that is lost asks at most a wave again, and the size of a wave costs neither a job nor a look at earlier ones.
    Rows whose batch failed stay open with their error, and the next run asks for them alone. Rows of one key are one request; null texts are not asked and have no answer.
    """
    spark = requests.sparkSession
    _added(store)
    once = requests.where("text is not null").select("key", "text").dropDuplicates(["key"])
    known = store.read("responses")
    pending = once if known is None else once.join(known.select("key"), "key", "left_anti")
    pending = materialise(pending, "pending")
    n = pending.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-min(n, wave) // batch)))
    shares = -(-n // -(-wave // tasks))
    jobs = -(-shares // JOB_TASKS)
    pause = tasks / rate if rate else 0.0
    for job in range(jobs):
        mine = pending if jobs == 1 else pending.where(F.pmod(F.xxhash64("key", F.lit(jobs)), F.lit(jobs)) == job)
        answered = _asked(mine.repartition(-(-shares // jobs), "key"), provider, batch, attempts, first_wait, pause).withColumn("at", F.current_timestamp())
        answered.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{store.path}/runs/{uuid.uuid4().hex}")
    _added(store)
    done, failures = store.read("responses"), store.read("failures")
    if done is None:
        done = requests.select("key", F.lit(None).cast("string").alias("response")).limit(0)
    out = requests.select("key").distinct().join(done, "key", "left")
    if failures is None:
        return out.select("key", "response", F.lit(None).cast("string").alias("error"))
    last = failures.groupBy("key").agg(F.max_by("error", "at").alias("error"))
    return out.join(last, "key", "left").select("key", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))
