"""Formats, snapshots, the run ledger and streams."""

from pyspark.sql import functions as F

from tessera.sources import tables as S
from tessera.streaming import runlog as L


def test_text_jsonl_csv(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "EX-1.txt").write_text("甲\n乙", encoding="utf-8")
    (tmp_path / "txt" / "skip.md").write_text("no")
    assert [tuple(r) for r in S.read_text_dir(spark, str(tmp_path / "txt")).collect()] == [("EX-1", "甲\n乙")]
    df = spark.createDataFrame([("甲", 1), (None, 2)], "a string, b int")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(S.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    S.write_csv(df, str(tmp_path / "c"))
    assert S.read_csv(spark, str(tmp_path / "c"), df.schema).count() == 2
    assert {r.name for r in S.list_artefacts(spark, str(tmp_path / "txt"), "*.txt").collect()} == {"EX-1.txt"}


def test_snapshot_and_append(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "Defect")], "id string, label string"), spark.createDataFrame([("a", "R", "b")], "source string, rel string, target string")
    S.save_graph(n, e, str(tmp_path / "g"))
    n2, e2 = S.load_graph(spark, str(tmp_path / "g"))
    assert n2.collect() == n.collect() and e2.select("source", "rel", "target").collect() == e.collect()
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    S.append_segments(rows, str(tmp_path / "s"), "key")
    assert S.append_segments(rows.union(spark.createDataFrame([("k3", 3)], rows.schema)), str(tmp_path / "s"), "key").count() == 3


def test_ledger_and_cache(spark):
    runs = spark.createDataFrame([(1, "a", "x"), (3, "a", "y"), (2, "b", "z")], "id long, node_id string, status string")
    assert {r.node_id: r.status for r in L.latest_runs(runs).collect()} == {"a": "y", "b": "z"}
    done = spark.createDataFrame([("k1", "m1", False), ("k2", "m1", True), ("k3", "m0", False)], "key string, mode string, failed boolean")
    segs = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "key string")
    assert {r.key for r in L.pending(segs, done, "m1").collect()} == {"k2", "k3", "k4"}
    assert L.pending(segs, done, "m2").count() == 4
    logs = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "id long, node_id string")
    assert [r.id for r in L.log_after(logs, 5, 3, "b").collect()] == [6, 9, 12]


def test_stream_adds_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for ck in ("c1", "c2"):  # the second run replays all from its own checkpoint
        L.run_to_table(L.tail(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / ck), ["id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_change_stream_equals_batch(spark, tmp_path):
    states = spark.createDataFrame([(i, f"u{i % 3}", "on" if (i // 4) % 2 else "off") for i in range(40)], "id long, user string, state string")
    for k in range(4):  # four files, one a batch
        states.where((F.col("id") >= 10 * k) & (F.col("id") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = L.tail(spark, str(tmp_path / "in"), states.schema, files_per_batch=1)
    L.changes_stream(stream, "user", "id", "state", str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got = {r.id for r in spark.read.option("recursiveFileLookup", False).parquet(str(tmp_path / "out")).select("id").collect()}
    assert got == {r.id for r in L.changes(states, "user", ["id"], "state").collect()}


def test_change_stream_by_event_time(spark, tmp_path):
    second = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = spark.createDataFrame([(i, f"u{i % 3}", "on" if (i // 4) % 2 else "off", i + 7 * (i % 3)) for i in range(60)], "id long, user string, state string, s long").withColumn("ts", second(F.col("s"))).drop("s")
    for k, part in enumerate([rows.where("id < 20"), rows.where("id >= 20 and id < 35"), rows.where("id >= 35")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:  # the second start goes on from the first one's checkpoint
            stream = L.tail(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
            L.changes_stream(stream, "user", "id", "state", str(tmp_path / "ck"), str(tmp_path / "out"), "ts", "20 seconds").awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    passed = rows.agg(F.max("ts") - F.expr("interval 20 seconds")).first()[0]
    want = L.changes(rows.withColumn("at", F.struct("ts", "id")), "user", ["at"], "state").where(F.col("ts") <= F.lit(passed))
    assert got == {r.id for r in want.collect()} and len(got) > 5
    # a row before the watermark comes too late and changes nothing
    rows.limit(1).select(F.lit(99).cast("long").alias("id"), "user", F.lit("odd").alias("state"), second(F.lit(1)).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    L.changes_stream(L.tail(spark, str(tmp_path / "in"), rows.schema), "user", "id", "state", str(tmp_path / "ck"), str(tmp_path / "out"), "ts", "20 seconds").awaitTermination()
    assert got == {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
