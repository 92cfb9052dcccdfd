"""SQLite: round trips, ranges in parallel, filters that reach the query, saves that fail."""

import os
import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import sqlite as Q


def run_logs(path, n=1000):
    db = sqlite3.connect(path)
    with db:
        db.execute("CREATE TABLE run_logs (id INTEGER PRIMARY KEY, node_id TEXT, cost REAL, raw BLOB, \"odd \"\"name\" TEXT)")
        db.executemany("INSERT INTO run_logs VALUES (?, ?, ?, ?, ?)", [(3 * k + 1, None if k % 7 == 0 else f"n{k % 5}", k / 4, bytes([k % 256]), "x") for k in range(n)])
    db.close()


def test_a_file_is_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "app.db")
    run_logs(path)
    df = Q.read_sqlite(spark, path, "run_logs", rows=500)
    assert df.rdd.getNumPartitions() == 6
    assert [f.dataType for f in df.schema] == [T.LongType(), T.StringType(), T.DoubleType(), T.BinaryType(), T.StringType()]
    rows = df.orderBy("id").collect()
    assert len(rows) == 1000 and rows[8][:3] == (25, "n3", 2.0) and bytes(rows[8].raw) == b"\x08"
    assert df.where("id > 100 and node_id = 'n2'").count() == sum(3 * k + 1 > 100 and k % 7 and k % 5 == 2 for k in range(1000))
    assert df.where("node_id is null").count() == 143 and df.where("node_id is not null and id in (1, 4, 7)").count() == 2
    assert df.where("node_id <> 'n2'").count() == sum(k % 7 > 0 and k % 5 != 2 for k in range(1000))


def test_filters_reach_the_query(tmp_path):
    path = str(tmp_path / "app.db")
    run_logs(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("node_id", T.StringType())])
    reader = Q.SqliteReader(schema, {"path": path, "table": "run_logs", "rows": "1500"})
    left = list(reader.pushFilters([D.GreaterThan(("id",), 2000), D.EqualTo(("node_id",), "n1"), D.StringContains(("node_id",), "n"), D.Not(D.EqualTo(("node_id",), "n1"))]))
    assert [type(f) for f in left] == [D.StringContains, D.Not]
    parts = reader.partitions()
    assert len(parts) == 2
    sql, values = reader.statement(parts[1])
    assert sql == 'SELECT "id", "node_id" FROM "run_logs" WHERE rowid BETWEEN ? AND ? AND "id" > ? AND "node_id" = ? ORDER BY rowid' and values[2:] == [2000, "n1"]
    found = [r for p in parts for r in reader.read(p)]
    assert found == [(3 * k + 1, "n1") for k in range(1000) if 3 * k + 1 > 2000 and k % 5 == 1 and k % 7]


def test_round_trip_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("half"), (F.col("id") % 2 == 0).alias("even"))
    Q.write_sqlite(df.repartition(3), path, "t")
    Q.register(spark)
    back = spark.read.format("sqlite").schema(df.schema).option("table", "t").load(path)
    assert sorted(back.collect()) == sorted(df.collect()) and back.where("even").count() == 50
    Q.write_sqlite(df.limit(5), path, "t")
    assert Q.read_sqlite(spark, path, "t").count() == 105
    Q.write_sqlite(df.limit(7), path, "t", "overwrite")
    assert Q.read_sqlite(spark, path, "t").count() == 7
    with pytest.raises(Exception, match="no SQLite type"):
        Q.write_sqlite(df.select(F.array("id").alias("a")), path, "t")
    with pytest.raises(Exception, match="lost"):
        Q.write_sqlite(df.repartition(2).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id")), path, "t")
    assert Q.read_sqlite(spark, path, "t").count() == 7 and all(f.endswith((".db", ".part")) for f in os.listdir(path))  # a task that was killed may leave a part


def test_no_rows_and_no_table(spark, tmp_path):
    path = str(tmp_path / "app.db")
    run_logs(path, 0)
    assert Q.read_sqlite(spark, path, "run_logs").count() == 0
    with pytest.raises(Exception, match="no table"):
        Q.read_sqlite(spark, path, "other").schema  # noqa: B018
    with pytest.raises(ValueError, match="folder"):
        Q._local("hdfs://host/x.db")
