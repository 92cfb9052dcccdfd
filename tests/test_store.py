"""Stored tables and graphs: overlapping loads, loads that fail, conflicts, appends; draws without repeats."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.draws import draws_without_repeats
from tessera.sources.graph_store import GraphStore
from tessera.sources.store import Conflict, Store

NODES = "id string, label string, aliases array<string>, brand string, ord long"
EDGES = "source string, rel string, target string, weight int"


def node_rows(seed, first, count):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(40)}", rng.choice(["Defect", "Cause"]), rng.choice([None, [f"a{rng.randrange(5)}"], ["x", "y"]]), rng.choice([None, "b1", "b2"]), first + k) for k in range(count)]


def edge_rows(seed, count):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(50)}", rng.choice(["R", "S"]), f"n{rng.randrange(50)}", 1) for _ in range(count)]


def content(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_two_overlapping_loads_equal_one(spark, tmp_path):
    rows, edges = node_rows(1, 0, 200), edge_rows(2, 150)
    one, two = GraphStore(spark, str(tmp_path / "one")), GraphStore(spark, str(tmp_path / "two"))
    n, e = spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES)
    one.load(n, e)
    two.load(spark.createDataFrame(rows[:120], NODES), spark.createDataFrame(edges[:90], EDGES))
    assert two.load(spark.createDataFrame(rows[80:], NODES), e) == 2
    columns = ["id", "label", "aliases", "brand"]
    assert content(one.read("nodes"), *columns) == content(two.read("nodes"), *columns) == content(G.upsert_entities(n), *columns)
    assert content(one.read("edges"), "source", "rel", "target") == content(two.read("edges"), "source", "rel", "target") == content(G.upsert_relations(e, n), "source", "rel", "target")


def test_edges_keep_their_first_properties_and_new_properties_come_in(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    n = [("a", "Defect", None, None, 0), ("b", "Cause", None, None, 1)]
    store.load(spark.createDataFrame(n, NODES), spark.createDataFrame([("a", "R", "b", 1)], EDGES))
    more = spark.createDataFrame([("b", "Cause", ["bb"], 7, 0)], "id string, label string, aliases array<string>, size int, ord long")
    store.load(more, spark.createDataFrame([("a", "R", "b", 2), ("a", "R", "missing", 3)], EDGES))
    assert [r.weight for r in store.read("edges").collect()] == [1]
    assert {r.id: (r.aliases, r.size) for r in store.read("nodes").select("id", "aliases", "size").collect()} == {"a": ([], None), "b": (["bb"], 7)}
    assert store.lookup("nodes", spark.createDataFrame([("b",), ("zz",)], "id string"), "id").count() == 1


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    none = spark.createDataFrame([], EDGES)
    store.load(spark.createDataFrame(node_rows(1, 0, 200), NODES), none)
    before = {e.bucket: e.folder for e in store.entries()[1] if e.name == "nodes"}
    store.load(spark.createDataFrame([("n3", "Other", None, None, 0)], NODES), none)
    after = {e.bucket: e.folder for e in store.entries()[1] if e.name == "nodes"}
    assert len(before) > 10 and sum(before[b] != after.get(b) for b in before) == 1
    assert store.read("nodes", 1).where("label = 'Other'").count() == 0


def test_a_load_that_fails_changes_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    n, e = spark.createDataFrame(node_rows(1, 0, 50), NODES), spark.createDataFrame(edge_rows(1, 50), EDGES)
    store.load(n, e)
    was = store.entries()[0], content(store.read("nodes"), "id", "label"), content(store.read("edges"), "source", "target")
    broken = spark.createDataFrame(edge_rows(9, 50), EDGES).withColumn("weight", F.when(F.col("weight") > 0, F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        store.load(spark.createDataFrame(node_rows(5, 0, 50), NODES), broken)
    assert was == (store.entries()[0], content(store.read("nodes"), "id", "label"), content(store.read("edges"), "source", "target"))


def test_another_writer_is_noticed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append("rows", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    base, entries = store.entries()
    store.append("rows", spark.createDataFrame([(2, "b")], "k long, v string"), ["k"])
    with pytest.raises(Conflict):
        store.publish(base, entries)


def test_appends_add_each_key_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda keys: spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string")
    assert store.append("rows", frame([1, 2, 2, 3, None]), ["k"]) == 1
    assert store.append("rows", frame([3, None, 1]), ["k"]) == 1
    assert store.append("rows", frame(range(100, 120)), ["k"]) == 2
    assert store.append("rows", frame([2, 110, 9, 1000]), ["k"]) == 3
    assert sorted(r.k or -1 for r in store.read("rows").collect()) == sorted([-1, 1, 2, 3, *range(100, 120), 9, 1000])


def test_a_table_that_grows_is_dealt_out_anew(spark, tmp_path, monkeypatch):
    from tessera.sources import store as module

    monkeypatch.setattr(module, "MOST_ROWS", 1)
    store, none = GraphStore(spark, str(tmp_path / "g")), spark.createDataFrame([], EDGES)
    rows = [(f"n{k}", "Defect", None, None, k) for k in range(100)]
    store.load(spark.createDataFrame(rows, NODES), none)
    store.load(spark.createDataFrame(rows[:3], NODES), none)
    assert {e.buckets for e in store.entries()[1]} == {256} and store.read("nodes").count() == 100


def test_draws_do_not_repeat_within_a_turn(spark):
    items = spark.createDataFrame([("a", k) for k in range(10)] + [("b", k) for k in range(2)] + [(None, 1)], "key string, item long")
    asks = spark.createDataFrame([(k, no) for k in "abc" for no in range(9)] + [("a", 3)], "key string, no long")
    rows = draws_without_repeats(asks, items, "s", 4, 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.key, r.no, r.place)):
        got.setdefault((r.key, r.no), []).append(r.item)
    # ten items: two draws of four, then two are left, too few; two items: always both
    assert all(len(got["a", no]) == 4 for no in range(9)) and all(sorted(got["b", no]) == [0, 1] for no in range(9)) and not any(k == "c" for k, _ in got)
    for no in range(0, 8, 2):
        assert max(Counter(got["a", no] + got["a", no + 1]).values()) == 1
    single = draws_without_repeats(asks.where("key = 'a'"), items, "s").collect()
    assert len({r.item for r in single}) == 9 and draws_without_repeats(asks.limit(0), items, "s").count() == 0


def test_ranges_follow_the_rows_not_the_plan_of_a_join(spark, tmp_path, monkeypatch):
    from tessera.operators import chunk as C

    monkeypatch.setattr(C, "new_folder", lambda *_: str(tmp_path / "n"))
    a, b = spark.range(30_000).withColumnRenamed("id", "k"), spark.range(30_000).withColumnRenamed("id", "k")
    got = C.numbered(a.join(b, "k"), ["k"])
    assert got.where("no <> k").count() == 0 and got.count() == 30_000
    assert sum(x.name.startswith("part-") for x in (tmp_path / "n").iterdir()) <= 4
