"""Graph operators on small graphs, and by comparison with a plain walk."""

import random
from collections import deque

from pyspark.sql import functions as F

from tessera import vocab
from tessera.operators import graph as G


def edges_of(spark, triples):
    return spark.createDataFrame(triples, "source string, rel string, target string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def walk(triples, seeds, hops, direction, limit=None):
    """A breadth-first walk over dictionaries, nodes and edges taken by name."""
    steps = {}
    for s, r, t in triples:
        if direction in ("out", "both"):
            steps.setdefault(s, []).append(("0", r, t, (s, r, t)))
        if direction in ("in", "both"):
            steps.setdefault(t, []).append(("1", r, s, (s, r, t)))
    known = {x for s, _, t in triples for x in (s, t)}
    depth = {s: 0 for s in sorted(seeds) if s in known}
    queue, out = deque(depth), []
    while queue:
        n = queue.popleft()
        if depth[n] >= hops:
            continue
        for _, _, m, e in sorted(steps.get(n, [])):
            out.append((*e, depth[n] + 1))
            if m not in depth:
                depth[m] = depth[n] + 1
                queue.append(m)
        if limit is not None and len(out) >= limit:
            break
    return depth, out[:limit] if limit is not None else out


def test_neighbors_equal_a_plain_walk(spark):
    rng = random.Random(3)
    triples = sorted({(f"n{rng.randrange(12)}", rng.choice(["A", "B"]), f"n{rng.randrange(12)}") for _ in range(30)})
    e = edges_of(spark, triples)
    for direction in ("out", "in", "both"):
        nodes, found = G.neighbors(e, ids(spark, "n1", "n2", "zz"), 2, None, direction)
        depth, out = walk(triples, ["n1", "n2", "zz"], 2, direction)
        assert {r.id: r.depth for r in nodes.collect()} == depth
        assert {(r.source, r.rel, r.target) for r in found.collect()} == {x[:3] for x in out}


def test_limit_cuts_edges_in_walk_order(spark):
    triples = [("a", "R", f"b{i}") for i in range(4)] + [(f"b{i}", "R", f"c{i}{j}") for i in range(4) for j in range(3)]
    nodes, found = G.neighbors(edges_of(spark, triples), ids(spark, "a"), 2, None, "out", limit=6)
    depth, out = walk(triples, ["a"], 2, "out", 6)
    assert {(r.source, r.target) for r in found.collect()} == {(s, t) for s, _, t, _ in out}
    assert {r.id: r.depth for r in nodes.collect()} == depth


def test_cycle_and_self_loop(spark):
    e = edges_of(spark, [("a", "R", "b"), ("b", "R", "a"), ("a", "R", "a")])
    nodes, found = G.neighbors(e, ids(spark, "a"), 3)
    assert {r.id: r.depth for r in nodes.collect()} == {"a": 0, "b": 1} and found.count() == 3


def test_upserts(spark):
    rows = spark.createDataFrame([("x", "Defect", ["a", "b"], "p", 1), ("x", "Cause", ["b", "c"], None, 2), ("y", "Defect", None, None, 3)], "id string, label string, aliases array<string>, prop string, ord int")
    got = {r.id: (r.label, r.aliases, r.prop) for r in G.upsert_entities(rows).collect()}
    assert got == {"x": ("Cause", ["a", "b", "c"], "p"), "y": ("Defect", [], None)}
    again = G.upsert_entities(rows.unionByName(rows.withColumn("ord", F.col("ord") + 10)))
    assert {r.id: r.aliases for r in again.collect()}["x"] == ["a", "b", "c"]
    n = ids(spark, "x", "y").withColumn("label", F.lit("Defect"))
    e = edges_of(spark, [("x", "CAUSED_BY", "y"), ("x", "CAUSED_BY", "y"), ("x", "CAUSED_BY", "gone")])
    assert G.upsert_relations(e, n).count() == 1 and G.without_endpoints(e, n).count() == 1


def test_vocabulary_and_conformance(spark):
    nodes = spark.createDataFrame([("d", "Defect"), ("c", "Cause"), ("m", "Countermeasure"), ("p", "Process")], "id string, label string")
    e = edges_of(spark, [("d", "CAUSED_BY", "c"), ("c", "CAUSED_BY", "d"), ("m", "TARGETS", "p"), ("d", "NOPE", "c")])
    assert [r.rel for r in G.outside_vocabulary(e, "rel", vocab.relations(spark).select("rel")).collect()] == ["NOPE"]
    bad = G.nonconforming_edges(e, nodes, vocab.relations(spark)).collect()
    assert [(r.source, r.target) for r in bad] == [("c", "d")]
    assert vocab.labels(spark).count() == 6 and vocab.intents(spark).count() == 9


def test_merge_and_branch(spark):
    a = (ids(spark, "x").withColumn("v", F.lit(1)), edges_of(spark, [("x", "R", "y")]))
    b = (ids(spark, "x", "z").withColumn("v", F.lit(2)), edges_of(spark, [("x", "R", "y"), ("x", "R", "z")]))
    n, e = G.merge_subgraphs([a, b])
    assert {r.id: r.v for r in n.collect()} == {"x": 2, "z": 2} and e.count() == 2
    links = spark.createDataFrame([(1, "a", "Process"), (1, "b", "Defect"), (2, "c", "Material"), (3, "d", "Device")], "question int, id string, label string")
    assert {r.question: r.branch for r in G.branch(links).collect()} == {1: "defect", 2: "material", 3: "neighborhood"}


def test_find_both_ways(spark):
    n = spark.createDataFrame([("1", "Defect", "连锡", ["桥连"]), ("2", "Defect", "QFN连锡", None), ("3", "Cause", "other", [])], "id string, label string, name string, aliases array<string>")
    assert [r.id for r in G.find_entities(n, "QFN连锡", substring=True).collect()] == ["1", "2"]
    assert [r.id for r in G.find_entities(n, "桥连").collect()] == ["1"]
    assert G.find_entities(n, "桥连", label="Cause").count() == 0


def test_empty_graph(spark):
    e, n = edges_of(spark, []), spark.createDataFrame([], "id string, label string")
    assert G.neighbors(e, ids(spark, "a"))[0].count() == 0
    assert G.stats(n, e).where("n > 0").count() == 0


def test_count_reached_equals_sets_in_one_cell_or_many(spark, monkeypatch):
    rng = random.Random(5)
    first = [(f"r{rng.randrange(30)}", f"v{rng.randrange(40)}") for _ in range(300)] + [(None, "v1"), ("r1", None), ("alone", "nowhere")]
    second = [(f"v{rng.randrange(40)}", rng.randrange(50)) for _ in range(300)] + [("v1", None), (None, 3)]
    want = {}
    for r, v in first:
        if r and v:
            want.setdefault(r, (set(), set()))[0].add(v)
            want[r][1].update(i for w, i in second if w == v and i is not None)
    for most in (8_000_000, 40):
        monkeypatch.setattr(G, "CELL_ENTRIES", most)
        got = G.count_reached(spark.createDataFrame(first, "root string, via string"), spark.createDataFrame(second, "via string, id long"))
        assert {r.root: (r.n_via, r.n) for r in got.collect()} == {r: (len(a), len(b)) for r, (a, b) in want.items()}


def test_the_material_branch_shuffles_no_pairs_of_roots_and_ends(spark):
    from tessera.plans import graph_queries as Q

    plan = Q.material_branch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Distinct" not in plan and "lineitem" not in plan  # pairs are counted within cells
