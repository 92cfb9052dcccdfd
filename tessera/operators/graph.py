"""Property-graph operators over ``nodes`` (id, label, name, ...) and ``edges`` (source, rel, target, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import materialise


# -- validation and loading -----------------------------------------------------------------------


def outside_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value is null or not in the one-column vocabulary."""
    known = vocabulary.select(F.col(vocabulary.columns[0]).alias("_known"))
    return df.join(known, df[column] == F.col("_known"), "left_anti")


def nonconforming_edges(edges: DataFrame, nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges whose endpoint labels differ from the domain or range of their relation (any range if polymorphic)."""
    a, b = nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label")), nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    full = edges.join(a, "source").join(b, "target").join(schema, "rel")
    return full.where((F.col("source_label") != F.col("domain")) | (~F.col("polymorphic") & (F.col("target_label") != F.col("range")))).select(*edges.columns, "source_label", "target_label")


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def upsert_entities(rows: DataFrame, order: str = "ord", overwrite_aliases: bool = False) -> DataFrame:
    """(id, label, aliases, props): rows merged by id in ``order``.

    The last label wins, aliases are united in order of first appearance (or the last list wins),
    and of every property the last value that is not null wins.
    """
    last = lambda c: F.max_by(c, order)
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("aliases").alias("x")))), lambda s: s["x"])
    aliases = last("aliases") if overwrite_aliases else F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull())))
    props = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rows.columns if c not in ("id", "label", "aliases", order)]
    return rows.groupBy("id").agg(last("label").alias("label"), aliases.alias("aliases"), *props)


def upsert_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints present, once by (source, rel, target)."""
    return with_endpoints(edges, nodes).dropDuplicates(["source", "rel", "target"])


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def without_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that ``upsert_relations`` skips, for an honest count."""
    ids = nodes.select(F.col("id").alias("i"), F.lit(1).alias("here"))
    a, b = ids.select(F.col("i").alias("source"), F.col("here").alias("ha")), ids.select(F.col("i").alias("target"), F.col("here").alias("hb"))
    return edges.join(a, "source", "left").join(b, "target", "left").where("ha is null or hb is null").select(edges.columns)


def merge_subgraphs(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by (source, rel, target); of equals the one of the last part stays."""
    ns = reduce(DataFrame.unionByName, [n.withColumn("_part", F.lit(i)) for i, (n, _) in enumerate(parts)])
    es = reduce(DataFrame.unionByName, [e.withColumn("_part", F.lit(i)) for i, (_, e) in enumerate(parts)])

    def last(df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "_part")]
        if not rest:
            return df.select(keys).distinct()
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_part").alias("r"))
        return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))

    return last(ns, ["id"]), last(es, ["source", "rel", "target"])


# -- lookup ---------------------------------------------------------------------------------------


def find_entities(nodes: DataFrame, name: str, label: str | None = None, limit: int | None = 10, substring: bool = False) -> DataFrame:
    """Entities by name or alias: equal, or one containing the other; by id, at most ``limit``."""
    names = F.array(F.col("name"))
    if "aliases" in nodes.columns:
        names = F.concat(names, F.coalesce("aliases", F.array().cast("array<string>")))
    want = F.lit(name)
    hit = F.exists(names, lambda n: F.contains(n, want) | F.contains(want, n)) if substring else F.array_contains(names, want)
    out = nodes.where(hit & (F.col("label") == label if label else F.lit(True))).orderBy("id")
    return out if limit is None else out.limit(limit)


def get_entities(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities of an ordered id list (pos, id), missing ones dropped, with their place in the list."""
    return ids.join(nodes, "id").select("pos", *nodes.columns)


def outgoing(edges: DataFrame, ids: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """(id, rel, target): direct targets of every id."""
    e = edges.where(F.col("rel").isin(rels)) if rels else edges
    return e.join(ids.select(F.col("id").alias("source")).distinct(), "source").select(F.col("source").alias("id"), "rel", "target")


# -- traversal ------------------------------------------------------------------------------------


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, other, way, source, rel, target): edges as they are walked from a node."""
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("other"), F.lit("0").alias("way"), "source", "rel", "target")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("other"), F.lit("1").alias("way"), "source", "rel", "target")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int = 2, rels: list[str] | None = None, direction: str = "out", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and edges (source, rel, target, hop) within ``hops`` steps of the seeds (id).

    Every node is expanded once, at its least depth. A fixed number of joins with an anti-join
    against what was visited; no intermediate result goes to the driver. With a ``limit``, edges come in the
    order of a breadth-first walk that takes nodes and edges by id, and the first ``limit`` stay; nodes are
    those of the sources expanded until then, and no others are expanded (``_budgeted_walk``).
    """
    e = edges.where(F.col("rel").isin(rels)) if rels else edges
    steps = _steps(e, direction)
    known = e.select(F.col("source").alias("id")).union(e.select(F.col("target").alias("id"))).distinct()
    start = seeds.select("id").distinct().join(known, "id", "left_semi")
    if limit is not None:
        return _budgeted_walk(steps, start, hops, limit)
    visited, found = start.select("id", F.lit(0).alias("depth")), []
    frontier = start
    for hop in range(1, hops + 1):
        walked = frontier.join(steps, F.col("id") == F.col("at")).select("other", "source", "rel", "target")
        found.append(walked.withColumn("hop", F.lit(hop)))
        frontier = walked.select(F.col("other").alias("id")).distinct().join(visited, "id", "left_anti")
        visited = visited.unionByName(frontier.select("id", F.lit(hop).alias("depth")))
    return visited, reduce(DataFrame.unionByName, found).groupBy("source", "rel", "target").agg(F.min("hop").alias("hop"))


def _budgeted_walk(steps: DataFrame, start: DataFrame, hops: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The walk of ``neighbors`` with a limit: each hop expands, in order, only as many nodes as the edges that are left allow.

    The steps of the frontier's first nodes, no more than edges are left, are counted; a running sum in the walk's order says which of them are expanded. So
    the edges that a hop joins are bounded by what is left and the last node's own edges, and what a hop gives is written and small.
    """
    left, found = limit, []
    frontier = start.select("id", F.array("id").alias("key"))
    visited = start.select("id")
    order = Window.orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)  # over the nodes that the limit allows
    for hop in range(1, hops + 1):
        first = frontier.join(steps.select(F.col("at").alias("id")), "id", "left_semi").orderBy("key", "id").limit(max(left, 1))
        counted = first.join(steps.select(F.col("at").alias("id")), "id").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
        taken = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < left).select("id", "key")
        edge_key = F.concat("key", F.array(F.concat_ws("\u0001", "way", "rel", "other"))).alias("edge_key")
        walked = materialise(taken.join(steps, F.col("id") == F.col("at")).select("other", "source", "rel", "target", "key", edge_key, F.lit(hop).alias("hop")), "walked")
        found.append(walked)
        left -= walked.count()
        if left <= 0 or hop == hops:
            break
        reached = walked.groupBy(F.col("other").alias("id")).agg(F.min("edge_key").alias("key"))
        frontier = reached.join(visited, "id", "left_anti")
        visited = visited.unionByName(frontier.select("id"))
    walked = reduce(DataFrame.unionByName, found)
    reached = walked.select(F.explode(F.array("source", "target")).alias("id"), "hop") if limit > 0 else walked.select(F.col("other").alias("id"), "hop").limit(0)
    inside = reached.groupBy("id").agg(F.min("hop").alias("depth")).join(start.withColumn("seed", F.lit(1)), "id", "full")
    edges = walked.orderBy("hop", "edge_key").limit(limit).select("source", "rel", "target", "hop")
    return inside.select("id", F.when(F.col("seed") == 1, F.lit(0)).otherwise(F.col("depth")).alias("depth")), edges


def hop(edges: DataFrame, frontier: DataFrame, rel: str, reverse: bool = False, keep: tuple[str, ...] = ("root",)) -> DataFrame:
    """(keep..., id): one step along one relation from ``frontier`` (keep..., id), without repeats."""
    a, b = ("target", "source") if reverse else ("source", "target")
    e = edges.where(F.col("rel") == rel).select(F.col(a).alias("id"), F.col(b).alias("_to"))
    return frontier.join(e, "id").select(*keep, F.col("_to").alias("id")).distinct()


#: Entries of roots, and of ends, that a cell of ``count_reached`` holds, on average at most.
CELL_ENTRIES = 8_000_000


def count_reached(first: DataFrame, second: DataFrame) -> DataFrame:
    """(root, n_via, n): how many distinct nodes each root has one step on (root, via), and how many distinct ends two steps on (via, id).

    Pairs of a root and an end are counted where they arise and never written, as there may be many for each edge. Each node between becomes the list of its roots and
    that of its ends; both are cut by hash, and a cell meets one share of all roots with one share of all ends. A cell marks the ends of
    one root after the other. There are more cells, not larger ones, when there are more edges; what is shuffled grows with their square root more than the edges do.
    """
    spark, kind = first.sparkSession, first.schema["root"].dataType
    own = lambda df, c: df.where(F.col("via").isNotNull() & F.col(c).isNotNull()).groupBy("via").agg(F.collect_set(c).alias(f"{c}s"))
    stars = materialise(own(first, "root").join(own(second, "id"), "via", "left").select("roots", "ids"), "stars")
    a, b = stars.agg(F.sum(F.size("roots")), F.sum(F.when(F.col("ids").isNotNull(), F.size("ids")))).first()
    rows, columns = (max(1, -(-(n or 0) // CELL_ENTRIES)) for n in (a, b))
    share = lambda c, n, k: F.filter(c, lambda x: F.pmod(F.xxhash64(x), F.lit(n)) == k)
    cut = lambda c, n: F.array(*(F.struct(F.lit(k).alias("at"), share(c, n, k).alias("x")) for k in range(n))) if n > 1 else F.array(F.struct(F.lit(0).alias("at"), F.col(c).alias("x")))
    left = stars.where("ids is not null").select(F.explode(cut("roots", rows)).alias("r"), "ids").where(F.size("r.x") > 0)
    met = left.select("r", F.explode(cut("ids", columns)).alias("c")).where(F.size("c.x") > 0)
    cells = met.select((F.col("r.at") * columns + F.col("c.at")).alias("cell"), F.col("r.x").alias("roots"), F.col("c.x").alias("ids"))
    schema = T.StructType([T.StructField("root", kind), T.StructField("n", T.LongType())])

    def reached(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        roots, ids = (pa.concat_arrays([b.column(c) for b in held]) for c in ("roots", "ids"))
        held.clear()
        named, ends = roots.flatten().dictionary_encode(), ids.flatten().dictionary_encode()
        of, end = named.indices.to_numpy(), ends.indices.to_numpy()
        star = np.repeat(np.arange(len(roots), dtype=np.int32), np.diff(roots.offsets.to_numpy()))[np.argsort(of, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(named.dictionary)))])
        begin = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        size, seen, n = np.diff(begin), np.zeros(len(ends.dictionary), bool), np.empty(len(named.dictionary), np.int64)
        for r in range(len(n)):
            mine = star[cuts[r] : cuts[r + 1]]
            long = size[mine]
            at = np.repeat(begin[:-1][mine] - np.cumsum(long) + long, long)
            at += np.arange(len(at), dtype=at.dtype)
            found = end[at]
            seen[found] = True
            n[r] = np.count_nonzero(seen)
            seen[found] = False
        return pa.RecordBatch.from_arrays([named.dictionary, pa.array(n)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    if numbers[x] != cell and held:
                        yield reached(held)
                    cell = numbers[x]
                    held.append(batch.slice(x, y - x).select([1, 2]))
        if held:
            yield reached(held)

    parts = rows * columns
    found = cells.repartitionByRange(parts, "cell") if parts > 1 else cells.coalesce(1)
    far = found.sortWithinPartitions("cell").mapInArrow(run, schema).groupBy("root").agg(F.sum("n").alias("n"))
    near = stars.select(F.explode("roots").alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n_via"))
    return near.join(far, "root", "left").select("root", "n_via", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def causal_paths(edges: DataFrame, roots: DataFrame, cause: str, remedy: str, where: str | None = None, material: str | None = None, scope: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(root, part, id): causes (one hop), countermeasures (two), processes and materials of many roots at once.

    ``scope`` restricts causes and countermeasures by a condition on their node; the other parts are not scoped.
    """
    start = roots.select(F.col("id").alias("root"), "id").distinct()
    causes = hop(edges, start, cause)
    if scope is not None:
        allowed = nodes.where(scope).select("id")
        causes = causes.join(allowed, "id", "left_semi")
    remedies = hop(edges, causes, remedy)
    if scope is not None and nodes is not None:
        remedies = remedies.join(nodes.where(scope | nodes["scope"].isNull()).select("id"), "id", "left_semi")
    parts = [causes.select("root", F.lit("cause").alias("part"), "id"), remedies.select("root", F.lit("countermeasure").alias("part"), "id")]
    for rel, part in ((where, "process"), (material, "material")):
        if rel:
            parts.append(hop(edges, start, rel).select("root", F.lit(part).alias("part"), "id"))
    return reduce(DataFrame.unionByName, parts)


def branch(links: DataFrame) -> DataFrame:
    """(question, branch): the kind of graph query that a question's linked entities (question, id, label) call for.

    Defects come before processes, processes before materials; anything else takes the neighbourhood.
    """
    has = lambda label: F.max((F.col("label") == label).cast("int")) == 1
    pick = F.when(has("Defect"), "defect").when(has("Process"), "process").when(has("Material"), "material").otherwise("neighborhood")
    return links.groupBy("question").agg(pick.alias("branch"))


#: Products are materials with this prefix; what is made for one has its code in its id. A fixed value.
PRODUCT_PREFIX = "MAT_PD"


def resolve_by_name(links: DataFrame, nodes: DataFrame, label: str = "Defect") -> DataFrame:
    """Links (question, surface) as (question, id): the first node of the label, by id, whose name holds the surface or is held by it."""
    from tessera.operators.search import substring_join

    names = nodes.where(F.col("label") == label).select("id", F.col("name").alias("text"))
    asked = links.select(F.col("surface").alias("sid"), F.col("surface")).distinct()
    held = substring_join(names, asked).select("sid", "id")
    holds = substring_join(asked.select(F.col("sid").alias("id"), F.col("surface").alias("text")), names.select(F.col("id").alias("sid"), F.col("text").alias("surface"))).select(F.col("id").alias("sid"), F.col("sid").alias("id"))
    first = held.unionByName(holds).groupBy("sid").agg(F.min("id").alias("id"))
    return links.join(first, links["surface"] == first["sid"]).select("question", first["id"]).distinct()


def cases(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question, case) and links by case: questions that name the same entities (question, id, label, pos) are one case, called by the first of them.

    What the graph answers depends on the case alone, so it is worked out once for all of its questions.
    """
    named = links.groupBy("question").agg(F.array_sort(F.collect_set(F.struct("id", "label", "pos"))).alias("named"))  # a question's own links
    first = named.groupBy("named").agg(F.min("question").alias("case"))
    mine = materialise(named.join(first, "named").select("question", "case", F.when(F.col("question") == F.col("case"), F.col("named")).alias("named")), "cases")
    return mine.select("question", "case"), mine.where("named is not null").select(F.col("case").alias("question"), F.inline("named"))


def answer_graph(links: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(question, branch, part, id): what the graph answers to questions with linked entities (question, id, label, pos).

    Each question takes one branch: its defects (causes, countermeasures, processes and materials), else its processes
    (their defects, those defects' countermeasures, materials), else its materials that are no products (their defects, the
    processes and countermeasures of these), else what lies within two hops of its first entity (part ``near``). Products
    that a question names restrict causes, and all countermeasures, to ids with one of their codes. With ``nodes``
    and a column ``surface`` in ``links``, defects of questions without a product are looked up anew by that text.
    """
    product = F.startswith("id", F.lit(PRODUCT_PREFIX))
    codes = links.where(product).groupBy("question").agg(F.collect_set(F.substring_index("id", "_", -1)).alias("codes"))
    plain = links.where(~product)
    kind = branch(plain.select("question", "id", "label").unionByName(links.select("question", "id", F.lit("").alias("label"))))
    of = lambda name, label=None: plain.where(F.col("label") == label if label else F.lit(True)).join(kind.where(F.col("branch") == name), "question").select("question", "id")
    step = lambda frontier, rel, reverse=False: hop(edges, frontier, rel, reverse, ("question",))

    def scoped(df: DataFrame) -> DataFrame:
        inside = F.col("codes").isNull() | F.exists("codes", lambda c: F.contains("id", F.concat(F.lit("_"), c, F.lit("_"))))
        return df.join(codes, "question", "left").where(inside).select("question", "id")

    defects = of("defect", "Defect")
    if nodes is not None:
        named = plain.where("label = 'Defect'").join(codes, "question", "left_anti").select("question", "surface")
        defects = defects.join(codes, "question", "left_semi").unionByName(resolve_by_name(named, nodes)).distinct()
    causes = scoped(step(defects, "CAUSED_BY"))
    at_process = step(of("process", "Process"), "OCCURS_AT", True)
    from_material = step(of("material", "Material"), "INDUCED_BY_MATERIAL", True)

    def remedies(label: str, name: str, rel: str) -> DataFrame:
        """Countermeasures of the defects of processes or materials, worked out once for each of these and then met with the questions."""
        start = of(name, label)
        roots = start.select(F.col("id").alias("root"), "id").distinct()
        way = hop(edges, hop(edges, hop(edges, roots, rel, True), "CAUSED_BY"), "ADDRESSED_BY")
        return scoped(start.withColumnRenamed("id", "root").join(way, "root").select("question", "id").distinct())

    induced = of("material", "Material")
    sites = hop(edges, hop(edges, induced.select(F.col("id").alias("root"), "id").distinct(), "INDUCED_BY_MATERIAL", True), "OCCURS_AT")
    places = induced.withColumnRenamed("id", "root").join(sites, "root").select("question", "id").distinct()
    first = links.join(kind.where("branch = 'neighborhood'"), "question").groupBy("question").agg(F.min(F.struct("pos", "id")).alias("f")).select("question", F.col("f.id").alias("id"))
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("_to"))
    once = first.join(out, "id").select("question", F.col("_to").alias("id")).distinct()
    near = once.unionByName(once.join(out, "id").select("question", F.col("_to").alias("id"))).unionByName(first).distinct()
    parts = (
        ("defect", "cause", causes), ("defect", "countermeasure", scoped(step(causes, "ADDRESSED_BY"))), ("defect", "process", step(defects, "OCCURS_AT")), ("defect", "material", step(defects, "INDUCED_BY_MATERIAL")),
        ("process", "defect", at_process), ("process", "countermeasure", remedies("Process", "process", "OCCURS_AT")), ("process", "material", step(of("process", "Process"), "USES_MATERIAL")),
        ("material", "defect", from_material), ("material", "process", places), ("material", "countermeasure", remedies("Material", "material", "INDUCED_BY_MATERIAL")), ("neighborhood", "near", near),
    )
    return reduce(DataFrame.unionByName, [df.distinct().select("question", F.lit(b).alias("branch"), F.lit(p).alias("part"), "id") for b, p, df in parts])


#: The part of the graph's answer that an intent asks for, and the intents whose linked label takes one hop instead.
# fixed values
INTENT_PARTS = {
    "defect_to_process": "process", "process_to_defects": "defect", "process_defect_count": "defect", "defect_to_causes": "cause",
    "defect_to_countermeasures": "countermeasure", "process_aggregate_cm": "countermeasure", "material_to_defects": "defect",
}
INTENT_HOPS = {"device_to_process": ("Device", "USED_IN"), "process_to_materials": ("Process", "USES_MATERIAL")}


def graph_candidates(answers: DataFrame, links: DataFrame, questions: DataFrame, edges: DataFrame, remedy_prefix: str = "CM_") -> DataFrame:
    """(question, id): the answers (question, part, id) that fit the intent of their question (question, intent).

    Of countermeasures only those with the prefix count. Devices and processes that a question names give their own targets.
    """
    part = F.create_map(*(F.lit(x) for kv in INTENT_PARTS.items() for x in kv))
    wanted = questions.select("question", F.try_element_at(part, F.col("intent")).alias("part")).where("part is not null")
    fit = answers.join(wanted, ["question", "part"]).where((F.col("part") != "countermeasure") | F.startswith("id", F.lit(remedy_prefix))).select("question", "id")
    for intent, (label, rel) in INTENT_HOPS.items():
        start = links.where(F.col("label") == label).join(questions.where(F.col("intent") == intent), "question", "left_semi").select("question", "id")
        fit = fit.unionByName(hop(edges, start, rel, keep=("question",)))
    return fit.distinct()


def template_answers(edges: DataFrame) -> DataFrame:
    """(template, root, found): the template questions of the vocabulary, as sorted lists for every root.

    Causes and countermeasures of a defect, processes where a defect occurs, and defects of a process.
    """
    rel = lambda name: edges.where(F.col("rel") == name)
    causes = rel("CAUSED_BY").select(F.col("source").alias("root"), F.col("target").alias("id"))
    remedies = hop(edges, causes, "ADDRESSED_BY")
    at = rel("OCCURS_AT")
    parts = (("causes", causes), ("countermeasures", remedies), ("processes", at.select(F.col("source").alias("root"), F.col("target").alias("id"))), ("defects", at.select(F.col("target").alias("root"), F.col("source").alias("id"))))
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("template"), "root", "id") for t, df in parts])
    return rows.groupBy("template", "root").agg(F.array_sort(F.collect_set("id")).alias("found"))


# -- aggregates -----------------------------------------------------------------------------------


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes and edges in all (name null), nodes by label, edges by relation; one pass over each.

    A null label or relation is counted under the empty name.
    """
    filled = lambda df, c: df.select(F.coalesce(c, F.lit("")).alias("name")).rollup("name").agg(F.count(F.lit(1)).alias("n"))
    n = filled(nodes, "label").select(F.lit("node").alias("kind"), "name", "n")
    e = filled(edges, "rel").select(F.lit("edge").alias("kind"), "name", "n")
    return n.unionByName(e)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def absent(df: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key no row of ``others`` has."""
    return df.join(others.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def neighbor_sets(edges: DataFrame) -> DataFrame:
    """(rel, source, targets): sorted distinct targets."""
    return edges.groupBy("rel", "source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def neighbor_counts(edges: DataFrame, rel: str, reverse: bool = False) -> DataFrame:
    """(id, n): distinct neighbours along one relation."""
    a, b = ("target", "source") if reverse else ("source", "target")
    return edges.where(F.col("rel") == rel).groupBy(F.col(a).alias("id")).agg(F.count_distinct(b).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("target"), F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def ambiguous_surfaces(aliases: DataFrame) -> DataFrame:
    """(surface, n): surfaces that more than one entity owns."""
    return aliases.groupBy("surface").agg(F.count_distinct("entity_id").alias("n")).where("n > 1")


def first_rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
