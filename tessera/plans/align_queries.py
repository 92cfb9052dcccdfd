"""Queries of alignment, ordering, set operations, run logs and question answering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.operators import chunk as C
from tessera.operators import evaluate as E
from tessera.operators import graph as G
from tessera.operators import qa as Q
from tessera.operators import search as S
from tessera.operators.draws import draws_without_repeats
from tessera.plans.search_queries import VEC_SQL
from tessera.plans.text_queries import MD5_SQL
from tessera.sources import fixture_graph as X
from tessera.sources.tables import table
from tessera.streaming import runlog as L

# surfaces: part names as they are, without their first letter, with the last letter changed, or with a new word
SURFACES_SQL = """m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name[1]) || p_name[2:] WHEN 2 THEN left(p_name, length(p_name) - 1) || 'z' WHEN 3 THEN p_name[2:] ELSE p_name || ' new' || (p_partkey % 3) END AS surface, p_name FROM part)"""


def _mentions(sp, d):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    tail = F.expr("substring(p_name, 2)")
    s = F.when(k == 0, n).when(k == 1, F.concat(F.upper(F.substring(n, 1, 1)), tail)).when(k == 2, F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("z"))).when(k == 3, tail).otherwise(F.concat(n, F.lit(" new"), (F.col("p_partkey") % 3).cast("string")))
    return table(sp, d, "part").select("p_partkey", s.alias("surface"), F.lit("Material").alias("label"))


def _names(sp, d):
    """(name, surface, label, entity_id, ord): distinct cleaned part names, named by their least key."""
    n = table(sp, d, "part").groupBy(F.regexp_replace("p_name", " ", "").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    return n.select("name", F.col("name").alias("surface"), F.lit("Material").alias("label"), "entity_id", F.col("entity_id").alias("ord"))


def _grouped(sp, d):
    return A.group_surfaces(_mentions(sp, d))


def _stages(sp, d):
    g, n = _grouped(sp, d), _names(sp, d)
    return g, [("alias", A.by_alias(g, n)), ("suffix", A.by_suffix(g, n)), ("edit", A.by_one_edit(g, n))]


def aligned(sp, d):
    return A.cascade(*_stages(sp, d))


def rolled(sp, d):
    g, stages = _stages(sp, d)
    return A.roll_up(A.cascade(g, stages), g).select("entity_id", "label", "n_surfaces", "n_mentions", "method")


ALIGN_SQL = "WITH " + SURFACES_SQL + """,
g AS (SELECT replace(surface, ' ', '') AS surface, count(*) AS n, count(DISTINCT surface) AS raws FROM m GROUP BY 1),
nm AS (SELECT replace(p_name, ' ', '') AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1),
al AS (SELECT g.surface, entity_id FROM g JOIN nm ON nm.name = g.surface),
su AS (SELECT g.surface, min(entity_id) AS entity_id FROM g JOIN nm ON suffix(nm.name, g.surface) WHERE length(g.surface) >= 8 GROUP BY 1 HAVING count(DISTINCT name) = 1),
ed AS (SELECT g.surface, min(entity_id) AS entity_id FROM g JOIN nm ON levenshtein(g.surface, nm.name) = 1 WHERE length(g.surface) <= 12 GROUP BY 1),
c AS (SELECT g.*, CASE WHEN al.entity_id IS NOT NULL THEN 'alias' WHEN su.entity_id IS NOT NULL THEN 'suffix' WHEN ed.entity_id IS NOT NULL THEN 'edit' ELSE 'new' END AS method,
  coalesce(CAST(al.entity_id AS VARCHAR), CAST(su.entity_id AS VARCHAR), CAST(ed.entity_id AS VARCHAR), 'EX_Material_' || upper(substring(md5(g.surface), 1, 10))) AS entity_id
  FROM g LEFT JOIN al USING (surface) LEFT JOIN su USING (surface) LEFT JOIN ed USING (surface))"""


def product_edges(sp, d):
    """Edges of orders: documents with a product take its mapping, others all mappings."""
    li = table(sp, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("p") % 30).cast("string").alias("head"), F.lit("USES_MATERIAL").alias("rel"), (30 + F.col("s") % 10).cast("string").alias("tail"), F.col("l_linenumber").alias("ord"))
    key = F.col("id")
    m = sp.range(36).select(key.cast("string").alias("surface"), F.explode(F.array(F.lit(None).cast("string"), F.when(key % 2 == 0, F.lit("A")).otherwise("C"), F.lit("B"))).alias("product")).where("product is not null or cast(surface as int) % 3 = 0")
    m = m.withColumn("entity_id", F.concat("surface", F.lit("/"), F.coalesce("product", F.lit("-"))))
    docs = t.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B").alias("product"))
    return A.resolve_edges(t, m, docs)


RESOLVE_SQL = """WITH t AS MATERIALIZED (SELECT l_orderkey AS doc_id, CAST(min(l_partkey) % 30 AS VARCHAR) AS head, CAST(30 + min(l_suppkey) % 10 AS VARCHAR) AS tail, l_linenumber AS ord, CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS product FROM lineitem GROUP BY l_orderkey, l_linenumber),
m AS (SELECT CAST(i AS VARCHAR) AS surface, p AS product, i || '/' || coalesce(p, '-') AS entity_id FROM range(36) r(i), (SELECT unnest([NULL, 'A', 'B', 'C']) AS p) WHERE (p IS NULL AND i % 3 = 0) OR p = 'B' OR (p = 'A' AND i % 2 = 0) OR (p = 'C' AND i % 2 = 1)),
e AS MATERIALIZED (SELECT doc_id, ord, 'h' AS side, entity_id, row_number() OVER (PARTITION BY doc_id, ord ORDER BY m.product IS NULL, entity_id) AS r, t.product FROM t JOIN m ON m.surface = t.head AND (t.product IS NULL OR m.product IS NULL OR m.product = t.product)
  UNION ALL SELECT doc_id, ord, 't', entity_id, row_number() OVER (PARTITION BY doc_id, ord ORDER BY m.product IS NULL, entity_id), t.product FROM t JOIN m ON m.surface = t.tail AND (t.product IS NULL OR m.product IS NULL OR m.product = t.product)),
k AS MATERIALIZED (SELECT * FROM e WHERE product IS NULL OR r = 1),
x AS MATERIALIZED (SELECT a.doc_id, a.ord, a.entity_id AS head_id, b.entity_id AS tail_id FROM k a JOIN k b USING (doc_id, ord) WHERE a.side = 'h' AND b.side = 't')"""


def scoped_margin(sp, d):
    v = table(sp, d, "embeddings")
    s = S.cosine_within(v.where("vec_id % 20 = 0"), v, "label", 5)
    scores = s.join(v.select(F.col("vec_id").alias("qid"), "label"), "qid").select(F.col("qid").cast("string").alias("surface"), F.when(F.col("label") % 2 == 0, "Cause").otherwise("Countermeasure").alias("label"), F.col("label").alias("scope"), F.col("id").alias("entity_id"), "sim")
    return A.by_similarity(scores, {"Cause": (0.2, 0.02), "Countermeasure": (0.15, 0.0)})


def accepted(sp, d):
    s = table(sp, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("sim"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3).alias("surface_product"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 3).alias("entity_product"))
    return A.accept_global(s, 0.05).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def _runs(sp, d):
    return table(sp, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("node_id"), "ts", F.when(F.col("value") > 50, "high").otherwise("low").alias("level"), F.col("props").alias("message"), "user_id")


def run_ledger(sp, d):
    e = table(sp, d, "events")
    starts = e.where("event_id % 4 <> 3").select(F.col("event_id").alias("id"), F.col("event_type").alias("node_id"), F.col("ts").alias("started_at"))
    ends = e.where("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, "failed").otherwise("done").alias("status"), F.col("ts").alias("finished_at"), F.col("props").alias("stats"))
    return L.ledger(starts, ends).groupBy("node_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count("finished_at").alias("finished"))


def resumed(sp, d):
    segs = table(sp, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    done = table(sp, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linestatus") == "O", "v1").otherwise("v2").alias("mode"), (F.col("l_returnflag") == "R").alias("failed"))
    return L.pending(segs, done, "v1").select("key")


def cached(sp, d):
    keys = table(sp, d, "orders").select((F.col("o_custkey") % 700).alias("cache_key"))
    cache = table(sp, d, "customer").select((F.col("c_custkey") % 500).alias("cache_key"), F.col("c_name").alias("response"), F.to_timestamp(F.timestamp_seconds("c_custkey")).alias("ts"))
    return L.read_through(keys, cache, lambda q: q.select("cache_key", F.concat(F.lit("new "), F.col("cache_key").cast("string")).alias("response")))[0]


def _answers(sp, d):
    """Per customer: parts of urgent orders as graph answers, parts of all orders by quantity as vector answers."""
    rows = table(sp, d, "orders").join(table(sp, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    g = S.flatten_ranks(rows.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("qid"), "l_orderkey", F.col("l_partkey").alias("id")), ["qid"], ["l_orderkey"])
    v = S.flatten_ranks(rows.select(F.col("o_custkey").alias("qid"), (-F.col("l_quantity")).alias("q"), F.col("l_partkey").alias("id")), ["qid"], ["q"])
    return g, v


ANSWERS_SQL = """WITH r AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
g AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY o, id) AS pos FROM (SELECT o_custkey AS qid, l_partkey AS id, min(l_orderkey) AS o FROM r WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)),
v AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY o, id) AS pos FROM (SELECT o_custkey AS qid, l_partkey AS id, min(-l_quantity) AS o FROM r GROUP BY 1, 2)),
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS k FROM v WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.qid = v.qid AND g.id = v.id))"""
FUSE_SQL = ANSWERS_SQL + ", f AS (SELECT qid, id, 0 AS s, pos AS p FROM g UNION ALL SELECT qid, id, 1, k FROM x WHERE k <= 3), o AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY s, p, id) AS INTEGER) AS pos FROM f)"


def numbers(sp, d):
    g, v = _answers(sp, d)
    both = g.select("qid", "id", F.lit("graph").alias("channel")).unionByName(v.select("qid", "id", F.lit("bm25").alias("channel")))
    questions = table(sp, d, "customer").select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 2 == 0, "process_defect_count").otherwise("defect_to_causes").alias("intent"))
    return Q.numeric_answers(both, questions, ("process_defect_count",))


def fitting(sp, d):
    g = table(sp, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.lit(1).alias("pos"))
    nodes = table(sp, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    questions = table(sp, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("intent"))
    intents = sp.createDataFrame([("BUILDING", "1-URGENT"), ("MACHINERY", "2-HIGH")], "intent string, label string")
    return Q.with_fitting_label(g, nodes, questions, intents)


def composed(sp, d):
    sets = table(sp, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("names"), F.array_sort(F.collect_set(F.when(F.col("n_nationkey") > 20, F.col("n_name")))).alias("late"))
    return sets.join(table(sp, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", Q.compose_answer(F.col("r_name"), [("原因", F.col("names"), 3), ("对策", F.col("late"), 2)]).alias("answer"))


def shown_evidence(sp, d):
    g, v = _answers(sp, d)
    hits = v.select("qid", F.col("id").cast("string").alias("chunk_id"), "pos")
    names = g.select("qid", F.col("id").cast("string").alias("name"), "pos")
    triples = g.select("qid", F.concat(F.lit("t"), F.col("id").cast("string")).alias("triple"), "pos")
    return Q.evidence(hits, triples, names).select("qid", F.array_join("chunks", ",").alias("chunks"), F.array_join("triples", ",").alias("triples"), F.array_join("names", ",").alias("names"))


def questions(sp, d):
    e = X.edges(sp, d, "BASED_IN", "LOCATED_IN").groupBy(F.col("target").alias("source"), "rel").agg(F.collect_set("source").alias("targets"))
    sets = e.join(X.nodes(sp, d).select(F.col("id").alias("source"), "name"), "source")
    out = Q.generate_questions(sets, [("single", "process_to_defects", "BASED_IN", "哪些供应商在{}？"), ("agg", "process_defect_count", "LOCATED_IN", "{}有多少客户？")], 10, "42")
    return out.select("qid", "qtype", "intent", "query", F.array_join("gold_ids", ",").alias("gold"), "gold_number")


QUESTIONS_SQL = """WITH b AS (SELECT 'N:' || n_nationkey AS source, n_name, string_agg('S:' || s_suppkey, ',' ORDER BY 'S:' || s_suppkey) AS gold FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
l AS (SELECT 'N:' || n_nationkey AS source, n_name, string_agg('C:' || c_custkey, ',' ORDER BY 'C:' || c_custkey) AS gold, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT * FROM (SELECT 'process_to_defects:' || source AS qid, 'single' AS qtype, 'process_to_defects' AS intent, '哪些供应商在' || n_name || '？' AS query, gold, CAST(NULL AS INTEGER) AS gold_number FROM b ORDER BY md5('42|process_to_defects|' || source), source LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'process_defect_count:' || source, 'agg', 'process_defect_count', n_name || '有多少客户？', gold, CAST(n AS INTEGER) FROM l ORDER BY md5('42|process_defect_count|' || source), source LIMIT 10)"""


def noisy(sp, d):
    q = table(sp, d, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.concat("c_name", F.lit("温")).alias("name")).withColumn("query", F.concat(F.lit("问："), "name"))
    aliases = table(sp, d, "customer").where("c_custkey % 2 = 0").select(F.concat("c_name", F.lit("温")).alias("name"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("alias"))
    return Q.with_noise(q, aliases, 0.3, 0.08).groupBy("noise").agg(F.count(F.lit(1)).alias("n"))


def set_sizes(sp, d):
    """Parts ordered urgently and parts ordered otherwise, per status: both, only the one, only the other."""
    rows = table(sp, d, "orders").join(table(sp, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    scores = E.set_scores(rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority <> '1-URGENT'"), ["l_partkey"], ["o_orderstatus"])
    return scores.select("o_orderstatus", "tp", "fp", "fn")


def shuffled(sp, d):
    return table(sp, d, "part").withColumn("h", F.md5(F.concat(F.lit("s|"), F.col("p_partkey").cast("string")))).orderBy("h", "p_partkey").limit(25).select("p_partkey", "p_name")


def slices(sp, d):
    order = [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    return S.top_k(table(sp, d, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "l_partkey", "l_quantity", F.col("rank").alias("r"))


def manifest(sp, d):
    docs = table(sp, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


def first_match(sp, d):
    """For each size the first part whose name holds a keyword, else the first of all."""
    order = [F.when(F.contains("p_name", F.lit("ring")), 0).otherwise(1), F.col("p_partkey")]
    return G.first_rank(table(sp, d, "part"), ["p_size"], order).select("p_size", "p_partkey", "p_name")


def batches(sp, d):
    """Parts not ordered at all first seen per brand, in fixed batches of 36."""
    unsold = table(sp, d, "part").join(table(sp, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return C.placed(unsold, ["p_brand"], ["p_partkey"]).withColumn("batch", F.floor(F.col("place") / 36).cast("long")).groupBy("p_brand", "batch").agg(F.count(F.lit(1)).alias("n"))


def scenarios(sp, d):
    """Each region with parts of its own kind, ten by hash: a filtered pairing of two small sides."""
    p = table(sp, d, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("kind"))
    pairs = table(sp, d, "region").join(p, F.col("kind") != F.col("r_regionkey"))
    w = Window.partitionBy("r_regionkey").orderBy(F.md5(F.concat_ws("|", F.col("r_regionkey").cast("string"), F.col("p_partkey").cast("string"))))
    return pairs.withColumn("r", F.row_number().over(w)).where("r <= 10").select("r_regionkey", "p_partkey")


def drawn(sp, d):
    """Four parts of a size for each order: the orders are dealt to the sizes in turn, and a size gives no part again before all are used, or fewer than three are left."""
    k = F.col("o_orderkey")
    asks = table(sp, d, "orders").select((k % 50 + 1).cast("int").alias("key"), F.floor(k / 50).cast("long").alias("no"))
    items = table(sp, d, "part").select(F.col("p_size").alias("key"), F.col("p_partkey").alias("item"))
    return draws_without_repeats(asks, items, "42", 4, 3).select("key", "no", "place", "item")


DRAWN_SQL = """WITH h AS (SELECT p_size AS key, count(*) AS n, greatest(count(*) // 4 + CASE WHEN count(*) % 4 >= 3 THEN 1 ELSE 0 END, 1) AS rounds FROM part GROUP BY 1),
a AS (SELECT DISTINCT key, no, n, no // rounds AS turn, no % rounds * 4 AS f FROM (SELECT CAST(o_orderkey % 50 + 1 AS INTEGER) AS key, o_orderkey // 50 AS no FROM orders) JOIN h USING (key)),
p AS (SELECT key, turn, p_partkey AS item, row_number() OVER (PARTITION BY key, turn ORDER BY md5('42|' || key || '|' || turn || '|' || p_partkey), p_partkey) - 1 AS place FROM (SELECT DISTINCT key, turn FROM a) JOIN part ON p_size = key)
SELECT key, no, place, item FROM a JOIN p USING (key, turn) WHERE place >= f AND place < least(f + 4, n)"""


QUERIES = {
    "aln1_surface_groups": (lambda sp, d: _grouped(sp, d).select("surface", F.size("raws").cast("long").alias("raws"), "n"), "WITH " + SURFACES_SQL + " SELECT replace(surface, ' ', '') AS surface, count(DISTINCT surface) AS raws, count(*) AS n FROM m GROUP BY 1"),
    "jn1_alias_join": (lambda sp, d: _stages(sp, d)[1][0][1].select("surface", "entity_id", "label_mismatch"), ALIGN_SQL + " SELECT surface, entity_id, false AS label_mismatch FROM al"),
    "jn5_suffix_join": (lambda sp, d: _stages(sp, d)[1][1][1].select("surface", "entity_id"), ALIGN_SQL + " SELECT surface, entity_id FROM su"),
    "jn4_one_edit_join": (lambda sp, d: _stages(sp, d)[1][2][1].select("surface", "entity_id"), ALIGN_SQL + " SELECT surface, entity_id FROM ed"),
    "aln2_cascade": (lambda sp, d: aligned(sp, d).select("surface", "entity_id", "method"), ALIGN_SQL + " SELECT surface, entity_id, method FROM c"),
    "aln3_global_accept": (accepted, "SELECT l_linenumber, count(*) AS n FROM (SELECT l_linenumber, l_discount, nullif(l_suppkey % 3, 0) AS s, nullif(l_partkey % 3, 0) AS e FROM lineitem) WHERE l_discount >= 0.05 AND (e IS NULL OR e = s) GROUP BY 1"),
    "aln4_new_entities": (lambda sp, d: aligned(sp, d).where("method = 'new'").select("surface", "entity_id"), ALIGN_SQL + " SELECT surface, entity_id FROM c WHERE method = 'new'"),
    "aln5_roll_up": (rolled, ALIGN_SQL + " SELECT entity_id, 'Material' AS label, CAST(sum(raws) AS BIGINT) AS n_surfaces, CAST(sum(n) AS BIGINT) AS n_mentions, min_by(method, surface) AS method FROM c GROUP BY entity_id"),
    "aln6_edge_dedup": (lambda sp, d: A.first_edges(product_edges(sp, d)[0]), RESOLVE_SQL + " SELECT head_id, 'USES_MATERIAL' AS rel, tail_id, arg_min(doc_id, CAST(ord AS BIGINT) * 1000000000 + doc_id) AS doc_id FROM x WHERE head_id <> tail_id GROUP BY ALL"),
    "aln7_audit": (lambda sp, d: A.audit(aligned(sp, d), _names(sp, d).where("entity_id % 2 = 0").select(F.col("entity_id").cast("string").alias("head_id"), F.lit("x").alias("tail_id"))),
        ALIGN_SQL + ", p AS (SELECT entity_id, min(method) AS method FROM c GROUP BY 1) SELECT count(*) AS entities, round(avg(CASE WHEN method = 'new' THEN 1.0::DOUBLE ELSE 0 END), 4) AS new_rate, round(avg(CASE WHEN entity_id IN (SELECT CAST(entity_id AS VARCHAR) FROM nm WHERE entity_id % 2 = 0) THEN 0.0::DOUBLE ELSE 1 END), 4) AS orphan_rate, count(*) FILTER (method = 'alias') AS n_alias, count(*) FILTER (method = 'suffix') AS n_suffix, count(*) FILTER (method = 'edit') AS n_edit, count(*) FILTER (method = 'new') AS n_new FROM p"),
    "jn8_edge_resolution": (lambda sp, d: product_edges(sp, d)[0], RESOLVE_SQL + " SELECT head_id, 'USES_MATERIAL' AS rel, tail_id, doc_id, ord FROM x WHERE head_id <> tail_id"),
    "jn8_dropped": (lambda sp, d: product_edges(sp, d)[1].select("doc_id", "ord"), RESOLVE_SQL + " SELECT doc_id, ord FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = t.doc_id AND x.ord = t.ord)"),
    "jn7_scoped_margin": (scoped_margin, VEC_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM s WHERE la = lb),
b AS (SELECT qid, la, max(id) FILTER (r = 1) AS entity_id, max(sim) FILTER (r = 1) AS sim, max(sim) FILTER (r = 1) - coalesce(max(sim) FILTER (r = 2), 0) AS margin FROM r WHERE r <= 2 GROUP BY qid, la)
SELECT CAST(qid AS VARCHAR) AS surface, CASE WHEN la % 2 = 0 THEN 'Cause' ELSE 'Countermeasure' END AS label, la AS scope, entity_id, sim, round(margin, 6) AS margin FROM b WHERE CASE WHEN la % 2 = 0 THEN sim >= 0.2 AND margin >= 0.02 ELSE sim >= 0.15 AND margin >= 0 END"""),
    "agg7_manifest": (manifest, "SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"),
    "win1_latest_run": (lambda sp, d: L.latest_runs(_runs(sp, d)).select("node_id", "id", "level", "user_id"), "SELECT event_type AS node_id, max(event_id) AS id, arg_max(CASE WHEN value > 50 THEN 'high' ELSE 'low' END, event_id) AS level, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1"),
    "win2_top_with_margin": (lambda sp, d: S.top_with_margin(table(sp, d, "lineitem"), ["l_partkey"], "l_quantity"),
        "SELECT l_partkey, q[1] AS best, q[1] - coalesce(q[2], 0) AS margin FROM (SELECT l_partkey, max(l_quantity, 2) AS q FROM lineitem GROUP BY 1)"),
    "win3_positional_pairs": (lambda sp, d: _pairs(sp, d), "SELECT a.k, p_partkey, s_suppkey FROM (SELECT p_partkey % 25 AS k, p_partkey, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS i FROM part) a JOIN (SELECT s_suppkey % 25 AS k, s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 25 ORDER BY s_suppkey DESC) AS i FROM supplier) b ON a.k = b.k AND a.i = b.i"),
    "srt1_longest_first": (lambda sp, d: C.numbered(table(sp, d, "part").select("p_name").distinct(), [F.desc(F.length("p_name")), "p_name"]).select("p_name", (F.col("no") + 1).cast("int").alias("place")), "SELECT p_name, CAST(row_number() OVER (ORDER BY length(p_name) DESC, p_name) AS INTEGER) AS place FROM (SELECT DISTINCT p_name FROM part)"),
    "srt2_top_slices": (slices, "SELECT l_orderkey, l_partkey, l_quantity, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3"),
    "srt3_seeded_shuffle": (shuffled, "SELECT p_partkey, p_name FROM part ORDER BY md5('s|' || p_partkey), p_partkey LIMIT 25"),
    "set1_set_sizes": (set_sizes, "WITH r AS (SELECT o_orderstatus, l_partkey, bool_or(o_orderpriority = '1-URGENT') AS a, bool_or(o_orderpriority <> '1-URGENT') AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_orderstatus, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM r GROUP BY 1"),
    "set2_union_distinct": (lambda sp, d: X.edges(sp, d, "CONTAINS").select("source").union(X.edges(sp, d, "FULFILLED_BY").select("source")).distinct(), "SELECT DISTINCT 'O:' || l_orderkey AS source FROM lineitem"),
    "set3_ordered_union": (lambda sp, d: Q.fuse(*_answers(sp, d), cap=10), FUSE_SQL + " SELECT * FROM o WHERE pos <= 10"),
    "qa1_hybrid_fusion": (lambda sp, d: Q.fuse(*_answers(sp, d)), FUSE_SQL + " SELECT * FROM o"),
    "qa1_label_fit": (fitting, "SELECT o_custkey AS qid, o_orderkey AS id, 1 AS pos FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT') OR (c_mktsegment = 'MACHINERY' AND o_orderpriority = '2-HIGH')"),
    "qa2_prefix_exclusion": (lambda sp, d: Q.without_prefixes(X.nodes(sp, d), ("S:1", "C:")).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT LIKE '1%')"),
    "prj4_intent_filter": (lambda sp, d: S.intent_filter(table(sp, d, "orders").select(F.col("o_orderpriority").alias("intent"), F.col("o_orderkey").cast("string").alias("id")), ("1-URGENT", "2-HIGH"), "12"), "SELECT o_orderpriority AS intent, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR CAST(o_orderkey AS VARCHAR) LIKE '12%'"),
    "qa4_numbers": (numbers, ANSWERS_SQL + ", a AS (SELECT qid, id, 'graph' AS channel FROM g UNION ALL SELECT qid, id, 'bm25' FROM v) SELECT qid, channel, CASE WHEN qid % 2 = 0 OR channel = 'bm25' THEN count(DISTINCT id) END AS number FROM a WHERE qid IN (SELECT c_custkey FROM customer) GROUP BY qid, channel"),
    "qa5_template_answer": (composed, """WITH s AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS a, list(n_name ORDER BY n_name) FILTER (n_nationkey > 20) AS b FROM nation GROUP BY 1)
SELECT r_regionkey, r_name || '：原因：' || array_to_string(a[1:3], '、') || CASE WHEN b IS NOT NULL THEN '；对策：' || array_to_string(b[1:2], '、') ELSE '' END || '。' AS answer FROM s JOIN region ON n_regionkey = r_regionkey"""),
    "qa7_evidence": (shown_evidence, ANSWERS_SQL + """, q AS (SELECT DISTINCT qid FROM v) SELECT q.qid, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FROM v WHERE v.qid = q.qid AND pos <= 3), '') AS chunks,
coalesce((SELECT string_agg('t' || id, ',' ORDER BY pos) FROM g WHERE g.qid = q.qid AND pos <= 30), '') AS triples, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FROM g WHERE g.qid = q.qid AND pos <= 10), '') AS names FROM q"""),
    "qg1_questions": (questions, QUESTIONS_SQL),
    "qg1_noise": (noisy, f"""WITH q AS (SELECT CAST(c_custkey AS VARCHAR) AS qid, c_custkey % 2 = 0 AS named FROM customer)
SELECT noise, count(*) AS n FROM (SELECT CASE WHEN named AND {MD5_SQL.format(k="'a|' || qid")} / 1000.0 < 0.3 THEN 'alias' WHEN {MD5_SQL.format(k="'t|' || qid")} / 1000.0 < 0.08 THEN 'typo' ELSE 'none' END AS noise FROM q) GROUP BY noise"""),
    "str1_log_tail": (lambda sp, d: L.log_after(_runs(sp, d), 100, 200, "click").select("id", "node_id", "level"), "SELECT event_id AS id, event_type AS node_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM events WHERE event_id > 100 AND event_type = 'click' ORDER BY event_id LIMIT 200"),
    "str2_state_changes": (lambda sp, d: L.changes(_runs(sp, d), "user_id", ["id"], "level").select("id", "user_id", "level"), "SELECT id, user_id, level FROM (SELECT event_id AS id, user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level, lag(CASE WHEN value > 50 THEN 'high' ELSE 'low' END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> level"),
    "str3_resume": (resumed, "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R')"),
    "str4_read_through": (cached, "WITH k AS (SELECT DISTINCT o_custkey % 700 AS cache_key FROM orders), c AS (SELECT c_custkey % 500 AS cache_key, arg_max(c_name, c_custkey) AS response FROM customer GROUP BY 1) SELECT cache_key, coalesce(response, 'new ' || cache_key) AS response FROM k LEFT JOIN c USING (cache_key)"),
    "str5_ledger": (run_ledger, "SELECT event_type AS node_id, CASE WHEN event_id % 5 <> 0 THEN 'running' WHEN value > 50 THEN 'failed' ELSE 'done' END AS status, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS finished FROM events WHERE event_id % 4 <> 3 GROUP BY 1, 2"),
    "prj7_optional_filters": (lambda sp, d: L.matching(table(sp, d, "events"), ["event_id"], 50, event_type="click", user_id=None).select("event_id", "value"), "SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50"),
    "jn13_trace_join": (lambda sp, d: E.with_answers(table(sp, d, "conversations").where("role = 'user'").select("conv_id", "turn"), table(sp, d, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("int").alias("turn"), F.length("text").cast("long").alias("n")), ["conv_id", "turn"]), "SELECT u.conv_id, u.turn, length(a.text) AS n FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"),
    "agg9_trace_stats": (lambda sp, d: E.trace_stats(table(sp, d, "events"), F.col("value") > 50, {"n_click": F.col("event_type") == "click"}), "SELECT count(*) AS n, count(*) FILTER (value > 50) AS linked, count(*) FILTER (event_type = 'click') AS n_click FROM events"),
    "gen1_scenarios": (scenarios, "SELECT r_regionkey, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY md5(r_regionkey || '|' || p_partkey)) AS r FROM region JOIN part ON p_partkey % 5 <> r_regionkey) WHERE r <= 10"),
    "gen2_memo": (lambda sp, d: G.first_rank(table(sp, d, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", F.col("p_partkey").alias("first_part")), "SELECT p_brand, p_type, min(p_partkey) AS first_part FROM part GROUP BY 1, 2"),
    "gen3_first_match": (first_match, "SELECT p_size, arg_min(p_partkey, o) AS p_partkey, arg_min(p_name, o) AS p_name FROM (SELECT *, CASE WHEN contains(p_name, 'ring') THEN 0 ELSE 1000000000 END + p_partkey AS o FROM part) GROUP BY p_size"),
    "gen6_draws": (drawn, DRAWN_SQL),
    "gen5_batches": (batches, "SELECT p_brand, b AS batch, count(*) AS n FROM (SELECT p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 36 AS BIGINT) AS b FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) GROUP BY 1, 2"),
}


def _pairs(sp, d):
    from tessera.operators.extract import pair_by_place

    a = table(sp, d, "part").select((F.col("p_partkey") % 25).alias("k"), "p_partkey")
    b = table(sp, d, "supplier").select((F.col("s_suppkey") % 25).alias("k"), "s_suppkey", (-F.col("s_suppkey")).alias("o"))
    return pair_by_place(a, b, ["k"], ["p_partkey"], ["o"]).select("k", "p_partkey", "s_suppkey")
