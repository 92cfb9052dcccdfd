"""Queries of text functions, segmentation and extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import chunk as C
from tessera.operators import extract as X
from tessera.operators import relations as R
from tessera.sources.tables import table

WIDE = "".join(chr(c) for c in [0x3000, *range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B)])
NARROW = " 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: md5 of k as a number, modulo 1000.
MD5_SQL = "(((((((CAST('0x' || substring(md5({k}), 1, 8) AS BIGINT) % 1000) * 4294967296 + CAST('0x' || substring(md5({k}), 9, 8) AS BIGINT)) % 1000) * 4294967296 + CAST('0x' || substring(md5({k}), 17, 8) AS BIGINT)) % 1000) * 4294967296 + CAST('0x' || substring(md5({k}), 25, 8) AS BIGINT)) % 1000)"


def _docs(sp, d):
    return table(sp, d, "documents")


def wide_names(sp, d):
    return table(sp, d, "part").select("p_partkey", TX.clean_surface(F.translate(F.concat(F.upper("p_name"), F.lit(" \t"), F.col("p_size").cast("string")), NARROW, WIDE)).alias("clean"))


def confusions(sp, d):
    c = F.concat(F.col("n_name"), F.lit("渡湿度温检捡"))
    return table(sp, d, "nation").select("n_nationkey", F.array_join(TX.typo_variants(c), ",").alias("variants"), F.array_join(TX.typo_repairs(c), ",").alias("repairs"))


def occurrences(sp, d):
    """Places of a short word in every document, each search going on after the match before."""
    places = TX.positions(F.col("text"), F.lit("enen"), overlapping=False)
    return _docs(sp, d).select("doc_id", F.size(places).cast("long").alias("n"), F.coalesce(F.get(places, F.lit(0)), F.lit(-1)).cast("long").alias("first"))


def segments(sp, d):
    """Lines of each document packed into segments of 600 characters."""
    lens = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("long"))
    packed = _docs(sp, d).select("doc_id", C.pack_items(lens, 600).alias("seg"), lens.alias("n"))
    rows = packed.select("doc_id", F.explode(F.arrays_zip("seg", "n")).alias("x")).select("doc_id", "x.seg", "x.n")
    return rows.groupBy("doc_id", "seg").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("size"))


def line_chunks(sp, d):
    """Lines of each document, with running ids over all."""
    chunks = C.chunk_items(_docs(sp, d).select("doc_id", "text"), r"\n").where("text <> ''")
    return C.with_chunk_ids(chunks, ["doc_id", "pos"]).select("chunk_id", "doc_id", F.length("text").cast("long").alias("n"))


def captured_rows(sp, d):
    """The title of each page and where it stands."""
    c = C.captured(F.col("html"), "<title>([^<]*)</title>")
    return table(sp, d, "pages").select("page_id", c.alias("c")).select("page_id", F.col("c.text").alias("title"), F.col("c.start").cast("long").alias("lo"), F.col("c.end").cast("long").alias("hi"))


def _gaz_entities(sp, d):
    """Benchmark passages as entities: the first sentence is the name, the others are aliases."""
    cut = F.filter(F.split("text", r"(?<=[.])\s+"), lambda s: F.length(s) >= 12)
    return table(sp, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 2 == 0, "Defect").otherwise("Material").alias("label"), cut.alias("s"), F.col("item_id").alias("ord")).where("size(s) > 0").select("id", "label", F.col("s")[0].alias("name"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))).alias("aliases"), "ord")


def dictionary(sp, d):
    return X.gazetteer(_gaz_entities(sp, d))


#: The dictionary of the passages as z.
GAZETTEER_SQL = r"""g AS (SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'Defect' ELSE 'Material' END AS label, list_filter(string_split(regexp_replace(text, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 12) AS s, item_id AS ord FROM benchmark),
a AS (SELECT s[1] AS surface, id, label, ord, 0 AS kind, -ord AS o FROM g WHERE len(s) > 0
  UNION ALL SELECT surface, id, label, ord, 1, ord FROM (SELECT id, label, ord, unnest(s[2:]) AS surface FROM g WHERE len(s) > 0) WHERE """ + MD5_SQL.format(k="id || '|' || surface") + """ / 1000.0 < CASE label WHEN 'Defect' THEN 0.98 ELSE 0.85 END),
z AS (SELECT surface, id, label, ord FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY kind, o, id) AS r FROM a) WHERE r = 1)"""


#: The greedy choice, one candidate of each document at a time; no surface here has a character that is wrongly written.
MENTIONS_SQL = "WITH RECURSIVE " + GAZETTEER_SQL + """,
c AS (SELECT doc_id, surface, id, label, ord, i - 1 AS s, i - 1 + length(surface) AS e FROM (SELECT d.doc_id, z.*, unnest(list_filter(range(1, length(d.text) - length(z.surface) + 2), lambda i: substring(d.text, i, length(z.surface)) = z.surface)) AS i FROM documents d JOIN z ON contains(d.text, z.surface))),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -length(surface), ord, surface, s) AS k FROM c),
w AS (SELECT doc_id, k, [{'s': s, 'e': e}] AS acc, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN free THEN list_append(acc, {'s': s, 'e': e}) ELSE acc END, free FROM (SELECT o.doc_id, o.k, o.s, o.e, w.acc, len(list_filter(w.acc, lambda x: x.s < o.e AND o.s < x.e)) = 0 AS free FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)),
m AS (SELECT o.* FROM o JOIN w ON w.doc_id = o.doc_id AND w.k = o.k WHERE ok)"""
PARAPHRASES_SQL = MENTIONS_SQL + """,
f AS (SELECT DISTINCT string_split(surface, ' ')[1] AS prefix FROM m WHERE length(string_split(surface, ' ')[1]) > 2)
SELECT doc_id, substring(surface, max(length(prefix)) + 1) AS surface, id FROM m JOIN f ON starts_with(surface, prefix) AND length(surface) > length(prefix)
WHERE """ + MD5_SQL.format(k="doc_id || '|' || s || '|' || surface") + """ / 1000.0 < 0.5 GROUP BY doc_id, s, surface, id"""
INSIDE_SQL = MENTIONS_SQL + """
SELECT doc_id, CAST(region AS INTEGER) AS region, id, CAST(s AS BIGINT) AS start FROM (SELECT *, s // 1000 AS region, row_number() OVER (PARTITION BY doc_id, s // 1000 ORDER BY s, e, surface) AS r FROM m WHERE e <= (s // 1000) * 1000 + 999) WHERE r = 1"""


def found_mentions(sp, d):
    return X.mentions(_docs(sp, d).select("doc_id", "text"), dictionary(sp, d)).select("doc_id", "surface", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "id", "label")


def paraphrased(sp, d):
    found = X.mentions(_docs(sp, d).select("doc_id", "text"), dictionary(sp, d))
    prefixes = found.select(F.substring_index("canonical", " ", 1).alias("prefix")).where(F.length("prefix") > 2).distinct()
    return X.paraphrases(found, prefixes, ("Defect", "Material"), 0.5).select("doc_id", "surface", "id")


def contained(sp, d):
    """For each document the first dictionary mention in each thousand characters."""
    found = X.mentions(_docs(sp, d).select("doc_id", "text"), dictionary(sp, d))
    regions = _docs(sp, d).select("doc_id", F.explode(F.sequence(F.lit(0), (F.length("text") / 1000).cast("int"))).alias("region")).select("doc_id", "region", (F.col("region") * 1000).alias("lo"), (F.col("region") * 1000 + 999).alias("hi"))
    return X.inside(found, regions).select("doc_id", "region", "id", F.col("start").cast("long").alias("start"))


# The wording of the sample reports is fixed: the patterns of ``relations`` read it.
def _reports(sp, d):
    """Exception reports about suppliers: one block each, with two causes and two measures, and the dictionary for them."""
    s = table(sp, d, "supplier").join(table(sp, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    part = F.concat(F.lit("不良"), (k % 64).cast("string"), F.lit("号"))
    c1, c2 = F.concat(F.lit("原因"), (k % 7).cast("string"), F.lit("甲")), F.concat(F.lit("原因"), (k % 5).cast("string"), F.lit("乙"))
    m1, m2 = F.concat(F.lit("对策"), (k % 3).cast("string"), F.lit("丙")), F.concat(F.lit("切换备用设备"), (k % 4).cast("string"), F.lit("丁"))
    text = F.concat(F.lit("异常报告\n1. 责任工序："), F.col("n_name"), F.lit("，设备 "), F.col("s_name"), F.lit("\n不良现象："), part, F.lit("偏高\n根因分析：\n（1）"), c1, F.lit("\n（2）"), c2, F.lit("\n临时遏制措施：\n（1）"), m1, F.lit("\n（2）"), m2, F.lit("\n二、其他"))
    docs = s.select(F.concat(F.lit("EX-"), k.cast("string")).alias("doc_id"), text.alias("text"), F.col("n_name"), F.col("s_name"), part.alias("part"), c1.alias("c1"), c2.alias("c2"), m1.alias("m1"), m2.alias("m2"))
    kinds = (("n_name", "Process"), ("s_name", "Device"), ("part", "Defect"), ("c1", "Cause"), ("c2", "Cause"), ("m1", "Countermeasure"), ("m2", "Countermeasure"))
    gaz = docs.select(F.explode(F.array(*(F.struct(F.col(c).alias("surface"), F.lit(x).alias("label")) for c, x in kinds))).alias("g")).select("g.*").distinct()
    return docs.select("doc_id", "text"), gaz.select("surface", F.col("surface").alias("id"), "label", F.lit(0).alias("ord"))


def report_relations(sp, d):
    docs, gaz = _reports(sp, d)
    return R.exception_relations(docs, X.mentions(docs, gaz))


REPORTS_SQL = """WITH s AS (SELECT 'EX-' || s_suppkey AS doc_id, n_name, s_name, '不良' || (s_suppkey % 64) || '号' AS part, '原因' || (s_suppkey % 7) || '甲' AS c1, '原因' || (s_suppkey % 5) || '乙' AS c2,
  '对策' || (s_suppkey % 3) || '丙' AS m1, '切换备用设备' || (s_suppkey % 4) || '丁' AS m2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT doc_id, s_name AS head, 'USED_IN' AS rel, n_name AS tail FROM s UNION ALL SELECT doc_id, part, 'OCCURS_AT', n_name FROM s UNION ALL SELECT doc_id, part, 'CAUSED_BY', c1 FROM s UNION ALL SELECT doc_id, part, 'CAUSED_BY', c2 FROM s
UNION ALL SELECT doc_id, c1, 'ADDRESSED_BY', m1 FROM s UNION ALL SELECT doc_id, c2, 'ADDRESSED_BY', m2 FROM s UNION ALL SELECT doc_id, m1, 'TARGETS', n_name FROM s UNION ALL SELECT doc_id, m2, 'TARGETS', n_name FROM s UNION ALL SELECT doc_id, m2, 'TARGETS', s_name FROM s"""


def _triples(sp, d):
    o = table(sp, d, "lineitem")
    return o.select(F.concat(F.lit("D"), (F.col("l_orderkey") % 500).cast("string")).alias("doc_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("head"), F.when(F.col("l_linenumber") % 2 == 0, "USES_MATERIAL").otherwise("SUBCLASS_OF").alias("rel"), F.concat(F.lit("P"), (F.col("l_suppkey") % 40).cast("string")).alias("tail"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))


TRIPLES_SQL = "t AS (SELECT 'D' || (l_orderkey % 500) AS doc_id, 'P' || (l_partkey % 40) AS head, CASE WHEN l_linenumber % 2 = 0 THEN 'USES_MATERIAL' ELSE 'SUBCLASS_OF' END AS rel, 'P' || (l_suppkey % 40) AS tail, l_orderkey * 100 + l_linenumber AS ord FROM lineitem)"


def kept(sp, d):
    return X.keep_triples(_triples(sp, d)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def extracted(sp, d):
    """Rows of a stub provider, checked against the segments that they came from."""
    segs = table(sp, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("seg_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = X.extract_with(segs, _longest_word)
    return X.valid_rows(rows, segs, ["Defect"]).groupBy("label").agg(F.count_distinct("surface").alias("n"))


def _longest_word(texts):
    """A deterministic stand-in for a model: the longest word of each text."""
    return [[(max(t.split(), key=lambda w: (len(w), w)), "Defect"), ("not there ever", "Defect")] if t.split() else [] for t in texts]


def salvaged(sp, d):
    """Event properties, fenced and cut off, read back as objects."""
    raw = F.concat(F.lit("```json\n[{\"surface\":\"s\",\"k\":1}, "), F.col("props"), F.lit(", {\"surface\":\"t"))
    e = table(sp, d, "events").select("event_id", TX.strip_code_fence(raw).alias("body"))
    return e.select("event_id", F.size(TX.salvage_objects(F.col("body"), "k")).cast("long").alias("n"), F.get(TX.salvage_objects(F.col("body"), "surface"), F.lit(0)).alias("first"))


QUERIES = {
    "txt1_clean_surface": (wide_names, "SELECT p_partkey, replace(upper(p_name), ' ', '') || p_size AS clean FROM part"),
    "txt2_units": (lambda sp, d: table(sp, d, "part").select("p_partkey", TX.normalize_units(F.concat(F.col("p_size").cast("string"), F.lit("摄氏度 5度 3毫米 兆帕"))).alias("t")), "SELECT p_partkey, p_size || '℃ 5℃ 3mm MPa' AS t FROM part"),
    "txt3_confusions": (confusions, "SELECT n_nationkey, concat_ws(',', n_name || '渡湿渡温检捡', n_name || '渡湿度湿检捡', n_name || '渡湿度温捡捡') AS variants, concat_ws(',', n_name || '度湿度温检捡', n_name || '渡温度温检捡', n_name || '渡湿度温检检') AS repairs FROM nation"),
    "txt4_one_edit": (lambda sp, d: table(sp, d, "part").select("p_name").distinct().select("p_name", TX.one_edit(F.col("p_name"), F.concat(F.col("p_name"), F.lit("x"))).alias("longer"), TX.one_edit(F.col("p_name"), F.col("p_name")).alias("same"), TX.one_edit(F.col("p_name"), F.concat(F.lit("zz"), F.expr("substring(p_name, 3)"))).alias("two")),
        "SELECT DISTINCT p_name, length(p_name) <= 12 AS longer, false AS same, length(p_name) <= 12 AND levenshtein(p_name, 'zz' || substring(p_name, 3)) = 1 AS two FROM part"),
    "txt6_positions": (occurrences, "SELECT doc_id, CAST((length(text) - length(replace(text, 'enen', ''))) // 4 AS BIGINT) AS n, CAST(instr(text, 'enen') - 1 AS BIGINT) AS first FROM documents"),
    "txt7_stable_hash": (lambda sp, d: table(sp, d, "customer").select("c_custkey", TX.md5_mod(F.concat(F.lit("k|"), "c_name"), 1000).alias("h")), f"SELECT c_custkey, {MD5_SQL.format(k="'k|' || c_name")} AS h FROM customer"),
    "txt8_new_ids": (lambda sp, d: table(sp, d, "part").select("p_partkey", TX.new_entity_id(F.lit("Material"), F.col("p_name")).alias("id")), "SELECT p_partkey, 'EX_Material_' || upper(substring(md5(p_name), 1, 10)) AS id FROM part"),
    "txt9_tokens": (lambda sp, d: _docs(sp, d).select("doc_id", F.size(TX.tokens(F.col("text"))).cast("long").alias("n"), F.get(TX.tokens(F.col("text")), F.lit(0)).alias("first")), r"SELECT doc_id, len(t) AS n, t[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"),
    "txt10_genre": (lambda sp, d: table(sp, d, "orders").select("o_orderkey", TX.genre(F.col("o_orderpriority")).alias("g")), "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS g FROM orders"),
    "txt11_json_salvage": (salvaged, """SELECT event_id, CAST(2 AS BIGINT) AS n, '{"surface":"s","k":1}' AS first FROM events"""),
    "txt12_list_union": (lambda sp, d: table(sp, d, "lineitem").groupBy("l_orderkey").agg(TX.union_in_order(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), F.array(F.lit("A"), F.lit("Z"))).alias("u")).select("l_orderkey", F.array_join("u", ",").alias("u")),
        """WITH f AS (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2), l AS (SELECT l_orderkey, list(f ORDER BY o, f) AS l FROM f GROUP BY 1)
SELECT l_orderkey, array_to_string(l || CASE WHEN list_contains(l, 'A') THEN ['Z'] ELSE ['A', 'Z'] END, ',') AS u FROM l"""),
    "txt13_formats": (lambda sp, d: table(sp, d, "orders").select("o_orderkey", TX.spelled_date(F.col("o_orderdate")).alias("day"), TX.code_of_width(F.col("o_orderkey")).alias("code")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') || '号' AS code FROM orders"),
    "txt14_window_arithmetic": (lambda sp, d: table(sp, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", TX.into_window(F.col("l_quantity"), F.lit(30.0), 0.25).alias("corrected"), TX.beyond_window(F.col("l_quantity"), F.lit(30.0)).alias("delta")),
        "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity > 30 THEN l_quantity * 0.25 + 7.5 ELSE l_quantity END, 2) AS corrected, round(l_quantity - 30, 2) AS delta FROM lineitem"),
    "txt15_templates": (lambda sp, d: table(sp, d, "part").select("p_partkey", TX.parameter_text("参数超出窗口", F.col("p_name"), F.col("p_size"), "mm", F.col("p_size") > 25).alias("t")), "SELECT p_partkey, '参数超出窗口：' || p_name || CASE WHEN p_size > 25 THEN '（' || p_size || 'mm）' ELSE '' END AS t FROM part"),
    "txt16_cache_keys": (lambda sp, d: table(sp, d, "benchmark").select("item_id", TX.embed_cache_key(F.lit("m"), F.col("text")).alias("k"), F.sha2(F.col("text"), 256).alias("p")), "SELECT item_id, sha1('m:' || text) AS k, sha256(text) AS p FROM benchmark"),
    "chk2_item_chunks": (lambda sp, d: C.chunk_items(_docs(sp, d).select("doc_id", "text"), r"\n").where("text <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("long").alias("longest")),
        r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), c AS (SELECT doc_id, unnest(CASE WHEN len(p) = 1 THEN [trim(p[1])] ELSE list_concat([trim(trim(p[1]) || chr(10) || trim(p[2]), ' ' || chr(10))], list_transform(p[3:], lambda x: trim(x))) END) AS t FROM p)
SELECT doc_id, count(*) AS n, max(length(t)) AS longest FROM c WHERE t <> '' GROUP BY doc_id"""),
    "chk1_section_chunks": (lambda sp, d: C.chunk_sections(table(sp, d, "nation").select(F.col("n_name").alias("doc_id"), F.concat(F.lit("标准\n一、目的\n"), F.repeat("n_name", 5), F.lit("\n二、范围\n短\n三、步骤\n"), F.repeat("n_name", 6)).alias("text")), longer_than=20).select("doc_id", "pos", F.length("text").cast("long").alias("n")),
        "SELECT n_name AS doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS BIGINT) AS n FROM (SELECT n_name, 0 AS pos, length('标准' || chr(10) || chr(10) || '一、目的' || chr(10) || repeat(n_name, 5)) AS n FROM nation UNION ALL SELECT n_name, 2, length('三、步骤' || chr(10) || repeat(n_name, 6)) FROM nation) WHERE n > 20"),
    "chk3_chunk_ids": (line_chunks, r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, CASE WHEN len(p) = 1 THEN [trim(p[1])] ELSE list_concat([trim(trim(p[1]) || chr(10) || trim(p[2]), ' ' || chr(10))], list_transform(p[3:], lambda x: trim(x))) END AS l FROM p),
c AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM l)
SELECT 'C' || CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS chunk_id, doc_id, n FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS VARCHAR) AS k, doc_id, length(t) AS n FROM c WHERE t <> '')"""),
    "chk4_packing": (segments, """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, l, 1 AS i, 0 AS seg, l[1] AS size FROM l UNION ALL SELECT doc_id, l, i + 1, CASE WHEN size + l[i + 1] <= 600 THEN seg ELSE seg + 1 END, CASE WHEN size + l[i + 1] <= 600 THEN size + l[i + 1] ELSE l[i + 1] END FROM p WHERE i < len(l))
SELECT doc_id, CAST(seg AS INTEGER) AS seg, count(*) AS items, CAST(sum(l[i]) AS BIGINT) AS size FROM p GROUP BY doc_id, seg"""),
    "chk5_capture": (captured_rows, r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(instr(html, '<title>') + 6 AS BIGINT) AS lo, CAST(instr(html, '<title>') + 6 + length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS BIGINT) AS hi FROM pages"),
    "ext1_gazetteer": (dictionary, "WITH " + GAZETTEER_SQL + " SELECT * FROM z"),
    "ext2_longest_match": (found_mentions, MENTIONS_SQL + ' SELECT doc_id, surface, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", id, label FROM m'),
    "ext3_paraphrases": (paraphrased, PARAPHRASES_SQL),
    "ext4_containment": (contained, INSIDE_SQL),
    "ext5_exception_rules": (report_relations, REPORTS_SQL),
    "ext8_rule_coverage": (kept, f"WITH {TRIPLES_SQL} SELECT rel, count(*) AS n, min(doc_id) AS first_doc FROM t WHERE head <> tail AND {MD5_SQL.format(k="doc_id || '|' || head || '|' || rel || '|' || tail")} / 1000.0 < CASE rel WHEN 'USES_MATERIAL' THEN 0.92 ELSE 0.85 END GROUP BY rel"),
    "ext9_triple_dedup": (lambda sp, d: X.dedup_triples(_triples(sp, d).withColumn("ord", F.struct("ord", "head"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), f"WITH {TRIPLES_SQL} SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, head, rel, tail FROM t) GROUP BY doc_id"),
    "ext10_provider": (extracted, r"SELECT 'Defect' AS label, count(DISTINCT s) AS n FROM (SELECT list_max(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: {'n': length(w), 'w': w})).w AS s FROM conversations WHERE text IS NOT NULL) WHERE s IS NOT NULL"),
    "ext11_frozen_sample": (lambda sp, d: X.frozen_sample(table(sp, d, "customer").select("c_custkey", "c_name"), F.col("c_name"), 150, "7|"), "SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_name), c_name LIMIT 150"),
    "prj3_row_filter": (lambda sp, d: X.valid_rows(table(sp, d, "benchmark").select(F.col("item_id").alias("seg_id"), F.substring("text", 5, 12).alias("surface"), F.when(F.col("item_id") % 3 == 0, "Odd").otherwise("Defect").alias("label")), table(sp, d, "benchmark").select(F.col("item_id").alias("seg_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.lit("other")).alias("text")), ["Defect"]),
        "SELECT item_id AS seg_id, substring(text, 5, 12) AS surface, 'Defect' AS label FROM benchmark WHERE item_id % 2 = 0 AND item_id % 3 <> 0 AND trim(substring(text, 5, 12)) <> ''"),
    "prj9_truncation": (lambda sp, d: _docs(sp, d).select("doc_id", F.substring("text", 1, 400).alias("t400"), F.substring("text", 1, 120).alias("t120")), "SELECT doc_id, substring(text, 1, 400) AS t400, substring(text, 1, 120) AS t120 FROM documents"),
    "gen4_running_offsets": (lambda sp, d: table(sp, d, "conversations").select("conv_id", "turn", (F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - F.length(F.coalesce("text", F.lit("")))).alias("offset")),
        "SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) - length(coalesce(text, '')) AS BIGINT) AS offset FROM conversations"),
}
