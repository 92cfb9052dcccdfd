"""Mentions, rules and alignment on hand-written documents."""

from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.operators import extract as X
from tessera.operators import relations as R


def gaz(spark, rows):
    return spark.createDataFrame([(s, s, lab, i) for i, (s, lab) in enumerate(rows)], "surface string, id string, label string, ord int")


def test_longest_match(spark):
    g = gaz(spark, [("连锡", "Defect"), ("QFN连锡", "Defect"), ("回流焊温度偏高", "Cause"), ("aa", "Process")])
    docs = spark.createDataFrame([("d1", "QFN连锡与连锡，回流焊温渡偏高"), ("d2", "aaa aa"), ("d3", None), ("d4", "")], "doc_id string, text string")
    got = {(r.doc_id, r.surface, r.start, r.end) for r in X.mentions(docs, g).collect()}
    assert got == {("d1", "QFN连锡", 0, 5), ("d1", "连锡", 6, 8), ("d1", "回流焊温渡偏高", 9, 16), ("d2", "aa", 0, 2), ("d2", "aa", 4, 6)}


def brute(text, surfaces):
    taken, out = [False] * len(text), []
    for s in sorted(surfaces, key=lambda x: -len(x)):
        at = text.find(s)
        while at >= 0:
            if not any(taken[at : at + len(s)]):
                out.append((s, at))
                taken[at : at + len(s)] = [True] * len(s)
            at = text.find(s, at + 1)
    return set(out)


def test_longest_match_equals_a_scan(spark):
    import random

    rng = random.Random(8)
    surfaces = sorted({" ".join(rng.choice(["ab", "ba", "aab"]) for _ in range(rng.randint(1, 4))) for _ in range(12)}, key=lambda s: (-len(s), s))
    texts = [" ".join(rng.choice(["ab", "ba", "aab", "b"]) for _ in range(25)) for _ in range(15)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {}
    for r in X.mentions(docs, gaz(spark, [(s, "Defect") for s in surfaces])).collect():
        got.setdefault(int(r.doc_id), set()).add((r.surface, r.start))
    assert all(got.get(i, set()) == brute(t, surfaces) for i, t in enumerate(texts))


def test_gazetteer_owners(spark):
    e = spark.createDataFrame([("1", "Defect", "n", ["a", "b"], 1), ("2", "Defect", "n", ["a"], 2), ("3", "Defect", "a", [], 3)], "id string, label string, name string, aliases array<string>, ord int")
    got = {r.surface: r.id for r in X.gazetteer(e, {"Defect": 1.0}).collect()}
    assert got == {"n": "2", "a": "3", "b": "1"}


def test_exception_rules(spark):
    g = gaz(spark, [("印刷", "Process"), ("焊接", "Process"), ("印刷机1", "Device"), ("少锡", "Defect"), ("网板堵塞", "Cause"), ("刮刀磨损", "Cause"), ("锡膏A", "Material"), ("清洗网板", "Countermeasure"), ("切换备用设备", "Countermeasure")])
    text = "异常单\n1. 责任工序：印刷（设备：印刷机1）\n不良现象：少锡\n根因分析如下\n（1）网板堵塞\n关联物料：锡膏A\n（2）刮刀磨损\n临时遏制措施：\n（1）清洗网板（作用工序：焊接）\n（2）切换备用设备\n二、结论"
    docs = spark.createDataFrame([("EX-1", text)], "doc_id string, text string")
    got = {(r.head, r.rel, r.tail) for r in R.exception_relations(docs, X.mentions(docs, g)).collect()}
    assert got == {
        ("印刷机1", "USED_IN", "印刷"), ("少锡", "OCCURS_AT", "印刷"), ("少锡", "CAUSED_BY", "网板堵塞"), ("少锡", "CAUSED_BY", "刮刀磨损"), ("少锡", "INDUCED_BY_MATERIAL", "锡膏A"), ("网板堵塞", "ADDRESSED_BY", "清洗网板"),
        ("刮刀磨损", "ADDRESSED_BY", "切换备用设备"), ("清洗网板", "TARGETS", "焊接"), ("切换备用设备", "TARGETS", "印刷"), ("切换备用设备", "TARGETS", "印刷机1"),
    }


def test_notice_rules(spark):
    g = gaz(spark, [("网板堵塞", "Cause"), ("更换网板", "Countermeasure"), ("纳入点检", "Countermeasure"), ("印刷", "Process"), ("印刷机1", "Device"), ("锡膏A", "Material")])
    text = "通知\n1. 适用产品 P1\n针对网板堵塞：\n对策：更换网板。\n标准化：纳入点检（责任工序：印刷）\n作用对象：设备 印刷机1，即日\n作用对象：物料 锡膏A，即日\n尾"
    docs = spark.createDataFrame([("NTC-1", text)], "doc_id string, text string")
    got = {(r.head, r.rel, r.tail) for r in R.notice_relations(docs, X.mentions(docs, g)).collect()}
    assert got == {("网板堵塞", "ADDRESSED_BY", "更换网板"), ("网板堵塞", "ADDRESSED_BY", "纳入点检"), ("纳入点检", "TARGETS", "印刷"), ("更换网板", "TARGETS", "印刷机1"), ("更换网板", "TARGETS", "锡膏A")}


def test_procedure_rules(spark):
    g = gaz(spark, [("印刷", "Process"), ("贴片", "Process"), ("印刷机1", "Device"), ("锡膏A", "Material"), ("少锡", "Defect"), ("空洞", "Defect"), ("BGA空洞", "Defect")])
    text = "规定产品在印刷工序的标准作业\n本工序使用印刷机1（型号 X）\n三、耗用物料\n锡膏A\n四、要点\n重点拦截的不良现象：少锡、空洞。\n其中BGA空洞属于空洞的细分。\n工序流转：印刷完工后进入贴片。"
    docs = spark.createDataFrame([("SOP-1", text)], "doc_id string, text string")
    got = {(r.head, r.rel, r.tail) for r in R.procedure_relations(docs, X.mentions(docs, g)).collect()}
    assert got == {("印刷机1", "USED_IN", "印刷"), ("印刷", "USES_MATERIAL", "锡膏A"), ("少锡", "OCCURS_AT", "印刷"), ("空洞", "OCCURS_AT", "印刷"), ("BGA空洞", "SUBCLASS_OF", "空洞"), ("印刷", "PRECEDES", "贴片")}


def test_cascade_order(spark):
    names = spark.createDataFrame([("回流焊温度过高异常", "Cause", 1), ("产品甲回流焊温度过低", "Cause", 2), ("少锡", "Cause", 3)], "name string, label string, entity_id int").withColumn("surface", F.col("name")).withColumn("ord", F.col("entity_id"))
    s = spark.createDataFrame([("少锡", "Cause"), ("甲回流焊温度过低", "Cause"), ("流焊温度过低", "Cause"), ("少锡渣", "Cause"), ("全新", "Cause"), ("少旱", "Cause")], "surface string, label string")
    out = A.cascade(s, [("alias", A.by_alias(s, names)), ("suffix", A.by_suffix(s, names)), ("confusion", A.by_confusion(s, names)), ("edit", A.by_one_edit(s, names))])
    got = {r.surface: (r.method, r.entity_id) for r in out.collect()}
    assert got["少锡"] == ("alias", "3") and got["甲回流焊温度过低"] == ("suffix", "2") and got["少锡渣"] == ("edit", "3")
    assert got["流焊温度过低"][0] == "new" and got["全新"][1].startswith("EX_Cause_") and got["少旱"] == ("edit", "3")


def test_margin_rule(spark):
    rows = [("a", "Cause", "p", 1, 0.68), ("a", "Cause", "p", 2, 0.65), ("b", "Cause", "p", 1, 0.70), ("b", "Cause", "p", 2, 0.68), ("c", "Countermeasure", "p", 1, 0.6), ("c", "Countermeasure", "p", 2, 0.6)]
    scores = spark.createDataFrame(rows, "surface string, label string, scope string, entity_id int, sim double")
    got = {r.surface: r.entity_id for r in A.by_similarity(scores, {"Cause": (0.68, 0.0299), "Countermeasure": (0.6, 0.0)}).collect()}
    assert got == {"a": 1, "c": 1}


def test_edge_resolution(spark):
    t = spark.createDataFrame([("d1", "h", "R", "t", 1), ("d2", "h", "R", "t", 1), ("d3", "h", "R", "none", 1)], "doc_id string, head string, rel string, tail string, ord int")
    m = spark.createDataFrame([("h", "A", "hA"), ("h", "B", "hB"), ("h", None, "h0"), ("t", None, "t0")], "surface string, product string, entity_id string")
    edges, dropped = A.resolve_edges(t, m, spark.createDataFrame([("d1", "A")], "doc_id string, product string"))
    assert {(r.doc_id, r.head_id) for r in edges.collect()} == {("d1", "hA"), ("d2", "hA"), ("d2", "hB"), ("d2", "h0")}
    assert [r.doc_id for r in dropped.collect()] == ["d3"]
