"""Metrics, search and fusion on small cases."""

from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import qa as Q
from tessera.operators import search as S


def test_prf_zero_guards(spark):
    gold = spark.createDataFrame([("a",), ("b",)], "k string")
    none = gold.limit(0)
    r = E.set_scores(none, gold, ["k"]).head()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 2, 0.0, 0.0, 0.0)
    r = E.set_scores(gold, gold.where("k = 'a'"), ["k"]).head()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 0, 0.6667)


def test_list_and_number_rules(spark):
    rows = [([], [1], False), ([1], [], False), (list(range(7)), list(range(10)), True), (list(range(6)), list(range(10)), False), ([1, 2, 9, 8], [1, 2], True), ([1, 2, 9, 8, 7], [1, 2], False)]
    df = spark.createDataFrame(rows, "a array<int>, g array<int>, want boolean")
    assert df.where(E.list_correct(F.col("a"), F.col("g")) != F.col("want")).count() == 0
    n = spark.createDataFrame([(1, 2, True), (1, 3, False), (None, 3, False)], "p int, g int, want boolean")
    assert n.where(E.number_correct(F.col("p"), F.col("g")) != F.col("want")).count() == 0


def test_retrieval_scores(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q2", "c", 4), ("q3", "z", 1)], "qid string, id string, pos int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "d"), ("q2", "c"), ("q4", "e")], "qid string, id string")
    r = E.retrieval_scores(ranked, gold).head()
    assert r.n == 3 and r.hit_at_3 == 0.3333 and r.mrr_at_3 == 0.1667 and r.coverage_at_3 == 0.1667 and r.coverage_all == 0.5


def test_coverage_grows_with_k(spark):
    ranked = spark.createDataFrame([("q", str(i), i + 1) for i in range(20)], "qid string, id string, pos int")
    gold = spark.createDataFrame([("q", str(i)) for i in (0, 5, 15)], "qid string, id string")
    r = E.retrieval_scores(ranked, gold).head()
    assert r.coverage_at_3 <= r.coverage_at_10 <= r.coverage_all == 1.0


def test_bm25_by_hand(spark):
    from math import log

    texts = {0: "red fox", 1: "red dog dog", 2: "blue cat", 3: "", 4: None}
    chunks = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {(r.qid, r.id): r.score for r in S.bm25(chunks, spark.createDataFrame([(7, "dog red"), (8, "none")], "qid int, query string"), k=5).collect()}
    n, avg, lens = 5, 7 / 5, {0: 2, 1: 3}
    idf = lambda df: log(n - df + 0.5) - log(df + 0.5)
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert set(got) == {(7, 0), (7, 1)}
    assert abs(got[7, 0] - part(2, 1, lens[0])) < 1e-5 and abs(got[7, 1] - (part(2, 1, 3) + part(1, 2, 3))) < 1e-5


def test_substring_join_equals_a_loop(spark):
    texts = ["the quick brown fox", "quick brown", "xquick brown fo", "", "brown"]
    surfaces = ["quick brown fox", "uick brown f", "brown", "o", "quick"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    s = spark.createDataFrame(list(enumerate(surfaces)), "sid int, surface string")
    got = {(r.id, r.sid) for r in S.substring_join(t, s).collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(surfaces) if y in x}


def test_fusion_keeps_graph_and_adds_three(spark):
    g = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, id string, pos int")
    v = spark.createDataFrame([("q", x, i) for i, x in enumerate("bcdef")] + [("p", "z", 1)], "qid string, id string, pos int")
    rows = Q.fuse(g, v).orderBy("qid", "pos").collect()
    assert [(r.qid, r.id) for r in rows] == [("p", "z"), ("q", "a"), ("q", "b"), ("q", "c"), ("q", "d"), ("q", "e")]


def test_answers_fall_back_to_the_template(spark):
    q = spark.createDataFrame([("x", "t1"), ("y", "t2")], "query string, answer string")
    got = {r.query: r.natural_answer for r in Q.answer_with(q, lambda texts: [None if t == "x" else "said" for t in texts]).collect()}
    assert got == {"x": "t1", "y": "said"}
