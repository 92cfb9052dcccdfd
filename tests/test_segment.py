"""Word segmentation against all segmentations of short texts, and Chinese questions against their chunks."""

import random

from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators import segment as G

CHUNKS = [
    (1, "回流焊炉温过高，焊点发黑。立即检查回流焊温区设置"),
    (2, "锡膏印刷偏位，检查钢网与锡膏粘度"),
    (3, "波峰焊温度低导致虚焊，提高波峰焊预热温度"),
    (4, "钢网堵塞，清洁钢网。锡膏印刷不足"),
    (5, "PCB 板翘曲 uses SN100C"),
    (6, None),
]
NAMES = ["回流焊", "锡膏印刷", "波峰焊", "钢网", "虚焊", "锡膏"]


def all_paths(run, costs, unknown):
    """(cost, lengths negated, words) of every way to cut a run."""
    if not run:
        yield 0, (), []
    for size in range(1, len(run) + 1):
        cost = costs.get(run[:size], unknown if size == 1 else None)
        if cost is not None:
            for c, sizes, words in all_paths(run[size:], costs, unknown):
                yield cost + c, (-size, *sizes), [run[:size], *words]


def test_likeliest_path_is_the_least_of_all():
    rng = random.Random(8)
    for _ in range(200):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)}
        costs = {w: rng.randint(1, 6) * len(w) for w in words}
        run = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        prefixes = G.Prefixes(list(costs), list(costs.values()), 9)
        assert G.likeliest(run, prefixes.edges(run)) == min(all_paths(run, costs, 9))[2]


def corpus(spark):
    return spark.createDataFrame(CHUNKS, "doc_id long, text string")


def costs(spark):
    return G.word_costs(G.learn_words(corpus(spark), spark.createDataFrame([(n,) for n in NAMES], "name string"), least=2))


def test_both_ways_agree_and_cut_names_whole(spark):
    a = {r.id: r.toks for r in G.segment(corpus(spark), costs(spark)).collect()}
    b = {r.id: r.toks for r in G.segment(corpus(spark), costs(spark), broadcast_chars=0).collect()}
    assert a == b and a[6] == []
    assert a[1][:1] == ["回流焊"] and {"锡膏印刷", "钢网"} <= set(a[4])
    assert a[5][0] == "pcb" and a[5][-2:] == ["uses", "sn100c"]
    for k, text in CHUNKS[:4]:
        assert "".join(a[k]) == "".join(c for c in text if c.isalpha())


def test_a_chinese_question_finds_its_chunk(spark):
    known = costs(spark)
    cut = lambda df, id_col, text_col: G.segment(df, known, id_col, text_col)
    questions = spark.createDataFrame([(1, "为什么会虚焊"), (2, "钢网堵塞怎么办"), (3, "回流焊温区")], "qid long, query string")
    found = {r.qid: r.id for r in S.bm25(corpus(spark), questions, k=1, cut=cut).collect()}
    assert found == {1: 3, 2: 4, 3: 1}


def test_learned_words_hold_together(spark):
    texts = spark.createDataFrame([("甲乙" + c,) for c in "丙丁戊己庚辛"] * 5 + [("丙" + c,) for c in "甲乙丁戊"], "text string")
    none = spark.createDataFrame([], "name string")
    words = {r.word: r.n for r in G.learn_words(texts, none, least=5, cohesion=2.0).where(F.length("word") > 1).collect()}
    assert words["甲乙"] == 30 and "丙丁" not in words and "丙甲" not in words


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert G.segment(empty, costs(spark)).count() == 0
    bare = G.word_costs(G.learn_words(empty, spark.createDataFrame([], "name string")))
    assert [r.toks for r in G.segment(corpus(spark).where("doc_id = 2"), bare).collect()] == [list("锡膏印刷偏位检查钢网与锡膏粘度")]
