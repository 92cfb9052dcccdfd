"""Graph answers, candidates, names, provider vectors, tiles, saved indexes, numbering and spans, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk as C
from tessera.operators import extract as X
from tessera.operators import graph as G
from tessera.operators import qa as Q
from tessera.operators import search as S
from tessera.operators import tiled
from tessera.sources import tables as T


def small_graph(spark):
    edges = [("D1", "CAUSED_BY", "CA_PD1_1"), ("D1", "CAUSED_BY", "CA_PD2_1"), ("D2", "CAUSED_BY", "CA_PD2_1"), ("CA_PD1_1", "ADDRESSED_BY", "CM_PD1_1"), ("CA_PD2_1", "ADDRESSED_BY", "CM_PD2_1"), ("CA_PD2_1", "ADDRESSED_BY", "CMT_PD2_1")]
    edges += [("D1", "OCCURS_AT", "P1"), ("D2", "OCCURS_AT", "P1"), ("D1", "INDUCED_BY_MATERIAL", "MAT_a"), ("P1", "USES_MATERIAL", "MAT_b"), ("DEV", "USED_IN", "P1")]
    return spark.createDataFrame(edges, "source string, rel string, target string")


def links(spark, rows):
    return spark.createDataFrame(rows, "question int, id string, label string, pos int, surface string")


def test_branches_of_the_graph(spark):
    rows = [(1, "D1", "Defect", 0, "bent pin"), (2, "D1", "Defect", 0, "bent pin"), (2, "MAT_PD1", "Material", 1, "x"), (3, "P1", "Process", 0, "p"), (4, "MAT_a", "Material", 0, "m"), (5, "DEV", "Device", 0, "d"), (6, "P1", "Process", 0, "p"), (6, "D2", "Defect", 1, "worn"), (7, "MAT_PD1", "Material", 0, "x")]
    edges = small_graph(spark)
    got = {}
    for r in G.answer_graph(links(spark, rows), edges).collect():
        got.setdefault((r.question, r.branch), set()).add((r.part, r.id))
    one = {("cause", "CA_PD1_1"), ("cause", "CA_PD2_1"), ("countermeasure", "CM_PD1_1"), ("countermeasure", "CM_PD2_1"), ("countermeasure", "CMT_PD2_1"), ("process", "P1"), ("material", "MAT_a")}
    assert got[1, "defect"] == one
    assert got[2, "defect"] == {("cause", "CA_PD1_1"), ("countermeasure", "CM_PD1_1"), ("process", "P1"), ("material", "MAT_a")}
    cms = {("countermeasure", x) for x in ("CM_PD1_1", "CM_PD2_1", "CMT_PD2_1")}
    assert got[3, "process"] == {("defect", "D1"), ("defect", "D2"), ("material", "MAT_b")} | cms
    assert got[4, "material"] == {("defect", "D1"), ("process", "P1")} | cms
    assert got[5, "neighborhood"] == {("near", x) for x in ("DEV", "P1", "MAT_b")}
    assert got[6, "defect"] == {("cause", "CA_PD2_1"), ("countermeasure", "CM_PD2_1"), ("countermeasure", "CMT_PD2_1"), ("process", "P1")}
    assert got[7, "neighborhood"] == {("near", "MAT_PD1")} and len(got) == 7

    nodes = spark.createDataFrame([("D0", "Defect", "bent"), ("D1", "Defect", "bent pin"), ("D2", "Defect", "worn"), ("P1", "Process", "bent pin")], "id string, label string, name string")
    again = G.resolve_by_name(links(spark, rows).where("label = 'Defect'"), nodes)
    assert {(r.question, r.id) for r in again.collect()} == {(1, "D0"), (2, "D0"), (6, "D2")}
    anew = G.answer_graph(links(spark, rows), edges, nodes).where("question in (1, 2)").collect()
    assert {r.question for r in anew} == {2}  # D0 has no edges; a question with a product keeps its own link

    ask = spark.createDataFrame([(1, "defect_to_countermeasures"), (3, "process_to_materials"), (4, "material_to_defects"), (5, "device_to_process"), (6, "defect_to_process"), (7, "none")], "question int, intent string")
    answers = G.answer_graph(links(spark, rows), edges)
    found = {(r.question, r.id) for r in G.graph_candidates(answers, links(spark, rows), ask, edges).collect()}
    assert found == {(1, "CM_PD1_1"), (1, "CM_PD2_1"), (3, "MAT_b"), (4, "D1"), (5, "P1"), (6, "P1")}
    vector = spark.createDataFrame([(1, x, i) for i, x in enumerate(["P1", "x", "y", "z", "w"])], "question int, id string, pos int")
    shown = Q.online_answer(answers.where("question = 1"), vector, nodes).orderBy("pos").collect()
    assert [r.id for r in shown] == ["CA_PD1_1", "CA_PD2_1", "CM_PD1_1", "CM_PD2_1", "P1", "MAT_a", "x", "y", "z"] and shown[4].name == "bent pin"


def test_null_labels_are_not_the_total(spark):
    n = spark.createDataFrame([("a", None), ("b", "X")], "id string, label string")
    e = spark.createDataFrame([("a", "R", "b")], "source string, rel string, target string")
    assert sorted(((r.kind, r.name, r.n) for r in G.stats(n, e).collect()), key=str) == sorted([("node", None, 2), ("node", "", 1), ("node", "X", 1), ("edge", None, 1), ("edge", "R", 1)], key=str)


def test_tiles_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"n{i:03d}", f"g{i % 3}", [float(x) for x in rng.integers(-2, 3, 3 + i % 2)]) for i in range(120)] + [("n000", "g0", [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, g string, v array<double>").repartition(3)
    asked = df.where("id > 'n080'")
    pad = lambda v: np.array([*v, *[0.0] * (4 - len(v))])
    for many in (False, True):
        if many:
            monkeypatch.setattr(tiled, "TILE_ROWS", 7)
            monkeypatch.setattr(tiled, "CELL_PRODUCTS", 200)
            monkeypatch.setattr(tiled, "COLUMN_BYTES", 600)
            monkeypatch.setattr(tiled, "HELD_BLOCKS", 1)
        got = {}
        for r in tiled.top_k(df, asked, 4, lambda q, c: (q @ c.T).round(6)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for i, g, v in rows[81:120]:
            best = sorted((-float(pad(v) @ pad(w)), j) for j, h, w in rows if h == g and j != i)[:4]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_saved_index_and_rare_words(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    posts = {(r.tok, r.id): (r.tf, r.dl) for r in S.postings(docs, "doc_id", "text").collect()}
    want = {(w, i): (t.split().count(w), len(t.split())) for i, t in enumerate(texts) if t for w in set(t.split())}
    assert posts == want
    ask = spark.createDataFrame([(1, "aa b zz"), (2, "cc dd")], "qid int, query string")
    S.save_index(S.build_index(docs), str(tmp_path / "i"), 3)
    loaded = S.load_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, S.bm25_search(loaded, ask, 5).collect())) == sorted(map(tuple, S.bm25(docs, ask, 5).collect()))
    often = {w for w in {x for x, _ in want} if sum(x == w for x, _ in want) > 0.4 * len(texts)}
    rare = {(r.qid, r.id) for r in S.bm25(docs, ask, None, most_frequent=0.4).collect()}
    assert rare == {(q, i) for q, words in ((1, {"aa", "b", "zz"}), (2, {"cc", "dd"})) for w, i in want if w in words - often}


def test_many_short_surfaces_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c不良") for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, ""]
    surfaces = sorted({t[i : i + n] for t in texts if t for i, n in ((rng.randrange(len(t)), rng.randint(1, 9)),)}) + ["absent", "a b c d e f", "", None]
    t, s = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame(list(enumerate(surfaces)), "sid int, surface string")
    want = {(i, j) for i, x in enumerate(texts) if x for j, y in enumerate(surfaces) if y and y in x}
    for bound in (500, 2):
        monkeypatch.setattr(S, "LOOP_SURFACES", bound)
        rows = S.substring_join(t, s).collect()
        assert {(r.id, r.sid) for r in rows} == want and len(rows) == len(want)


def test_provider_vectors(spark):
    texts = spark.createDataFrame([(f"text {i}",) for i in range(150)], "text string")
    cache = texts.limit(1).select(F.sha1(F.concat(F.lit("m:"), "text")).alias("cache_key"), F.array(F.lit(-1.0)).alias("v"))
    seen = spark.sparkContext.accumulator(0)

    def provider(batch):
        assert len(batch) <= 64
        seen.add(len(batch))
        return [[float(len(x))] for x in batch]

    got = {r.text: r.v for r in S.embed_through(texts, cache, provider, "m").collect()}
    assert len(got) == 150 and sum(v == [-1.0] for v in got.values()) == 1 and seen.value == 149
    plain = S.embed_through(texts, cache, None, "m").collect()
    assert len(plain) == 150 and all(len(r.v) == 1024 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in plain)


def test_numbers_and_margins(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), rng.randint(0, 9), i) for i in range(300)] + [(None, 1, 300)]
    df = spark.createDataFrame(rows, "a int, b int, i int").repartition(5)
    got = {r.i: r.no for r in C.numbered(df, ["a", F.desc("b"), "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))
    assert got == {r[2]: k for k, r in enumerate(order)}
    assert C.numbered(df.limit(0), ["a"]).count() == 0
    m = {r.a: (r.best, r.margin) for r in S.top_with_margin(spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 5.0), (3, 9.0), (3, 4.0), (3, 1.0), (4, None)], "a int, v double"), ["a"], "v").collect()}
    assert m == {1: (3.0, 0.0), 2: (5.0, 5.0), 3: (9.0, 5.0)}


def test_spans_are_chosen_greedily():
    rng = random.Random(5)
    for _ in range(200):
        spans = [{"start": s, "end": s + rng.randint(1, 6)} for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        want = []
        for x in spans:
            if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in want):
                want.append(x)
        assert X._free_spans(spans) == want


def test_marks_and_allowed_folders(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1), (None, 2)], "a string, b int")
    T.write_csv(df.coalesce(1), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfa,b\n")
    assert sorted(T.read_csv(spark, str(tmp_path / "c"), df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    for b in ("x", "y"):
        (tmp_path / "d" / b).mkdir(parents=True)
        (tmp_path / "d" / b / f"{b}.txt").write_text("1")
    assert [r.name for r in T.list_artefacts(spark, str(tmp_path / "d"), allowed=("y",)).collect()] == ["y.txt"]


def test_the_ontology_meets_counts_not_edges(spark):
    from tessera.plans import qa_queries as Q

    lines = Q.ontology(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    below = [x for x in lines[join:] if "Aggregate [rel" in x]
    assert below and "count(1)" in below[0]


def test_questions_that_name_the_same_entities_are_answered_once(spark):
    from tessera.operators import graph as G

    rows = [(q, x, "Defect", 0) for q, x in ((1, "a"), (2, "a"), (3, "b"), (4, "a"), (4, "b"))]
    of, links = G.cases(spark.createDataFrame(rows, "question long, id string, label string, pos int"))
    assert {r.question: r.case for r in of.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(tuple(r) for r in links.select("question", "id", "label", "pos").collect()) == [(1, "a", "Defect", 0), (3, "b", "Defect", 0), (4, "a", "Defect", 0), (4, "b", "Defect", 0)]


def test_the_answer_queries_make_a_row_for_each_case_not_each_question(spark, tmp_path, monkeypatch):
    import duckdb

    from tessera.plans import qa_queries as Q

    sf, made, real = "/root/testdata/sf0.001", [], Q.materialise
    for t in ("part", "supplier", "lineitem", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    duckdb.execute(f"COPY (SELECT c.* REPLACE (c_custkey + 300 * i AS c_custkey) FROM '{sf}/customer.parquet' c, range(6) r(i) WHERE c_custkey <= 300) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    monkeypatch.setattr(Q, "materialise", lambda df, name: made.append(real(df, name)) or made[-1], raising=False)
    query, sql = Q.QUERIES["gr12_answer_graph"]
    got = query(spark, str(tmp_path)).collect()
    views = ", ".join(f"{t} AS (FROM '{tmp_path}/{t}.parquet')" for t in ("part", "supplier", "lineitem", "nation", "customer"))
    assert sorted(tuple(r) for r in got) == sorted(duckdb.execute(sql.replace("WITH ", f"WITH {views}, ", 1)).fetchall())
    assert made and made[0].count() * 2 < sum(r.n for r in got)


def test_the_scan_ranks_as_the_joins_do(spark):
    import random

    from tessera.operators import search as S

    rng = random.Random(11)
    words = [f"w{k}" for k in range(25)]
    docs = [(k, " ".join(rng.choices(words, weights=range(1, 26), k=rng.randrange(0, 12)))) for k in range(150)] + [(150, None), (151, "w1 w2"), (152, "w1 w2")]
    asked = [(f"q{k}", " ".join(rng.choices([*words, "unknown"], k=rng.randrange(1, 6)))) for k in range(20)] + [("none", "unknown"), ("blank", None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "qid string, query string")
    for k, most in ((3, None), (1, None), (200, None), (4, 0.3)):
        rows = lambda df: sorted((r.qid, r.rank, r.id, round(r.score, 5)) for r in df.collect())
        assert rows(S.bm25_scan(d, q, k, most_frequent=most)) == rows(S.bm25(d, q, k, most_frequent=most))


def test_the_search_queries_write_no_index(spark, monkeypatch):
    from tessera.operators import search as S
    from tessera.plans import search_queries as Q

    monkeypatch.setattr(S, "save_index", lambda *_: pytest.fail("an index of all postings"))
    assert Q.QUERIES["idx2_bm25"][0](spark, "/root/testdata/sf0.001").count() > 0


def test_postings_of_unique_chunks_are_counted_where_they_lie(spark):
    from tessera.operators import search as S

    docs = spark.createDataFrame([(k, " ".join(f"t{(k * j) % 7}" for j in range(k % 9))) for k in range(1200)] + [(5000, None), (5001, "Ä ä x")], "doc_id long, text string")
    rows = lambda **how: S.postings(docs, "doc_id", "text", **how)
    assert sorted(map(tuple, rows(unique=True).select("tok", "id", "tf", "dl").collect())) == sorted(map(tuple, rows().select("tok", "id", "tf", "dl").collect()))
    assert "Exchange" not in rows(unique=True)._jdf.queryExecution().executedPlan().toString()


def test_names_near_a_text_are_those_of_the_joined_grams(spark):
    from tessera.operators import search as S

    rng = random.Random(4)
    words = ["ring", "Bolz", "Ä", "Schraube", "渡湿", "x", "kette"]
    text = lambda n: rng.choice([" ", "\t "]).join(rng.choices(words, k=n))
    texts = spark.createDataFrame([(k, text(rng.randrange(1, 9))) for k in range(60)] + [(90, None), (91, "  ")], "id long, text string")
    names = spark.createDataFrame([(k, text(2)) for k in range(15)], "id long, name string")
    rows = lambda df: sorted((r.a_id, r["rank"], r.b_id, round(r.sim, 5)) for r in df.collect())
    near = S.near_names(texts, names, 3, 0.3)
    assert rows(near) == rows(S.sparse_neighbors(S.hash_embedding(texts, "id", "text"), S.hash_embedding(names, "id", "name"), 3, 0.3))
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
