"""Text functions, segmentation and packing on hand-written cases."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import chunk as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).head().x


def test_clean_surface(spark):
    assert one(spark, "　０１Ａ b　\tＺ ", TX.clean_surface) == "01AbZ"
    assert one(spark, "ａ", TX.clean_surface) == "ａ"  # lower-case full-width letters stay
    assert one(spark, None, TX.clean_surface) is None


def test_units_in_order(spark):
    assert one(spark, "5摄氏度 3度 2毫米 公斤", TX.normalize_units) == "5℃ 3℃ 2mm kg"


def test_confusions(spark):
    assert one(spark, "温度度", TX.typo_variants) == ["温渡度", "湿度度"]
    assert one(spark, "湿渡渡", TX.typo_repairs) == ["湿度度", "温渡渡"]


def test_one_edit(spark):
    rows = [("光捡", "光检", True), ("abc", "abc", False), ("abc", "ab", True), ("abc", "acb", False), ("a" * 12, "a" * 13, True), ("a" * 13, "a" * 12, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", TX.one_edit(F.col("a"), F.col("b")))
    assert df.where("got <> want").count() == 0


def test_deletion_keys_meet(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(60):
        a = "".join(rng.choice("ab检") for _ in range(rng.randint(1, 6)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :]])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").where(TX.one_edit(F.col("a"), F.col("b")))
    assert df.where(~F.arrays_overlap(TX.deletion_keys(F.col("a")), TX.deletion_keys(F.col("b")))).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("xaay", "aa"), ("", "aa"), ("aa.aa", "a.a"), ("检a检", "检")], "t string, p string")
    rows = df.select(TX.positions(F.col("t"), F.col("p")).alias("o"), TX.positions(F.col("t"), F.col("p"), False).alias("n")).collect()
    assert [(r.o, r.n) for r in rows] == [([0, 1, 2], [0, 2]), ([1], [1]), ([], []), ([1], [1]), ([0, 2], [0, 2])]


def test_md5_mod(spark):
    import hashlib

    for k in ("a", "检|x", ""):
        assert one(spark, k, lambda c: TX.md5_mod(c, 1000)) == int(hashlib.md5(k.encode()).hexdigest(), 16) % 1000


def test_json_salvage(spark):
    raw = '```json\n[{"surface": "a", "label": "Defect"}, {"surface": "b"'
    assert one(spark, raw, lambda c: TX.salvage_objects(TX.strip_code_fence(c), "surface")) == ['{"surface": "a", "label": "Defect"}']


def test_packing_is_sequential(spark):
    cases = [[2600, 1], [2601, 1], [1300, 1300, 1], [], [5]] + [[random.Random(i).randint(1, 1500) for _ in range(30)] for i in range(20)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<bigint>")
    got = {r.i: r.seg for r in df.select("i", C.pack_items(F.col("n")).alias("seg")).collect()}
    for i, lens in enumerate(cases):
        want, seg, size = [], -1, 0
        for n in lens:
            if seg >= 0 and size + n <= 2600:
                size += n
            else:
                seg, size = seg + 1, n
            want.append(seg)
        assert got[i] == want


def test_chunks_by_genre(spark):
    docs = spark.createDataFrame([
        ("SOP-1", "标题\n一、目的\n" + "甲" * 50 + "\n二、短\n少\n三、步骤\n" + "乙" * 60), ("EX-1", "抬头\n1. 责任工序：A\n正文\n2. 责任工序：B\n尾"), ("EX-2", " 没有条目 "),
        ("NTC-1", "头\n1. 适用产品 P\n内容\n2. 适用产品 Q\n内容"), ("NTC-2", "无"), ("SOP-2", "no heading"),
    ], "doc_id string, text string")
    rows = {(r.doc_id, r.pos): r.text for r in C.chunk_documents(docs).collect()}
    assert set(rows) == {("SOP-1", 0), ("SOP-1", 2), ("EX-1", 0), ("EX-1", 1), ("EX-2", 0), ("NTC-1", 0), ("NTC-1", 1)}
    assert rows["EX-1", 0] == "抬头\n1. 责任工序：A\n正文" and rows["EX-2", 0] == "没有条目" and rows["SOP-1", 0].startswith("标题\n\n一、目的")


def test_chunk_ids_run_on(spark):
    chunks = spark.range(500).select((F.col("id") % 50).alias("doc_id"), (F.col("id") / 50).cast("int").alias("pos"))
    rows = C.with_chunk_ids(chunks, ["doc_id", "pos"]).orderBy("doc_id", "pos").collect()
    assert [r.chunk_id for r in rows] == [f"C{i:05d}" for i in range(500)]


def test_codes_of_a_width_as_sql_pads_them(spark):
    import duckdb

    numbers = [0, 7, 12345, 99999, 100000, 132010, 9000001, None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(TX.code_of_width(F.col("n"))).collect()]
    assert got == [duckdb.execute("SELECT lpad(CAST(CAST(? AS BIGINT) AS VARCHAR), 5, '0') || '号'", [n]).fetchone()[0] for n in numbers]


def test_the_formats_query_agrees_with_its_sql_on_long_keys(spark, tmp_path):
    import duckdb

    from tessera.plans.text_queries import QUERIES

    duckdb.execute(f"COPY (SELECT k AS o_orderkey, TIMESTAMP '1995-05-07' AS o_orderdate FROM (VALUES (5), (99999), (132010), (132011)) t(k)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    query, sql = QUERIES["txt13_formats"]
    want = duckdb.execute(f"WITH orders AS (FROM '{tmp_path}/orders.parquet') {sql}").fetchall()
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == sorted(want)
