"""Substring dedup, near-duplicates, top-k search, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, neardup, substrings, topk
from tessera.llm.common import shared_dir

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def frame(spark, rows, cols="doc_id long, text string"):
    return spark.createDataFrame(rows, cols)


def near_rows(seed=1, groups=8, size=7, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(n)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 5, 8])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += ["", None, "   ", "one", "ONE", "one two", "one two one two", "A b", "a B", rows[0].upper()]
    rng.shuffle(rows)
    return [(10 + 3 * i, t) for i, t in enumerate(rows)]


def sets_of(rows, width):
    out = {}
    for d, t in rows:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(LOW)) if x]
        out[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute_components(sets, percent=80):
    ids, up = sorted(sets), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("width", "rounds"), [(2, 4), (5, 1), (2, 1)])
def test_near_duplicates(spark, width, rounds):
    rows = near_rows(width)
    df = frame(spark, rows).withColumn("n", F.lit(1)).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=width, rounds=rounds).collect()}
    sets = sets_of(rows, width)
    want = brute_components(sets)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (want[d] == d) for d, r in got.items())


def test_near_duplicates_edges(spark):
    df = frame(spark, [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (5, "x y z"), (7, "x y z"), (9, "long " * 5000)])
    rows = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2).collect()]
    assert sorted(rows, key=str) == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)], key=str)
    assert neardup.near_duplicates(df.limit(0), width=2).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = base[:700], base[100:800]  # similarity 600 / 800
    est = np.mean([(neardup.signature(a ^ np.uint64(k << 7), 160) == neardup.signature(b ^ np.uint64(k << 7), 160)).mean() for k in range(10)])
    assert abs(est - 0.75) < 0.05


def test_near_duplicates_link_texts_of_one_id(spark):
    df = frame(spark, [(1, "p q r"), (2, "p q r"), (2, "x y z"), (3, "x y z"), (4, "k l m"), (None, "p q r"), (2, "x y z")])
    rows = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2).collect())
    assert rows == [(0, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_substring_dedup_of_null_ids(spark):
    long = "One sentence of seven words is here. Another sentence of seven words is there. "
    df = frame(spark, [(None, long), (None, long), (1, long), (2, None)]).withColumn("n_removed", F.lit("clash"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_removed) for r in substrings.remove_repeats(df).collect() if r.doc_id != 2)
    assert got == [(False, 0, long, 0), (False, 0, long, 0), (True, 1, "", 2)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if x in got} and all(find(x) == x for x in up if x not in got or got[x] == x)
    assert {x for x in up if find(x) != x} <= set(got)


def test_substring_dedup(spark):
    rng = random.Random(6)
    sent = lambda: (" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 22)))).capitalize() + rng.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sent() for _ in range(6)) for _ in range(4)]
    rows = [(i, "".join(sent() for _ in range(rng.randint(0, 8))) + (rng.choice(passages) if i % 2 else "") + "".join(sent() for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "  "), (54, "of. " * 60), (3, rows[3][1])]
    got = {}
    for r in substrings.remove_repeats(frame(spark, rows).withColumn("place", F.lit(1))).collect():
        got.setdefault(r.doc_id, r)
    parts, where = {}, {}
    for d, t in {(d, t) for d, t in rows}:
        s = substrings.sentences(t) if t else []
        first, last = substrings.runs([x for _, _, x in s])
        parts[d] = (t, s)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            where.setdefault(tuple(x for _, _, x in s[a:b]), []).append((d, a, b))
    gone = {d: set() for d in parts}
    for places in where.values():
        for d, a, b in sorted(places)[1:]:
            gone[d].update(range(a, b))
    for d, (t, s) in parts.items():
        assert got[d].n_removed == len(gone[d])
        assert got[d].text == ("".join(t[x:y] for i, (x, y, _) in enumerate(s) if i not in gone[d]) if gone[d] else t)
    joined = [r.text or "" for r in got.values()]
    for p in passages:
        inner = p[len(p) // 3 : 2 * len(p) // 3]
        assert sum(inner in t for t in joined) <= 1
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def brute_repeats(rows):
    """{id: (text, sentences, removed places)} from every run of enough sentences and words, of any length."""
    parts, where = {d: (t, substrings.sentences(t)) for d, t in rows}, {}
    for d, (_, s) in parts.items():
        for a in range(len(s)):
            for b in range(a + substrings.LEAST_SENTENCES, len(s) + 1):
                run = tuple(x for _, _, x in s[a:b])
                if len(" ".join(run).split()) >= substrings.LEAST_WORDS:
                    where.setdefault(run, []).append((d, a, b))
    gone = {d: set() for d in parts}
    for places in where.values():
        for d, a, b in sorted(places)[1:]:
            gone[d].update(range(a, b))
    return {d: (t, s, gone[d]) for d, (t, s) in parts.items()}


def test_substring_dedup_takes_runs_of_every_length(spark):
    rng = random.Random(9)
    sent = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n)).capitalize() + ". "
    short = lambda k: "".join(sent(rng.randint(1, 15)) for _ in range(k))
    passage = "".join(sent(n) for n in (15, 14, 13, 9, 4, 4))
    passages = [short(rng.randint(2, 9)) for _ in range(6)]
    rows = [(i, sent(10) + passage + sent(10)) for i in range(3)]
    rows += [(10 + i, short(rng.randint(0, 4)) + rng.choice(passages) + short(rng.randint(0, 4)) + rng.choice(passages)) for i in range(40)]
    rows += [(60, "Of. A b. " * 30), (61, sent(13) + "A. B c. D. " * 6)]
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    for d, (t, s, gone) in brute_repeats(rows).items():
        assert got[d].n_removed == len(gone)
        assert got[d].text == "".join(t[x:y] for i, (x, y, _) in enumerate(s) if i not in gone)
    assert passage in got[0].text and all(len(got[i].text.split()) == 20 for i in (1, 2))


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (350, [1e12] * 8), (400, [1.0, 2.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    good = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for block in (10_000, 2):
        got = {}
        for r in topk.search(df, df.where("vec_id % 50 = 0"), k=5, block_queries=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == {q for q in good if q % 50 == 0}
        for q, found in got.items():
            clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
            scores = sorted((-clip(sum(x * y for x, y in zip(good[q], v))), i) for i, v in good.items() if i != q)[:5]
            assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.search(df, df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id in (1, 50)"), df.where("vec_id = 50")).count() == 1


def test_top_k_takes_empty_vectors_and_many_cells(spark, monkeypatch):
    rows = [(0, [-1.0, -1.0]), (1, []), (2, [1.0, 1.0]), (3, [-1.0])] + [(50, [float(i), 0.5]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.where("vec_id in (0, 1)"), k=2).collect())
    assert got == [(0, 1, 3, 65536), (0, 2, 1, 0), (1, 1, 0, 0), (1, 2, 2, 0)]
    assert {r.vec_id for r in topk.search(df, df.where("vec_id = 50"), k=9).collect()} == {0, 1, 2, 3}
    rng = np.random.default_rng(5)
    big = spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.search(big, big.where("vec_id % 3 = 0")).collect()))
    monkeypatch.setattr(topk.tiled, "TILE_ROWS", 16)
    monkeypatch.setattr(topk.tiled, "CELL_PRODUCTS", 500)
    monkeypatch.setattr(topk.tiled, "COLUMN_BYTES", 1024)
    assert sorted(map(tuple, topk.search(big, big.where("vec_id % 3 = 0"), block_queries=16).collect())) == want
    v = {r.vec_id: [int(256 * x) for x in r.embedding] for r in big.collect()}
    assert all(s == sum(x * y for x, y in zip(v[q], v[c])) for q, _, c, s in want) and len(want) == 500


def leak_rows(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "..."), (33, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (34, items[5][1]), (34, items[6][1])]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            t = rng.choice(items[:25])[1].split()
            at = rng.randint(0, len(w))
            w[at:at] = t
        docs.append((d, (rng.choice([" ", ", ", "-"])).join(w).upper() if d % 2 else " ".join(w)))
    return docs + [(100, None), (101, ""), (102, "w1 " * 5000), (5, docs[5][1])], items


def brute_leaks(docs, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [200_000, 60])
def test_decontamination(spark, block):
    docs, items = leak_rows()
    df = frame(spark, docs).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in decontaminate.find_leaks(df, frame(spark, items, "item_id long, text string"), block_windows=block).collect()}
    for d, (n, hit, found) in brute_leaks(docs, items).items():
        assert (got[d].n_words, sum(s.end - s.start for s in got[d]["spans"]), got[d]["items"]) == (n, hit, found)


def test_decontamination_edges(spark):
    docs, items = leak_rows()
    df = frame(spark, docs).withColumn("items", F.lit("clash"))
    clean = decontaminate.find_leaks(df, frame(spark, [], "item_id long, text string"), keep_rows=True)
    assert clean.count() == len(docs) and clean.where("size(spans) > 0").count() == 0
    assert clean.columns == ["doc_id", "text", "n_words", "spans", "items"]
    assert decontaminate.find_leaks(df.limit(0), frame(spark, items, "item_id long, text string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    from tests.llm.test_maps import _lang_rows

    rng = random.Random(1)
    rows = [(i, t + f" n{i}" * rng.randint(0, 2), lang) for i, t, lang in _lang_rows(120, 8)]
    item = "zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows += [(200, rows[0][1], "aa"), (201, "1234 %%%", None), (202, rows[1][1] + " " + item, "bb"), (203, None, "aa"), (204, rows[2][1] + " tail password=abcdefgh12345", "cc"), (205, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(P.STAGES)
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {201, 203, 205}
    out = P.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    left = [(i, t) for i, t, _ in rows if i not in (201, 203, 205)]
    comp = brute_components(sets_of(left, 5))
    want = {i for i, t in left if comp[i] == i and item not in t}
    assert set(got) == want
    from tokenizers import Tokenizer

    from tessera.llm import bpe, secrets

    tok = Tokenizer.from_file(bpe.default_file())
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i in want:
        ids = tok.encode(masked[i], add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    if 204 in want:
        assert "abcdefgh12345" not in masked[204]


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    from tests.llm.test_maps import _lang_rows

    spark.createDataFrame([(1, "zeta eta theta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*_lang_rows(60, 8), (None, "ingthering therth", "aa"), (None, "ingthering therth", "aa"), (70, None, None), (71, "the ing zeta eta theta", "aa"), (72, "pwd: Xk9$mQ2!vLz8 thering", "aa")]
    odd = [c for c in ("score", "n_words", "items", "spans", "lang_pred", "s.p", "ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in odd)).withColumn("n_chars", F.length("text"))
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in odd), name
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0, name
    got = docs.collect()
    assert sum(r.doc_id is None for r in got) == 2 and not {70, 71} & {r.doc_id for r in got}
    assert [r.text for r in got if r.doc_id == 72] == ["pwd: [SECRET] thering"] and all(r.n_chars == len(r.text) for r in got)
    assert P.encoded(spark, docs, str(tmp_path)).count() == len(got)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language(spark, unlabelled, str(tmp_path)).count() == len(got)


def test_shared_dir_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
