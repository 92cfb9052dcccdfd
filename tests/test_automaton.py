"""Automaton against joins and plain search; BM25 with an early stop against the full ranking."""

import random

import pytest

from tessera.operators import automaton as A
from tessera.operators import extract as X
from tessera.operators import search as S


def corpus(seed=3, texts=120, alphabet="abc "):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for k in range(texts)] + [(texts, None), (texts + 1, "漢字漢字 漢")]
    surfaces = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 6))) for _ in range(40)} | {"漢字", "漢"})
    return rows, surfaces


def places(text, s):
    return [i for i in range(len(text or "") - len(s) + 1) if text.startswith(s, i)]


@pytest.mark.parametrize("chars", [1_000_000, 40])
def test_places_of_all_surfaces(spark, chars):
    rows, surfaces = corpus()
    found_in = A.blocks(spark.createDataFrame([(s,) for s in [*surfaces, surfaces[0], ""]], "surface string"), block_chars=chars)
    assert len(found_in) == (1 if chars > 1000 else len(found_in)) and (chars > 1000 or len(found_in) > 2)
    got = {(r.id, r.surface): sorted(r.starts) for r in A.occurrences(spark.createDataFrame(rows, "id long, text string"), found_in).collect()}
    assert got == {(k, s): p for k, t in rows for s in surfaces if (p := places(t, s))}


def test_more_surfaces_than_automata_hold_are_joined(spark, monkeypatch):
    rows, surfaces = corpus(4)
    texts, sid = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(k, s) for k, s in enumerate([*surfaces, surfaces[1]])], "sid long, surface string")
    one = sorted(map(tuple, S.substring_join(texts, sid).collect()))
    docs = texts.withColumnRenamed("id", "doc_id")
    gaz = spark.createDataFrame([(s, f"e{k % 5}", "Defect", k) for k, s in enumerate(surfaces)], "surface string, id string, label string, ord long")
    spans = sorted(map(str, X.mentions(docs, gaz).collect()))
    monkeypatch.setattr(A, "blocks", lambda *a, **k: None)
    assert one == sorted(map(tuple, S.substring_join(texts, sid).collect())) and len(one) > 50
    assert spans == sorted(map(str, X.mentions(docs, gaz).collect())) and len(spans) > 50
    assert A.blocks is not None


def test_too_large_a_dictionary_has_no_blocks(spark):
    surfaces = spark.createDataFrame([("x" * k,) for k in range(1, 20)], "surface string")
    assert A.blocks(surfaces, block_chars=10, most=3) is None
    assert A.occurrences(spark.createDataFrame([(1, "x")], "id long, text string"), []).count() == 0


def test_early_stop_gives_the_same_ranks_and_reads_less(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    chunks = spark.createDataFrame([(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for k in range(1500)] + [(1500, None)], "doc_id long, text string")
    asked = [(q, " ".join(rng.choices(words[20:], k=4) + rng.choices(words, weights, k=3))) for q in range(25)] + [(25, "unknown"), (26, "w0 w1 w2 w0")]
    questions = spark.createDataFrame(asked, "qid long, query string")
    index = S.build_index(chunks)
    want = sorted(map(tuple, S.bm25_search(index, questions, 3).select("qid", "id", "score", "rank").collect()))
    ranks, read = S.bm25_early_stop(S.block_index(index, 8), questions, 3)
    assert want == sorted(map(tuple, ranks.select("qid", "id", "score", "rank").collect())) and len(want) == 78
    read = read.collect()
    assert len(read) == 26 and sum(r.read for r in read) < 0.6 * sum(r.held for r in read)
    rare, _ = S.bm25_early_stop(S.block_index(index, 8), questions, 5, most_frequent=0.1)
    assert sorted(map(tuple, rare.select("qid", "id", "score", "rank").collect())) == sorted(map(tuple, S.bm25_search(index, questions, 5, most_frequent=0.1).select("qid", "id", "score", "rank").collect()))
