"""Alignment of two tokenizers against a plain walk over all tokens of all documents."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment

A_FILE, B_FILE = alignment.default_files()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def b_bytes(b, i):
    piece = b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()


def expected(rows, tokenizers):
    """By doc_id (they are distinct): the columns of the result."""
    a, b = tokenizers
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in printable]
    back = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
    links, groups, sizes = {}, {}, {}
    for doc, text, *_ in rows:
        links[doc], groups[doc], sizes[doc] = [], [], (0, 0)
        if not text:
            continue
        found = a.encode(" " + text, add_special_tokens=False)
        xs = [(i, bytes(back[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        ys = [(i, b_bytes(b, i)) for i in b.encode(text)]
        if not b"".join(s for _, s in xs) == b"".join(s for _, s in ys) == (" " + text).encode():
            continue
        sizes[doc] = (len(xs), len(ys))
        ends = []
        for tokens in (xs, ys):
            at, out = 0, []
            for i, s in tokens:
                at += len(s)
                out.append((i, at))
            ends.append(out)
        links[doc] = [(i, j) for i, e in ends[0] for j, f in ends[1] if e == f]
        cuts = sorted({e for _, e in ends[0]} & {f for _, f in ends[1]})
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups[doc].append("|".join(",".join(str(i) for i, e in side if low < e <= high) for side in ends))
    counts = Counter(x for doc in links.values() for x in doc)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return {
        doc: (*sizes[doc], len(groups[doc]), len(links[doc]), sum(counts[x] == most[x[1]] for x in links[doc]), sum(counts[x] for x in links[doc]),
              sha256(";".join(groups[doc]).encode()).hexdigest() if groups[doc] else "")
        for doc in links
    }


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "the the the dog", "  two  spaces\n\nand\tlines ", "Étion dans çouelle, ß ö ü", "漢字 and かな 🙂🙂", "<|endoftext|> </s> <0x41>",
    "def f(x):\n    return x**2  # 12345", "", None, " ", "▁ is not a space", "a" * 300, "don't can't 3.14159", "\x00 nul", "é combining", "ﬁ ligature", "the quick brown dog",
]


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_against_a_plain_walk(spark, tokenizers):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows, tokenizers)
    assert got(alignment.align(df, A_FILE, B_FILE)) == want
    assert sum(w[2] > 0 for w in want.values()) > 30 and want[8] == want[7] == (0, 0, 0, 0, 0, 0, "")


def test_rare_groups_are_joined(spark, tokenizers):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align(df, A_FILE, B_FILE, frequent=5)) == expected(rows, tokenizers)


def test_table(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align(df, A_FILE, B_FILE)) == expected(rows, tokenizers)


def test_links_of_a_group():
    t = alignment.load(A_FILE, B_FILE)
    group, _ = alignment.cut_groups(t, *next(t.encode(["hello"])))
    assert len(group) == 1 and len(alignment.links(group[0], t.a_sizes, t.b_sizes)) == 1


def test_stretches_give_what_whole_texts_give():
    t = alignment.load(A_FILE, B_FILE)
    groups, rng = alignment.Groups(t), random.Random(2)
    bits = ["the", "Étion", " ", "  ", "\n", "\t", " \n", "a", ",", "don't", "漢字", "🙂", "\u00a0", "\x1f", "123", "...", "▁", "\u3000", "é", "<s>", "  end"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    assert t.cuttable
    for text, (a, b), found in zip(texts, t.encode(texts), groups.of(texts), strict=True):
        whole = alignment.cut_groups(t, a, b)[0] if a else []
        assert found == (len(a), len(b), len(whole), ";".join(whole), Counter(whole)), text
        a_ids, b_ids = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
        assert not a or (a, b) == (a_ids, b_ids)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A_FILE, B_FILE).count() == 0
    df = spark.createDataFrame([(1, "one", 5, "x"), (1, "one", 6, "y"), (None, "one two", 7, "z")], "doc_id long, text string, row long, g string")
    found = alignment.align(df, A_FILE, B_FILE).collect()
    assert sorted((r.doc_id is None, r.n_links, r.count_sum) for r in found) == [(False, 1, 3), (False, 1, 3), (True, 2, 4)]
