"""Packing against the library's ids, and first fit against a plain scan over all bins."""

import random
from zlib import crc32

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain_first_fit(sizes, length):
    bins, held = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((b for b in range(len(bins)) if held[b] + sizes[k] <= length), None)
        if at is None:
            bins.append([])
            held.append(0)
            at = len(bins) - 1
        bins[at].append(k)
        held[at] += sizes[k]
    return bins


def test_tournament_tree_finds_the_first_bin_that_fits():
    rng = random.Random(3)
    for n in (1, 2, 3, 17, 200):
        for _ in range(20):
            sizes = [rng.choice([1, 2, 5, 30, 63, 64, rng.randint(1, 64)]) for _ in range(n)]
            assert packing.first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)


def test_pack_holds_all_once_and_needs_no_padding():
    rng = random.Random(4)
    for n in (0, 1, 2, 40, 300):
        sizes = [rng.randint(1, 63) for _ in range(n)]
        sequences = packing.pack(sizes, 64)
        held = sorted((k, start, m) for s in sequences for k, start, m in s)
        at = dict.fromkeys(range(n), 0)
        for k, start, m in held:
            assert start == at[k] and m > 0
            at[k] += m
        assert [at[k] for k in range(n)] == sizes
        full = [sum(m for _, _, m in s) for s in sequences]
        assert sum(f == 64 for f in full) >= sum(sizes) // 64
        assert all(f <= 64 and f & (f - 1) == 0 for f in full)


def check(spark, rows, columns="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, columns)
    found = packing.pack_documents(df, FILE, **options).collect()
    library, length = Tokenizer.from_file(FILE), options.get("length", 2048)
    library.no_truncation()
    library.no_padding()
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc_id, []).append(ids)
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, lists in want.items():
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                ids = lists[0][r.start : r.start + r.length]
                assert (r.start, r.doc_tokens) == (at, len(lists[0]))
                assert r.ids_crc32 == crc32(b"".join(i.to_bytes(4, "little") for i in ids))
                at += r.length
    for rows_of in by_sequence.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0
    return found


def test_pieces_of_documents(spark):
    rng = random.Random(5)
    words = ["the", "on", "Étion", "zz9", "don't", "<|endoftext|>", "漢字", "a" * 40, "\n\n", "?!"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 40, 900])))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "the " * 20_000), (None, "no id"), (2**60 + 1, "a large id"), (5, "again the id 5")]
    check(spark, rows)
    check(spark, rows, length=64, group_tokens=500)


def test_documents_of_whole_sequences_ties_and_repeats(spark):
    check(spark, [(1, "the " * 15), (2, "the " * 31), (3, "the " * 7), (4, "the " * 7), (5, "the " * 7)], length=16)
    found = check(spark, [(1, "same text")] * 500, length=16, group_tokens=100)
    assert sum(r.length for r in found) == 1500


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    found = check(spark, [(1, "one two", 9, "x"), (2, None, 8, "y")], "doc_id long, text string, length long, ids string")
    assert found[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
