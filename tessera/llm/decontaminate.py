"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of ``window`` consecutive words (one window of all its words if it has fewer).
A window occurs in a document only if all its shingles do, so with shingles in one global order,
rarest first, joining on the first shingle of each window finds every occurrence: the needed prefix
of an exact containment is one token. Candidates pass length and positional bounds (the whole
window must fit around the shingle's place) and are then compared word by word.

The window index is built with joins and aggregates, its size is checked, and it is broadcast in
blocks of at most ``BLOCK_WINDOWS`` windows; documents are read block by block, and never shuffled.

Defined results: a null text has no words; an item without id, text or words has no window; repeated
items count once by id, repeated documents each get their row; extra columns are dropped; an empty
benchmark leaves all documents clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, portions, table

WINDOW, SHINGLE = 10, 5
#: Windows in one broadcast block at most.
BLOCK_WINDOWS = 200_000

#: Words are runs of ASCII letters and digits and of all bytes above ASCII; letters are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_array(text):
    """The words of a text column, as Spark sees them."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1))


def window_index(bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, n, shingle, offset, items): each distinct window, its rarest shingle and that one's place in it."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("words")).where(F.col("item").isNotNull() & (F.size("words") > 0))
    n = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    wins = items.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("win"))
    wins = wins.groupBy("win", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    words, k = F.split("win", " "), F.least(F.lit(shingle), F.col("n"))
    parts = wins.select("win", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).alias("offset", "shingle"))
    rarity = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("rarity"))
    first = parts.join(rarity, "shingle").groupBy("win").agg(F.min(F.struct("rarity", "shingle", "offset")).alias("f"))
    return wins.join(first, "win").select("win", "n", "items", "f.shingle", "f.offset")


class WindowIndex:
    """One block of windows, ready for vectorised lookup."""

    def __init__(self, rows: list):
        vocab: dict[bytes, int] = {}
        self.vocab = vocab
        rows = sorted(rows, key=lambda r: (r.shingle, r.win))
        self.items = [list(r["items"]) for r in rows]
        self.by_size: dict[int, tuple] = {}
        shingles: dict[int, dict[int, list]] = {}
        for k, r in enumerate(rows):
            ids = [vocab.setdefault(w, len(vocab)) for w in r.win.encode("utf-8").split(b" ")]
            size = len(r.shingle.split(" "))
            key = int(self._hash(np.array([ids[r.offset : r.offset + size]], np.uint64))[0])
            shingles.setdefault(size, {}).setdefault(key, []).append((r.offset, ids, k))
        for size, found in shingles.items():
            keys = sorted(found)
            flat = [x for key in keys for x in found[key]]
            longest = max(len(ids) for _, ids, _ in flat)
            words = np.full((len(flat), longest), -2, np.int32)
            for i, (_, ids, _) in enumerate(flat):
                words[i, : len(ids)] = ids
            counts = np.array([len(found[key]) for key in keys])
            self.by_size[size] = (
                np.array(keys, np.uint64), np.concatenate([[0], np.cumsum(counts)]), words,
                np.array([len(ids) for _, ids, _ in flat]), np.array([o for o, _, _ in flat]), np.array([k for _, _, k in flat]),
            )

    @staticmethod
    def _hash(ids: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each row of word ids; a collision only costs a comparison."""
        h = np.zeros(ids.shape[0], np.uint64)
        for j in range(ids.shape[1]):
            h = (h + ids[:, j] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def matches(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, window) of every occurrence in ``ids`` (-1: no window has the word); begin, end: of the document at each place."""
        out = []
        known = ids >= 0
        for size, (keys, at, words, sizes, offsets, owners) in self.by_size.items():
            if len(ids) < size:
                continue
            ok = known[: len(ids) - size + 1].copy()
            for j in range(1, size):
                ok &= known[j : len(ids) - size + 1 + j]
            place = np.flatnonzero(ok)
            if not len(place):
                continue
            h = self._hash(ids[place[:, None] + np.arange(size)].astype(np.uint64))
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            place, k = place[hit], k[hit]
            n = at[k + 1] - at[k]
            row = np.repeat(at[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else k
            place = np.repeat(place, n)
            start = place - offsets[row]
            fits = (start >= begin[place]) & (start + sizes[row] <= end[place])
            start, row = start[fits], row[fits]
            same = np.ones(len(row), bool)
            for j in range(words.shape[1]):
                inside = j < sizes[row]
                same &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == words[row, j])
            out.append((start[same], sizes[row[same]], owners[row[same]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pass(df: DataFrame, index) -> DataFrame:
    """Add the hits of one block: (text, n_words, spans, items, ...) gains spans [start, end) and item ids."""
    schema = df.schema
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: WindowIndex = index.value
        get = found.vocab.get
        for whole in batches:
            for batch in portions(whole, 0):
                spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                split = [t.encode("utf-8").translate(_FOLD).split() if t else [] for t in batch.column(0).to_pylist()]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.fromiter((i for ws in split for i in map(get, ws, repeat(-1))), np.int32, int(sizes.sum()))
                stops = np.cumsum(sizes)
                begins = stops - sizes
                start, size, window = found.matches(ids, np.repeat(begins, sizes), np.repeat(stops, sizes))
                doc = np.searchsorted(stops, start, side="right")
                order = np.lexsort((start, doc))
                for d, s, n, w in zip(doc[order].tolist(), start[order].tolist(), size[order].tolist(), window[order].tolist(), strict=True):
                    s -= int(begins[d])
                    spans[d].append({"start": s, "end": s + n})
                    items[d] += found.items[w]
                spans = [_union(x) if len(x) > 1 else x for x in spans]
                items = [sorted(set(x)) if x else x for x in items]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), *batch.columns[4:]], names=schema.names)

    return df.mapInArrow(run, schema)


def _union(spans: list[dict]) -> list[dict]:
    """Overlapping and touching spans joined, by start."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS, keep_rows: bool = False) -> DataFrame:
    """(id, n_words, spans array<struct<start, end>> of hit words, items array<string>): whole documents against all windows.

    ``keep_rows``: all columns of ``docs`` come first (whole rows pass through, no join is needed), but
    columns of ``docs`` that are named n_words, spans or items give way to the new ones.
    """
    spark = docs.sparkSession
    index = window_index(bench, window, shingle)
    n = index.count()
    blocks = max(1, -(-n // block_windows))
    if blocks > 1:
        index = materialise(index, "windows")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    carried = [c for c in docs.columns if c not in ("n_words", "spans", "items")] if keep_rows else [id_col]
    # a text that is carried is not sent twice
    own = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carried) if c != text_col]
    back = [F.col("text" if c == text_col else f"_{k}").alias(c) for k, c in enumerate(carried)]
    df = docs.select(F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"), *own)
    for b in range(blocks):
        part = index if blocks == 1 else index.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        df = _pass(df, spark.sparkContext.broadcast(WindowIndex(part.collect())))
        if b + 1 < blocks:  # one block in memory at a time
            df = materialise(df, "leaks")
    return df.select(*back, "n_words", "spans", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: hit words and items of every document."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
