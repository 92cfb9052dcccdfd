"""Substring dedup by sliding sentence spans.

Each text is cut into sentences (a long one further, at commas and at words that a hash picks, so that
copies with a changed word soon fall into step again). For every sentence the shortest run of at least ``LEAST_SENTENCES`` sentences with at least
``LEAST_WORDS`` words that begins at it is hashed, and the shortest that ends at it. Every sentence of any longer
run lies in one of these inside that run, so the result is that of hashing all runs. A count of each hash
leaves the places of repeated runs; one global aggregate finds the first place of each by (doc_id, place); a
join brings that back to the places, and every sentence that a repeated run covers at another place than its
first is removed. A run that ends at a sentence starts with a run that begins at its first sentence and repeats only if that one does, so
it travels with it, as the hash of the rest, and is looked at only where that one repeats.

Both aggregates combine before they shuffle. What they give is written before it is joined back to the places,
so both sides of those joins are plain shuffles and adaptive execution can split the partition of a passage that a
third of all documents share (from its thresholds on; a smaller one fits in a task). Only places of runs and the
texts are shuffled.

Defined results: null text stays null; empty text stays empty; rows with equal id and
text are one document, so they do not remove each other; a null id sorts first; words are compared in
lower case with white space folded; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, portions, table

#: A run has so many sentences and words at least; sentences of more than LONG_SENTENCE words are cut
#: into pieces of LEAST_PIECE words or more, LONG_PIECE at most.
LEAST_SENTENCES, LEAST_WORDS, LONG_SENTENCE, LEAST_PIECE, LONG_PIECE = 2, 12, 16, 5, 24

_END = re.compile(r"""[.!?]+["')\]]*\s+|\n+""")
_WORD = re.compile(r"\S+")
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded text) of the sentences; together they cover the text from its first word on."""
    out, at, low = [], 0, text.lower()
    same = len(low) == len(text)  # else places differ, and each piece is folded alone
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end <= at:
            continue
        words = (low[at:end] if same else text[at:end].lower()).split()
        if not words:
            if out:
                out[-1] = (out[-1][0], end, out[-1][2])
                at = end
            continue
        if len(words) <= LONG_SENTENCE:
            out.append((at, end, " ".join(words)))
        else:
            cuts = _cuts(words)
            if cuts:
                ends = [m.end() for m in _WORD.finditer(text, at, end)]
                first, begin = 0, at
                for k in cuts:
                    out.append((begin, ends[k - 1], " ".join(words[first:k])))
                    first, begin = k, ends[k - 1]
                out.append((begin, end, " ".join(words[first:])))
            else:
                out.append((at, end, " ".join(words)))
        at = end
    return out


def _cuts(words: list[str]) -> list[int]:
    """Where a long sentence is cut: the counts of words before each cut."""
    cuts, last, n = [], 0, len(words)
    k = LEAST_PIECE
    while k < n:
        w = words[k - 1]
        if k - last >= LONG_PIECE or w[-1] in ",;:" or crc32(w.encode()) % 6 == 0:
            cuts.append(k)
            last = k
            k += LEAST_PIECE
        else:
            k += 1
    return cuts


def runs(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence (exclusive) of every run of a text, by its folded sentences.

    The shortest run from each sentence comes first, in order, so the i-th begins at i; then the shortest run
    up to each sentence, if it is another. One of these begins where one of the former does.
    """
    n = len(parts)
    words = np.concatenate([[0], np.cumsum([p.count(" ") + 1 for p in parts])]).astype(np.int64)
    first = np.arange(n)
    last = np.maximum(np.searchsorted(words, words[first] + LEAST_WORDS, side="left"), first + LEAST_SENTENCES)
    first, last = first[last <= n], last[last <= n]
    end = np.arange(1, n + 1)
    back = np.minimum(np.searchsorted(words, words[end] - LEAST_WORDS, side="right") - 1, end - LEAST_SENTENCES)
    back, end = back[back >= 0], end[back >= 0]
    other = last[back] != end
    return np.concatenate([first, back[other]]), np.concatenate([last, end[other]])


def _place(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of every run: twice its first sentence, or for those up to a sentence twice that sentence and one.

    Runs of equal text are of one kind and length, so their places are in the order of the text.
    """
    return np.where(first == np.arange(len(first)), 2 * first, 2 * last - 1).astype(np.int64)


def _hashed(h: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of every run, from a polynomial sum over the hashes of the sentences."""
    with np.errstate(over="ignore"):
        acc = np.zeros(len(first), np.uint64)
        size = last - first
        for j in range(int(size.max(initial=0))):
            on = j < size
            acc[on] = (acc[on] ^ h[first[on] + j]) * np.uint64(base)
            acc[on] ^= acc[on] >> np.uint64(31)
    return acc.view(np.int64)


def _packed(text: str | None) -> tuple[np.ndarray, ...]:
    """(h1, h2, n, place, tail): two hashes of each run from a sentence and how many runs begin there; their places, and the hash of what follows the first of them (0 for itself)."""
    parts = [p for _, _, p in sentences(text)] if text else []
    h = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))
    first, last = runs(parts)
    k = int((first == np.arange(len(first))).sum())
    tail = np.concatenate([np.zeros(k, np.int64), _hashed(h, last[first[k:]], last[k:], _B1)])
    order = np.argsort(first, kind="stable")
    return _hashed(h, first[:k], last[:k], _B1), _hashed(h, first[:k], last[:k], _B2) >> 32, np.bincount(first, minlength=k), _place(first, last)[order], tail[order]


def _hashes(docs: DataFrame) -> DataFrame:
    """(id, th, h1, h2, places, tails): the runs of each text, packed in arrays of equal length."""
    lists = [T.StructField("h1", T.ArrayType(T.LongType())), T.StructField("h2", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("tails", T.ArrayType(T.ArrayType(T.LongType())))]
    schema = T.StructType([docs.schema["id"], docs.schema["th"], *lists])
    offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                found = [_packed(text) for text in part.column(2).to_pylist()]
                h1, h2, n, place, tail = (np.concatenate(c) for c in zip(*found, strict=True))
                outer, inner = offsets([len(x[0]) for x in found]), offsets(n)
                values = pa.array(h1), pa.array(h2.astype(np.int32)), pa.ListArray.from_arrays(inner, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(inner, pa.array(tail))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.ListArray.from_arrays(outer, v) for v in values)], names=schema.names)

    return docs.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_removed): every text without the sentences of repeated runs but the first, and how many went."""
    docs = df.select(F.col(id_col).alias("id"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))
    packed = materialise(_hashes(docs), "runs")
    places = packed.select("id", "th", F.explode(F.arrays_zip("h1", "h2", "places", "tails")).alias("x")).select("x.h1", "x.h2", "id", "th", "x.places", "x.tails")
    # most runs occur once: counting one hash finds those that may repeat, and only their places go on
    often = materialise(places.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "often")
    places = materialise(places.join(often, "h1", "left_semi"), "places")
    places = places.select("h1", "h2", "id", "th", F.explode(F.arrays_zip("places", "tails")).alias("x")).select("h1", "h2", "x.tails", "id", "th", F.col("x.places").alias("place"))
    here = F.struct("id", "th", "place")
    first = places.groupBy("h1", "h2", "tails").agg(F.min(here).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "tails", "f")
    first = materialise(first, "first")
    again = places.join(first, ["h1", "h2", "tails"]).where(here != F.col("f")).select("id", "th", "place")
    cut = again.groupBy(F.col("id").alias("cut_id"), F.col("th").alias("cut_th")).agg(F.collect_set("place").alias("places"))
    joined = docs.join(cut, (F.col("th") == F.col("cut_th")) & F.col("id").eqNullSafe(F.col("cut_id")), "left").select("id", "text", "places")
    schema = T.StructType([docs.schema["id"], docs.schema["text"], T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in portions(whole, 1)):
            out, gone = [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not at or not text:
                    out.append(text)
                    gone.append(0)
                    continue
                parts = sentences(text)
                covered = np.zeros(len(parts) + 1, np.int64)
                first, last = runs([p for _, _, p in parts])
                hit = np.isin(_place(first, last), at)
                np.add.at(covered, first[hit], 1)
                np.add.at(covered, last[hit], -1)
                keep = (np.cumsum(covered)[:-1] == 0).tolist()
                out.append("".join(text[s:e] for (s, e, _), k in zip(parts, keep, strict=True) if k))
                gone.append(keep.count(False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document without repeated passages."""
    return remove_repeats(table(spark, sf_dir, "documents"))
