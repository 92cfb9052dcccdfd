"""Alignment of two tokenizers: where tokens of both end together, and which ids are linked how often.

A is a byte-level vocabulary, B a piece vocabulary that puts a space before the text. Byte offsets at which tokens of both end cut a
text into groups. A link is a pair of tokens of A and B whose byte ranges end together, which is the last of both in each
group. Groups repeat all over a corpus, so they are interned: a dictionary of the distinct groups is counted, links are expanded once
for each of its rows and weighed by how often the group occurs, and what a group is worth (its links, those with the
count that is the highest of their B id, the sum of counts) is joined back by the group.

Both tokenizers cut before a single space between other characters, so a text is taken in stretches between such spaces, and a worker
remembers the groups of the stretches that it met. Where a vocabulary does not allow that, or a stretch does not give its bytes back, the text is encoded whole.

The documents are encoded once; what is written has a document's distinct groups with their numbers. The commonest groups,
``FREQUENT`` at most, are broadcast; the others meet theirs by a shuffle on the group, which has no hot key, since a document has a
group once and hot groups are broadcast. Both sums are combined for each document before they are shuffled.

Defined results: a text that is null or empty has no tokens, nor has one whose joined bytes of A or of B are
not the space and the text; rows of one id are documents of their own; ids may be null; repeated rows count each; texts are encoded whole; other columns
are dropped, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, portions, table
from tessera.llm.wordbpe import _byte_chars

#: Groups that are broadcast with their sums, at most, and characters of the longest that may be (so 20 MB at the very most).
FREQUENT, FREQUENT_CHARS = 100_000, 64
#: Bytes of text that are encoded together, stretches that a worker remembers, and characters of the longest of them.
SLICE_BYTES, CACHE, CACHE_CHARS = 1 << 20, 300_000, 48
#: Where a text is cut: at a space between characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        back = {c: b for b, c in enumerate(_byte_chars())}
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        a_bytes = {i: bytes(back[c] for c in entry) for entry, i in vocabulary.items() if all(c in back for c in entry)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Whether no piece goes on over a space, so that stretches can be encoded one by one.
        self.cuttable = all("▁" not in p.lstrip("▁") for p in pieces) and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B for each text; none where the bytes of either are not the space and the text."""
        of_a = self.a.encode_batch_fast([" " + text for text in texts], add_special_tokens=False)
        of_b = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            want, a = (" " + text).encode(), a.ids
            whole = text and b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if whole else ([], [])


@lru_cache(2)
def load(a_file: str, b_file: str) -> Tokenizers:
    """One instance per worker process."""
    return Tokenizers(a_file, b_file)


def cut_groups(t: Tokenizers, a: list[int], b: list[int]) -> tuple[list[str], np.ndarray]:
    """The groups of the tokens of one text, each as ``a1,a2|b1``, and the byte offsets where they end."""
    a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    ends, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    out, x, y = [], 0, 0
    for p, q in zip((i + 1).tolist(), (j + 1).tolist(), strict=True):
        out.append(f"{a[x]}|{b[y]}" if p == x + 1 and q == y + 1 else ",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
        x, y = p, q
    return out, ends


class Groups:
    """Groups of whole texts, with a bounded memory of those of stretches between spaces."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.known: dict[str, tuple[int, int, str] | None] = {}

    def _of(self, texts: list[str]) -> Iterator[tuple[int, int, str] | None]:
        """(n_a, n_b, groups joined) of each text, None for one without tokens."""
        for a, b in self.t.encode(texts):
            yield (len(a), len(b), ";".join(cut_groups(self.t, a, b)[0])) if a else None

    def _together(self, stretches: list[str]) -> Iterator[tuple[int, int, str] | None]:
        """The same of many stretches that begin and end without white space: encoded as one text, whose tokens and groups end where they do.

        If the text does not give its bytes back, its halves may.
        """
        if len(stretches) <= 8:
            yield from self._of(stretches)
            return
        a, b = next(self.t.encode([" ".join(stretches)]))
        if not a:
            half = len(stretches) // 2
            yield from self._together(stretches[:half])
            yield from self._together(stretches[half:])
            return
        stops = np.cumsum([len(s.encode()) + 1 for s in stretches])
        groups, ends = cut_groups(self.t, a, b)
        in_a, in_b = (np.searchsorted(np.cumsum(sizes[ids]), stops, side="right") for sizes, ids in ((self.t.a_sizes, a), (self.t.b_sizes, b)))
        in_groups = np.searchsorted(ends, stops, side="right").tolist()
        at = 0
        for n_a, n_b, stop in zip(np.diff(in_a, prepend=0).tolist(), np.diff(in_b, prepend=0).tolist(), in_groups, strict=True):
            yield n_a, n_b, ";".join(groups[at:stop])
            at = stop

    def of(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, dict[str, int]]]:
        """(n_a, n_b, n_groups, groups joined, number of each group) of every text."""
        split = [_CUT.split(text) if text and self.t.cuttable else [] for text in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        met = set().union(*split).difference(known)
        inner = [s for s in met if not s[0].isspace() and not s[-1].isspace()]
        outer = list(met.difference(inner))
        once = dict(zip(inner, self._together(inner), strict=True)) | dict(zip(outer, self._of(outer), strict=True))
        known.update((s, found) for s, found in once.items() if len(s) <= CACHE_CHARS)
        for text, stretches in zip(texts, split, strict=True):
            found = [known[s] if s in known else once[s] for s in stretches]
            if not found or None in found:
                found = [next(self._of([text]))] if text else [None]
            if found == [None]:
                yield 0, 0, 0, "", {}
                continue
            joined = ";".join([f[2] for f in found])
            groups = joined.split(";")
            yield sum([f[0] for f in found]), sum([f[1] for f in found]), len(groups), joined, Counter(groups)


def links(group: str, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[tuple[int, int]]:
    """All pairs of an A id and a B id of a group whose byte ranges end together."""
    a, b = ([int(x) for x in ids.split(",")] for ids in group.split("|"))
    ends = {}
    for x, end in zip(a, np.cumsum(a_sizes[a]).tolist(), strict=True):
        ends.setdefault(end, []).append(x)
    return [(x, y) for y, end in zip(b, np.cumsum(b_sizes[b]).tolist(), strict=True) for x in ends.get(end, [])]


def grouped(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups_sha256, groups array<struct<g, n>>): each document with its distinct groups; row is unique."""
    own = df.select(F.col(id_col), F.col(text_col))
    long, pair = T.LongType(), T.StructType([T.StructField("g", T.StringType()), T.StructField("n", T.LongType())])
    out = T.StructType([T.StructField("row", long), own.schema[0], *(T.StructField(c, long) for c in ("n_a", "n_b", "n_groups")), T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.ArrayType(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load(a_file, b_file)
        groups, row = Groups(tokenizers), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in portions(batch, 1, SLICE_BYTES):
                n_a, n_b, n_groups, digests, offsets, g, n = [], [], [], [], [0], [], []
                for a, b, parts, joined, counted in groups.of([t or "" for t in part.column(1).to_pylist()]):
                    g += counted.keys()
                    n += counted.values()
                    n_a.append(a)
                    n_b.append(b)
                    n_groups.append(parts)
                    offsets.append(len(g))
                    digests.append(sha256(joined.encode()).hexdigest() if parts else "")
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.int64())], names=["g", "n"]))
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), lists], names=out.names)

    return own.mapInArrow(run, out)


def expanded(groups: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(g, n, a, b): the links of each distinct group (g, n), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(a_file, b_file)
        for batch in batches:
            rows = [(g, n, a, b) for g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b in links(g, t.a_sizes, t.b_sizes)]
            g, n, a, b = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["g", "n", "a", "b"])

    return groups.select("g", "n").mapInArrow(run, "g string, n long, a int, b int")


def link_counts(found: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold a pair of ids, and whether that is the most of all pairs with its B id; from ``expanded``."""
    counts = found.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    documents = materialise(grouped(df, a_file, b_file, id_col, text_col), "groups")
    each = documents.select("row", F.explode("groups").alias("x")).select("row", "x.g", "x.n")
    dictionary = materialise(each.groupBy("g").agg(F.sum("n").alias("n")), "dictionary")
    found = materialise(expanded(dictionary, a_file, b_file), "links")
    worth = found.join(link_counts(found), ["a", "b"]).groupBy("g", "n").agg(F.count(F.lit(1)).alias("links"), F.count_if("best").alias("best"), F.sum("count").alias("count"))
    worth = materialise(worth, "worth")
    top = worth.where(F.length("g") <= FREQUENT_CHARS).orderBy(F.desc("n"), "g").limit(frequent)
    top = materialise(top.drop("n"), "frequent")
    met = each.join(F.broadcast(top), "g", "left")
    rare = met.where("links is null").select("row", "g", "n").join(worth.drop("n"), "g")
    sums = [F.sum(F.col("n") * F.col(c)).alias(s) for c, s in (("links", "n_links"), ("best", "n_best"), ("count", "count_sum"))]
    both = met.where("links is not null").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    total = both.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return documents.drop("groups").join(total, "row", "left").select(id_col, "n_a", "n_b", "n_groups", *zero, "groups_sha256")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: tokens, groups and links of two vocabularies in every document."""
    return align(table(spark, sf_dir, "documents"), *default_files())
