"""Packing of encoded documents into sequences of a fixed number of tokens.

What a document has beyond whole sequences (its tail) is packed by first-fit decreasing: tails, longest first, each go to the
first bin with room, which a tournament tree of the bins' free room finds in logarithmic time. This runs independently in groups of
documents that a hash of their place deals out, so no id, source or text can make a group hot, and the number of
groups comes from the tails counted. What first fit leaves open is then filled: the fullest bins are completed with cuts
of the emptiest ones, and the one bin that stays open in a group is cut into sequences of a power of two each, which
need no padding.

Defined results: a null text counts as empty, so its document has the end token alone; rows of one id are documents of
their own; a text of any length is encoded whole, and its whole sequences never leave the task that encodes it; a
document of a whole number of sequences has no tail; other columns are dropped, so names cannot clash; an empty table gives an empty
result. One map that encodes, written to the shared folder; then one shuffle of the tails alone (fewer tokens than a sequence each).
Sequence ids are unique but not dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import SLICE_BYTES, Encoder, default_file
from tessera.llm.common import materialise, portions, table

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 2048, 1
#: Tokens and tails of a group, on average; bounds what a task holds at once.
GROUP_TOKENS, GROUP_TAILS = 1 << 20, 1 << 16
#: Whole sequences of one task are numbered from here on; those of groups before.
_WHOLE = 1 << 62


class FreeRoom:
    """A tournament tree over bins of equal size: each inner node holds the larger free room of its two halves."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with so much room (there is one), less that room from now on."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        found = at - self.leaves
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins of the places in ``sizes``: the largest first (of equals the first), each to the first bin where it fits."""
    tree, bins = FreeRoom(len(sizes), length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = tree.first(sizes[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (place in ``sizes``, start, length) that hold all of every item, full or of a power of two long.

    First-fit decreasing; then the bins with most in them are filled with cuts of those with least, and what is left, less
    than a sequence, is cut at powers of two.
    """
    bins = [[(k, 0, sizes[k]) for k in b] for b in first_fit_decreasing(sizes, length)]
    held = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-held[b], b))
    whole = sum(held) // length
    spare = [piece for b in reversed(order[whole:]) for piece in bins[b]]
    out = []

    def take(room: int) -> list[tuple[int, int, int]]:
        got = []
        while room:
            k, start, n = spare.pop()
            used = min(n, room)
            got.append((k, start, used))
            if used < n:
                spare.append((k, start + used, n - used))
            room -= used
        return got

    for b in order[:whole]:
        out.append(bins[b] + take(length - held[b]))
    left = sum(n for _, _, n in spare)
    while left:
        part = 1 << (left.bit_length() - 1)
        out.append(take(part))
        left -= part
    return out


def _lot(place: int) -> int:
    """62 pseudo-random bits for a place in the table."""
    mixed = (place + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return ((mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)) >> 2


def encoded_tails(df: DataFrame, file: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, lot, ids): the whole sequences of every document, and its tail.

    Whole sequences have an id and no ids; a tail has its ids and a lot, pseudo-random bits, but no sequence yet.
    """
    own = df.select(F.col(id_col), F.col(text_col))
    long = T.LongType()
    out = T.StructType([own.schema[0], *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "lot")), T.StructField("ids", T.BinaryType())])
    last, step = end.to_bytes(4, "little"), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(file), TaskContext.get().partitionId()
        row = whole = 0
        for batch in batches:
            for part in portions(batch, 1, SLICE_BYTES):
                source, rows = [], []
                for k, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    ids += last
                    n = len(ids) // 4
                    for at in range(0, len(ids) - step + 1, step):
                        rows.append((at // 4, length, crc32(ids[at : at + step]), n, _WHOLE | task << 36 | whole, None, None))
                        source.append(k)
                        whole += 1
                    tail = ids[n // length * step :]
                    if tail:
                        rows.append((n - len(tail) // 4, len(tail) // 4, None, n, None, _lot(task << 36 | row), tail))
                        source.append(k)
                    row += 1
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                ids_of = part.column(0).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, pa.binary() if j == 6 else pa.int64()) for j, c in enumerate(columns))], names=out.names)

    return own.mapInArrow(run, out)


def pack_documents(df: DataFrame, file: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents in their sequences."""
    written = materialise(encoded_tails(df, file, length, end, id_col, text_col), "encoded")
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = written.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")).select(columns)
    tails = written.where(F.col("sequence_id").isNull())
    size = tails.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    groups = max(1, -(-size.tokens // group_tokens), -(-size.n // GROUP_TAILS))
    out = T.StructType([*(written.schema[c] for c in columns[:-1]), T.StructField("offset", T.LongType())])

    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("lot").combine_chunks()
        ids, starts, group = rows["ids"].to_pylist(), rows["start"].to_pylist(), key[0].as_py()
        source, pieces = [], []
        for s, sequence in enumerate(pack(rows["length"].to_pylist(), length)):
            offset = 0
            for k, start, n in sequence:
                source.append(k)
                pieces.append((starts[k] + start, n, crc32(ids[k][4 * start : 4 * (start + n)]), group << 32 | s, offset))
                offset += n
        kept = rows.select([id_col, "doc_tokens"]).take(pa.array(source, pa.int64()))
        start, n, crc, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*pieces, strict=True))
        return pa.table([kept[id_col], start, n, crc, kept["doc_tokens"], sequence, offset], names=out.names)

    grouped = tails.withColumn("group", F.pmod("lot", F.lit(groups))).select("group", id_col, "start", "length", "doc_tokens", "lot", "ids")
    return whole.unionByName(grouped.groupBy("group").applyInArrow(packed, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the pieces of all documents in sequences of 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), default_file())
