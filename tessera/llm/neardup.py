"""MinHash near-duplicates: circulant signatures, banding, and exact confirmation on full sets.

Two permutations of the 32-bit integers make a whole signature: the first scatters the hashed
shingles, the second is shifted circularly by one place for each further coordinate. Texts with equal
sets become one class first. Classes that share a band of coordinates are candidates; a bucket is never
expanded into all its pairs. In each round every member is compared with one hub of its bucket, on
the full sets; links join classes into components. A bucket whose members are in one component needs
nothing more. What is left after the rounds is compared in full: each member outside the bucket's
main component with all of the main component and with the others outside it, so no candidate pair is
given up. For that the sets are packed into blocks; a row is one set and one block, and a task gives
back the links only, never the pairs.

With 32 bands of 5 a pair at the threshold 0.8 shares no band with probability 3e-6.

What is joined back to the members of hot buckets (hubs, open buckets) is written first, so that the join has
plain shuffles on both sides and its large partitions can be split; blocks of a large component are
spread over several keys.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and stay;
rows that repeat a doc_id are one document with several texts, so what is near any of them is in one component;
a null id is alone, its component null;
extra columns are dropped; an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, portions, table
from tessera.llm.components import connect

#: Bands and coordinates in each; links have 100 * intersection >= PERCENT * union.
BANDS, ROWS, PERCENT = 32, 5, 80
#: Rounds of hub comparisons at most before the rest is compared in full.
ROUNDS = 4
#: Bytes of sets in one packed block, on average, and blocks that one key of the join holds.
BLOCK_BYTES, SPREAD = 128 << 10, 16
#: Distinct words whose hash a worker remembers.
CACHE_WORDS = 50_000
_TILE = 1024


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], width: int, cache: _Hashes) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of ``width`` words of every text."""
    for text in texts:
        words = text.encode("utf-8").lower().split() if text else []
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            yield h
            continue
        n = max(1, len(h) - width + 1)
        acc = np.full(n, len(h) if len(h) < width else 0, np.uint64)
        for j in range(min(width, len(h))):
            acc = (acc ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(32)
        acc.sort()
        yield acc[np.concatenate(([True], acc[1:] != acc[:-1]))] if n > 1 else acc


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of pi(sigma(x) + k) over the set, modulo 2^32."""
    x = hashes.astype(np.uint32)  # the low half of a 64-bit hash
    x *= np.uint32(0xCC9E2D51)  # sigma
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x1B873593)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(x), _TILE):
        y = x[None, at : at + _TILE] + shift  # circular: modulo 2^32
        y ^= y >> np.uint32(16)  # pi
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        np.minimum(least, y.min(1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    part, acc = sig.reshape(bands, rows).astype(np.uint64), np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        acc = (acc ^ part[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def _sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, fp, keys): set size, 128-bit fingerprint of the set and band keys; null fp for an empty set."""
    schema = T.StructType([docs.schema[0], T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in (x for whole in batches for x in portions(whole, 1)):
            n, fp, keys, counts = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width, cache):
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
                counts.append(len(keys[-1]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, s): the sorted hashes of every set, packed."""
    schema = T.StructType([docs.schema[0], T.StructField("s", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in (x for whole in batches for x in portions(whole, 1)):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width, cache)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, joined.select("a", "b").schema)


def _against_blocks(one: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets and blocks of sets: one (a, group) and blocks (group, id, n), both by ids.

    The sets of a group (n hashes each) are split by a hash of their ids into blocks of bounded size, and the
    blocks of a large group over several keys.
    """
    sized = blocks.groupBy("group").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("parts"))
    sized = materialise(sized, "sized")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    packed = blocks.join(sized, "group").join(sets, "id").groupBy("group", part.alias("part")).agg(F.collect_list(F.struct("id", "s")).alias("block"))
    packed = materialise(packed.select("group", F.floor(F.col("part") / SPREAD).cast("int").alias("spread"), "block"), "blocks")
    spread = F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / SPREAD).cast("int"))).alias("spread")
    left = one.join(sized, "group").select("a", "group", spread).join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    joined = left.join(packed, ["group", "spread"]).select("a", "sa", "block")
    kind = joined.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for name, x, block in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                x, parts = np.frombuffer(x.as_buffer(), np.uint64), block.values.field("s").to_pylist()
                sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
                flat = np.frombuffer(b"".join(parts), np.uint64)
                at = np.searchsorted(x, flat)
                at[at == len(x)] = 0
                same = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for i in np.flatnonzero(100 * same >= percent * (len(x) + sizes - same)).tolist():
                    a.append(name.as_py())
                    b.append(block.values.field("id")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, batch.schema.field(0).type)], names=["a", "b"])

    return joined.mapInArrow(run, schema).where("a <> b")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, comp) after more links (a, b): the components that links join become one."""
    over = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    between = links.join(over[0], "a", "left").join(over[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connect(between)
    roots = merged.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
    moved = labels.join(roots, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return materialise(moved.unionByName(merged.join(labels.select("id"), "id", "left_anti")), "labels")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``df``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sketched = materialise(_sketch(docs, width, bands, rows), "sketch")
    # equal sets are one class, named by its smallest id
    classes = materialise(sketched.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    placed = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = materialise(placed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared")
    members = materialise(placed.join(shared, "key"), "members")
    wanted = members.select("id").distinct()
    sets = materialise(_sets(docs.join(wanted, "id", "left_semi"), width).distinct(), "sets")
    # the classes of one document that has several texts belong together
    several = sketched.where("fp is not null and id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("id")
    named = sketched.join(several, "id", "left_semi").select(F.col("id").alias("doc"), "fp").distinct().join(classes.select("fp", "id"), "fp").select("doc", "id")
    joint = named.join(named.groupBy("doc").agg(F.min("id").alias("a")), "doc").where("a <> id").select("a", F.col("id").alias("b"))

    labels, tried = None, None
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    for turn in range(rounds + 1):
        if labels is None:
            now = members.withColumn("comp", F.col("id"))
        else:
            now = members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            now = materialise(now, "labelled")
            split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            now = now.join(materialise(split, "split"), "key")
        if turn:
            now = materialise(now, "open")
            if now.isEmpty():
                break
        if turn < rounds:
            # one hub for each bucket, another in each round; only members of other components meet it
            order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            hubs = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))).alias("h"))
            pairs = now.join(materialise(hubs.select("key", "h.*"), "hubs"), "key").where((F.col("comp") != F.col("hub_comp")) & near(F.col("n"), F.col("hub_n")))
            pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        else:
            # the rest in full: members outside the main component of a bucket against all others
            main = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("x")).select("key", F.col("x.comp").alias("main"))
            main = materialise(main, "main")
            outside = materialise(now.join(main, "key").where("comp <> main").select("key", "id", "n", "main"), "outside")
            mains = outside.select("main").distinct()
            everyone = members.select("id", "n").distinct().join(labels, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("main"))
            first = _against_blocks(outside.select(F.col("id").alias("a"), F.col("main").alias("group")).distinct(), everyone.join(mains, "main", "left_semi").select(F.col("main").alias("group"), "id", "n"), sets, percent)
            crowded = materialise(outside.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "crowded")
            crowd = outside.join(crowded, "key").select(F.col("key").alias("group"), "id", "n")
            second = _against_blocks(crowd.select(F.col("id").alias("a"), "group"), crowd, sets, percent)
            links = materialise(first.unionByName(second).distinct(), "links")
            labels = _relabel(labels, links)
            break
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = _confirm(pairs, sets, percent)
        if turn == 0:
            links = links.unionByName(joint)
        labels = connect(links) if labels is None else _relabel(labels, links)

    named = classes.join(labels, "id", "left").select("fp", F.coalesce("comp", "id").alias("component_id"))
    out = sketched.select("id", "n", "fp").join(named, "fp", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), comp).alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: components of documents over two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
