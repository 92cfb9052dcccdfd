"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast to all
tasks: words of a bounded sample, most frequent first, as one joined text and one byte string.
Tier two is a bounded cache in each worker; its misses are encoded in bulk. No pre-token is ever
shuffled. The tables decide the speed only: every word of every text is counted exactly.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
other columns are dropped, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordbpe
from tessera.llm.bpe import default_file
from tessera.llm.common import portions, table

#: Entries of the broadcast table at most, and rows (on average) of the sample that it is taken from.
TABLE_WORDS, SAMPLE_ROWS = 40_000, 600
#: Distinct words that a worker remembers; when full, the memory starts anew.
CACHE_WORDS = 50_000
#: Longest word that the broadcast table holds, so that its size has a bound.
LONGEST = 40


def frequent_words(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS, sample_rows: int = SAMPLE_ROWS) -> tuple[str, bytes]:
    """The broadcast tier: frequent words of about ``sample_rows`` rows, joined by spaces, and a length byte each.

    Rows are drawn one by one with a fixed seed, whatever their ids and texts. The few that are drawn go to one
    task, which counts their words and returns ``table_words`` of them at most.
    """
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).sample(share, seed=11).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = wordbpe.load(file), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in model.words(text) if len(w) <= LONGEST and w[0] != " ")
        top = seen.most_common(table_words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    found = [(r.word, r.n) for r in sample.mapInArrow(run, "word string, n long").collect()]
    words = [w for w, _ in sorted(found, key=lambda x: (-x[1], x[0]))]
    _, counts = wordbpe.load(file).encode_words(words)
    kept = [(w, c) for w, c in zip(words, counts.tolist(), strict=True) if c < 256]
    return " ".join(w for w, _ in kept), bytes(c for _, c in kept)


def count_tokens(df: DataFrame, file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): bytes and tokens of every whole text."""
    spark = df.sparkSession
    tier = spark.sparkContext.broadcast(frequent_words(df, file, id_col, text_col))
    own = df.select(F.col(id_col), F.col(text_col))
    mid = T.StructType([own.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = wordbpe.load(file)
        words, lengths = tier.value
        frequent = dict(zip(words.split(" "), lengths, strict=False)) if words else {}
        known = dict(frequent)
        for batch in batches:
            for part in portions(batch, 1):
                split = [model.words(t) if t else [] for t in part.column(1).to_pylist()]
                if len(known) > cache_words + len(frequent):
                    known = dict(frequent)
                new = [w for w in set().union(*split) if w not in known]
                for w in new:
                    if w[0] == " ":
                        known[w] = 1
                new = [w for w in new if w[0] != " "]
                _, counts = model.encode_words(new)
                known.update(zip(new, counts.tolist(), strict=True))
                get = known.__getitem__
                n_tokens = np.array([sum(map(get, ws)) for ws in split], np.int64)
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n_tokens)], names=mid.names)

    return own.mapInArrow(run, mid).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: byte and token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), default_file(), limit=2048)
