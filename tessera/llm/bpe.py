"""BPE encoding and decoding: speculate with greedy longest match, verify pairs, merge only failures exactly.

Defined results: a null text encodes as the empty text (no ids); null ids decode to the empty text;
repeated rows give repeated results; columns other than the id and the input are dropped, so names
cannot clash; an empty table gives an empty result. Every text is encoded whole. The work is one
narrow map over the rows, so no key or source can be hot, and a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordbpe
from tessera.llm.common import portions, table

#: Bytes of text that are encoded together; their distinct words are looked up in one go.
SLICE_BYTES = 2 << 20
#: Distinct words that a worker remembers; when full, the memory starts anew.
CACHE_WORDS = 300_000


class Encoder:
    """Encodes texts in bulk with a bounded cache from word to packed ids."""

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        self.model, self.limit = wordbpe.load(file), cache_words
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers. ``texts`` are worked on together."""
        split = [self.model.words(t) if t else [] for t in texts]
        if len(self.cache) > self.limit:
            self.cache = {}
        new = [w for w in set().union(*split) if w not in self.cache]
        special = [w for w in new if w[0] == " "]
        for w in special:
            self.cache[w] = self.model.special[w[1:]].to_bytes(4, "little")
        if special:
            new = [w for w in new if w[0] != " "]
        ids, counts = self.model.encode_words(new)
        packed, stops = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        at = 0
        for w, stop in zip(new, stops, strict=True):
            self.cache[w] = packed[at:stop]
            at = stop
        get = self.cache.__getitem__
        for words in split:
            yield b"".join(map(get, words))


class Decoder:
    """Decodes packed ids: the token strings, special ones included, joined by a space."""

    def __init__(self, file: str):
        strings = wordbpe.load(file).strings
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    def decode(self, ids: bytes | None) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else ""


def _mapped(df: DataFrame, id_col: str, in_col: str, schema: list[tuple[str, T.DataType]], work) -> DataFrame:
    """Run ``work(list of inputs) -> list of columns`` over Arrow batches, carrying the id column along."""
    own = df.select(F.col(id_col), F.col(in_col))
    out = T.StructType([own.schema[0], *(T.StructField(n, t) for n, t in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in portions(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *step(part.column(1).to_pylist())], names=out.names)

    return own.mapInArrow(run, out)


def encode(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): every whole text as the library encodes it without added special tokens."""

    def work():
        encoder = Encoder(file)

        def step(texts):
            ids = list(encoder.encode(texts))
            return pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())

        return step

    return _mapped(df, id_col, text_col, [("n_tokens", T.LongType()), ("ids", T.BinaryType())], work)


def decode(df: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string): ids as ``encode`` gives them, back to text as the library decodes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(file)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(decoder.decode, part.column(1).to_pylist()), pa.string())], names=out.names)

    own = df.select(F.col(id_col), F.col(ids_col))
    out = T.StructType([own.schema[0], T.StructField("decoded", T.StringType())])
    return own.mapInArrow(run, out)


def round_trip(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping only digests of both."""

    def work():
        encoder, decoder = Encoder(file), Decoder(file)

        def step(texts):
            n, a, b = [], [], []
            for ids in encoder.encode(texts):
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(decoder.decode(ids).encode("utf-8")).hexdigest())
            return pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())

        return step

    return _mapped(df, id_col, text_col, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], work)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: digests of the ids and of the decoded text of every document."""
    return round_trip(table(spark, sf_dir, "documents"), default_file())
