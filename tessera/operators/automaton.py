"""Places of many surfaces in texts, by one multi-pattern automaton and a single pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the surfaces in one automaton (about 60 bytes of memory each), and automata that texts are run through, at most.
BLOCK_CHARS, MOST_BLOCKS = 1_000_000, 8
#: Texts that are handled at once.
_ROWS = 64
#: The automaton that this worker built last, by its broadcast.
_BUILT: dict[int, ahocorasick.Automaton] = {}


def blocks(surfaces: DataFrame, column: str = "surface", block_chars: int = BLOCK_CHARS, most: int = MOST_BLOCKS) -> list[Broadcast] | None:
    """The distinct surfaces as broadcast blocks of ``block_chars`` characters, counted first; None if that would be more than ``most`` blocks."""
    named = surfaces.select(F.col(column).alias("surface")).where("surface <> ''").distinct()
    size = named.agg(F.coalesce(F.sum(F.length("surface").cast("long")), F.lit(0)).alias("chars")).first().chars
    if size > block_chars * most:
        return None
    out: list[list[str]] = [[]]
    room = block_chars
    for s in sorted(named.toArrow().column(0).to_pylist()):  # within the bound
        if len(s) > room and out[-1]:
            out.append([])
            room = block_chars
        out[-1].append(s)
        room -= len(s)
    return [surfaces.sparkSession.sparkContext.broadcast(b) for b in out if b]


def _automaton(block: Broadcast) -> ahocorasick.Automaton:
    """One for each worker and block; the one before is let go."""
    key = block._jbroadcast.id() if block._jbroadcast is not None else block._path  # in a task only the path is there
    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for s in block.value:
            built.add_word(s, s)
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def occurrences(texts: DataFrame, found_in: list[Broadcast], starts: bool = True) -> DataFrame:
    """(id, surface, starts): each surface of the blocks that a text (id, text) holds, with all its places, overlapping ones too; no row for others.

    Texts go once through each block's automaton, whatever it holds. Without ``starts`` only the first place found is given.
    """
    own = texts.select("id", "text")
    out = T.StructType([own.schema["id"], T.StructField("surface", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType()))])
    if not found_in:
        return own.select("id", F.lit("").alias("surface"), F.array().cast("array<int>").alias("starts")).where("false")

    def through(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block)
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    rows, surfaces, places = [], [], []
                    for k, text in enumerate(part.column(1).to_pylist()):
                        found: dict[str, list[int]] = {}
                        for end, surface in automaton.iter(text) if text else ():
                            if starts or surface not in found:
                                found.setdefault(surface, []).append(end + 1 - len(surface))
                        rows += [k] * len(found)
                        surfaces += found.keys()
                        places += found.values()
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(surfaces, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=out.names)

        return own.mapInArrow(run, out)

    return reduce(DataFrame.unionByName, map(through, found_in))
