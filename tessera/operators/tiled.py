"""Exact nearest vectors by tiled matrix products, laid out as a grid of cells.

Candidates and queries are packed into rows that hold a small matrix each. A cell meets a share of the candidate
tiles with a share of the query blocks: tiles are dealt to ``columns``, blocks to ``rows``, and each goes to every cell
of its own column or row. Both numbers come from the counts of vectors, so that the candidates of a cell
fit in memory and its work is bounded; Spark shuffles the cells, and a lost one is computed again alone. A
task keeps the best k of each query in a cell; the lists of the cells are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors and bytes in one packed matrix at most.
TILE_ROWS, TILE_BYTES = 1024, 2 << 20
#: Bytes of candidates in a column of cells, and products of vectors in a cell, on average at most.
COLUMN_BYTES, CELL_PRODUCTS = 32 << 20, 1 << 33
#: Cells whose lists are merged first, and query blocks whose lists a task holds.
FAN_IN, HELD_BLOCKS = 32, 64


def _matrix(vectors: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column, as rows; one matrix if they are equally long."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        return list(flat.reshape(len(sizes), -1))
    return np.split(flat, np.cumsum(sizes)[:-1])


def packed(df: DataFrame, prepare: Callable[[np.ndarray], np.ndarray] = np.asarray, most: int = TILE_ROWS) -> DataFrame:
    """(g, ids, m, width): rows (g, id, v array) packed by g, ``most`` to a row at most, sorted by id in each; shorter vectors are padded with zeros."""

    own = df.select("g", "id", "v")
    schema = T.StructType([own.schema["g"], T.StructField("ids", T.ArrayType(own.schema["id"].dataType)), T.StructField("m", T.BinaryType()), T.StructField("width", T.IntegerType())])

    def give(g, ids: list, rows: list, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        width, order = max(map(len, rows)), np.array(sorted(range(len(ids)), key=ids.__getitem__))
        m = np.zeros((len(rows), width))
        for i, j in enumerate(order.tolist()):
            m[i, : len(rows[j])] = rows[j]
        return pa.RecordBatch.from_arrays([pa.array([g], kinds[0]), pa.array([[ids[j] for j in order.tolist()]], pa.list_(kinds[1])), pa.array([prepare(m).tobytes()], pa.binary()), pa.array([width], pa.int32())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        total, kinds = 0, None
        for batch in batches:
            kinds = batch.column(0).type, batch.column(1).type
            for g, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2)), strict=True):
                ids, rows = held.setdefault(g, ([], []))
                ids.append(i)
                rows.append(v)
                total += v.nbytes
                if len(ids) >= most or len(ids) * max(8, v.nbytes) >= TILE_BYTES:
                    total -= sum(x.nbytes for x in rows)
                    yield give(g, *held.pop(g), kinds)
                elif total > 16 * TILE_BYTES:  # many groups at once
                    yield from (give(k, *x, kinds) for k, x in held.items())
                    held, total = {}, 0
        yield from (give(k, *x, kinds) for k, x in held.items())

    return own.mapInArrow(run, schema)


def grid(n_candidates: int, n_queries: int, width: int, parallelism: int) -> tuple[int, int]:
    """Columns and rows of the grid."""
    columns = max(1, -(-n_candidates * width * 8 // COLUMN_BYTES), min(parallelism, -(-n_candidates // TILE_ROWS)))
    rows = max(1, -(-n_candidates * n_queries // (columns * CELL_PRODUCTS)))
    return columns, min(rows, max(1, -(-n_queries // TILE_ROWS)))


class Running:
    """The best k (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, kind: type):
        self.queries, self.k, self.kind = ids, k, None
        self.none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.ids, self.scores = np.full((len(ids), k), 0 if ids.dtype != object else "", ids.dtype), np.full((len(ids), k), self.none, kind)

    def add(self, scores: np.ndarray, ids: np.ndarray, itself: bool = False) -> None:
        """One tile: scores (queries, n) of candidates that are sorted by id. Partial selection, then a merge."""
        if not itself:
            at = np.searchsorted(ids, self.queries)
            own = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == self.queries)
            for q in own.tolist():  # its id may be there more than once
                scores[q, at[q] : np.searchsorted(ids, self.queries[q], side="right")] = self.none
        rows = np.flatnonzero(scores.max(1) >= self.scores[:, -1])  # other queries gain nothing here
        if not len(rows):
            return
        part, at = scores[rows], np.arange(len(rows))
        best_s, best_i = [self.scores[rows]], [self.ids[rows]]
        for _ in range(min(self.k, part.shape[1])):  # the first of equals is the smallest id
            j = part.argmax(1)
            best_s.append(part[at, j][:, None])
            best_i.append(ids[j][:, None])
            part[at, j] = self.none
        s, i = np.concatenate(best_s, 1), np.concatenate(best_i, 1)
        place = i if i.dtype != object else np.unique(i, return_inverse=True)[1].reshape(i.shape)
        order = np.lexsort((place, ~s if s.dtype == np.int64 else -s), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type = np.float64, prepare: Callable[[np.ndarray], np.ndarray] = np.asarray, block: int = TILE_ROWS, itself: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (g, id, v) of each query (g, id, v) with the same g, without ``itself``.

    ``score`` gives the scores (queries, candidates) of two matrices as ``kind``, ``prepare`` what is done to a matrix first;
    ties go to the smaller id. A query id comes once in all; ``block`` queries at most meet a tile together.
    """
    spark = candidates.sparkSession
    n_candidates = candidates.count()
    n_queries, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    columns, rows = grid(n_candidates, n_queries, max(1, width or 1), spark.sparkContext.defaultParallelism)
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    few = max(1, -(-n_queries // block))
    asked = packed(queries.repartition(min(few, 10_000), F.xxhash64("id") % few), prepare, block)
    left = asked.select("g", deal(rows).alias("r"), F.xxhash64("ids").alias("b"), F.col("ids").alias("q_ids"), F.col("m").alias("q"), F.col("width").alias("q_width"), every(columns).alias("c"))
    right = packed(candidates, prepare).select("g", deal(columns).alias("c"), "ids", "m", "width", every(rows).alias("r"))
    cells = left.join(right, ["g", "c", "r"]).select("c", "b", "q_ids", "q", "q_width", "ids", "m", "width")
    sql = T.LongType() if kind is np.int64 else T.DoubleType()
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("vec_id", candidates.schema["id"].dataType), T.StructField("score", sql), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(key: tuple[int, int], best: Running) -> pa.RecordBatch:
            full = best.scores > best.none
            n = full.sum(1)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.queries, n), best.kind), pa.array(best.ids[full], best.kind), pa.array(best.scores[full]), pa.array(np.full(n.sum(), key[0], np.int32))], names=schema.names)

        def array(x: pa.Scalar, width: int) -> np.ndarray:
            return np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width)

        held: dict[tuple[int, int], Running] = {}
        for batch in batches:
            kind_of_id = batch.schema.field("q_ids").type.value_type
            for c, b, q_ids, q, q_width, ids, m, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5), batch.column(6), batch.column(7).to_pylist(), strict=True):
                best = held.get((c, b))
                if best is None:
                    if len(held) >= HELD_BLOCKS:
                        oldest = next(iter(held))
                        yield lists(oldest, held.pop(oldest))
                    best = held[c, b] = Running(q_ids.values.to_numpy(zero_copy_only=False), k, kind)
                    best.kind = kind_of_id
                x, y = array(q, q_width), array(m, w)
                if q_width != w:
                    x, y = (np.pad(z, ((0, 0), (0, max(q_width, w) - z.shape[1]))) for z in (x, y))
                best.add(score(x, y), ids.values.to_numpy(zero_copy_only=False), itself)
        for key, best in held.items():
            yield lists(key, best)

    order = [F.desc("score"), F.col("vec_id")]
    found = cells.mapInArrow(run, schema)
    near = Window.partitionBy("query_id", (F.col("cell") / FAN_IN).cast("int")).orderBy(*order)
    merged = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
