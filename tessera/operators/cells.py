"""Exact vector search that skips cells: rows by their nearest centre, and the triangle inequality for what a cell can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import tiled
from tessera.operators.search import _unit_rows, _units, top_k
from tessera.sources.tables import materialise

#: Rows that centres are fitted on, and centres, at most; rounds of fitting; cells of a query that are searched before its threshold is known.
SAMPLE_ROWS, MOST_CELLS, ROUNDS, FIRST_CELLS = 20_000, 256, 8, 2
#: Similarities are rounded to 6 places, and bounds are computed in doubles.
_SLACK = 2e-6


def fit_centres(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors: a few rounds of k-means from rows far from each other."""
    picked = [0]
    far = np.full(len(rows), np.inf)
    for _ in range(min(cells, len(rows)) - 1):
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(1))
        picked.append(int(far.argmax()))
    centres = rows[picked].copy()
    for _ in range(rounds):
        own = (rows @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in np.unique(own):
            centres[c] = rows[own == c].mean(0)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors of one width, shorter ones padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(tiled._matrix(column)):
        out[i, : len(v)] = v[:width]
    return _units(out)


def build_cells(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows (g, id, v), centres, radii): every usable row with the cell of its nearest centre, and how far a cell reaches.

    Centres come from a sample of SAMPLE_ROWS rows at most, picked by the hash of the id; as many as the root of the row count, MOST_CELLS at most. All rows
    are assigned, so the centres decide the speed only.
    """
    rows = _unit_rows(vectors, F.lit(0), id_col, vec_col).select("id", "v")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 62)).cast("double") < min(1.0, SAMPLE_ROWS / 2 / max(1, n)) * float(1 << 62)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    sample = picked.toArrow().column(1).combine_chunks() if n else None
    count = cells or min(MOST_CELLS, max(1, int(n**0.5)))
    centres = fit_centres(_matrix(sample, width), count) if sample is not None and len(sample) else np.zeros((1, width))
    out = T.StructType([T.StructField("g", T.IntegerType()), rows.schema["id"], rows.schema["v"], T.StructField("far", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = _matrix(part.column(1), width)
                own = (m @ centres.T - (centres**2).sum(1) / 2).argmax(1)
                far = np.sqrt(((m - centres[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column(0), part.column(1), pa.array(far)], names=out.names)

    dealt = materialise(rows.mapInArrow(run, out), "cells")
    radii = np.full(len(centres), -1.0)  # of a cell without rows
    for r in dealt.groupBy("g").agg(F.max("far").alias("far")).collect():  # as many as centres at most
        radii[r.g] = r.far
    return dealt.select("g", "id", "v"), centres, radii


def pruned_top_k(index: tuple[DataFrame, np.ndarray, np.ndarray], queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", first: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(ranks (qid, id, sim, rank), cells (qid, cells, searched)): the rows of ``search.vector_top_k``, and how many of the cells were searched.

    A row of a cell is at least as far from a query as the cell's centre less the cell's radius. The nearest ``first`` cells are searched, and their k-th best
    similarity is a threshold: cells that are too far for it are skipped.
    """
    rows, centres, radii = index
    width = centres.shape[1]
    asked = _unit_rows(queries, F.lit(0), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    out = T.StructType([asked.schema["id"], asked.schema["v"], T.StructField("cells", T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("turn", T.IntegerType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.flatnonzero(radii >= 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = _matrix(part.column(1), width)
                away = np.sqrt(np.maximum(((m[:, None, :] - centres[None, live, :]) ** 2).sum(2), 0)) if len(live) else np.zeros((len(m), 0))
                near = np.maximum(away - radii[live], 0.0)
                # unit vectors: the similarity is 1 - distance^2 / 2; one of zeros is alike to all by 0, and at distance 1
                bound = np.where((m == 0).all(1, keepdims=True), 0.0, np.maximum(1.0 - near**2 / 2, 0.0))
                order = np.argsort(away, 1, kind="stable")
                turn = np.argsort(order, 1)
                lists = [[{"g": int(g), "bound": float(b), "turn": int(t)} for g, b, t in zip(live, bound[i], turn[i], strict=True)] for i in range(len(m))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.struct([("g", pa.int32()), ("bound", pa.float64()), ("turn", pa.int32())])))], names=out.names)

    planned = materialise(asked.mapInArrow(run, out), "planned").select("id", "v", F.inline("cells"))
    score = lambda q, c: (q @ c.T).round(6)

    def searched(chosen: DataFrame) -> DataFrame:
        found = tiled.top_k(rows, chosen.select("g", "id", "v"), k, score, prepare=_units)
        return found.select(F.col("query_id").alias("qid"), F.col("vec_id").alias("id"), F.col("score").alias("sim"))

    begun = planned.where(F.col("turn") < first)
    early = materialise(searched(begun), "early")
    least = early.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where(F.col("n") >= k)
    rest = planned.where(F.col("turn") >= first).join(least.select(F.col("qid").alias("id"), "least"), "id", "left")
    more = materialise(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)).select("g", "id", "v"), "more")
    both = early.unionByName(searched(more)) if more.limit(1).count() else early
    ranks = top_k(both, ["qid"], [F.desc("sim"), F.col("id")], k)
    used = begun.select("id").unionByName(more.select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("searched"))
    return ranks, planned.groupBy("id").agg(F.count(F.lit(1)).alias("cells")).join(used, "id").select(F.col("id").alias("qid"), "cells", "searched")
