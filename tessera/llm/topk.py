"""Exact top-k inner-product search by tiled matrix products.

Components become the integers floor(256 x). Queries are packed into blocks and candidates into tiles, and both are dealt to
the cells of a grid (``tessera.operators.tiled``); a task multiplies blocks with tiles, keeps the best k of each query by
partial selection per tile, and merges tile after tile into one running list per query. The lists of the
cells are then merged in a tree: first within groups of cells, then over the groups. Nothing goes
through the driver but the counts.

Defined results: vectors that are null or hold null or non-finite components take no part, as
query or candidate; an empty vector counts as zeros; ids that are null take no part; rows that repeat a query's id are
one query (its least vector), and no candidate with the query's own id is returned; repeated candidates each count;
ties go to the smaller id; fewer candidates than k are all returned; shorter vectors count as padded with zeros;
products beyond 64 bits are clipped to them; extra columns are dropped; no query gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.operators import tiled

_NONE = np.iinfo(np.int64).min


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def quantise(m: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component."""
    return np.floor(256.0 * m)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products (queries, candidates): by floats where 53 bits hold them, else by integers of any size."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = tiled.TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product."""
    cand = _usable(candidates, id_col, vec_col)
    asked = _usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    one = lambda df: df.select(F.lit(0).alias("g"), "id", "v")
    return tiled.top_k(one(cand), one(asked), k, product, np.int64, quantise, block_queries)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the 5 best of every 50th vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CASE WHEN least(len(a.q), len(b.q)) = 0 THEN 0 ELSE CAST(list_inner_product(a.q, b.q) AS BIGINT) END AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
