"""Connected components over a distributed edge table: hook every root to its smallest neighbour, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _flatten(hooks: DataFrame) -> DataFrame:
    """(r, g) with g smaller than r: follow g until it is hooked no further. Doubles its reach each turn."""
    while True:
        inner = hooks.select(F.col("r").alias("g"), F.col("g").alias("g2"))
        deeper = materialise(hooks.join(inner, "g", "left").select("r", F.coalesce("g2", "g").alias("g"), F.col("g2").isNotNull().alias("moved")), "hooks")
        hooks = deeper.select("r", "g")
        if deeper.where("moved").isEmpty():
            return hooks


def connect(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from every id that has an edge, for edges (a, b).

    Each turn hooks every root that has a smaller neighbour to the smallest one, flattens the
    chains of hooks, and keeps the edges between different roots only. A root stays only if it is smaller than all
    its neighbours, so of every two joined roots the larger one goes in each turn, and the turns end; no better bound is
    claimed for all graphs. A star whose centre is its smallest id takes one turn, one whose centre is the largest two.
    """
    labels = None
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        hooks = _flatten(materialise(edges.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("g")), "hooks"))
        if labels is None:
            labels = hooks.select(F.col("r").alias("id"), F.col("g").alias("comp"))
        else:
            moved = labels.join(hooks, labels.comp == hooks.r, "left").select("id", F.coalesce("g", "comp").alias("comp"))
            labels = moved.unionByName(hooks.join(labels.select(F.col("id").alias("r")), "r", "left_anti").select(F.col("r").alias("id"), F.col("g").alias("comp")))
        labels = materialise(labels, "labels")
        left, right = hooks.select(F.col("r").alias("a"), F.col("g").alias("ga")), hooks.select(F.col("r").alias("b"), F.col("g").alias("gb"))
        edges = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")).where("a <> b")
        edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
