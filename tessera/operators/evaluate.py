"""Evaluation: precision, recall, F1, hit rate, reciprocal rank, coverage, accuracy and ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """Precision, recall and F1; a zero denominator gives zero."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), digits).alias("f1")]


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., tp, fp, fn, precision, recall, f1) of two sets of rows, compared by ``keys``; micro over ``by``."""
    by = by or []
    cols = [*by, *keys]
    both = predicted.select(cols).distinct().withColumn("p", F.lit(1)).join(gold.select(cols).distinct().withColumn("g", F.lit(1)), cols, "full")
    counts = both.groupBy(*by).agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return counts.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def extraction_scores(entities: DataFrame, gold_entities: DataFrame, relations: DataFrame, gold_relations: DataFrame) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1): entities (doc_id, id) micro over documents, relations (head, rel, tail) over the corpus."""
    e = set_scores(entities, gold_entities, ["doc_id", "id"]).select(F.lit("entity").alias("kind"), "*")
    return e.unionByName(set_scores(relations, gold_relations, ["head", "rel", "tail"]).select(F.lit("relation").alias("kind"), "*"))


def trace_stats(traces: DataFrame, linked, methods: dict) -> DataFrame:
    """One row: traces, those that are linked, and the count of each link method (name to condition)."""
    return traces.agg(F.count(F.lit(1)).alias("n"), F.count_if(linked).alias("linked"), *(F.count_if(c).alias(name) for name, c in methods.items()))


def with_answers(traces: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Traces beside their answers, by question; either without the other drops out."""
    return traces.join(answers, keys)


def retrieval_scores(ranked: DataFrame, gold: DataFrame, by: list[str] | None = None, cut: int = 3, wide: int = 10) -> DataFrame:
    """Hit rate and reciprocal rank within ``cut``, and gold coverage within ``cut``, ``wide`` and overall.

    ``ranked``: (by..., qid, id, pos); ``gold``: (qid, id). Questions without gold are left out. ``by`` are
    columns of ``ranked`` such as the channel; every question counts for each of their values.
    """
    by = by or []
    n_gold = gold.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    groups = ranked.select(by).distinct() if by else None
    frame = n_gold if groups is None else n_gold.join(F.broadcast(groups), how="cross")
    found = ranked.join(gold.distinct(), ["qid", "id"], "left_semi").groupBy(*by, "qid").agg(
        F.min("pos").alias("first"), F.count_if(F.col("pos") <= cut).alias("c"), F.count_if(F.col("pos") <= wide).alias("w"), F.count(F.lit(1)).alias("a"))
    each = frame.join(found, [*by, "qid"], "left").fillna(0, ["c", "w", "a"])
    hit = F.col("first") <= cut
    mean = lambda c: F.round(F.avg(c), 4)
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mean(F.when(hit, 1.0).otherwise(0.0)).alias(f"hit_at_{cut}"), mean(F.when(hit, 1.0 / F.col("first")).otherwise(0.0)).alias(f"mrr_at_{cut}"),
        mean(F.col("c") / F.col("n_gold")).alias(f"coverage_at_{cut}"), mean(F.col("w") / F.col("n_gold")).alias(f"coverage_at_{wide}"), mean(F.col("a") / F.col("n_gold")).alias("coverage_all"))


def list_correct(answers: Column, gold: Column, recall: float = 0.7, precision: float = 0.5) -> Column:
    """Recall and precision of a list of answers are high enough; an empty list is not."""
    a, g = F.array_distinct(answers), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, g))
    return F.when((F.size(a) == 0) | (F.size(g) == 0), F.lit(False)).otherwise((both / F.size(g) >= recall) & (both / F.size(a) >= precision))


def number_correct(predicted: Column, gold: Column, tolerance: int = 1) -> Column:
    return F.coalesce(F.abs(predicted - gold) <= tolerance, F.lit(False))


def accuracy(df: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(ok).cast("double")), 4).alias("accuracy"))


def ablation(scores: DataFrame, channel: str, on: str, off: str, metrics: list[str], by: list[str]) -> DataFrame:
    """Stored scores of two channels side by side: (by..., metric_on, metric_off, metric_gain)."""
    picked = [F.max(F.when(F.col(channel) == c, F.col(m))).alias(f"{m}_{k}") for m in metrics for k, c in (("on", on), ("off", off))]
    wide = scores.groupBy(*by).agg(*picked)
    return wide.select(*wide.columns, *(F.round(F.col(f"{m}_on") - F.col(f"{m}_off"), 4).alias(f"{m}_gain") for m in metrics))


def per_question(df: DataFrame, channels: list[str], value: str = "hit") -> DataFrame:
    """One row for each question, one 0/1 column for each channel."""
    return df.groupBy("qid").agg(*(F.coalesce(F.max(F.when(F.col("channel") == c, F.col(value).cast("int"))), F.lit(0)).alias(f"{c}_{value}") for c in channels))
