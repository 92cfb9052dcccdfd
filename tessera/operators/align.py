"""Entity alignment: staged joins of surfaces to canonical entities, and the edges between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as TX


def group_surfaces(mentions: DataFrame) -> DataFrame:
    """(surface, label, raws, n): mentions by cleaned surface and label."""
    return mentions.groupBy(TX.clean_surface(F.col("surface")).alias("surface"), "label").agg(F.array_sort(F.collect_set("surface")).alias("raws"), F.count(F.lit(1)).alias("n"))


def by_alias(surfaces: DataFrame, aliases: DataFrame, same_label: bool = False) -> DataFrame:
    """(surface, label, entity_id, label_mismatch): the first owner of an equal alias (surface, entity_id, label, ord).

    The label is not asked for unless ``same_label``; a different one is flagged.
    """
    a = aliases.select(TX.clean_surface(F.col("surface")).alias("surface"), "entity_id", F.col("label").alias("owner_label"), "ord")
    hit = surfaces.select("surface", "label").join(a, "surface")
    if same_label:
        hit = hit.where("label = owner_label")
    w = Window.partitionBy("surface", "label").orderBy("ord", "entity_id")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("surface", "label", "entity_id", (F.col("label") != F.col("owner_label")).alias("label_mismatch"))


def by_suffix(surfaces: DataFrame, names: DataFrame, least: int = 8) -> DataFrame:
    """(surface, label, entity_id): surfaces of ``least`` characters or more that end exactly one name (name, label, entity_id).

    An equi-join on the suffixes of the names, not a comparison of all pairs.
    """
    tails = names.select("entity_id", "label", "name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - least + 1, F.lit(1))), lambda i: F.substring("name", i, F.length("name")))).alias("surface")).where(F.length("surface") >= least)
    owners = tails.groupBy("surface", "label").agg(F.count_distinct("name").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1")
    return surfaces.select("surface", "label").join(owners, ["surface", "label"]).select("surface", "label", "entity_id")


def by_confusion(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surface, label, entity_id): surfaces that one known confusion, put right throughout, turns into an alias of the same label."""
    tries = surfaces.select("surface", "label", F.posexplode(TX.typo_repairs(F.col("surface"))).alias("turn", "fixed"))
    hit = tries.join(aliases.select(F.col("surface").alias("fixed"), "label", "entity_id", "ord"), ["fixed", "label"])
    w = Window.partitionBy("surface", "label").orderBy("turn", "ord", "entity_id")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("surface", "label", "entity_id")


def by_one_edit(surfaces: DataFrame, names: DataFrame, longest: int = 12) -> DataFrame:
    """(surface, label, entity_id): short surfaces exactly one edit from a name of the same label; of several, the least id.

    Blocked by deletion neighbourhoods: strings one edit apart share a string with one character less.
    """
    s = surfaces.where(F.length("surface") <= longest).select("surface", "label", F.explode(TX.deletion_keys(F.col("surface"))).alias("key"))
    n = names.where(F.length("name") <= longest + 1).select("name", "label", "entity_id", F.explode(TX.deletion_keys(F.col("name"))).alias("key"))
    hit = s.join(n, ["label", "key"]).where(TX.one_edit(F.col("surface"), F.col("name"), longest))
    return hit.groupBy("surface", "label").agg(F.min("entity_id").alias("entity_id"))


def by_similarity(scores: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(surface, label, scope, entity_id, sim, margin): best candidate within a scope, if good enough and clear enough.

    ``scores`` (surface, label, scope, entity_id, sim); ``rules`` give the least score and the least margin
    to the runner-up by label.
    """
    w = Window.partitionBy("surface", "label", "scope").orderBy(F.desc("sim"), "entity_id")
    best = scores.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("sim").over(w)).where("_r = 1")
    margin = F.when(F.col("_next").isNull(), F.col("sim")).otherwise(F.col("sim") - F.col("_next"))
    ok = reduce(lambda acc, kv: F.when(F.col("label") == kv[0], (F.col("sim") >= kv[1][0]) & (margin >= kv[1][1])).otherwise(acc), rules.items(), F.lit(False))
    return best.withColumn("margin", F.round(margin, 6)).where(ok).select("surface", "label", "scope", "entity_id", "sim", "margin")


def accept_global(scores: DataFrame, least: float = 0.82) -> DataFrame:
    """Global candidates (…, sim, surface_product, entity_product) above the threshold whose products agree.

    They agree if neither has one, both have the same, or only the surface has one.
    """
    agree = F.col("entity_product").isNull() | F.col("entity_product").eqNullSafe(F.col("surface_product"))
    return scores.where((F.col("sim") >= least) & agree)


def cascade(surfaces: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(surface, label, entity_id, method): the first stage (surface, label, entity_id) that has an answer; else a new entity."""
    out = surfaces.select("surface", "label")
    for k, (_, hits) in enumerate(stages):
        out = out.join(hits.select("surface", "label", F.col("entity_id").cast("string").alias(f"e{k}")), ["surface", "label"], "left")
    method = F.coalesce(*(F.when(F.col(f"e{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(stages)), F.lit("new"))
    entity = F.coalesce(*(F.col(f"e{k}") for k in range(len(stages))), TX.new_entity_id(F.col("label"), F.col("surface")))
    return out.select("surface", "label", entity.alias("entity_id"), method.alias("method"))


def roll_up(aligned: DataFrame, grouped: DataFrame) -> DataFrame:
    """(entity_id, label, surfaces, n_surfaces, n_mentions, method): one row for each entity.

    ``n_surfaces`` counts distinct spellings, ``n_mentions`` mentions; the method is that of the first surface.
    """
    full = aligned.join(grouped, ["surface", "label"])
    spellings = F.array_sort(F.array_distinct(F.flatten(F.collect_list("raws"))))
    return full.groupBy("entity_id").agg(F.min_by("label", "surface").alias("label"), spellings.alias("surfaces"), F.size(spellings).cast("long").alias("n_surfaces"), F.sum("n").alias("n_mentions"), F.min_by("method", "surface").alias("method"))


def resolve_edges(triples: DataFrame, mapping: DataFrame, doc_product: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (head_id, rel, tail_id, doc_id, ord) of triples (doc_id, head, rel, tail, ord), and the triples dropped.

    ``mapping``: (surface, product, entity_id), product null for the global one. A document with a product
    takes that product's mapping or else the global one; a document without takes all of them.
    """

    def ends(col: str) -> DataFrame:
        t = triples.select("doc_id", "ord", F.col(col).alias("surface")).join(doc_product, "doc_id", "left")
        m = mapping.select("surface", F.col("product").alias("mp"), "entity_id")
        hit = t.join(m, "surface")
        own = hit.where(F.col("product").isNotNull() & (F.col("mp").isNull() | (F.col("mp") == F.col("product"))))
        w = Window.partitionBy("doc_id", "ord").orderBy(F.col("mp").isNull().cast("int"), "entity_id")
        one = own.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "ord", "entity_id")
        many = hit.where("product is null").select("doc_id", "ord", "entity_id").distinct()
        return one.unionByName(many).withColumnRenamed("entity_id", f"{col}_id")

    full = triples.join(ends("head"), ["doc_id", "ord"]).join(ends("tail"), ["doc_id", "ord"])
    dropped = triples.join(full.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    return full.where("head_id <> tail_id").select("head_id", "rel", "tail_id", "doc_id", "ord"), dropped


def first_edges(edges: DataFrame) -> DataFrame:
    """(head_id, rel, tail_id, doc_id): once each, with the first document."""
    return edges.groupBy("head_id", "rel", "tail_id").agg(F.min_by("doc_id", F.struct("ord", "doc_id")).alias("doc_id"))


def audit(aligned: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, share of new ones, share without edge (4 places), and counts by method."""
    ends = edges.select(F.explode(F.array("head_id", "tail_id")).alias("entity_id")).distinct().withColumn("linked", F.lit(1))
    per = aligned.groupBy("entity_id").agg(F.min("method").alias("method")).join(ends, "entity_id", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return per.agg(F.count(F.lit(1)).alias("entities"), share(F.col("method") == "new").alias("new_rate"), share(F.col("linked").isNull()).alias("orphan_rate"), *(F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("alias", "suffix", "edit", "new")))
