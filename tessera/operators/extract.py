"""Dictionary and rule extraction of mentions and relations."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.operators import automaton
from tessera.operators.chunk import placed
from tessera.operators.search import substring_join_by_token

# fixed values: share of aliases that the dictionary keeps by label, share of triples that a rule keeps by relation
ALIAS_RATES = {"Device": 0.98, "Process": 0.98, "Defect": 0.98, "Material": 0.85, "Cause": 0.82, "Countermeasure": 0.82}
RELATION_RATES = {
    "CAUSED_BY": 1.00, "ADDRESSED_BY": 0.98, "OCCURS_AT": 1.00, "USED_IN": 0.97, "TARGETS": 0.93,
    "INDUCED_BY_MATERIAL": 0.92, "USES_MATERIAL": 0.92, "PRECEDES": 0.90, "SUBCLASS_OF": 0.85,
}
OTHER_RATE = 0.85


def _rate(key: Column, rates: dict[str, float]) -> Column:
    return reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(acc), rates.items(), F.lit(OTHER_RATE))


def gazetteer(entities: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """(surface, id, label, ord): names and kept aliases of entities (id, label, name, aliases, ord).

    A surface belongs to the last entity of that name, else to the first that has it as an alias.
    """
    rates = ALIAS_RATES if rates is None else rates
    names = entities.select(F.col("name").alias("surface"), "id", "label", (-F.col("ord")).alias("o"), F.lit(0).alias("kind"), "ord")
    alias = entities.select(F.explode("aliases").alias("surface"), "id", "label", F.col("ord").alias("o"), F.lit(1).alias("kind"), "ord")
    alias = alias.where(TX.stable_keep(F.concat("id", F.lit("|"), "surface"), _rate(F.col("label"), rates)))
    w = Window.partitionBy("surface").orderBy("kind", "o", "id")
    return names.unionByName(alias).withColumn("r", F.row_number().over(w)).where("r = 1").select("surface", "id", "label", "ord")


def _free_spans(spans: list[dict]) -> list[dict]:
    """Greedy choice of spans that do not overlap, from spans in order of preference."""
    starts, ends, out = [], [], []
    for x in spans:
        k = bisect_right(starts, x["start"])
        if (k == 0 or ends[k - 1] <= x["start"]) and (k == len(starts) or starts[k] >= x["end"]):
            starts.insert(k, x["start"])
            ends.insert(k, x["end"])
            out.append(x)
    return out


def select_spans(grouped: DataFrame) -> DataFrame:
    """(key, spans): of each array of structs (start, end, ...), sorted by preference, those that are chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_free_spans(x or []) for x in batch.column(1).to_pylist()], kind)], names=batch.schema.names)

    return grouped.mapInArrow(run, grouped.schema)


def mentions(docs: DataFrame, gaz: DataFrame, typo_longest: int = 40) -> DataFrame:
    """(doc_id, surface, start, end, id, label, canonical): longest matches that do not overlap.

    Longer dictionary surfaces come first, ties in dictionary order; each is tried as it stands and
    then with one known wrong character (if it is short enough). Places come from one pass of an automaton over each
    text, or from a join if the forms are counted to be too many; the choice walks over the candidates of one document.
    """
    forms = gaz.select("surface", "id", "label", "ord", F.posexplode(F.concat(F.array("surface"), F.when(F.length("surface") <= typo_longest, TX.typo_variants(F.col("surface"))).otherwise(F.array().cast("array<string>")))).alias("variant", "form"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    found_in = automaton.blocks(forms, "form")
    if found_in is None:
        pairs = substring_join_by_token(texts, forms.select(F.col("form").alias("sid"), F.col("form").alias("surface")).distinct())
        found = pairs.select(F.col("id").alias("doc_id"), F.col("surface").alias("form")).join(docs.select("doc_id", "text"), "doc_id")
        at = found.select("doc_id", "form", F.explode(TX.positions(F.col("text"), F.col("form"))).alias("start"))
    else:
        at = automaton.occurrences(texts, found_in).select(F.col("id").alias("doc_id"), F.col("surface").alias("form"), F.explode("starts").alias("start"))
    placed = at.join(forms, "form")
    span = F.struct((-F.length("surface")).alias("o1"), F.col("ord").alias("o2"), F.col("surface").alias("canonical"), F.col("variant"), F.col("start"), (F.col("start") + F.length("form")).alias("end"), F.col("form"), F.col("id"), F.col("label"))
    picked = select_spans(placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")))
    return picked.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.form").alias("surface"), "s.start", "s.end", "s.id", "s.label", "s.canonical")


def paraphrases(found: DataFrame, prefixes: DataFrame, labels: tuple[str, ...] = ("Cause", "Countermeasure"), rate: float = 0.12) -> DataFrame:
    """More mentions: long entities without their prefix (prefix), for a share of mentions picked by hash."""
    pick = found.where(F.col("label").isin(*labels)).where(TX.stable_keep(F.concat_ws("|", "doc_id", F.col("start").cast("string"), "surface"), rate))
    sizes = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect() if r[0]]  # lengths only
    heads = F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.substring("canonical", F.lit(1), n))
    cut = pick.withColumn("prefix", F.explode(F.array_distinct(heads))).join(prefixes.select("prefix").distinct(), "prefix").where(F.length("surface") > F.length("prefix"))
    longest = Window.partitionBy("doc_id", "start", "surface").orderBy(F.desc(F.length("prefix")))
    cut = cut.withColumn("_r", F.row_number().over(longest)).where("_r = 1")
    return cut.select("doc_id", F.expr("substring(surface, length(prefix) + 1)").alias("surface"), (F.col("start") + F.length("prefix")).alias("start"), "end", "id", "label", "canonical")


def inside(found: DataFrame, regions: DataFrame, label: str | None = None, first: bool = True) -> DataFrame:
    """Mentions inside regions (doc_id, region, lo, hi), of one label if it is named: the first by place, or all."""
    m = found.where(F.col("label") == label) if label else found
    hit = m.join(regions, "doc_id").where((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi")))
    if not first:
        return hit
    w = Window.partitionBy("doc_id", "region").orderBy("start", "end", "surface")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pair_by_place(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """The i-th row of ``a`` with the i-th of ``b`` within each key; what is left over has no partner and drops out."""
    return placed(a, keys, order_a, "_i").join(placed(b, keys, order_b, "_i"), [*keys, "_i"]).drop("_i")


def keep_triples(triples: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Triples (doc_id, head, rel, tail) that the rules cover, picked by hash at the rate of their relation; no self pairs."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "head", "rel", "tail")
    return triples.where((F.col("head") != F.col("tail")) & TX.stable_keep(key, _rate(F.col("rel"), RELATION_RATES if rates is None else rates)))


def dedup_triples(triples: DataFrame, order: str = "ord") -> DataFrame:
    """Once by (doc_id, head, rel, tail); the first in ``order`` stays."""
    keys = ["doc_id", "head", "rel", "tail"]
    w = Window.partitionBy(*keys).orderBy(order)
    return triples.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def valid_rows(rows: DataFrame, segments: DataFrame, labels: list[str]) -> DataFrame:
    """Extracted rows (seg_id, surface, label) with a surface that stands in the segment (seg_id, text) and a known label."""
    good = (F.length(F.trim("surface")) > 0) & F.col("label").isin(labels) & F.contains("text", "surface")
    return rows.join(segments, "seg_id").where(good).select(*rows.columns)


def valid_relations(rels: DataFrame, rows: DataFrame) -> DataFrame:
    """Relations whose both ends (seg_id, surface, label) were extracted."""
    ends = rows.select("seg_id", F.col("surface").alias("_s"), F.col("label").alias("_l")).distinct()
    on = lambda s, l: [rels["seg_id"] == ends["seg_id"], rels[s] == ends["_s"], rels[l] == ends["_l"]]  # noqa: E731, E741
    return rels.join(ends, on("head", "head_label"), "left_semi").join(ends, on("tail", "tail_label"), "left_semi")


def frozen_sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """The n rows whose hashed key comes first: the same at every run."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(seed), key))).orderBy("_h", key).limit(n).drop("_h")


def extract_with(segments: DataFrame, provider) -> DataFrame:
    """Rows (seg_id, surface, label) from a provider: a function from a list of texts to lists of (surface, label).

    The provider runs in the tasks, on batches; a model client can be made once for each task.
    """
    schema = T.StructType([segments.schema["seg_id"], T.StructField("surface", T.StringType()), T.StructField("label", T.StringType())])

    def run(frames):
        import pandas as pd

        for f in frames:
            found = provider(f["text"].fillna("").tolist())
            yield pd.DataFrame([(i, s, lab) for i, rows in zip(f["seg_id"], found, strict=True) for s, lab in rows], columns=["seg_id", "surface", "label"])

    return segments.select("seg_id", "text").mapInPandas(run, schema)
