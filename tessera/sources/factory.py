"""A graph of the closed vocabulary over the relational test tables, with questions that are linked to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: The same graph and questions in SQL.
SQL = """fe AS (
  SELECT DISTINCT 'DEF_' || l_partkey AS source, 'CAUSED_BY' AS rel, 'CA_PD' || (l_suppkey % 4) || '_' || l_suppkey AS target FROM lineitem UNION ALL
  SELECT 'CA_PD' || (s_suppkey % 4) || '_' || s_suppkey, 'ADDRESSED_BY', 'CM_PD' || (s_suppkey % 4) || '_' || (s_suppkey % 50) FROM supplier UNION ALL
  SELECT 'CA_PD' || (s_suppkey % 4) || '_' || s_suppkey, 'ADDRESSED_BY', 'CMT_PD' || (s_suppkey % 4) || '_' || (s_suppkey % 50) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL
  SELECT 'DEF_' || p_partkey, 'OCCURS_AT', 'PRO_' || (p_partkey % 25) FROM part UNION ALL
  SELECT 'DEF_' || p_partkey, 'INDUCED_BY_MATERIAL', 'MAT_' || p_brand FROM part UNION ALL
  SELECT DISTINCT 'PRO_' || (p_partkey % 25), 'USES_MATERIAL', 'MAT_' || p_brand FROM part UNION ALL
  SELECT 'DEV_' || s_suppkey, 'USED_IN', 'PRO_' || s_nationkey FROM supplier),
fq AS (SELECT c_custkey AS question, list_extract(['defect_to_causes', 'defect_to_countermeasures', 'process_to_defects', 'material_to_defects', 'device_to_process', 'process_to_materials'], CAST(c_custkey % 6 + 1 AS INTEGER)) AS intent FROM customer),
fl AS (
  SELECT c_custkey AS question, 'DEF_' || (c_custkey % 150 + 1) AS id, 'Defect' AS label, 0 AS pos FROM customer WHERE c_custkey % 6 IN (0, 1) UNION ALL
  SELECT c_custkey, 'MAT_PD' || (c_custkey % 4), 'Material', 1 FROM customer WHERE c_custkey % 6 IN (1, 2) UNION ALL
  SELECT c_custkey, 'PRO_' || (c_custkey % 25), 'Process', 0 FROM customer WHERE c_custkey % 6 IN (2, 5) UNION ALL
  SELECT c_custkey, 'MAT_' || p_brand, 'Material', 0 FROM customer JOIN part ON p_partkey = c_custkey % 150 + 1 WHERE c_custkey % 6 IN (3, 5) UNION ALL
  SELECT c_custkey, 'DEV_' || (c_custkey % 10), 'Device', 0 FROM customer WHERE c_custkey % 6 = 4)"""

INTENTS = ("defect_to_causes", "defect_to_countermeasures", "process_to_defects", "material_to_defects", "device_to_process", "process_to_materials")
#: Labels by the prefix of an id.
PREFIXES = {"DEF": "Defect", "CA": "Cause", "CM": "Countermeasure", "CMT": "Countermeasure", "PRO": "Process", "MAT": "Material", "DEV": "Device"}


def _text(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, rel, target) with the relations of the vocabulary."""
    get = lambda name: table(spark, sf_dir, name)
    s, p, li, part = F.col("s_suppkey"), F.col("p_partkey"), F.col("l_suppkey"), get("part")
    cause = lambda k: _text("CA_PD", k % 4, "_", k)
    edge = lambda df, a, rel, b: df.select(a.alias("source"), F.lit(rel).alias("rel"), b.alias("target"))
    return reduce(DataFrame.unionByName, [
        edge(get("lineitem").select("l_partkey", "l_suppkey").distinct(), _text("DEF_", F.col("l_partkey")), "CAUSED_BY", cause(li)),
        edge(get("supplier"), cause(s), "ADDRESSED_BY", _text("CM_PD", s % 4, "_", s % 50)), edge(get("supplier").where("s_suppkey % 3 = 0"), cause(s), "ADDRESSED_BY", _text("CMT_PD", s % 4, "_", s % 50)),
        edge(part, _text("DEF_", p), "OCCURS_AT", _text("PRO_", p % 25)), edge(part, _text("DEF_", p), "INDUCED_BY_MATERIAL", _text("MAT_", F.col("p_brand"))),
        edge(part.select((p % 25).alias("k"), "p_brand").distinct(), _text("PRO_", F.col("k")), "USES_MATERIAL", _text("MAT_", F.col("p_brand"))), edge(get("supplier"), _text("DEV_", s), "USED_IN", _text("PRO_", F.col("s_nationkey"))),
    ])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name) of all ends of edges."""
    ids = edges(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kinds = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    return ids.select("id", F.try_element_at(kinds, F.substring_index("id", "_", 1)).alias("label"), F.concat(F.lit("name of "), "id").alias("name"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, intent): one for each customer."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("question"), F.element_at(F.array(*map(F.lit, INTENTS)), (c % 6 + 1).cast("int")).alias("intent"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, id, label, pos): the entities that the questions name."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    link = lambda df, id_, label, pos: df.select(k.alias("question"), id_.alias("id"), F.lit(label).alias("label"), F.lit(pos).alias("pos"))
    branded = c.where("c_custkey % 6 in (3, 5)").join(table(spark, sf_dir, "part"), F.col("p_partkey") == k % 150 + 1)
    return reduce(DataFrame.unionByName, [
        link(c.where("c_custkey % 6 in (0, 1)"), _text("DEF_", k % 150 + 1), "Defect", 0), link(c.where("c_custkey % 6 in (1, 2)"), _text("MAT_PD", k % 4), "Material", 1),
        link(c.where("c_custkey % 6 in (2, 5)"), _text("PRO_", k % 25), "Process", 0), link(branded, _text("MAT_", F.col("p_brand")), "Material", 0), link(c.where("c_custkey % 6 = 4"), _text("DEV_", k % 10), "Device", 0),
    ])
