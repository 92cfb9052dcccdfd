"""A property graph over the relational test tables: nodes, edges and the relation schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Relation, domain label, range label.
RELATIONS = (
    ("IN_REGION", "nation", "region"), ("LOCATED_IN", "customer", "nation"), ("BASED_IN", "supplier", "nation"), ("PLACED", "customer", "orders"), ("CONTAINS", "orders", "part"),
    ("SUPPLIED_BY", "part", "supplier"), ("FULFILLED_BY", "orders", "supplier"), ("SUBCLASS_OF", "part", "part"), ("PRECEDES", "orders", "orders"),
)
#: Label, id prefix, key column, name column.
_NODES = (("region", "R", "r_regionkey", "r_name"), ("nation", "N", "n_nationkey", "n_name"), ("customer", "C", "c_custkey", "c_name"), ("supplier", "S", "s_suppkey", "s_name"), ("part", "P", "p_partkey", "p_name"), ("orders", "O", "o_orderkey", "o_orderkey"))


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name, scope): scope is the priority of an order, else null."""
    parts = []
    for label, prefix, key, name in _NODES:
        t = table(spark, sf_dir, label)
        scope = F.col("o_orderpriority") if label == "orders" else F.lit(None).cast("string")
        parts.append(t.select(_id(prefix, F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), scope.alias("scope")))
    return reduce(DataFrame.unionByName, parts)


def _edge(df: DataFrame, rel: str, a: str, source: str, b: str, target: str, distinct: bool = False) -> DataFrame:
    pairs = df.select(F.col(source).alias("s"), F.col(target).alias("t"))
    if distinct:
        pairs = pairs.distinct()
    return pairs.select(_id(a, F.col("s")).alias("source"), F.lit(rel).alias("rel"), _id(b, F.col("t")).alias("target"))


def edges(spark: SparkSession, sf_dir: str, *rels: str) -> DataFrame:
    """(source, rel, target) of the named relations, all if none is named; other tables are not read."""
    get = lambda name: table(spark, sf_dir, name)
    make = {
        "IN_REGION": lambda: _edge(get("nation"), "IN_REGION", "N", "n_nationkey", "R", "n_regionkey"),
        "LOCATED_IN": lambda: _edge(get("customer"), "LOCATED_IN", "C", "c_custkey", "N", "c_nationkey"),
        "BASED_IN": lambda: _edge(get("supplier"), "BASED_IN", "S", "s_suppkey", "N", "s_nationkey"),
        "PLACED": lambda: _edge(get("orders"), "PLACED", "C", "o_custkey", "O", "o_orderkey"),
        "CONTAINS": lambda: _edge(get("lineitem"), "CONTAINS", "O", "l_orderkey", "P", "l_partkey", True),
        "SUPPLIED_BY": lambda: _edge(get("lineitem"), "SUPPLIED_BY", "P", "l_partkey", "S", "l_suppkey", True),
        "FULFILLED_BY": lambda: _edge(get("lineitem"), "FULFILLED_BY", "O", "l_orderkey", "S", "l_suppkey", True),
        "SUBCLASS_OF": lambda: _edge(_parents(get("part")), "SUBCLASS_OF", "P", "p_partkey", "P", "parent"),
        "PRECEDES": lambda: _edge(_next_orders(get("orders")), "PRECEDES", "O", "o_orderkey", "O", "following"),
    }
    return reduce(DataFrame.unionByName, [make[r]() for r in (rels or make)])


def _parents(part: DataFrame) -> DataFrame:
    """Each part with the lowest key of its name, itself excluded."""
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("parent"))
    return part.join(first, "p_name").where("parent <> p_partkey")


def _next_orders(orders: DataFrame) -> DataFrame:
    """Each order with the next one of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.withColumn("following", F.lead("o_orderkey").over(w)).where(F.col("following").isNotNull())


def relation_schema(spark: SparkSession) -> DataFrame:
    """(rel, domain, range, polymorphic)."""
    return spark.createDataFrame([(*r, False) for r in RELATIONS], "rel string, domain string, range string, polymorphic boolean")
