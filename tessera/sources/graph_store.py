"""A stored property graph that loads are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources.store import Store


class GraphStore(Store):
    """Nodes (id, label, aliases, properties) by id and edges (source, rel, target, properties) by source."""

    def load(self, nodes: DataFrame, edges: DataFrame, order: str = "ord") -> int:
        """Merge a load into the stored graph and publish both tables at once; the new version.

        Nodes as ``graph.upsert_entities``, in ``order`` after what is stored. Edges whose ends are both stored, or in this load, are created once;
        one that exists keeps its properties. The rest are skipped (``graph.without_endpoints`` counts them).
        """
        base, entries = self.entries()

        def merged(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
            place = F.struct(F.lit(1).alias("load"), F.col(order).cast("long").alias("at"))
            fresh = rows.withColumn("_place", place).drop(order)
            if stored is not None:
                old = stored.withColumn("_place", F.struct(F.lit(0).alias("load"), F.lit(0).cast("long").alias("at")))
                fresh = old.unionByName(fresh, allowMissingColumns=True)
            return G.upsert_entities(fresh, "_place")

        entries = self.staged_merge(entries, "nodes", nodes, ["id"], merged)
        ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        listed = [e for e in entries if e.name == "nodes"]
        touched = self._touched(ends, ["id"], listed[0].buckets) if listed else ()
        known = self._rows([e for e in listed if e.bucket in touched])
        kept = edges.limit(0) if known is None else G.upsert_relations(edges, known)

        def created(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
            if stored is None:
                return rows
            return stored.unionByName(rows.join(stored.select("source", "rel", "target"), ["source", "rel", "target"], "left_anti"), allowMissingColumns=True)

        return self.publish(base, self.staged_merge(entries, "edges", kept, ["source"], created))
