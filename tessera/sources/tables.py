"""Readers and writers of the formats that the engine takes and gives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text_dir(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(doc_id, text): one row for each text file, named by its stem."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), f"\\Q{suffix}\\E$", "").alias("doc_id"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line, by a given schema (no inference pass); lines that do not parse give nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys are not yet stored, one for each key, to a stored table; all of them count at once, or none."""
    Store(df.sparkSession, path).append("rows", df, keys)


def append_segments(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append only the rows whose key is not yet stored; returns all that is stored. Running it again adds nothing."""
    append_new(df, path, [key])
    stored = Store(df.sparkSession, path).read("rows")
    return (df.limit(0) if stored is None else stored).select(df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files in UTF-8, each with a byte-order mark and the column names in its first line."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *(F.col(f"`{c}`") for c in rest)).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot; edges are laid out by relation, so that a query for one relation reads only its files."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def list_artefacts(spark: SparkSession, path: str, pattern: str = "*", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(name, size) of the files below a folder, without reading them; with ``allowed`` only those directly in one of these subfolders."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    if allowed is not None:
        df = df.where(F.element_at(F.split("path", "/"), -2).isin(*allowed))
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of a query with named parameters (:name) over named tables ({name}); values are never put into the text."""
    return spark.sql(sql, args or {}, **tables)


def ontology(spark: SparkSession, spec: dict) -> tuple[DataFrame, DataFrame]:
    """Labels and relations of a parsed ontology file, as DataFrames."""
    ents = [(e["label"], e.get("name_cn")) for e in spec.get("entities", [])]
    rels = [(r["type"], r["domain"], r["range"], r.get("name_cn")) for r in spec.get("relations", [])]
    return spark.createDataFrame(ents, "label string, display string"), spark.createDataFrame(rels, "rel string, domain string, range string, display string")


def read_ontology(spark: SparkSession, path: str, copy_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels and relations of an ontology file in YAML (one small file, or a folder with one), wherever Spark can read it; ``copy_to`` keeps a copy as text."""
    import yaml  # only this reader needs it

    lines = spark.read.text(path, wholetext=True)
    if copy_to is not None:
        lines.coalesce(1).write.mode("overwrite").text(copy_to)
    spec = yaml.safe_load(lines.first()[0])
    if not isinstance(spec, dict):
        raise ValueError(f"{path} is no ontology")
    return ontology(spark, spec)


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a query in a relational store; pass partitioning options to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
