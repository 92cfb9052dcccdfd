"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage reads all that its predecessor kept, and its decisions take effect: documents without a
language go, of near copies one document stays, documents that hold benchmark windows go, secrets are
masked in the texts, and what is left is encoded and decoded. All stages but the last return the
columns of documents.

Defined results: a null text, or one without a letter, has no language and goes; if no row is labelled there is nothing
to learn from, and every text with a letter stays. Rows of one doc_id are one document: near copies take all
of its rows or none; a null id is nobody's copy. Repeated rows stay repeated. Texts are whole at any length. Other columns pass
unchanged whatever their names, and also where an operator gives one of that name (n_chars alone is counted anew, if it is there). An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, neardup, secrets
from tessera.llm.common import materialise, table

#: A predicted language counts as none unless its pooled probability is so many times that of a guess among all languages.
ABOVE_CHANCE = 1.2


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but id and text under names that no operator uses, and the columns that bring theirs back."""
    own = {c: c if c in ("doc_id", "text") else f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), [F.col(n).alias(c) for c, n in own.items()]


def _kept(docs: DataFrame, found: DataFrame, keep) -> DataFrame:
    """The rows of docs whose row in found (one for each, by doc_id) is to stay; rows with a null id stay."""
    gone = found.where(~keep & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(_columns(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the recurrent network can tell; those it rejects go."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own, back = _aside(docs)
    told = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= min(1.0, ABOVE_CHANCE / len(model.langs)))
    return langid.predict(own, model, keep_rows=True).where(told).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies (five-word shingles, similarity 0.8)."""
    return _kept(docs, neardup.near_duplicates(docs, width=5), F.col("kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    own, back = _aside(docs)
    found = decontaminate.find_leaks(own, table(spark, sf_dir, "benchmark"), keep_rows=True)
    return found.where(F.size("spans") == 0).select(back)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars, if it is there, counted anew."""
    own, back = _aside(docs)
    out = secrets.redact(own).select(back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.round_trip(docs, bpe.default_file())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", masked),
    ("bpe", encoded),
]
#: SQL cannot run the recurrent network of the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
