"""Segmentation: headed sections, numbered items, and greedy packing of items."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import new_folder


# fixed values: headings of procedure documents, numbered items of exception and notice documents
SECTION = r"\n?[一二三四五六]、[^\n]*\n"
EXCEPTION_ITEM = r"\n(?=\d+\.\s责任工序：)"
NOTICE_ITEM = r"\n(?=\d+\.\s适用产品\s)"
NOTICE_WORD = "适用产品"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _split_before(text: Column, pattern: str) -> Column:
    """The pieces of a text, each but the first beginning with a match of ``pattern``."""
    return F.split(text, f"(?={pattern})", -1)


def chunk_sections(docs: DataFrame, pattern: str = SECTION, longer_than: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text): one chunk for each headed section; what stands before the first heading goes with it.

    Chunks of ``longer_than`` characters or less are dropped; a text without heading has none.
    """
    marked = F.regexp_replace(F.col(text_col), f"({pattern})", "\u0001$1")
    parts = F.split(marked, "\u0001", -1)
    head, rest = F.element_at(parts, 1), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    bodies = F.transform(rest, lambda b, i: F.when(i == 0, _trim(F.concat(head, F.lit("\n"), b))).otherwise(_trim(b)))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(bodies).alias("pos", "text")).where(F.length("text") > longer_than)


def chunk_items(docs: DataFrame, pattern: str, must_contain: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text): one chunk for each item; the head goes with the first, and a text without items is one chunk."""
    parts = F.split(F.col(text_col), pattern, -1)
    head, rest = _trim(F.element_at(parts, 1)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    bodies = F.transform(rest, lambda b, i: F.when(i == 0, _trim(F.concat(head, F.lit("\n"), _trim(b)))).otherwise(_trim(b)))
    chunks = F.when(F.size(parts) == 1, F.array(head)).otherwise(bodies)
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("pos", "text"))
    return out.where(F.contains("text", F.lit(must_contain))) if must_contain else out


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, genre, text): every document cut by the rule of its genre, the prefix of its id."""
    genre = F.substring_index("doc_id", "-", 1)
    parts = [
        chunk_sections(docs.where(genre == "SOP")),
        chunk_items(docs.where(genre == "EX"), EXCEPTION_ITEM),
        chunk_items(docs.where(genre == "NTC"), NOTICE_ITEM, NOTICE_WORD),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("genre", genre).select("doc_id", "pos", "genre", "text")


#: Bytes of rows that a range of ``numbered`` holds, on average at most.
RANGE_BYTES = 64 << 20


def _measured(df: DataFrame) -> int:
    """Bytes of rows, about: texts as they are, the rest by type. The plan's own size multiplies the sides of joins."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    fixed = df.drop(*texts)._jdf.schema().defaultSize() + 8 * len(texts)
    long = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(long + fixed), F.lit(0))).first()[0]


def numbered(df: DataFrame, order: list, name: str = "no", spare: tuple[str, ...] = ()) -> DataFrame:
    """``df``, less the columns ``spare``, with the place of each row, from 0, in one order over all of them.

    Rows are dealt to ranges of the whole order and sorted there, and this is written to the shared folder once, so that
    counts and places agree whatever is lost later. There are as many ranges as shuffle partitions, more if the plan's size, and then the
    rows themselves, ask for them (``RANGE_BYTES``); only their sizes are gathered; a row's place is that in its range and the sizes of the ranges before.
    """
    spark = df.sparkSession
    path = new_folder(spark, "numbered")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size // RANGE_BYTES > ranges:
        ranges = max(ranges, min(size, _measured(df)) // RANGE_BYTES)
    ranged = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    ranged.drop(*spare).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = placed.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in spare), (F.col("_before") + at).alias(name))


def placed(df: DataFrame, keys: list[str], order: list, name: str = "place", spare: tuple[str, ...] = ()) -> DataFrame:
    """``df``, less the columns ``spare``, with the place of each row, from 0, among those of its keys; rows with a null key drop out.

    One numbering over all rows, less where each key begins: no key is sorted in one task, however many rows it has.
    """
    out = numbered(df, [*keys, *order], "_no", spare)
    begins = out.groupBy(*keys).agg(F.min("_no").alias("_begin"))
    return out.join(begins, keys).withColumn(name, F.col("_no") - F.col("_begin")).select(*(F.col(f"`{c}`") for c in df.columns if c not in spare), name)


def with_chunk_ids(chunks: DataFrame, order: list[str], digits: int = 5) -> DataFrame:
    """``chunks`` with running ids C00000, C00001, ... in one order over all of them."""
    number = F.col("_no").cast("string")
    out = numbered(chunks, order, "_no")
    return out.withColumn("chunk_id", F.concat(F.lit("C"), F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number))).drop("_no")


def pack_items(lengths: Column, limit: int = 2600) -> Column:
    """Segment number of every item of a list, packed in order: a segment takes items while their lengths sum to ``limit`` at most.

    The first item of a segment is always taken. A sequential walk, as an Arrow function.
    """

    @F.pandas_udf("array<int>")
    def packed(lists: pd.Series) -> pd.Series:
        out = []
        for items in lists:
            if items is None:
                out.append(None)
                continue
            segs, seg, size = [], -1, 0
            for n in items:
                if seg >= 0 and size + n <= limit:
                    size += n
                else:
                    seg, size = seg + 1, n
                segs.append(seg)
            out.append(segs)
        return pd.Series(out, dtype=object)

    return packed(lengths)


def captured(text: Column, pattern: str, base: Column | None = None) -> Column:
    """(text, start, end) of the first group of the first match, as places in the whole document; null without a match.

    What stands before the group in the pattern becomes a group of its own, whose length gives the place.
    """
    flags, body = re.match(r"((?:\(\?[a-z]+\))*)(.*)", pattern, re.S).groups()
    at = re.search(r"(?<!\\)\((?!\?)", body).start()
    marked = f"{flags}({body[:at]}){body[at:]}"
    whole, before, part = (F.regexp_extract(text, marked, k) for k in (0, 1, 2))
    start = F.instr(text, whole) - 1 + F.length(before) + (base if base is not None else F.lit(0))
    return F.when(F.length(whole) > 0, F.struct(part.alias("text"), start.alias("start"), (start + F.length(part)).alias("end")))
