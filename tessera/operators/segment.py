"""Word segmentation of scripts without spaces: a dictionary learned from names and counts, and the likeliest path over each run's word lattice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the scripts that are written without spaces, as the inside of a character class.
HAN = r"\p{IsHan}"
#: Costs are whole numbers, millionths of a natural logarithm, so that equal paths are equal everywhere.
UNIT = 1_000_000
#: A dictionary whose words have so many characters in all their prefixes at most is broadcast to the tasks; a larger one is joined.
BROADCAST_CHARS = 32 << 20
#: Words of a run that are proposed have so many characters at most, unless they are names.
LONGEST = 4


def pieces(text: Column, script: str = HAN) -> Column:
    """Runs of the script, and runs of other letters and digits, of a lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([{script}]+|[\p{{L}}\p{{N}}&&[^{script}]]+)"), F.lit(1))


def gram_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, script: str = HAN) -> DataFrame:
    """(word, n): how often each run of up to ``longest`` characters stands within the script's runs; combined before the shuffle."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(rf"([{script}]+)"), F.lit(1))).alias("run"))
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))
    grams = starts.select(F.explode(F.transform(sizes, lambda size: F.substring("run", F.col("at"), size))).alias("word"))
    return grams.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def run_counts(texts: DataFrame, text_col: str = "text", script: str = HAN) -> DataFrame:
    """(word, n): the whole runs of the script and how often each stands there, for texts that separate their words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(rf"([{script}]+)"), F.lit(1))
    return texts.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def learn_words(texts: DataFrame, names: DataFrame, text_col: str = "text", longest: int = LONGEST, least: int = 5, cohesion: float = 20.0, script: str = HAN) -> DataFrame:
    """(word, n): the dictionary of a corpus and of names (name).

    A name is a word whatever its count, its occurrences counted as far as its length is within ``longest`` (one else). Of other runs those are words that
    stand there ``least`` times or more and hold together: however they are cut in two, they are ``cohesion`` times
    as frequent as their parts would meet by chance. Single characters always are.
    """
    grams = gram_counts(texts, text_col, longest, script)
    total = grams.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    size = F.length("word")
    cuts = grams.where((size > 1) & (F.col("n") >= least)).select("word", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("at"))
    halves = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.substring("word", F.col("at") + 1, size - F.col("at")).alias("right"))
    l, r = grams.select(F.col("word").alias("left"), F.col("n").alias("n_left")), grams.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    tied = halves.join(l, "left").join(r, "right").join(F.broadcast(total), how="cross")
    holds = tied.groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_left") * F.col("n_right"))).alias("least")).where(F.col("least") >= cohesion)
    listed = names.select(F.lower("name").alias("word")).where(F.col("word").rlike(f"^[{script}]+$")).distinct()
    named = listed.join(grams, "word", "left").select("word", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    return grams.where(size == 1).unionByName(holds.select("word", "n")).unionByName(named).groupBy("word").agg(F.max("n").alias("n"))


def word_costs(words: DataFrame) -> DataFrame:
    """(word, cost): minus the log of each word's share of all counts, in whole units; the empty word has that of a character in no word."""
    total = words.agg(F.log(F.greatest(F.sum("n"), F.lit(1)).cast("double")).alias("all"))
    costs = words.join(F.broadcast(total), how="cross").select("word", F.round(F.lit(UNIT) * (F.col("all") - F.log(F.col("n").cast("double")))).cast("long").alias("cost"))
    unknown = total.select(F.lit("").alias("word"), F.round(F.lit(UNIT) * F.coalesce("all", F.lit(0.0))).cast("long").alias("cost"))
    return costs.unionByName(unknown)


def likeliest(run: str, edges: list[list[tuple[int, int]]]) -> list[str]:
    """The words of the path of least cost through a run; ``edges[i]`` has (length, cost) of the words from place i on. Of equal paths the one whose first word is longest, and so on."""
    best: list[tuple[int, int]] = [(0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        best[i] = min((cost + best[i + size][0], -size) for size, cost in edges[i])
    out, i = [], 0
    while i < len(run):
        size = -best[i][1]
        out.append(run[i : i + size])
        i += size
    return out


class Prefixes:
    """A dictionary with all prefixes of its words, so that a search from a place ends where no word goes on."""

    def __init__(self, words: list[str], costs: list[int], unknown: int):
        self.unknown, self.costs = unknown, dict.fromkeys((w[:k] for w in words for k in range(1, len(w))), None)
        self.costs |= zip(words, costs, strict=True)

    def edges(self, run: str) -> list[list[tuple[int, int]]]:
        out = []
        for i in range(len(run)):
            here, j = [], i + 1
            while j <= len(run) and (part := run[i:j]) in self.costs:
                if (cost := self.costs[part]) is not None:
                    here.append((j - i, cost))
                j += 1
            out.append(here if here and here[0][0] == 1 else [(1, self.unknown), *here])
        return out


def segment(df: DataFrame, costs: DataFrame, id_col: str = "doc_id", text_col: str = "text", script: str = HAN, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, toks): the words of each text in order; runs of the script by the dictionary ``costs`` (word, cost), others whole.

    A dictionary within the bound goes to every task; a larger one is joined with the substrings of the distinct runs. A null text has no words.
    """
    cut = df.select(F.col(id_col).alias("id"), F.transform(pieces(F.col(text_col), script), lambda p: F.struct(p.alias("t"), p.rlike(f"^[{script}]").alias("s"))).alias("pieces"))
    size = F.length("word").cast("long")
    chars = costs.agg(F.coalesce(F.sum(size * (size + 1) / 2), F.lit(0)).alias("n")).first().n
    return _by_prefixes(cut, costs) if chars <= broadcast_chars else _by_join(cut, costs)


def _by_prefixes(cut: DataFrame, costs: DataFrame) -> DataFrame:
    rows = costs.select("word", "cost").toArrow().to_pydict()  # within the bound
    words = dict(zip(rows["word"], rows["cost"], strict=True))
    known = cut.sparkSession.sparkContext.broadcast((words.pop("", 0), words))
    out = T.StructType([cut.schema["id"], T.StructField("toks", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown, table = known.value
        prefixes, seen = Prefixes(list(table), list(table.values()), unknown), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                toks = []
                for found in part.column(1).to_pylist():
                    words = []
                    for piece in found:
                        text = piece["t"]
                        if not piece["s"]:
                            words.append(text)
                            continue
                        if text not in seen:
                            if len(seen) > 20_000:
                                seen.clear()
                            seen[text] = likeliest(text, prefixes.edges(text))
                        words += seen[text]
                    toks.append(words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(toks, pa.list_(pa.string()))], names=out.names)

    return cut.mapInArrow(run, out)


def _by_join(cut: DataFrame, costs: DataFrame) -> DataFrame:
    """The lattice of every distinct run as rows: its substrings, as long as words get, met with the dictionary."""
    each = cut.select("id", F.posexplode("pieces").alias("pos", "p")).select("id", "pos", F.col("p.t").alias("run"), F.col("p.s").alias("s"))
    bounds = costs.agg(F.max(F.length("word")).alias("longest"), F.max(F.when(F.col("word") == "", F.col("cost"))).alias("unknown"))
    runs = each.where("s").select("run").distinct().join(F.broadcast(bounds), how="cross")
    places = runs.select("run", "unknown", "longest", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("at"))
    parts = places.select("run", "unknown", "at", F.explode(F.sequence(F.lit(1), F.least(F.col("longest"), F.length("run") - F.col("at")))).alias("size"))
    met = parts.withColumn("word", F.substring("run", F.col("at") + 1, F.col("size"))).join(costs, "word", "left").where("cost is not null or size = 1")
    lattice = met.groupBy("run").agg(F.collect_list(F.struct("at", "size", F.coalesce("cost", "unknown").alias("cost"))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, words = batch.slice(at, 64), []
                for text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    edges: list[list[tuple[int, int]]] = [[] for _ in text]
                    for e in found:
                        edges[e["at"]].append((e["size"], e["cost"]))
                    words.append(likeliest(text, edges))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    split = lattice.mapInArrow(run, "run string, words array<string>")
    told = each.join(split, "run", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("words", F.array("run")).alias("words")))).alias("w"))
    return cut.select("id").distinct().join(told.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left").select("id", F.coalesce(F.flatten("w.words"), F.array().cast("array<string>")).alias("toks"))
