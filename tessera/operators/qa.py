"""Question answering: fusing channels, numeric answers, evidence, template texts and question generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(graph: DataFrame, vector: DataFrame, extra: int = 3, cap: int | None = None) -> DataFrame:
    """(qid, id, pos): graph answers (qid, id, pos) first, then up to ``extra`` vector answers that are not among them."""
    more = vector.join(graph.select("qid", "id"), ["qid", "id"], "left_anti")
    w = Window.partitionBy("qid").orderBy("pos", "id")
    more = more.withColumn("r", F.row_number().over(w)).where(F.col("r") <= extra).select("qid", "id", F.lit(1).alias("src"), F.col("r").alias("p"))
    both = graph.select("qid", "id", F.lit(0).alias("src"), F.col("pos").alias("p")).unionByName(more)
    first = both.groupBy("qid", "id").agg(F.min(F.struct("src", "p")).alias("o"))
    out = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("o", "id"))).select("qid", "id", "pos")
    return out if cap is None else out.where(F.col("pos") <= cap)


def online_answer(answers: DataFrame, vector: DataFrame, nodes: DataFrame, extra: int = 3, shown: int = 10, without: tuple[str, ...] = ("CMT_", "CMS_"), cases: DataFrame | None = None) -> DataFrame:
    """(question, pos, id, name): the names that a question's answer shows.

    All groups of the graph's answer (question, part, id) come in a fixed order, stopgap and standard measures left out, then
    up to ``extra`` vector answers (question, id, pos) that are not among them; the first ``shown`` of all. With ``cases`` (question, case), ``answers`` are
    those of the cases: they are ranked once for each, and a question gets the first ``shown`` of its own.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ("cause", "countermeasure", "process", "defect", "material", "near"))), F.col("part")), F.lit(0))
    kept = without_prefixes(answers, without).groupBy("question", "id").agg(F.min(place).alias("group"))
    graph = kept.select(F.col("question").alias("qid"), "id", F.row_number().over(Window.partitionBy("question").orderBy("group", "id")).alias("pos"))
    near = vector.select(F.col("question").alias("qid"), "id", "pos")
    if cases is not None:
        of = cases.select(F.col("question").alias("qid"), "case")
        known = of.join(near, "qid").join(kept.select(F.col("question").alias("case"), "id"), ["case", "id"], "left_semi").select("qid", "id")
        near = near.join(known, ["qid", "id"], "left_anti")
        graph = of.join(graph.where(F.col("pos") <= shown).withColumnRenamed("qid", "case"), "case").select("qid", "id", "pos")
    fused = fuse(graph, near, extra, shown)
    return fused.join(nodes.select("id", "name"), "id", "left").select(F.col("qid").alias("question"), "pos", "id", "name")


def with_fitting_label(vector: DataFrame, nodes: DataFrame, questions: DataFrame, intents: DataFrame) -> DataFrame:
    """Vector answers whose label fits the intent of their question."""
    want = questions.select("qid", "intent").join(F.broadcast(intents), "intent").select("qid", F.col("label").alias("want"))
    return vector.join(nodes.select("id", "label"), "id").join(want, "qid").where("label = want").select(vector.columns)


def without_prefixes(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Answers whose id has none of the prefixes."""
    out = df
    for p in prefixes:
        out = out.where(~F.startswith("id", F.lit(p)))
    return out


def numeric_answers(answers: DataFrame, questions: DataFrame, count_intents: tuple[str, ...]) -> DataFrame:
    """(qid, channel, number): distinct answers; graph and hybrid channels only answer counting questions."""
    n = answers.groupBy("qid", "channel").agg(F.count_distinct("id").alias("n"))
    full = questions.select("qid", "intent").join(n, "qid")
    counts = F.col("intent").isin(*count_intents) | ~F.col("channel").isin("graph", "hybrid")
    return full.select("qid", "channel", F.when(counts, F.col("n")).alias("number"))


def evidence(hits: DataFrame, triples: DataFrame, names: DataFrame, chunks: int = 3, facts: int = 30, shown: int = 10) -> DataFrame:
    """(qid, chunks, triples, names): the first few of each, in order."""

    def lists(df: DataFrame, item: str, n: int, name: str) -> DataFrame:
        few = df.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("pos", item))).where(F.col("_r") <= n)
        return few.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]).alias(name))

    out = lists(hits, "chunk_id", chunks, "chunks").join(lists(triples, "triple", facts, "triples"), "qid", "full").join(lists(names, "name", shown, "names"), "qid", "full")
    none = F.array().cast("array<string>")
    return out.select("qid", *(F.coalesce(c, none).alias(c) for c in ("chunks", "triples", "names")))


def compose_answer(subject: Column, groups: list[tuple[str, Column, int]]) -> Column:
    """A template text: the subject, then each group that has names, with its title and its first few names."""
    parts = [F.when(F.size(names) > 0, F.concat(F.lit(title + "："), F.array_join(F.slice(names, 1, n), "、"))) for title, names, n in groups]
    body = F.concat_ws("；", *parts)
    return F.when(F.length(body) > 0, F.concat(subject, F.lit("："), body, F.lit("。"))).otherwise(F.concat(subject, F.lit("：未找到相关信息。")))


def answer_with(questions: DataFrame, provider, template: str = "answer") -> DataFrame:
    """``questions`` with ``natural_answer``: the provider's text where it gives one, else the template column."""

    def run(frames):
        for f in frames:
            said = provider(f["query"].tolist())
            f["natural_answer"] = [s if s else t for s, t in zip(said, f[template], strict=True)]
            yield f

    return questions.mapInPandas(run, questions.select("*", F.lit("").alias("natural_answer")).schema)


def generate_questions(sets: DataFrame, templates: list[tuple[str, str, str, str]], per_template: int, seed: str) -> DataFrame:
    """(qid, qtype, intent, query, gold_ids, gold_number): questions from neighbour sets (rel, source, name, targets).

    ``templates``: (qtype, intent, relation, text with {} for the name). Of each, the sources whose seeded
    hash comes first; gold ids are sorted; counting intents also give their number.
    """
    parts = None
    for qtype, intent, rel, text in templates:
        key = F.md5(F.concat(F.lit(f"{seed}|{intent}|"), "source"))
        rows = sets.where((F.col("rel") == rel) & (F.size("targets") > 0)).withColumn("_h", key).orderBy("_h", "source").limit(per_template)
        q = rows.select(F.concat(F.lit(f"{intent}:"), "source").alias("qid"), F.lit(qtype).alias("qtype"), F.lit(intent).alias("intent"), F.replace(F.lit(text), F.lit("{}"), F.col("name")).alias("query"), F.array_sort("targets").alias("gold_ids"), F.when(F.lit(intent.endswith("_count")), F.size("targets")).alias("gold_number"))
        parts = q if parts is None else parts.unionByName(q)
    return parts


def with_noise(questions: DataFrame, aliases: DataFrame, alias_rate: float, typo_rate: float) -> DataFrame:
    """Questions whose entity name is replaced by an alias, or has one wrong character, for shares picked by hash.

    ``aliases``: (name, alias), one alias for each name; ``questions`` have a column ``name`` that their query holds.
    """
    from tessera.functions.text import stable_keep, typo_variants

    full = questions.join(aliases.groupBy("name").agg(F.min("alias").alias("alias")), "name", "left")
    wrong = F.get(typo_variants(F.col("name")), F.lit(0))
    by_alias = F.col("alias").isNotNull() & stable_keep(F.concat(F.lit("a|"), "qid"), alias_rate)
    by_typo = ~by_alias & wrong.isNotNull() & stable_keep(F.concat(F.lit("t|"), "qid"), typo_rate)
    said = F.when(by_alias, F.col("alias")).when(by_typo, wrong).otherwise(F.col("name"))
    return full.withColumn("query", F.replace("query", "name", said)).withColumn("noise", F.when(by_alias, "alias").when(by_typo, "typo").otherwise("none")).drop("alias")
