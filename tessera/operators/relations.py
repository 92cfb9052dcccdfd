"""Rule relations of the three document genres: mentions inside regions of a block, joined by the block.

A rule names a region by a pattern with one group; the first (or every) mention of a label inside the
region takes a role in the block. Relations join two roles. All rules of a genre are joins over one
table of roles, so documents are independent and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunk as C
from tessera.operators.extract import inside, pair_by_place

# The patterns below are fixed values: the formats of the three document genres. A defect is looked for in so many
# characters from its marker on, the marker among them.
DEFECT_MARK, DEFECT_WINDOW = "不良现象：", 120


def blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, block, base, text): blocks of documents (doc_id, text) and their offsets; separators are one character."""
    parts = F.split("text", pattern, -1)
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("block"), (F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + i).alias("base"), p.alias("text")))
    return docs.select("doc_id", F.explode(placed).alias("b")).select("doc_id", "b.*")


def lines(blks: DataFrame) -> DataFrame:
    """The same for the lines of blocks, with column ``line``."""
    parts = F.split("text", "\n", -1)
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("line"), (F.col("base") + F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + i).alias("base"), p.alias("text")))
    return blks.select("doc_id", "block", F.explode(placed).alias("b")).select("doc_id", "block", "b.*")


def region(blks: DataFrame, pattern: str, slack: int = 0) -> DataFrame:
    """(doc_id, block, region, lo, hi): the first group of the pattern's first match in each block (or line)."""
    part = ["line"] if "line" in blks.columns else []
    hit = blks.select("doc_id", "block", *part, C.captured(F.col("text"), pattern, F.col("base")).alias("c")).where("c is not null")
    name = F.concat_ws("/", "block", *part)
    return hit.select("doc_id", "block", name.alias("region"), F.col("c.start").alias("lo"), (F.col("c.end") + slack).alias("hi"))


def role(found: DataFrame, regions: DataFrame, label: str, name: str, first: bool = True) -> DataFrame:
    """(doc_id, block, name, name_start): the mention that takes a role."""
    return inside(found, regions, label, first).select("doc_id", "block", F.col("surface").alias(name), F.col("start").alias(f"{name}_start"))


def _relate(head: DataFrame, h: str, rel: str, tail: DataFrame, t: str) -> DataFrame:
    pairs = head.select("doc_id", "block", F.col(h).alias("head")).join(tail.select("doc_id", "block", F.col(t).alias("tail")), ["doc_id", "block"])
    return pairs.select("doc_id", "head", F.lit(rel).alias("rel"), "tail")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where("head <> tail").distinct()


def exception_relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, head, rel, tail) of exception reports: device, process, defect, causes, materials, stopgap measures."""
    b = blocks(docs, C.EXCEPTION_ITEM)
    header = region(b, "(责任工序：[^\\n]*)\\n")
    proc, dev = role(found, header, "Process", "proc"), role(found, header, "Device", "dev")
    defect = role(found, region(b, "(?s)(不良现象：.*?)根因分析").unionByName(region(b.where(~F.contains("text", F.lit("根因分析"))), f"(?s)({DEFECT_MARK}.{{0,{DEFECT_WINDOW - len(DEFECT_MARK)}}})")), "Defect", "defect")
    section = "(?s)根因分析[^\\n]*\\n(.*?)(?:临时遏制措施：|二、|$)"
    causes = role(found, region(b, section), "Cause", "cause", first=False)
    inner = b.select("doc_id", "block", C.captured(F.col("text"), section, F.col("base")).alias("c")).where("c is not null").select("doc_id", "block", F.col("c.start").alias("base"), F.col("c.text").alias("text"))
    material = role(found, region(lines(inner), "关联物料：([^\\n]*)"), "Material", "material")
    stop = b.select("doc_id", "block", C.captured(F.col("text"), "(?s)临时遏制措施：\\n(.*?)(?:\\d+\\.\\s责任工序：|二、|$)", F.col("base")).alias("c")).where("c is not null")
    parts = F.split("c.text", "(?=（\\d+）)", -1)
    ends = F.transform(parts, lambda p, i: F.struct((F.col("c.start") + F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))).alias("lo"), F.length(p).alias("n"), p.rlike("^（\\d+）").alias("item")))
    items = stop.select("doc_id", "block", F.posexplode(F.filter(ends, lambda x: x["item"])).alias("i", "e")).select("doc_id", "block", "i", F.concat_ws("/", "block", "i").alias("region"), F.col("e.lo").alias("lo"), (F.col("e.lo") + F.col("e.n")).alias("hi"))
    measure = inside(found, items, "Countermeasure").select("doc_id", "block", "i", F.col("surface").alias("cm"))
    at = inside(found, items, "Process").select("doc_id", "block", "i", F.col("surface").alias("at"))
    # the i-th measure belongs to the i-th cause
    ranked = causes.select("doc_id", "block", "cause", "cause_start")
    slots = items.select("doc_id", "block", "i")
    paired = pair_by_place(ranked, slots, ["doc_id", "block"], ["cause_start", "cause"], ["i"]).join(measure, ["doc_id", "block", "i"])
    goal = paired.join(at, ["doc_id", "block", "i"], "left").join(proc.select("doc_id", "block", "proc"), ["doc_id", "block"], "left").select("doc_id", F.col("cm").alias("head"), F.lit("TARGETS").alias("rel"), F.coalesce("at", "proc").alias("tail")).where("tail is not null")
    spare = paired.where(F.contains("cm", F.lit("备用设备"))).join(dev.select("doc_id", "block", "dev"), ["doc_id", "block"]).select("doc_id", F.col("cm").alias("head"), F.lit("TARGETS").alias("rel"), F.col("dev").alias("tail"))
    return _all([
        _relate(dev, "dev", "USED_IN", proc, "proc"), _relate(defect, "defect", "OCCURS_AT", proc, "proc"), _relate(defect, "defect", "CAUSED_BY", causes, "cause"),
        _relate(defect, "defect", "INDUCED_BY_MATERIAL", material, "material"), paired.select("doc_id", F.col("cause").alias("head"), F.lit("ADDRESSED_BY").alias("rel"), F.col("cm").alias("tail")), goal, spare,
    ])


def notice_relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, head, rel, tail) of change notices: causes, engineering and standard measures, and what they target."""
    b = blocks(docs, C.NOTICE_ITEM).where(F.col("text").rlike("针对.+?：\\n"))
    ln = lines(b)
    cause = role(found, region(b, "针对(.+?)：\\n", 2), "Cause", "cause")
    fix = role(found, region(b, "对策：(.+?)。\\n"), "Countermeasure", "cm")
    standard = role(found, region(b, "标准化：(.+?)（责任工序：", 20), "Countermeasure", "cm")
    goals = [
        (standard, "标准化：.+?（责任工序：(.+?)）", "Process", 1), (standard, "设备侧要求：(.+?)的保养规程", "Device", 20), (fix, "作用对象：责任工序\\s*(.+?)，", "Process", 30), (fix, "作用对象：设备\\s*(.+?)，", "Device", 30),
        (fix, "作用对象：物料\\s*(.+?)，", "Material", 30), (fix, "同步执行：对\\s*(.+?)\\s进行参数标定", "Device", 0), (fix, "同步更新\\s*(.+?)\\s工序", "Process", 0),
    ]
    return _all([_relate(cause, "cause", "ADDRESSED_BY", fix, "cm"), _relate(cause, "cause", "ADDRESSED_BY", standard, "cm"), *(_relate(cm, "cm", "TARGETS", role(found, region(ln, p, slack), label, "goal"), "goal") for cm, p, label, slack in goals)])


def procedure_relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, head, rel, tail) of work procedures: process, device, materials, defects, finer defects, order of processes."""
    b = docs.select("doc_id", F.lit(0).alias("block"), F.lit(0).alias("base"), "text")
    one = lambda p, label, name, slack=0, first=True: role(found, region(b, p, slack), label, name, first)
    proc = one("在(.+?)工序的标准作业", "Process", "proc", 4)
    return _all([
        _relate(one("本工序使用(.+?)（型号", "Device", "dev"), "dev", "USED_IN", proc, "proc"),
        _relate(proc, "proc", "USES_MATERIAL", one("(?s)三、耗用物料\\n(.*?)(?:四、|五、|$)", "Material", "mat", first=False), "mat"),
        _relate(one("(?s)重点拦截的不良现象：(.+?)。\\n", "Defect", "defect", first=False), "defect", "OCCURS_AT", proc, "proc"),
        _relate(one("(?s)其中(.+?)属于.+?的细分", "Defect", "child"), "child", "SUBCLASS_OF", one("(?s)其中.+?属于(.+?)的细分", "Defect", "parent"), "parent"),
        _relate(one("(?s)工序流转：(.+?)完工", "Process", "prev"), "prev", "PRECEDES", one("(?s)工序流转：.+?完工.*?进入(.+?)。", "Process", "curr"), "curr"),
    ])
