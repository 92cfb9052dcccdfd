"""The closed vocabulary: entity labels, relation types with domain and range, and question intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: labels, relation types, domains and ranges, display names
LABELS = {
    "Device": "设备",
    "Process": "工序",
    "Material": "物料",
    "Defect": "不良现象",
    "Cause": "原因",
    "Countermeasure": "对策",
}
RELATIONS = {
    "USED_IN": ("Device", "Process", "用于工序"),
    "USES_MATERIAL": ("Process", "Material", "耗用物料"),
    "OCCURS_AT": ("Defect", "Process", "发生于工序"),
    "CAUSED_BY": ("Defect", "Cause", "归因于"),
    "ADDRESSED_BY": ("Cause", "Countermeasure", "对策为"),
    "TARGETS": ("Countermeasure", "Device", "作用于"),
    "INDUCED_BY_MATERIAL": ("Defect", "Material", "物料诱发"),
    "SUBCLASS_OF": ("Defect", "Defect", "细分为"),
    "PRECEDES": ("Process", "Process", "前序工序"),
}
#: Relations whose target may have any label.
POLYMORPHIC = ("TARGETS",)

#: Intent of a question, and the label that its answers have.
INTENT_LABELS = {
    "defect_to_process": "Process",
    "process_to_defects": "Defect",
    "defect_to_causes": "Cause",
    "device_to_process": "Process",
    "process_to_materials": "Material",
    "defect_to_countermeasures": "Countermeasure",
    "process_defect_count": "Defect",
    "material_to_defects": "Defect",
    "process_aggregate_cm": "Countermeasure",
}


def labels(spark: SparkSession) -> DataFrame:
    """(label, display)."""
    return spark.createDataFrame(list(LABELS.items()), "label string, display string")


def relations(spark: SparkSession) -> DataFrame:
    """(rel, domain, range, display, polymorphic)."""
    return spark.createDataFrame([(r, d, g, n, r in POLYMORPHIC) for r, (d, g, n) in RELATIONS.items()], "rel string, domain string, range string, display string, polymorphic boolean")


def intents(spark: SparkSession) -> DataFrame:
    """(intent, label)."""
    return spark.createDataFrame(list(INTENT_LABELS.items()), "intent string, label string")
