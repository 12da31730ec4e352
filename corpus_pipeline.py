"""A corpus pipeline over `documents`: rules, line and near dedup, redaction, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_dedup, near_dedup, packing, pii, quality
from quillspark.llm.util import cut, table

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: SQL expresses neither the linked lines nor the tokenizer. The tests hold the operator of
#: each stage against a brute-force version, and the stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
