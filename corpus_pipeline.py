"""A training-data pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.decontaminate import stage_decontaminate
from ledgerlake.llm.mixing import stage_mix
from ledgerlake.llm.neardup import stage_dedup
from ledgerlake.llm.quality import stage_quality
from ledgerlake.llm.stage import stage, table
from ledgerlake.llm.tokens import stage_tokens

STAGES = [
    ("quality classifier", stage_quality),
    ("near-duplicates", stage_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("mixing to target weights", stage_mix),
    ("token output", stage_tokens),
]

#: The stages train a model, verify near copies and write files; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
