"""A training-corpus pipeline over ``documents``: each stage's rows are written and read again as the next one's input.

Language ID drops texts of no language, the n-gram Jaccard join keeps one document of each group of near copies, decontamination cuts benchmark passages (and
drops documents that are little else), PII puts a mark in the place of personal data, packing cuts what is left into sequences. All stages but the last
return the columns of ``documents``; a null text is of no language and goes in the first stage. An empty table passes through all of them.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowsieve.llm import decontaminate, jaccard, language, packing, pii  # noqa: E402
from flowsieve.llm.common import table  # noqa: E402
from flowsieve.session import durable  # noqa: E402


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    del spark, sf_dir
    return packing.pack(docs)


STAGES = [("language", language.stage), ("near_copies", jaccard.stage), ("decontamination", decontaminate.stage), ("pii", pii.stage), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
