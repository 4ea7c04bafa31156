"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet into the shared folder and reads it back as the
next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe_words import stage_encode
from lodestone.llm.common import materialise, read_table
from lodestone.llm.fuzzy_lines import stage_lines
from lodestone.llm.jaccard_forest import stage_near_duplicates
from lodestone.llm.language_id import stage_language
from lodestone.llm.mixing import stage_mix

STAGES = [
    ("language", stage_language),
    ("lines", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("mix", stage_mix),
    ("encode", stage_encode),
]

#: The stages are not expressible in SQL (n-gram filters, SimHash and MinHash graphs, cube sampling, BPE).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
