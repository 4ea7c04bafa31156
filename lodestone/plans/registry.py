"""All queries of the engine, by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decisions, files, records, sequences, summaries, texts  # noqa: F401  registration
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit_summary(spark, sf_dir)
