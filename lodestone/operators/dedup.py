"""Exact duplicates, keeping one row a key, and recovery of names by content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, content: Column, row_id: str) -> DataFrame:
    """(sha256, n, first_id) of contents that occur more than once."""
    return rows.where(content.isNotNull()).groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id")).where("n > 1")


def duplicate_stats(rows: DataFrame, content: Column) -> DataFrame:
    """One row: rows, unique, excess, groups (contents with several rows)."""
    per = rows.groupBy(F.sha2(content, 256).alias("_sha")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("_sha").alias("unique"), F.sum(F.col("n") - 1).alias("excess"), F.count_if(F.col("n") > 1).alias("groups"))


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which must be total), by an aggregate with partial sums.

    min_by over structs combines on the map side, so a hot key costs its
    mappers one row each; a window would bring all its rows to one task.
    """
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def mode_first_seen(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """The most frequent value of each key; ties go to the value seen first."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col("_first"))).alias(value), F.max("n").alias("n"))


def file_local_duplicates(rows: DataFrame, file: str, content: Column) -> DataFrame:
    """One row a file: rows, repeated contents and rows in excess, counted within the file."""
    per = rows.groupBy(file, F.sha2(content, 256).alias("_sha")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(file).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("excess"))


def first_occurrence_counts(rows: DataFrame, content: Column, row_id: str, order: Sequence[str], file: str | None = None) -> DataFrame:
    """(sha256, n, representative): the representative is the first row in ``order``; with ``file`` also files, in how many files the content stands."""
    files = [] if file is None else [F.countDistinct(file).alias("files")]
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min_by(row_id, F.struct(*order)).alias("representative"), *files)


def catalogue(rows: DataFrame, name: str, part: str, quotas: dict[str, int]) -> DataFrame:
    """(part, rows, names, quota, met) of every part with a quota: rows and distinct names (case and outer blanks apart) against the quota of names."""
    per = rows.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.lower(F.trim(name))).alias("names"))
    wanted = rows.sparkSession.createDataFrame(list(quotas.items()), "part string, quota long")
    return wanted.join(per, "part", "left").fillna(0, ["rows", "names"]).select("part", "rows", "names", "quota", (F.col("names") >= F.col("quota")).alias("met"))


def recover_names(rows: DataFrame, known: DataFrame, content: str, name: str) -> DataFrame:
    """Adds recovered and status: the known name of the same content, if there is exactly one.

    ``known`` has ``content`` and ``name``; status: recovered, ambiguous, no_match, not_applicable (no content).
    """
    names = known.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("_sha")).agg(F.countDistinct(name).alias("_n"), F.min(name).alias("_name"))
    joined = rows.withColumn("_sha", F.sha2(content, 256)).join(names, "_sha", "left")
    status = F.when(F.col(content).isNull(), "not_applicable").when(F.col("_n").isNull(), "no_match").when(F.col("_n") > 1, "ambiguous").otherwise("recovered")
    return joined.withColumn("recovered", F.when(F.col("_n") == 1, F.col("_name"))).withColumn("status", status).drop("_sha", "_n", "_name")


def conflicting_content(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys that stand for several contents."""
    return rows.groupBy(key).agg(F.countDistinct(F.sha2(content, 256)).alias("contents")).where("contents > 1")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def neighbours_kept(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in ``order``, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
