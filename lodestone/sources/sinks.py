"""Writers that refuse to overwrite, append-only manifests, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_json_lines(frame: DataFrame, path: str) -> int:
    """Write JSON lines, never over anything; returns the number of rows, counted on the way."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return int(seen.get["n"])


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def append_manifest(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str], fixed: Sequence[str]) -> None:
    """Append rows whose keys are new to a Parquet manifest; a known key with other ``fixed`` fields is an error. Of several rows of a key the first in the order of all fields is taken."""
    names = rows.columns
    rows = rows.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    try:
        known = spark.read.schema(rows.schema).parquet(path)
        known.limit(0).collect()
    except Exception as e:  # there is no manifest yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.write.parquet(path)
        return
    same = rows.alias("a").join(known.alias("b"), list(keys))
    differ = " OR ".join(f"NOT (a.`{c}` <=> b.`{c}`)" for c in fixed)
    if fixed and not same.where(differ).isEmpty():
        raise ValueError("a known key has other fields now")
    rows.join(known.select(*keys), list(keys), "left_anti").write.mode("append").parquet(path)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, lines) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    text = F.regexp_count(F.col("content").cast("string"), F.lit("\n"))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), text.cast("long").alias("lines"))


def judged_files(files: DataFrame, bad_suffixes: Sequence[str]) -> DataFrame:
    """Adds verdict to (path, bytes): bad_suffix, empty or keep; nothing is deleted."""
    bad = F.lit(False)
    for s in bad_suffixes:
        bad = bad | F.lower("path").endswith(s)
    return files.withColumn("verdict", F.when(bad, "bad_suffix").when(F.col("bytes") == 0, "empty").otherwise("keep"))


def packaged(files: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds reason to files (or rows): the first (condition, reason) that holds, null for those that are packed."""
    reason = F.coalesce(*[F.when(condition, why) for condition, why in rules]) if rules else F.lit(None).cast("string")
    return files.withColumn("reason", reason)
