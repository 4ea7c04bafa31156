"""Readers of record files. Only Spark's readers touch paths; every file format is split where it can be."""

from __future__ import annotations

import fnmatch
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.textmine import few


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Records with ``_corrupt`` (lines that are no JSON object) and ``_file``; ``strict`` fails on the first of them. Blank lines are skipped."""
    frame = spark.read.schema(schema if strict else f"{schema}, _corrupt string")
    frame = frame.option("mode", "FAILFAST") if strict else frame.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return frame.json(path).withColumn("_file", F.col("_metadata.file_path"))


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of files that are each one JSON array (or one object): one task a file, as such files cannot be split."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = ("\t", ";", ",")) -> str:
    """The candidate that stands most often in the first line (one row reaches the driver)."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    line = first[0]["value"] if first else ""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))


def delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A table with a header line, all columns strings; a byte order mark at its start is dropped."""
    frame = spark.read.option("header", True).option("sep", separator or sniff_separator(spark, path)).option("mode", "PERMISSIVE").csv(path)
    return frame.toDF(*[c.lstrip("﻿").strip() for c in frame.columns])


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Dispatch by suffix: parquet, jsonl, json, fasta, else delimited; .gz is transparent."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".jsonl", ".ndjson", ".json")):
        frame = spark.read if schema is None else spark.read.schema(schema)
        return frame.option("multiLine", name.endswith(".json")).json(path)
    if name.endswith((".fa", ".fasta", ".faa", ".fna")):
        return fasta(spark, path)
    return delimited(spark, path)


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The delimited table, or an empty one of ``schema`` where there is no path or nothing at it."""
    try:
        return spark.createDataFrame([], schema) if path is None else delimited(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fasta(spark: SparkSession, path: str, others: bool = False) -> DataFrame:
    """(id, description, sequence): records start with ``>``; split at records, so plain files are read in parallel.

    Text before a file's first ``>`` is an error, which costs a second pass
    over the files. ``others``: without the first record of each file.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.length(F.trim("value")) > 0)
    # only the first record of a file still has its mark
    marked = F.col("value").startswith(">")
    begun = raw.groupBy("_file").agg(F.bool_or(marked).alias("_begun"))
    # a row a file: its records stay where they are unless there are very many files
    checked = raw.join(F.broadcast(begun) if few(begun) else begun, "_file").where(F.when(F.col("_begun"), True).otherwise(F.raise_error(F.concat(F.lit("no header at the start of "), F.col("_file"))).cast("boolean")))
    block = (checked.where(~marked) if others else checked).select(F.regexp_replace("value", "^>", "").alias("b"))
    head = F.regexp_extract("b", r"^([^\r\n]*)", 1)
    return block.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.regexp_replace(F.regexp_replace("b", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, read, quality, faulty): records of four lines; faulty where the record's shape is broken.

    A file is read whole by one task, as records cannot be told from within it.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int"))
    # records are formed before they are exploded, so that none carries the file's lines
    at = files.select("file", F.explode(F.transform(starts, lambda k: F.slice("lines", k * 4 + 1, F.lit(4)))).alias("record"))
    line = lambda i: F.get("record", F.lit(i))
    good = line(0).startswith("@") & line(2).startswith("+") & (F.length(line(1)) == F.length(line(3)))
    return at.select("file", F.regexp_extract(line(0), r"^@?(\S*)", 1).alias("id"), line(1).alias("read"), line(3).alias("quality"), (~F.coalesce(good, F.lit(False))).alias("faulty"))


def file_integrity(records: DataFrame) -> DataFrame:
    """(file, records, valid) of ``fastq`` records: one faulty record makes a file invalid."""
    return records.groupBy("file").agg(F.count(F.lit(1)).alias("records"), (~F.bool_or("faulty")).alias("valid"), F.avg(F.length("read")).alias("mean_length"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(id, reference, position, mapped) of SAM files; header lines and lines of under three columns are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(parts) > 2))
    flag = F.get(parts, F.lit(1)).try_cast("int")
    return rows.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(2)).alias("reference"), F.get(parts, F.lit(3)).try_cast("long").alias("position"), (F.coalesce(flag, F.lit(4)).bitwiseAND(4) == 0).alias("mapped"))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, name, score, strand) of BED files with six columns at least."""
    p = F.split("value", "\t")
    names = [("chrom", "string"), ("start", "long"), ("stop", "long"), ("name", "string"), ("score", "double"), ("strand", "string")]
    return spark.read.text(path).where(F.size(p) >= 6).select(*[F.get(p, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])


def aligned_texts(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records of an alignment but for the first of each file, the query; without insertions (lower-case letters and dots)."""
    return fasta(spark, path, others=True).withColumn("sequence", F.regexp_replace("sequence", "[a-z.]", ""))


def blocks(spark: SparkSession, path: str, separator: str = "//", keys: Sequence[str] | None = None) -> DataFrame:
    """(fields): a map of each block's ``key<TAB>value`` lines; blocks end with a line ``separator``. ``keys``: a block with other keys, more or fewer, is an error."""
    rows = spark.read.option("lineSep", f"\n{separator}").text(path).select(F.trim(F.regexp_replace("value", r"^[\r\n]+", "")).alias("b")).where(F.col("b") != "")
    lines = F.filter(F.split("b", r"\r?\n"), lambda x: F.contains(x, F.lit("\t")))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "\t", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^\t]*\t", "")).alias("v")))
    found = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    out = rows.select(F.map_from_entries(F.transform(found, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("v")))).alias("fields"))
    if keys is None:
        return out
    got = F.array_sort(F.map_keys("fields"))
    same = got == F.array(*[F.lit(k) for k in sorted(keys)])
    return out.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("a block has the keys "), F.array_join(got, ", ")))).cast("boolean"))


def features(spark: SparkSession, path: str, kind: str = "CDS") -> DataFrame:
    """(file, place, qualifiers map) of one kind of entry of GenBank feature tables; values may go on over lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    entries = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(rf"(?m)^     {kind}\s+(\S[^\n]*(?:\n {{21}}[^\n]*)*)"), F.lit(1))).alias("e"))
    joined = F.regexp_replace("e", r"\s*\n\s+", " ")
    pairs = F.regexp_extract_all(joined, F.lit(r"/(\w+=\"[^\"]*\"|\w+=[^\s/]+)"), F.lit(1))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    value = lambda k: F.trim(F.regexp_replace(F.element_at(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == k), 1), "^[^=]*=", ""), F.lit('"'))
    return entries.select("file", F.regexp_extract(joined, r"^(\S+)", 1).alias("place"), F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k)))).alias("qualifiers"))


def link_rows(text: Column) -> Column:
    """Array of (name, url) of the Markdown links of a text."""
    links = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\]\([^)\s]*\))"), F.lit(1))
    return F.transform(links, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("name"), F.regexp_extract(x, r"\(([^)]*)\)$", 1).alias("url")))


def section_titles(xml: Column) -> Column:
    """Titles of the sections of well-formed XML; null where a parser finds it not well formed."""
    broken = F.from_xml(xml, "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"]
    return F.when(F.coalesce(xml.rlike(r"(?s)^\s*<.*>\s*$") & broken.isNull(), F.lit(False)), F.xpath(xml, F.lit("//sec/title/text()")))


def section_paragraphs(xml: Column) -> Column:
    """Texts of the paragraphs of the sections of well-formed XML, markup left out and blanks drawn together; null where it is not well formed."""
    sections = F.regexp_extract_all(xml, F.lit(r"(?s)<sec(?:\s[^>]*)?>(.*)</sec>"), F.lit(1))
    paragraphs = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))))
    plain = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"\s+", " ")))
    return F.when(section_titles(xml).isNotNull(), F.filter(plain, lambda p: p != ""))


def archive_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, member, number, line) of the text members of zip and tar archives (gzip too) whose names match.

    An archive is read by one task, as archives cannot be split; its lines
    leave in batches. Lines are UTF-8, faulty bytes replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple[str, str, int, str]] = []
                for member, number, line in _members(content.as_buffer()):
                    if fnmatch.fnmatch(member, pattern):
                        rows.append((archive, member, number, line))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["archive", "member", "number", "line"]
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("number", pa.int64()), ("line", pa.string())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, number long, line string")


def _members(content: pa.Buffer) -> Iterator[tuple[str, int, str]]:
    file = pa.BufferReader(content)
    if zipfile.is_zipfile(file):
        with zipfile.ZipFile(file) as archive:
            for name in archive.namelist():
                if not name.endswith("/"):
                    with archive.open(name) as stream:
                        yield from ((name, k, line.decode("utf-8", "replace").rstrip("\r\n")) for k, line in enumerate(stream))
        return
    file.seek(0)
    with tarfile.open(fileobj=file, mode="r:*") as archive:
        for entry in archive:
            if entry.isfile() and (stream := archive.extractfile(entry)) is not None:
                yield from ((entry.name, k, line.decode("utf-8", "replace").rstrip("\r\n")) for k, line in enumerate(stream))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of all files below a folder; contents are not read. Spark's listing leaves out empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def vectors(table: DataFrame, wanted: DataFrame, key: str, place: str, **fields: str) -> DataFrame:
    """The wanted keys in their order with their rows, of those whose ``fields`` (view, track) have these values; a key without a row raises when it is read."""
    for name, value in fields.items():
        table = table.where(F.col(name) == value)
    joined = wanted.join(table.withColumn("_found", F.lit(True)), key, "left")
    checked = joined.where(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return checked.drop("_found").orderBy(place)


def path_records(paths: DataFrame, patterns: dict[str, str], constants: dict[str, object], path: str = "path") -> DataFrame:
    """One record a path: the first group of each pattern (null where it is not found), and constant columns."""
    found = {name: F.regexp_extract(path, pattern, 1) for name, pattern in patterns.items()}
    return paths.select(path, *[F.when(c != "", c).alias(name) for name, c in found.items()], *[F.lit(v).alias(name) for name, v in constants.items()])


def names_in_paths(paths: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """(name): the distinct first groups of the pattern over all paths."""
    return path_records(paths, {"name": pattern}, {}, path).select("name").where(F.col("name").isNotNull()).distinct()
