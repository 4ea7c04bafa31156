"""Record files of any size, read in parallel by byte ranges: numbered lines, JSON lines with places, FASTQ, JSON arrays.

Spark's text reader splits files into blocks and streams each block's parts
(lines, or what lies between other separators). A block's parts are counted in
a first pass; the counts of earlier blocks then number the parts of a file in
order, whatever the number of tasks that read it. The table of blocks has a
row for each range of a file (some 128 MB); it is broadcast where it has at
most a million rows and else joined by a shuffle, after which parts are put in
order again. Compressed files are one block, streamed by one task. Spark lists
no empty files, so they give no records and no error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import reasons
from lodestone.operators.textmine import few
from lodestone.operators.validate import Rule, record_rules


def _parts(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(value, _file, _block, _id): parts in a block's order; _id grows by one from part to part of a block."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def _with_blocks(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parts with their block's columns, in order within every task."""
    if few(blocks):
        return parts.join(F.broadcast(blocks), ["_file", "_block"])
    return parts.join(blocks, ["_file", "_block"]).sortWithinPartitions("_file", "_block", "_id")


def numbered(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(value, _file, _block, _number from 0, _start and _n of the block, _total of the file) of every line, or part between separators."""
    parts = _parts(spark, path, separator)
    of_file = Window.partitionBy("_file")
    blocks = parts.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    blocks = blocks.withColumns({"_start": F.sum("_n").over(of_file.orderBy("_block")) - F.col("_n"), "_total": F.sum("_n").over(of_file)})
    return _with_blocks(parts, blocks).withColumn("_number", F.col("_start") + F.col("_id") - F.col("_first")).drop("_id", "_first")


def json_records(spark: SparkSession, path: str | list[str], schema: str, kind: str | None = None, rules: Sequence[Rule] = (), strict: bool = True) -> DataFrame:
    """Records of JSON lines with ``_file`` and ``_line`` (from 1); blank lines are skipped.

    A line that is no JSON object of the schema, or breaks a rule of its
    ``kind`` (feature, label, graph) or of ``rules``, is an error that names
    its file and line. ``strict=False`` keeps such rows, with ``_error``
    (``file:line: reasons``; null for sound ones).
    """
    lines = numbered(spark, path).where(F.trim("value") != "")
    parsed = lines.select("_file", (F.col("_number") + 1).alias("_line"), F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    rows = parsed.select("_r.*", "_file", "_line")
    every = [*(record_rules(kind) if kind else []), *rules]
    sound = F.col("_corrupt").isNull()
    broken = F.when(~sound, F.array(F.lit("no JSON object of the schema"))).otherwise(reasons(*every) if every else F.array().cast("array<string>"))
    error = F.when(F.size(broken) > 0, F.concat_ws("", F.col("_file"), F.lit(":"), F.col("_line").cast("string"), F.lit(": "), F.array_join(broken, "; ")))
    out = rows.withColumn("_error", error).drop("_corrupt")
    if not strict:
        return out
    return out.where(F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(True)).drop("_error")


def _fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four lines in a row are a record; only whole records of a block come here."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        whole = rows.num_rows - rows.num_rows % 4
        held = rows.slice(whole)
        if whole:
            rows = rows.slice(0, whole)
            at = lambda i: pa.array(range(i, whole, 4), pa.int64())  # noqa: E731, B023
            columns = [rows.column("_file").take(at(0)), *(rows.column("value").take(at(i)) for i in range(4))]
            yield from pa.table(columns, names=["file", "l0", "l1", "l2", "l3"]).to_batches()


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, id, read, quality, faulty): records of four lines; faulty where a record's shape is broken or its end is missing.

    A line's number in its file tells its place in the record (its first
    character cannot: ``@`` is a quality too). Records within a block are
    formed where they are read; the at most two that a block shares with its
    neighbours meet by their number. Blank lines after the last record are
    no record. Reads are in upper case.
    """
    lines = numbered(spark, path).withColumn("value", F.regexp_replace("value", r"\s+$", ""))
    record = F.floor(F.col("_number") / 4)
    inside = (record * 4 >= F.col("_start")) & (record * 4 + 4 <= F.col("_start") + F.col("_n"))
    whole = lines.where(inside).select("_file", "value").mapInArrow(_fours, "file string, l0 string, l1 string, l2 string, l3 string")
    line = lambda i: F.max(F.when(F.col("_number") % 4 == i, F.col("value"))).alias(f"l{i}")
    edges = lines.where(~inside).groupBy(F.col("_file").alias("file"), record.alias("_record")).agg(*map(line, range(4)))
    every = whole.unionByName(edges.drop("_record")).where(F.concat_ws("", "l0", "l1", "l2", "l3") != "")
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    return every.select("file", F.regexp_extract(F.coalesce("l0", F.lit("")), r"^@?(\S*)", 1).alias("id"), F.upper("l1").alias("read"), F.col("l3").alias("quality"), (~F.coalesce(good, F.lit(False))).alias("faulty"))


#: A string, or the rest of one that began earlier; the group is empty where it does not end.
STRING = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*("|\Z)', re.S)
REST = re.compile(r'(?:[^"\\]|\\.|\\\Z)*("|\Z)', re.S)
BETWEEN = re.compile(r"[\s,]*")
BEGIN = re.compile("﻿?\\s*")


def outside(part: str, inside: bool) -> tuple[bool, str]:
    """Whether the part ends inside a string, and what of it lies outside strings (which leave a quote)."""
    if inside:
        m = REST.match(part)
        if not m.group(1):
            return True, ""
        part = part[m.end() :]
    if '"' not in part:
        return False, part
    ends = STRING.findall(part)
    return ends[-1] == "", STRING.sub('"', part)


def steps(text: str) -> tuple[int, int]:
    """How much deeper the text ends than it begins, and its lowest depth on the way."""
    depth = low = 0
    for c in text:
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            low = min(low, depth)
    return depth, low


SUMMARY = "_file string, _block long, in0 boolean, depth0 long, low0 long, in1 boolean, depth1 long, low1 long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state of a reader that enters it outside (0) or inside (1) a string."""
    now: tuple[str, int] | None = None
    state: list[list] = []

    def row() -> pa.RecordBatch:
        columns = zip((pa.string(), pa.int64(), *(pa.bool_(), pa.int64(), pa.int64()) * 2), (*now, *state[0], *state[1]))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for t, v in columns], names=[c.split()[0] for c in SUMMARY.split(", ")])

    for batch in batches:
        for file, block, part in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "value"))):
            if now != (file, block):
                if now:
                    yield row()
                now, state = (file, block), [[False, 0, 0], [True, 0, 0]]
            for s in state:
                s[0], text = outside(part, s[0])
                deeper, low = steps(text if s[0] else text + "}")
                s[2] = min(s[2], s[1] + low)
                s[1] += deeper
    if now:
        yield row()


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered, from the blocks of its file in order: inside a string, depth, the block where the open element began."""
    file, inside, depth, opener = None, False, 0, -1
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["_file"] != file:
                file, inside, depth, opener = r["_file"], False, 0, -1
            out.append((r["_file"], r["_block"], inside, depth, opener))
            k = int(inside)
            if depth + r[f"low{k}"] <= 1:
                opener = r["_block"]
            inside, depth = r[f"in{k}"], depth + r[f"depth{k}"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["_file", "_block", "_inside", "_depth", "_opener"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that begin and end in a block, and the pieces of those that do not, by the block where they begin."""
    now: tuple[str, int] | None = None
    inside, depth, opener, held, out = False, 0, -1, [], []
    names = ["_file", "_opener", "_block", "_whole", "element"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def close() -> None:
        if now and held:
            out.append((now[0], opener, now[1], False, "".join(held)))

    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if now != (r["_file"], r["_block"]):
                close()
                now, held = (r["_file"], r["_block"]), []
                inside, depth, opener = r["_inside"], r["_depth"], r["_opener"]
            part, last = r["value"], r["_last"]
            if depth == 0:
                part = part[BEGIN.match(part).end() :] if r["_number"] == 0 else part
                if r["_number"] == 0 and part.startswith("["):
                    depth, part = 1, part[1:]
                elif r["_number"] == 0:
                    raise ValueError(f"{now[0]}: expected a JSON array")
                elif part.strip() or not last:
                    raise ValueError(f"{now[0]}: text after the array")
            if depth == 1:
                part = part[BETWEEN.match(part).end() :]
                if part.startswith("]") and last and not part[1:].strip():
                    depth = 0
                    continue
                if not part.startswith("{") and (part or not last):
                    raise ValueError(f"{now[0]}: expected elements that are JSON objects, found {part[:40]!r}")
                opener = now[1]
            if last and depth:
                raise ValueError(f"{now[0]}: the array is not closed")
            inside, text = outside(part, inside)
            depth += steps(text if inside else text + "}")[0]
            held.append(part + "}")
            if depth == 1:
                out.append((now[0], opener, now[1], opener == now[1] and not (r["_depth"] > 1 and opener == r["_opener"]), "".join(held)))
                size += len(out[-1][4])
                held = []
                if size > 4_000_000:
                    yield flush()
                    out, size = [], 0
            elif depth < 1:
                raise ValueError(f"{now[0]}: brackets do not match")
    close()
    if out:
        yield flush()


def json_elements(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records (with ``_file``) of files that are each one JSON array of objects, of any size and layout, read by byte ranges.

    Files are cut at every ``}``. A first pass tells what each range does to
    quotes and depth if it is entered outside or inside a string; these steps,
    chained range by range, give the state in which a range is entered, and a
    second pass cuts elements where the depth returns to 1. An element over
    several ranges is put together from its pieces. Errors: no array, an
    element that is no object or does not fit the schema, an array that is not
    closed, text after it.
    """
    # the tail of a file is what follows its last brace
    parts = numbered(spark, path, "}").withColumn("_last", F.col("_number") == F.col("_total") - 1)
    steps_of = _parts(spark, path, "}").mapInArrow(_summaries, SUMMARY)
    entered = steps_of.repartition("_file").sortWithinPartitions("_file", "_block").mapInArrow(_entered, "_file string, _block long, _inside boolean, _depth long, _opener long")
    state = parts.join(F.broadcast(entered), ["_file", "_block"]) if few(entered) else parts.join(entered, ["_file", "_block"]).sortWithinPartitions("_file", "_block", "_number")
    found = state.select("value", "_file", "_block", "_number", "_last", "_inside", "_depth", "_opener").mapInArrow(_elements, "_file string, _opener long, _block long, _whole boolean, element string")
    pieces = found.where(~F.col("_whole")).groupBy("_file", "_opener").agg(F.array_sort(F.collect_list(F.struct("_block", "element"))).alias("_p"))
    joined = pieces.select("_file", F.array_join(F.transform("_p", lambda p: p["element"]), "").alias("element"))
    every = found.where("_whole").select("_file", "element").unionByName(joined)
    record: Column = F.from_json("element", schema, {"mode": "FAILFAST"})
    return every.select(record.alias("_r"), "_file").select("_r.*", "_file")
