"""Queries over record files: tables are written in a format of files and read back by its reader."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, splits, validate
from lodestone.sources import readers, sinks, streams

from .catalogue import Tables, query


def fresh(t: Tables, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    graph._checkpoints(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def lines(t: Tables, name: str, rows: DataFrame, line: Column) -> str:
    path = fresh(t, name)
    rows.select(line.alias("value")).write.text(path)
    return path


@query("SELECT event_id, user_id, round(value, 6) AS value, true AS placed FROM events")
def json_records(t: Tables) -> DataFrame:
    """Events as JSON lines, read with the number of each line."""
    path = lines(t, "events", t.events, F.to_json(F.struct("event_id", "user_id", "value")))
    rows = streams.json_records(t.spark, path, "event_id long, user_id long, value double", rules=[(F.col("event_id").isNull(), "event_id:missing")])
    return rows.select("event_id", "user_id", F.round("value", 6).alias("value"), (F.col("_line") > 0).alias("placed"))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'value:high' END AS error FROM events")
def json_record_errors(t: Tables) -> DataFrame:
    """Events whose value breaks a rule, with the error that names their place."""
    path = lines(t, "events", t.events, F.to_json(F.struct("event_id", "value")))
    rows = streams.json_records(t.spark, path, "event_id long, value double", rules=[(F.col("value") > 100, "value:high")], strict=False)
    return rows.select("event_id", F.regexp_extract("_error", r":\d+: (.*)$", 1).alias("error")).withColumn("error", F.when(F.col("error") != "", F.col("error")))


@query("SELECT page_id, url, md5(html) AS html FROM pages")
def json_array_elements(t: Tables) -> DataFrame:
    """Pages as files that are each one JSON array, cut at every closing brace."""

    def brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([mark + value])], names=["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array([mark.replace(",", "") + "]"])], names=["value"])

    # a file with a single record would have no closing bracket of its own; records of a task follow each other
    rows = t.pages.repartition(4, "page_id").select(F.to_json(F.struct("page_id", "url", "html")).alias("value"))
    path = fresh(t, "pages")
    rows.mapInArrow(brackets, "value string").write.text(path)
    return streams.json_elements(t.spark, path, "page_id long, url string, html string").select("page_id", "url", F.md5("html").alias("html"))


@query("""SELECT doc_id::VARCHAR AS id, length(r)::INT AS length, md5(upper(r)) AS read, false AS faulty FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS r FROM documents)""")
def fastq_records(t: Tables) -> DataFrame:
    """Documents' letters as reads of four lines, whose qualities begin with the mark of a header."""
    read = F.regexp_replace("text", "[^A-Za-z]", "")
    rows = t.documents.select("doc_id", read.alias("r")).select(F.explode(F.array(F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit(" x")), F.col("r"), F.lit("+"), F.repeat(F.lit("@"), F.length("r")))).alias("line"))
    found = streams.fastq(t.spark, lines(t, "reads", rows, F.col("line")))
    return found.select("id", F.length("read").alias("length"), F.md5("read").alias("read"), "faulty")


@query("SELECT doc_id::VARCHAR AS id, lang || ' ' || source AS description, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents")
def fasta_records(t: Tables) -> DataFrame:
    wrapped = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", ""), "(.{60})", "$1\n")
    line = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"), F.lit("\n"), wrapped)
    return readers.fasta(t.spark, lines(t, "fasta", t.documents, line)).select("id", "description", F.md5("sequence").alias("sequence"))


@query("SELECT l_orderkey::VARCHAR AS id, l_returnflag AS reference, l_partkey AS position, l_linenumber % 8 < 4 AS mapped FROM lineitem")
def sam_records(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag", F.col("l_partkey").cast("string"), F.lit("60"))
    return readers.alignments(t.spark, lines(t, "sam", t.lineitem, line))


@query("SELECT event_type AS chrom, event_id AS start, event_id + user_id AS stop, 'e' || event_id AS name, round(value, 6) AS score, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events")
def bed_records(t: Tables) -> DataFrame:
    fields = ["event_type", F.col("event_id").cast("string"), (F.col("event_id") + F.col("user_id")).cast("string"), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("value").cast("string"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-")]
    return readers.intervals(t.spark, lines(t, "bed", t.events, F.concat_ws("\t", *fields))).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part")
def delimited_records(t: Tables) -> DataFrame:
    """Parts as a table with semicolons, which the reader finds out."""
    path = fresh(t, "parts")
    t.part.select("p_partkey", "p_name", "p_brand", "p_size").write.option("header", True).option("sep", ";").csv(path)
    return readers.table(t.spark, path)


@query("SELECT p_partkey::VARCHAR AS key, p_brand AS brand, p_type AS type FROM part")
def block_records(t: Tables) -> DataFrame:
    """Parts as blocks of key and value lines that end with two slashes."""
    line = F.concat(F.lit("key\t"), F.col("p_partkey").cast("string"), F.lit("\nbrand\t"), F.col("p_brand"), F.lit("\ntype\t"), F.col("p_type"), F.lit("\n//"))
    fields = readers.blocks(t.spark, lines(t, "blocks", t.part, line))
    return fields.select(*[F.col("fields")[c].alias(c) for c in ("key", "brand", "type")])


@query("SELECT c_mktsegment, count(*) AS rows, count(*) AS lines, true AS known FROM customer GROUP BY 1")
def written_segments(t: Tables) -> DataFrame:
    """Customers written as JSON lines once a segment, with an inventory of the files and a manifest that knows each segment."""
    path = fresh(t, "segments")
    t.customer.write.partitionBy("c_mktsegment").json(path)
    segment = F.regexp_replace(F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1), "%20", " ")
    files = sinks.inventory(t.spark, path, "*.json").groupBy(segment.alias("c_mktsegment")).agg(F.sum("lines").alias("lines"))
    rows = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"))
    manifest = fresh(t, "manifest")
    for part in (rows.where("c_mktsegment < 'C'"), rows):  # the second time, known segments are left as they are
        sinks.append_manifest(t.spark, part, manifest, ["c_mktsegment"], ["rows"])
    known = t.spark.read.parquet(manifest).groupBy("c_mktsegment").agg((F.count(F.lit(1)) == 1).alias("known"))
    return rows.join(files, "c_mktsegment").join(known, "c_mktsegment").select("c_mktsegment", "rows", "lines", "known")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE user_id::VARCHAR END AS value FROM events")
def null_masks_later_keys(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    fields = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), none, F.lit("b"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("b"), F.col("event_type"), F.lit("c"), none)).otherwise(F.create_map(F.lit("c"), F.col("user_id").cast("string")))
    return t.events.select("event_id", T.first_present(fields, "a", "b", "c").alias("value"))


@query("SELECT c_custkey, 'c' || c_custkey || '_' || substr(sha256(c_custkey || chr(31) || c_name || chr(31) || c_mktsegment), 1, 16) AS id FROM customer")
def stable_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.stable_id("c", F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("""WITH r AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS r FROM documents), s AS (SELECT doc_id, r, len(regexp_extract_all(r, '[Nn]')) AS u, length(r) AS n, CASE WHEN length(r) = 0 THEN 0 ELSE list_sum(list_transform(string_split(r, ''), lambda c: greatest(ascii(c) - 83, 0))) END AS q FROM r)
SELECT doc_id, n::INT AS length, round_even(CASE WHEN n > 0 THEN u / n ELSE 0 END, 4) AS unknown, round_even(CASE WHEN n > 0 THEN q / n ELSE 0 END, 2) AS mean_quality,
  concat_ws(';', CASE WHEN n < 20 THEN 'too_short' END, CASE WHEN n > 0 AND u / n > 0.3 THEN 'too_many_unknown' END, CASE WHEN contains(r, 'tion') THEN 'adapter' END, CASE WHEN (CASE WHEN n > 0 THEN q / n ELSE 0 END) < 15 THEN 'low_quality' END) AS reasons FROM s""")
def read_qualities(t: Tables) -> DataFrame:
    """Documents' letters as reads, each letter 50 places down as its quality."""
    down = "".join(chr(max(33, ord(c) - 50)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    letters = t.documents.select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", "").alias("letters"))
    quality = F.translate("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", down)
    out = letters.select("doc_id", T.read_quality(F.col("letters"), quality, ["tion"]).alias("q"))
    return out.select("doc_id", "q.length", F.round("q.unknown", 4).alias("unknown"), F.round("q.mean_quality", 2).alias("mean_quality"), F.array_join("q.reasons", ";").alias("reasons"))


@query("""WITH v AS (SELECT user_id, bool_or(event_type = 'purchase') AS y, bool_or(event_type = 'error') AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN y AND NOT n THEN 1 WHEN n AND NOT y THEN 0 END AS outcome FROM v""")
def outcomes(t: Tables) -> DataFrame:
    """Users whose events speak of purchases or of errors only."""
    return t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("v")).select("user_id", T.outcome(F.col("v"), "purchase", "error").alias("outcome"))


@query("SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') OR regexp_matches(p_type, '[aeiou]{2}') AS found FROM part")
def matches_by_column_name(t: Tables) -> DataFrame:
    """Parts where a column whose name holds name or type has two vowels in a row."""
    return t.part.select("p_partkey", T.matches_in_columns(t.part, ["name", "type"], "[aeiou]{2}").alias("found"))


@query("SELECT doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS turned FROM documents")
def reverse_complements(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.reverse_complement(F.col("text"))).alias("turned"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' ELSE 'other' END AS kind FROM pages")
def file_kinds(t: Tables) -> DataFrame:
    """Pages' contents behind the first bytes of different kinds of files."""
    k = F.col("page_id") % 4
    head = F.when(k == 0, F.unhex(F.lit("1F8B08"))).when(k == 1, F.unhex(F.lit("255044462D"))).when(k == 2, F.unhex(F.lit("89504E470D0A"))).otherwise(F.lit(b"<"))
    return t.pages.select("page_id", validate.file_kind(F.concat(head, F.col("html").cast("binary"))).alias("kind"))


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY sha256('7:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(t: Tables) -> DataFrame:
    return splits.sample_n(t.customer, "c_custkey", 100, 7).select("c_custkey", "c_mktsegment")
