"""Queries over alignments of short texts to long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import align

from .catalogue import Tables, query

#: 60 letters of the benchmark's passages from every 20th place on, with one letter changed in every third.
READS = """r AS (SELECT item_id, i, CASE WHEN i % 3 = 0 THEN substr(w, 1, 30) || '#' || substr(w, 32) ELSE w END AS read FROM (SELECT item_id, unnest(range(0, length(text) - 59, 20)) AS i, substr(text, unnest(range(0, length(text) - 59, 20)) + 1, 60) AS w FROM benchmark)),
d AS (SELECT DISTINCT read FROM r), w AS (SELECT read, '+' AS strand, read AS way FROM d UNION ALL SELECT read, '-', reverse(read) FROM d),
s AS (SELECT read, strand, unnest(range(0, 42)) AS f, substr(way, unnest(range(0, 42)) + 1, 19) AS seed FROM w),
t AS (SELECT doc_id, pos, seed FROM (SELECT doc_id, unnest(range(0, length(text) - 18)) AS pos, substr(text, unnest(range(0, length(text) - 18)) + 1, 19) AS seed FROM documents) WHERE seed IN (SELECT seed FROM s)),
c AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY votes DESC, strand, doc_id, place) AS turn FROM (SELECT read, strand, doc_id, pos - f AS place, count(*) AS votes FROM s JOIN t USING (seed) WHERE seed NOT LIKE '%~%' GROUP BY ALL HAVING count(*) >= 3) QUALIFY turn <= 50)"""


def passages(t: Tables) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.length("text") - 60, F.lit(20)))
    cut = t.benchmark.where(F.length("text") >= 60).select("item_id", i.alias("i"), "text").select("item_id", "i", F.expr("substring(text, i + 1, 60)").alias("w"))
    changed = F.concat(F.substring("w", 1, 30), F.lit("#"), F.substring("w", 32, 29))
    return cut.select("item_id", "i", F.when(F.col("i") % 3 == 0, changed).otherwise(F.col("w")).alias("read"))


@query(f"WITH {READS} SELECT md5(read) AS read, strand, doc_id, place, votes, turn::INT AS turn FROM c")
def seed_votes(t: Tables) -> DataFrame:
    """The 50 places of the documents that most seeds of a passage vote for."""
    found = align.candidates(passages(t), t.documents, "doc_id", "text", complement={}, unknown="~")
    return found.withColumn("read", F.md5("read"))


@query(f"""WITH {READS}, n AS (SELECT c.*, greatest(place - 2, 0) AS start, least(length(text), place + 62) AS stop, text, CASE WHEN strand = '+' THEN read ELSE reverse(read) END AS way FROM c JOIN documents USING (doc_id) WHERE turn <= 10),
o AS (SELECT read, strand, doc_id, turn, start + off AS position, off, len(list_filter(range(1, 61), lambda j: substr(way, j, 1) <> substr(text, start + off + j, 1))) AS mismatches FROM (SELECT *, unnest(range(greatest(0, place - start - 1), stop - start - 59)) AS off FROM n)),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY read, turn ORDER BY mismatches, off) = 1), e AS (SELECT * FROM b WHERE mismatches <= 2 QUALIFY row_number() OVER (PARTITION BY read ORDER BY mismatches, turn) = 1)
SELECT item_id, i::INT AS i, doc_id, strand, position, mismatches::INT AS mismatches, 60.0 - mismatches AS score, floor(40 * (1 - mismatches / 60))::INT AS mapq, CASE WHEN strand = '+' THEN position ELSE position + 60 END AS site FROM r JOIN e USING (read)""")
def passage_alignments(t: Tables) -> DataFrame:
    """Where the benchmark's passages stand in the documents, forwards or backwards."""
    out = align.align(passages(t), t.documents, "doc_id", "text", complement={}, letters=None, unknown="~")
    return out.select("item_id", "i", "doc_id", "strand", "position", "mismatches", "score", "mapq", "site")
