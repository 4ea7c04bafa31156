"""Spelling variant grouping by a symmetric-delete join.

Tasks count a document's letter runs and Spark sums the counts of the words.
Every word emits itself and its distinct single deletions, each as a 128-bit
checksum with the range of places whose deletion gives it; an equi-join on the
checksum brings together the words that share one. Two words are near exactly
if one is the shared string itself and the other a deletion, or if both are
deletions and some place lies in both ranges (then they differ in that place
alone); so each near pair is found once, and strings, which for one long word
would be as many copies as it has letters, need not travel.

A shared string of L letters has at most 1 + (L + 1) * a words, a being the
letters that a run may have (some 90), so no key is hot whatever the corpus;
frequent words are summed within tasks first. A word's form has at least
``ratio`` times its occurrences, so chains have at most log10 of the corpus's
length, and each round of joins doubles what has been followed. All joins are
of tables without a size bound and never broadcast: Spark sizes the shared
strings by the packed file of the words they are made of.

Defined cases: null texts have no words; a null id is spelled as '' before the
colon; repeated rows are documents of their own with the same deletions;
equal counts give the form that is first in code-point order; an empty table
gives no rows; other columns are ignored; words of any length take part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, materialise, read_table

#: Least letters and occurrences of a word, how much more frequent a form is, one run in so many loses a letter.
LETTERS = 7
OCCURRENCES = 2
RATIO = 10
NOISE = 31
HELD = 300_000
TAKEN = 2_000_000
KEYS = 50_000
ROUNDS = 40


def _count(letters: int, noise: int, held: int):
    """Words and their counts. A text in Latin-1 has one byte a letter, and bytes.lower() changes A-Z only; other characters become '?'."""
    runs = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            names = [w.decode("latin-1") for w in words]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            column = batch.column("text")
            for a, b in by_bytes(pc.binary_length(column).to_pylist(), TAKEN):
                for doc_id, text in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist()):
                    prefix = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in Counter(runs.findall(text.encode("latin-1", "replace").lower())).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if not h % noise:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                        words[word] += n
                    if len(words) >= held:
                        yield flush()
                        words = Counter()
        if words:
            yield flush()

    return run


def noisy_words(docs: DataFrame, letters: int = LETTERS, noise: int = NOISE, occurrences: int = OCCURRENCES, held: int = HELD) -> DataFrame:
    """(word, n): the words of at least ``letters`` letters and ``occurrences`` occurrences, one run in ``noise`` having lost a letter."""
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(_count(letters, noise, held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def deletions(word: str) -> Iterator[tuple[str, int, int]]:
    """The word itself, as (word, -1, -1), and each distinct single deletion with the first and last place that give it."""
    yield word, -1, -1
    a = 0
    while a < len(word):
        b = a
        while b + 1 < len(word) and word[b + 1] == word[a]:
            b += 1
        yield word[:a] + word[a + 1 :], a, b
        a = b + 1


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    names = ["key", "lo", "hi", "id", "n"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        for i, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            for key, lo, hi in deletions(word):
                rows.append((digest(key.encode()), lo, hi, i, n))
                if len(rows) >= KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n, other, other_n) for rows (id, word, n) of distinct words: both directions of every pair that differs by one inserted, deleted or replaced letter."""
    keys = words.mapInArrow(_keys, "key binary, lo int, hi int, id long, n long")
    a, b = (keys.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("lo", "hi", "id", "n"))) for side in "ab")
    whole_a, whole_b = F.col("a_lo") < 0, F.col("b_lo") < 0
    replaced = ~whole_a & ~whole_b & (F.greatest("a_lo", "b_lo") <= F.least("a_hi", "b_hi"))
    met = a.join(b.hint("merge"), "key").where((F.col("a_id") != F.col("b_id")) & ((whole_a != whole_b) | replaced))
    return met.select(F.col("a_id").alias("id"), F.col("a_n").alias("n"), F.col("b_id").alias("other"), F.col("b_n").alias("other_n"))


def roots(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, root) for a table (id, form) of a forest: every node with a form, and the last of its forms. Each round doubles the steps followed."""
    now = materialise(links.select("id", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        joined = now.join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = materialise(joined, "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("id", "root")
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts."""
    # numbers in code-point order, fixed by writing them
    words = materialise(words.select("word", "n").orderBy("word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    best = F.max(F.struct(F.col("other_n").alias("form_n"), (-F.col("other")).alias("turned")))
    near = near_words(words).groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.col("best.form_n") >= ratio * F.col("n")
    near = near.select("id", "n_near", F.when(formed, -F.col("best.turned")).alias("form_id"), F.when(formed, F.col("best.form_n")).alias("form_n"))
    near = materialise(near, "spelling-near")
    root = roots(near.where(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("form"))).select("id", F.col("root").alias("root_id"))
    named = words.select(F.col("id").alias("name_id"), F.col("word").alias("name")).hint("merge")
    found = words.join(near.hint("merge"), "id", "left").join(root.hint("merge"), "id", "left")
    found = found.join(named.withColumnsRenamed({"name_id": "form_id", "name": "form"}), "form_id", "left").join(named.withColumnsRenamed({"name_id": "root_id", "name": "root"}), "root_id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(noisy_words(read_table(spark, sf_dir, "documents")))


#: crc32 is a fold over bytes with its table of 256 remainders, each made by eight steps.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i)
  )
),
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT row_number() OVER () AS k, doc_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word FROM documents WHERE text IS NOT NULL
  ) WHERE length(word) >= 7 GROUP BY doc_id, word
),
hashed AS (
  SELECT word, n, xor(4294967295, list_reduce(
    [4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || word, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END)),
    lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT]))) AS h
  FROM runs, crc
),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2) ELSE word END AS word, n FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
keys AS (SELECT DISTINCT word, n, unnest([word] || list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS key FROM words),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE length(a.word) <> length(b.word) AND (a.key = a.word OR b.key = b.word)
    OR length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word, n
),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word
),
walk AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM formed
  UNION ALL
  SELECT w.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM walk w JOIN formed f ON f.word = w.root WHERE w.more
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND NOT w.more
"""
