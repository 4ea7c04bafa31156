"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Each text becomes its set of five-word shingles. Texts with equal sets form a
class; from here on there is one row a class. A class has one label in each of
``TREES`` (16) trees: up to eight 16-bit MinHash values. A tree is its labels
in order, so that classes with a common prefix stand together: a sorted prefix
trie. The tries are dealt to tasks by the shortest prefix that may be needed
(see ``shortest``) and read off in order. Each run of that prefix is matched
from the full label on, and the prefix is then shortened value by value: what
a longer prefix has joined stays joined, and each join is noted with the
length of the prefix that gave it. Signatures that agree in too few places to
reach the threshold (less than five standard deviations below it) do not join;
a run too long for one task joins all its members instead, which only adds
candidates.

How short prefixes must become is then measured: of the joins whose signatures
promise the threshold, the share that prefixes of at least d values give. The
longest d that gives the target recall is taken, and joins of shorter prefixes
are dropped. Connected candidates are verified exactly, every pair of them, in
blocks: shared shingles are counted by matrix products in a task, so no pairs
leave it, only each class's number of links and a spanning forest of its
verified links.

Result: one row a document with ``class_id``, the smallest doc_id of the
documents connected by links, ``n_links``, the number of other documents at
or above the threshold with it (copies included), and ``n_copies``, the
number of documents in its class.

Defined cases: a null or wordless text has no shingles, links with nothing,
and is a class of its own (class_id is its doc_id); a text of one to four
words has one shingle; repeated rows are copies; null doc_ids are left out of
the minimum; extra columns are ignored; an empty table gives no rows. The
input must give the same rows in the same partitions each time it is read (a
file scan or written table), as texts of candidates are fetched in a second
reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, giving_back, materialise, packed_rows, read_table, with_row_id
from .components import connected_components, forest, in_units
from .shingles import mix, overlaps, shingle_sets

THRESHOLD = 0.8
WORDS = 5
#: Trees, values of a label, values by which prefixes may shorten, values of which a byte each is compared.
TREES, LONGEST, STEPS, SAMPLE = 16, 8, 4, 64
TARGET_RECALL = 0.9995
_seeds = np.random.default_rng(7).integers(1, 2**63, TREES * LONGEST, dtype=np.uint64)
FACTORS = _seeds | np.uint64(1)


def recall(depth: int, threshold: float = THRESHOLD) -> float:
    """The probability that a pair at the threshold has a common prefix of ``depth`` values in some tree."""
    return 1 - (1 - threshold**depth) ** TREES


def shortest(threshold: float, target: float = TARGET_RECALL) -> int:
    """The longest prefix that cannot fail the target, even if all pairs are at the threshold; prefixes are never shorter."""
    return next((d for d in range(LONGEST, 1, -1) if recall(d, threshold) >= target), 1)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(FACTORS), np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        np.minimum(low, (part[None, :] * FACTORS[:, None]).min(axis=1), out=low)
    return mix(low)


def _sketch(words: int):
    """Class and labels (16 bits a value) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            cls: list[bytes | None] = []
            labels: list[bytes | None] = []
            for a, b in by_bytes((len(t) for t in texts), 500_000):
                for s in shingle_sets(texts[a:b], words):
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    labels.append((signature(s) & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(labels, pa.binary())], names=["row", "doc_id", "cls", "labels"])

    return run


def _tries(depth: int):
    """A row a tree: path, the first ``depth`` values of its label; rest, the next ``STEPS`` values; and a sample of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, TREES, LONGEST).astype(np.uint64)
            path = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (n, TREES))
            for k in range(depth):
                path = mix(path * np.uint64(31) + values[:, :, k])
            rest = np.zeros((n, TREES), np.uint64)
            for k in range(depth, depth + STEPS):
                rest = (rest << np.uint64(16)) | (values[:, :, k] if k < LONGEST else np.uint64(0))
            sample = (values.reshape(n, -1)[:, :: TREES * LONGEST // SAMPLE] & np.uint64(255)).astype(np.uint8)
            of = pa.array(np.repeat(np.arange(n), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), batch.column(0).take(of), pa.array([r.tobytes() for r in sample], pa.binary()).take(of)], names=["path", "rest", "id", "sample"]
            )

    return run


def descend(rest: np.ndarray, sample: np.ndarray, least: int, depth: int) -> list[tuple[int, int, int, int]]:
    """Joins (i, j, length of the prefix, agreeing values) of one trie below a common prefix of ``depth`` values; rows come in order of ``rest``.

    From the full label to the common prefix; rows that a longer prefix has
    joined count as one.
    """
    group = np.arange(len(rest))
    joins: list[tuple[int, int, int, int]] = []
    for d in range(min(STEPS, LONGEST - depth), -1, -1):
        prefix = rest >> np.uint64(16 * (STEPS - d)) if d else np.zeros(len(rest), np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a == 1 or (group[a:b] == group[a]).all():
                continue
            left = np.arange(a, b)
            while len(left):
                first = int(left[0])
                queue, left = [first], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    agree = (sample[left] == sample[i]).sum(axis=1)
                    same = group[left] == group[i]
                    near = same | (agree >= least)
                    others, one = np.unique(group[left[near & ~same]], return_index=True)
                    joins += [(i, int(j), depth + d, int(k)) for j, k in zip(left[near & ~same][one], agree[near & ~same][one])]
                    queue += left[near].tolist()
                    left = left[~near]
                    group[a:b][np.isin(group[a:b], others)] = group[i]
    return joins


def _joins(least: int, longest: int, depth: int):
    """The joins of all tries; rows come sorted by path, rest and id."""

    def batch_of(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        types = pa.int64(), pa.int64(), pa.int32(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["src", "dst", "depth", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: int | None = None
        ids: list[np.ndarray] = []
        rests: list[np.ndarray] = []
        samples: list[bytes] = []
        head: int | None = None  # of a run too long for one task

        def whole() -> list[tuple[int, int, int, int]]:
            if head is not None or len(samples) < 2:
                return []
            name = np.concatenate(ids)
            found = descend(np.concatenate(rests), np.frombuffer(b"".join(samples), np.uint8).reshape(len(samples), -1), least, depth)
            return [(int(name[i]), int(name[j]), d, k) for i, j, d, k in found]

        for batch in batches:
            paths, rest, names, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), batch.column(3)
            cuts = np.concatenate([[0], np.flatnonzero(paths[1:] != paths[:-1]) + 1, [len(paths)]])
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if paths[a] != path:
                    out += whole()
                    path, ids, rests, samples, head = int(paths[a]), [], [], [], None
                    if b - a == 1 and b < len(paths):
                        continue  # alone on its path, and the next row has another
                if head is None and sum(map(len, ids)) + b - a > longest:
                    held = np.concatenate([*ids, names[a:b]]).tolist()
                    head = held[0]
                    out += [(head, x, LONGEST, SAMPLE) for x in held[1:]]
                elif head is not None:
                    out += [(head, x, LONGEST, SAMPLE) for x in names[a:b].tolist()]
                else:
                    ids.append(names[a:b]), rests.append(rest[a:b])
                    samples += marks.slice(a, b - a).to_pylist()
            if out:
                yield batch_of(out)
        if out := whole():
            yield batch_of(out)

    return run


def enough(joins: DataFrame, threshold: float, depth: int, target: float = TARGET_RECALL) -> int:
    """The longest prefix that gives the target share of the promising joins; one row reaches the driver."""
    once = joins.groupBy("src", "dst").agg(F.max("depth").alias("depth"), F.max("agree").alias("agree")).where(F.col("agree") >= threshold * SAMPLE)
    found = once.agg(*[F.coalesce(F.count_if(F.col("depth") >= d), F.lit(0)).alias(f"d{d}") for d in range(depth, LONGEST + 1)]).first()
    return next((d for d in range(LONGEST, depth, -1) if found[f"d{d}"] and found[f"d{d}"] >= target * found[f"d{depth}"]), depth)


VERIFIED = "id long, other long, links long"


def _verify(words: int, threshold: float):
    def run(key, table):
        bi, bj = key[1].as_py(), key[2].as_py()
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        blk = table.column("blk").to_numpy()
        texts = table.column("text").to_pylist()
        sets: list[np.ndarray] = []
        for a, b in by_bytes((len(t) for t in texts), 500_000):
            sets += shingle_sets(texts[a:b], words)
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets).astype(np.float64)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if bi != bj:
            linked &= blk[:, None] != blk[None, :]
        links = linked @ n.astype(np.int64)
        tree = forest(len(ids), lambda i, left: linked[i, left])
        some = np.flatnonzero(links)
        return pa.table(
            [
                pa.array([int(ids[i]) for i in some] + [int(ids[i]) for i, _ in tree], pa.int64()),
                pa.array([None] * len(some) + [int(ids[j]) for _, j in tree], pa.int64()),
                pa.array(links[some].tolist() + [None] * len(tree), pa.int64()),
            ],
            names=["id", "other", "links"],
        )

    return run


def _classes(docs: DataFrame, words: int, threshold: float, block: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, cls) of all rows, and (cls, n, first_row, class_id, class_row, links) of all classes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = with_row_id(docs.select("doc_id", "text"), "row")
    rows = numbered.select("row", "doc_id", "text").mapInArrow(giving_back(_sketch(words)), f"row long, doc_id {kind}, cls binary, labels binary")
    rows = materialise(rows, "sketches")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.min("doc_id").alias("first_id"), F.min("labels").alias("labels"))
    classes = with_row_id(materialise(classes, "classes"), "id")
    depth = shortest(threshold)
    tries = classes.select("id", "labels").mapInArrow(_tries(depth), "path long, rest long, id long, sample binary")
    least = int(np.ceil(SAMPLE * threshold - 5 * np.sqrt(SAMPLE * threshold * (1 - threshold))))
    joins = tries.repartition("path").sortWithinPartitions("path", "rest", "id").mapInArrow(giving_back(_joins(least, longest, depth)), "src long, dst long, depth int, agree int")
    joins = materialise(joins, "joins")
    near = connected_components(joins.where(F.col("depth") >= enough(joins, threshold, depth))).withColumnRenamed("node", "id").withColumnRenamed("component", "grp")
    near = materialise(near.join(classes.select("id", "n", "first_row"), "id"), "candidates")
    # candidates have no size bound, so they are not broadcast: one plan at every size
    texts = numbered.select(F.col("row").alias("first_row"), "text").join(near.hint("merge"), "first_row").select("grp", "id", "n", "text")
    units = in_units(texts, "grp", "id", block)
    found = materialise(units.groupBy("grp", "bi", "bj").applyInArrow(_verify(words, threshold), VERIFIED), "verified")
    links = found.where(F.col("other").isNull()).groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where(F.col("other").isNotNull()), "id", "other").withColumnRenamed("node", "id")
    info = classes.select("id", "cls", "n", "first_row", "first_id").join(links, "id", "left").join(parts, "id", "left")
    first = info.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first_id").alias("class_id"), F.min("first_row").alias("class_row"))
    info = info.join(first, "component", "left")
    return rows.select("row", "doc_id", "cls"), info.select(
        "cls", "n", "first_row", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_row", "first_row").alias("class_row"), F.coalesce("links", F.lit(0)).alias("links")
    )


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block: int = 1024, longest: int = 4096) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of ``docs``; see the module's text."""
    rows, info = _classes(docs, words, threshold, block, longest)
    out = rows.join(info, "cls", "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but the first row of each group connected by links or equal shingles."""
    rows, info = _classes(docs, words, threshold, 1024, 4096)
    gone = rows.join(info.where((F.col("n") > 1) | (F.col("class_row") != F.col("first_row")) | (F.col("links") > 0)), "cls").where(F.col("row") != F.col("class_row")).select("row")
    return with_row_id(packed_rows(docs), "row").join(gone, "row", "left_anti").select("doc.*")


def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


#: Exact Jaccard similarity of five-word shingles of all distinct sets; components by the least doc_id reached.
OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
k AS (SELECT r, doc_id, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'none' || r END AS cls, s FROM s),
c AS (SELECT cls, count(*) AS n, min(doc_id) AS first_id, any_value(s) AS s, len(any_value(s)) AS size FROM k GROUP BY 1),
e AS (SELECT cls, unnest(s) AS g FROM c),
p AS (SELECT a.cls AS x, b.cls AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.cls <> b.cls GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c a ON a.cls = x JOIN c b ON b.cls = y WHERE common >= 0.8 * (a.size + b.size - common) - 1e-9),
t AS (SELECT cls, cls AS reached FROM c UNION SELECT t.cls, l.y FROM t JOIN l ON l.x = t.reached),
m AS (SELECT t.cls, min(c.first_id) AS class_id FROM t JOIN c ON c.cls = t.reached GROUP BY 1),
d AS (SELECT x AS cls, sum(n)::BIGINT AS links FROM l JOIN c ON c.cls = l.y GROUP BY 1)
SELECT k.doc_id, m.class_id, coalesce(d.links, 0) + c.n - 1 AS n_links, c.n AS n_copies
FROM k JOIN c USING (cls) JOIN m USING (cls) LEFT JOIN d USING (cls)
"""


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates stays, with all its columns; wordless and null texts stay, of repeated rows one stays, an empty table stays empty."""
    bound_batches(spark)
    return drop_near_duplicates(docs)
