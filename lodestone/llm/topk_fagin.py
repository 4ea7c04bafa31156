"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt evenly into blocks of about ``block`` rows, whatever their
ids; each block is one row that holds its vectors. Queries are packed the same
way, and every pack of queries meets every block of vectors once; the pairs are
dealt out by block and pack, so neither side gathers in a task. Within a pair,
each dimension's list is the block sorted by that component, once for the up to
``PACK`` queries. A query
walks all lists at once, from the end that its own component favours; it
scores what the lists bring up by random access and stops as soon as the
bound, the score that a vector standing at the current depth of every list
would have, is below its kth best score. No approximation is made: a tie with
the bound goes on. The k best of all blocks are merged by a window.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows with a null id take no part; only vectors of equal length are
compared; a row is never a candidate for a query of its own id; repeated ids
are separate candidates; query rows that agree in id and vector are one query,
queries that share an id and differ in vector are ranked apart; ties go to the
smaller id; fewer than k candidates give fewer rows; an empty table gives none.
Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

PACKED = "blk int, dim int, ids binary, extra binary, flat binary"
EXACT = 2.0**53
#: Queries that meet a block at once: their search takes many times as long as sorting and moving the block.
PACK = 2048


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v = floor(scale x) as 64-bit integers, for usable vectors only."""
    x = F.col(embedding)
    usable = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("long")).alias("v"))


def _pack(most: int):
    """One row for each vector length and ``most`` vectors at most; blk: the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def out(dim: int, parts: list) -> pa.RecordBatch:
            ids, extra, flat = (np.concatenate([p[i] for p in parts]) for i in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([extra.tobytes()]), pa.array([flat.tobytes()])],
                names=["blk", "dim", "ids", "extra", "flat"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            extra = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for a in range(0, len(rows), most):
                    r = rows[a : a + most]
                    matrix = flat[((ends[r] - dim)[:, None] + np.arange(dim)).ravel()]
                    parts = held.setdefault(dim, [])
                    if sum(len(p[0]) for p in parts) + len(r) > most:
                        yield out(dim, parts)
                        parts.clear()
                    parts.append((ids[r], extra[r], matrix))
        for dim, parts in held.items():
            if parts:
                yield out(dim, parts)

    return run


def _dealt(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // most))
    return rows.repartition(n).mapInArrow(_pack(most), PACKED), n


class Lists:
    """A block's vectors and its list for each dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.order = np.argsort(matrix, axis=0, kind="stable")

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, dim = self.matrix.shape
        used = np.flatnonzero(query)
        seen = np.zeros(n, dtype=bool)
        seen[self.ids == own] = True  # never a candidate
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        big = dim * float(np.abs(query).max(initial=0)) * float(np.abs(self.matrix).max(initial=0)) >= EXACT
        q = query if big else query.astype(float)
        best_first = query[used] > 0
        depth, step = 0, 16
        while depth < n:
            upto = min(n, depth + step)
            at = np.arange(depth, upto)
            rows = self.order[np.where(best_first, n - 1 - at[:, None], at[:, None]), used] if len(used) else at[:, None]
            new = np.unique(rows[~seen[rows]])
            if len(new):
                seen[new] = True
                part = self.matrix[new] if big else self.matrix[new].astype(float)
                ids = np.concatenate([ids, self.ids[new]])
                scores = np.concatenate([scores, (part @ q).astype(np.int64)])
                if len(scores) > k:
                    keep = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[keep], scores[keep]
            depth, step = upto, step * 2
            if len(scores) >= k and depth < n:
                edge = self.order[np.where(best_first, n - depth, depth - 1), used] if len(used) else np.zeros(0, int)
                bound = int((self.matrix[edge, used] * query[used]).sum())
                if bound < scores.min():
                    break
        keep = np.lexsort((ids, -scores))[:k]
        return ids[keep], scores[keep]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # read in place: a row is a whole block
                ids, flat, own, key, q_flat = (np.frombuffer(b, np.int64) if (b := batch.column(c)[i].as_buffer()).size else np.zeros(0, np.int64) for c in ("ids", "flat", "q_ids", "q_extra", "q_flat"))
                dim = batch.column("dim")[i].as_py()
                lists = Lists(ids, flat.reshape(len(ids), dim))
                queries = q_flat.reshape(len(own), dim)
                out: list[tuple[np.ndarray, ...]] = []
                for q, o, e in zip(queries, own.tolist(), key.tolist()):
                    ids, scores = lists.top(q, o, k)
                    out.append((np.full(len(ids), o), np.full(len(ids), e), ids, scores))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(4)], names=["query_id", "q", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are (vec_id, v) as ``quantised`` gives them."""
    asked = queries.withColumn("extra", F.xxhash64("v")).dropDuplicates(["vec_id", "extra"]).select("vec_id", "extra", "v")
    vector_blocks, n = _dealt(vectors.select("vec_id", F.lit(0).cast("long").alias("extra"), "v"), block)
    query_packs, m = _dealt(asked, PACK)
    named = query_packs.select(F.col("blk").alias("pack"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("blk"), "dim", F.col("ids").alias("q_ids"), F.col("extra").alias("q_extra"), F.col("flat").alias("q_flat"))
    spread = vector_blocks.select("blk", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("pack"), "dim", "ids", "flat")
    pairs = named.join(spread, ["blk", "pack", "dim"]).select("dim", "ids", "flat", "q_ids", "q_extra", "q_flat")
    found = pairs.mapInArrow(_search(k), "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk_fagin(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
