"""Source divergence audit by term-block dense matrices.

Tasks count a language's and source's terms with two counters in Python, and
Spark sums the counts. Each language keeps the terms that enough of its
documents have. Its kept terms are dealt to blocks by a checksum, its sources
to blocks as well, and a unit is a term block with two source blocks (or one
alone): a dense int64 tile of sources by terms, in which all pairs of sources
are compared by broadcasting. Units give partial pair matrices, which are
summed, and each source's heap of its ``top`` terms, which are merged.

A term that none of a unit's sources has adds the same to each of their pairs,
so units count the terms they have seen and the rest is added at the end; no
unit needs terms from elsewhere. A tile has about ``terms`` times twice
``sources`` cells, whatever a language's, source's or term's share of the
corpus: a frequent term is one column, a large source one row.

Defined cases: null text, language and source count as ''; every (language,
source) that occurs is compared, with or without terms; repeated rows and
repeated or null ids are documents of their own; a language of one source has
no pairs; without kept terms all pairs are 0; an empty table gives no rows;
other columns are ignored. All arithmetic is exact for corpora of up to
9e15 occurrences in a language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise, read_table

#: What a term is (in UTF-8, lower-cased before), documents a kept term has at least, the scale, ranks of terms.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 10
SCALE_THOUSANDS = 3
TOP = 10
#: A task's counters are handed on after so many entries; bytes of text at once; terms and sources of a tile.
HELD = 300_000
TAKEN = 2_000_000
TERMS = 4096
SOURCES = 256
CELLS = 1 << 20


def _count(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for a, b in by_bytes(pc.binary_length(texts).to_pylist(), TAKEN):
                part = batch.slice(a, b - a)
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts.slice(a, b - a).to_pylist()):
                    n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                    found = TERM.findall(text.lower())
                    before = len(n)
                    n.update(found)
                    docs.update(set(found))
                    entries += len(n) - before
                    if entries >= held:
                        yield from flush()
                        groups, entries = {}, 0
        yield from flush()

    return run


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of every group's terms."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    part = rows.mapInArrow(_count(held), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1000000000 * count / total) for counts up to the total, a thousand at a time so that nothing overflows."""
    q, r = count // total, count % total
    for _ in range(SCALE_THOUSANDS):
        r = r * 1000
        q = q * 1000 + r // total
        r = r % total
    return 1 + q


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


UNIT = "lang string, part string, source string, item string, value long, seen long, none long, kept long"


def _tile(top: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, _, bi, bj = (k.as_py() for k in key)
        right = right.sort_by("source")
        sources, blocks = right.column("source").to_pylist(), right.column("blk").to_numpy()
        kept = right.column("kept")[0].as_py()
        total = right.column("size").to_numpy() + 2 * kept
        whole = right.column("lang_size")[0].as_py() + 2 * kept
        terms = left.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.combine_chunks()
        order = pc.array_sort_indices(terms.dictionary).to_numpy()  # terms in order of their bytes
        names = terms.dictionary.take(pa.array(order)).cast(pa.string()).to_pylist()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        column = place[terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        row_of = {s: k for k, s in enumerate(sources)}
        row = np.fromiter((row_of[s] for s in left.column("source").to_pylist()), np.int64, left.num_rows)
        counts = np.zeros((len(sources), len(names)), np.int64)
        counts[row, column] = left.column("n").to_numpy()
        in_lang = np.zeros(len(names), np.int64)
        in_lang[column] = left.column("total").to_numpy()
        out: list[tuple] = []
        if kept:
            p = scaled(counts + 2, total[:, None])
            rare = scaled(np.full(len(sources), 2, np.int64), total)
        else:
            p, rare = counts, np.ones(len(sources), np.int64)
        step = max(1, CELLS // max(1, len(names)))
        for i in np.flatnonzero(blocks == bi).tolist():
            others = np.arange(i + 1, len(sources)) if bi == bj else np.flatnonzero(blocks == bj)
            for at in range(0, len(others), step):
                some = others[at : at + step]
                value = divergence(p[some], p[i]).sum(axis=1)
                none = divergence(rare[some], rare[i])
                out += [(lang, "pair", sources[i], sources[j], v, len(names), z, kept) for j, v, z in zip(some.tolist(), value.tolist(), none.tolist())]
            if bi == bj and len(names):
                q = scaled(in_lang + 2, np.int64(whole))
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                value = divergence(p[i][over], q[over])
                best = np.argsort(-value, kind="stable")[:top]
                out += [(lang, "term", sources[i], names[over[k]], int(value[k]), 0, 0, 0) for k in best.tolist()]
        kinds = (pa.string(),) * 4 + (pa.int64(),) * 4
        columns = list(zip(*out)) if out else [()] * 8
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "part", "source", "item", "value", "seen", "none", "kept"])

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, terms: int = TERMS, sources: int = SOURCES, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from the others of its language, and the terms it has more of than the language."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, held).withColumns({
        "in_docs": F.sum("docs").over(of_term),
        "total": F.sum("n").over(of_term),
        "once": (F.min("source").over(of_term) == F.col("source")).cast("long"),  # one row of each term
    })
    kept = materialise(counted.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", "once"), "divergence-terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("once").alias("once"))
    groups = materialise(groups.join(sizes, ["lang", "source"], "left").fillna(0, ["size", "once"]), "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("once").alias("kept"), F.ceil(F.count(F.lit(1)) / sources).alias("wide"))
    langs = langs.withColumn("deep", F.greatest(F.ceil(F.col("kept") / terms), F.lit(1)))

    def in_units(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("blk", F.pmod(F.xxhash64("source"), "wide")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)))
        return dealt.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")})

    cells = in_units(kept.join(langs.select("lang", "wide", "deep"), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "deep")))
    cells = cells.select("lang", "tile", "bi", "bj", "source", "term", "n", "total")
    heads = in_units(groups.join(langs, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deep") - 1))))
    heads = heads.select("lang", "tile", "bi", "bj", "blk", "source", "size", "lang_size", "kept")
    unit = ["lang", "tile", "bi", "bj"]
    found = materialise(cells.groupBy(*unit).cogroup(heads.groupBy(*unit)).applyInArrow(_tile(top), UNIT), "divergence-tiles")

    pairs = found.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("none").alias("none"), F.max("kept").alias("kept"))
    value = F.col("value") + (F.col("kept") - F.col("seen")) * F.col("none")
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", F.lit("pair").alias("part"), value.alias("value"), ways.alias("way")).select("lang", "way.source", "part", "way.item", "value")
    both = pairs.unionByName(found.where(F.col("part") == "term").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
p AS (
  SELECT cell.lang, source, term, n,
    (1 + 1000000000::HUGEINT * (n + 2)::HUGEINT // (cell.size + 2 * v.v)::HUGEINT)::HUGEINT AS p,
    (1 + 1000000000::HUGEINT * (total + 2)::HUGEINT // (v.size + 2 * v.v)::HUGEINT)::HUGEINT AS q
  FROM cell JOIN v ON v.lang = cell.lang
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
