"""Seed-and-extend alignment of short texts (reads) to long ones (references), on both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.textmine import few

#: Pairs of letters of the two strands, the letter that is no letter.
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
UNKNOWN = "N"
#: Letters of a piece of a text; k-letter words are cut from pieces, so that no word is found by counting from a long text's start.
PIECE = 256


def seeds(texts: DataFrame, text_id: str, text: str, k: int, unknown: str = UNKNOWN) -> DataFrame:
    """(id, seed, at): every word of k letters and its place from 0; words with the unknown letter are left out."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = texts.select(text_id, F.posexplode(F.arrays_zip(pieces.alias("p"), F.slice(F.concat(pieces, F.array(F.lit(""))), 2, F.size(pieces)).alias("q"))).alias("_piece", "_z"))
    # a word that begins in a piece ends in it or in the next ones' first letters
    if k > PIECE:
        raise ValueError(f"words of more than {PIECE} letters")
    body = cut.select(text_id, "_piece", F.concat("_z.p", F.substring("_z.q", 1, k - 1)).alias("_t"), F.length("_z.p").alias("_n"))
    last = F.least(F.col("_n"), F.length("_t") - k + 1)
    words = body.where(last > 0).select(text_id, "_piece", "_t", F.explode(F.sequence(F.lit(0), last - 1)).alias("_i"))
    found = words.select(text_id, F.substring("_t", F.col("_i") + 1, F.lit(k)).alias("seed"), (F.col("_piece") * PIECE + F.col("_i")).cast("long").alias("at"))
    return found.where(~F.contains("seed", F.lit(unknown)))


#: Odd factor of the seeds' hashes.
FACTOR = 0x9E3779B97F4A7C15


def seed_hashes(text: str, k: int) -> np.ndarray:
    """A hash for the k letters from each place on: a sum of letters times powers of a factor, put together from halves."""
    one = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(one) < k:
        return np.zeros(0, np.uint64)
    out, done, width = None, 0, 1
    while True:
        if k & width:
            shifted = one[done : done + len(text) - k + 1]
            out = shifted if out is None else out * np.uint64(pow(FACTOR, width, 1 << 64)) + shifted
            done += width
        if width * 2 > k:
            return out * np.uint64(0xC2B2AE3D27D4EB4F)
        one = one[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + one[width:]
        width *= 2


def seeds_among(texts: DataFrame, text_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """``seeds`` of the texts that hash like one of ``wanted`` (seed); few, as their hashes go to every task."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(seed_hashes(s, k)[0].view(np.int64)) for s in batch.column(0).to_pylist()], pa.int64())], names=["h"])

    known = np.unique(wanted.select("seed").mapInArrow(hashed, "h long").toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    kind = texts.schema[text_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 22, bool)
        seen[(known >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            rows, found, places = [], [], []
            for row, s in enumerate(batch.column("_t")):
                s = s.as_py()
                h = seed_hashes(s, k)
                at = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
                if len(at):
                    at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]].tolist()
                    rows += [row] * len(at)
                    places += at
                    found += [s[i : i + k] for i in at]
                if len(rows) > 100_000 or (rows and row == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), pa.array(found, pa.string()), pa.array(places, pa.int64())], names=[text_id, "seed", "at"])
                    rows, found, places = [], [], []

    return texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_t")).mapInArrow(find, f"`{text_id}` {kind}, seed string, at long")


def other_strand(text: Column, complement: dict[str, str] | None = None) -> Column:
    """The text from its end, letters exchanged by ``complement``."""
    pairs = COMPLEMENT if complement is None else complement
    return F.translate(F.reverse(text), "".join(pairs), "".join(pairs.values()))


def candidates(reads: DataFrame, references: DataFrame, ref_id: str, text: str, read: str = "read", k: int = 19, least: int = 3, keep: int = 50, by: str = "diagonal", complement: dict[str, str] | None = None, unknown: str = UNKNOWN) -> DataFrame:
    """(read, strand, ref_id, place, votes, turn): the ``keep`` places of each read's text with most votes, ``least`` at least.

    Seeds of both strands of a read vote for the place where the read would
    begin (``by="diagonal"``: the seed's place in the reference less its place
    in the read, which may be negative) or for the seed's own place
    (``by="place"``). Ties go to the + strand, then to the smaller reference
    and place. Equal reads vote once. References' seeds are held against the
    hashes of the reads' distinct seeds where those are few, so that only seeds in common
    become rows; a pair of a read and a place with a seed in common is a row before
    votes are summed.
    """
    texts = reads.select(F.col(read).alias("read")).where(F.col("read").isNotNull()).distinct()
    ways = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("read").alias("_way")), F.struct(F.lit("-").alias("strand"), other_strand(F.col("read"), complement).alias("_way")))).alias("_w")
    sided = texts.select("read", ways).select(F.struct("read", "_w.strand").alias("_key"), "_w._way")
    mine = seeds(sided, "_key", "_way", k, unknown).select("_key", "seed", F.col("at").alias("_from"))
    whole = references.where(F.col(text).isNotNull())
    wanted = mine.select("seed").distinct()
    theirs = seeds_among(whole, ref_id, text, k, wanted) if few(wanted) else seeds(whole, ref_id, text, k, unknown)
    place = F.col("at") - F.col("_from") if by == "diagonal" else F.col("at")
    votes = mine.join(theirs, "seed").groupBy("_key", ref_id, place.alias("place")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
    order = Window.partitionBy("read").orderBy(F.col("votes").desc(), "strand", ref_id, "place")
    named = votes.select("_key.read", "_key.strand", ref_id, "place", "votes")
    return named.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= keep)


def edit_string(match: np.ndarray) -> str:
    """Runs of M and X; their lengths add up to the read's."""
    if not len(match):
        return ""
    ends = np.append(np.flatnonzero(match[1:] != match[:-1]), len(match) - 1)
    runs = np.diff(np.append(-1, ends))
    return "".join(f"{n}{'M' if m else 'X'}" for n, m in zip(runs.tolist(), match[ends].tolist()))


def extend(read: str, segment: str, first: int, most: int, letters: str | None, unknown: str) -> tuple[int, int, float, str] | None:
    """(offset, mismatches, score, edit string) of the read at the best offset of the segment from ``first`` on, or None.

    The penalty is the mismatches and half the places with an unknown letter
    on either side; an offset is better if its penalty is below the best
    one's whole part. Accepted: at most ``most``, and a score (length less
    penalty) of 0.7 of the length.
    """
    n = len(read)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    x, y = code(read), code(segment)
    blank_of = lambda v: ~np.isin(v, code(letters)) if letters is not None else v == ord(unknown)
    blank_x, blank_y = blank_of(x), blank_of(y)
    best, score, at = n, 0.0, 0
    for offset in range(first, min(n, len(y) - n + 1) + 1):
        if offset + n > len(y):
            break
        z, blank = y[offset : offset + n], blank_y[offset : offset + n]
        penalty = int(((x != z) & ~(blank_x & blank)).sum()) + 0.5 * int((blank_x | blank).sum())
        if penalty < best:
            best, score, at = int(penalty), n - penalty, offset
    if best > most or score < 0.7 * n:
        return None
    z = y[at : at + n]
    return at, best, score, edit_string((x == z) & (x != ord(unknown)) & (z != ord(unknown)))


EXTENDED = "position long, mismatches int, score double, edits string"


def align(
    reads: DataFrame, references: DataFrame, ref_id: str, text: str, read: str = "read", k: int = 19, least: int = 3, most: int = 2, keep: int = 50, tried: int = 10, by: str = "diagonal",
    complement: dict[str, str] | None = None, letters: str | None = "ACGT", unknown: str = UNKNOWN,
) -> DataFrame:
    """Rows of ``reads`` with their best alignment: ref_id, strand, position, mismatches, score, mapq, edits, site; rows without one are left out.

    ``candidates`` names the places, the first ``tried`` of them are extended
    by counting mismatches at the offsets within ``most`` letters of the
    place, and the highest score wins, ties to the earlier candidate. On the -
    strand the read's other strand is what is aligned. mapq is
    40 (1 - mismatches / length); site is where the read begins, its far end
    on the - strand. ``letters``: all others are unknown; None: ``unknown``
    alone is. Only the piece of a reference around a place goes to Python.
    """
    pairs = COMPLEMENT if complement is None else complement
    found = candidates(reads, references, ref_id, text, read, k, least, keep, by, complement, unknown).where(F.col("turn") <= tried)
    n = F.length("read")
    start = F.greatest(F.lit(0).cast("long"), F.col("place") - most)
    stop = F.least(F.length("_ref").cast("long"), F.col("place") + n + most)
    whole = references.select(F.col(ref_id), F.col(text).alias("_ref"))
    near = found.join(whole, ref_id).where(stop > start).select(
        "read", "strand", ref_id, "turn", start.alias("_start"), F.greatest(F.lit(0).cast("long"), F.col("place") - start - 1).alias("_first"),
        F.substring("_ref", (start + 1).cast("int"), (stop - start).cast("int")).alias("_segment"),
        F.when(F.col("strand") == "+", F.col("read")).otherwise(other_strand(F.col("read"), pairs)).alias("_way"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_way", "_segment", "_first", "_start")))
            got = [(s + e[0], *e[1:]) if (e := extend(w, g, f, most, letters, unknown)) else (None,) * 4 for w, g, f, s in rows]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("read", "strand", ref_id, "turn")), *columns], names=["read", "strand", ref_id, "turn", "position", "mismatches", "score", "edits"])

    kind = references.schema[ref_id].dataType.simpleString()
    extended = near.mapInArrow(run, f"read string, strand string, {ref_id} {kind}, turn int, {EXTENDED}").where(F.col("position").isNotNull())
    fields = [ref_id, "strand", "position", "mismatches", "score", "edits"]
    best = extended.groupBy("read").agg(F.max_by(F.struct(*fields), F.struct("score", -F.col("turn"))).alias("_a")).select(F.col("read").alias(read), "_a.*")
    out = reads.join(best, read)
    return out.withColumns({
        "mapq": F.greatest(F.lit(0), F.floor(40 * (1 - F.col("mismatches") / F.greatest(F.length(read), F.lit(1))))).cast("int"),
        "site": F.when(F.col("strand") == "+", F.col("position")).otherwise(F.col("position") + F.length(read)),
    })
