"""Removing long repeated byte strings with a run-length index.

A string of ``length`` bytes that starts in two places is found in two steps.

Routing. Every window of ``length`` bytes names the smallest hash of its
16-byte substrings (its anchor). Equal windows have equal anchors, so only
texts that share an anchor have to meet. Neighbouring windows with one anchor
form a segment: its window starts are disjoint from those of other segments.
Anchors are counted over the whole corpus; those that occur once, and once only
in their segment, are done.
If all segments of an anchor are equal, or a segment occurs twice, all its
windows are repeated.

Index. What is left, the distinct segments of anchors with several, is
brought together by anchor in blocks of bounded size. Each block becomes a
run-length index (``RunIndex``): the Burrows-Wheeler transform as runs, and at
both ends of every run the suffix's place and its match with the neighbour in
suffix order. The matching statistics of the block's text are streamed from
these samples: between samples the match with the neighbour falls by one a
byte. Windows whose statistic reaches ``length`` are marked.

Segments are told apart by 128-bit hashes (XXH3), which is the only place where
a hash stands for bytes: 10^14 segments hold two unequal ones of equal hash
with a probability of about 10^-11.

An anchor with more than ``hot`` distinct segments would not fit a block. Its
segments are cut down to single windows, which are counted as segments are, by
a shuffle with partial sums; so a passage that a third of all documents share
is spread evenly, and the result is the same on either way (tested).

Defined cases: null text counts as empty; texts below ``length`` bytes lose
nothing; matches never cross documents, and overlapping occurrences within a
document count; repeated rows are repeats of one another; null or repeated
doc_ids are fine (rows are told apart by their place); extra columns are
ignored; an empty table gives no rows. The input must be a file scan or a
written table, as texts are read more than once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, materialise, read_table, with_row_id
from .shingles import mix

LENGTH = 400
GRAM = 16
SEPARATOR = 0xFF  # no UTF-8 text holds this byte


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def digests(data: memoryview, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """128-bit hashes of (start, size) pieces, as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[s : s + n]) for s, n in spans]), "<i8").reshape(-1, 2)


def within(h: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How often each anchor's hash stands at the places low..high-1."""
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(anchor >> np.uint64(42)).astype(np.int64)] = True
    place = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
    values, code = np.unique(anchor, return_inverse=True)
    at = np.minimum(np.searchsorted(values, h[place]), len(values) - 1)
    hit = values[at] == h[place]
    stands = np.sort(at[hit] * (len(h) + 1) + place[hit])
    base = code * (len(h) + 1)
    return np.searchsorted(stands, base + high) - np.searchsorted(stands, base + low)


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, number of window starts, anchor stands more than once) of concatenated texts that end at ``ends``."""
    span = length - GRAM + 1
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if n < length:
        return none
    eight = np.ascontiguousarray(np.ndarray(n - 7, "<u8", data, strides=(1,)))
    second = eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + ((second << np.uint64(29)) | (second >> np.uint64(35))))
    rows = -(-len(h) // span)
    padded = np.full(rows * span, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - length + 1], ahead[span - 1 : span - 1 + n - length + 1])
    start = np.concatenate([[0], ends[:-1]])
    delta = np.zeros(n - length + 2, dtype=np.int32)
    long = (ends - start) >= length
    if not long.any():
        return none
    np.add.at(delta, start[long], 1)
    np.add.at(delta, ends[long] - length + 1, -1)
    valid = np.cumsum(delta[:-1]) > 0
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    new[start[long]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.concatenate([(new | ~valid)[1:], [True]])) + 1
    count = stop - first
    anchor = low[first]
    if count.max(initial=0) > span:  # long runs of one anchor are cut, so that segments stay short
        pieces = -(-count // span)
        which = np.repeat(np.arange(len(count)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = first[which] + nth * span
        count = np.minimum(count[which] - nth * span, span)
        anchor = anchor[which]
    return anchor, first, count, within(h, anchor, first, first + count - 1 + span) > 1


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = [raw(t) for t in batch.column(1).to_pylist()]
            for a, b in by_bytes((len(t) for t in texts), 2_000_000):
                joined = b"".join(texts[a:b])
                ends = np.cumsum([len(t) for t in texts[a:b]])
                anchor, first, count, inner = segments(np.frombuffer(joined, np.uint8), ends, length)
                if not len(anchor):
                    continue
                of = np.searchsorted(ends, first, side="right")
                view = memoryview(joined)
                seg = digests(view, zip(first.tolist(), (count + length - 1).tolist()))
                begin = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), *(pa.array(seg[:, i]) for i in (0, 1)), pa.array(rows[a:b][of]), pa.array((first - begin[of]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inner)],
                    names=["anchor", "seg", "seg2", "row", "at", "n", "inner"],
                )

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes (a power of two, above 8), equal ones by place."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[False], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    h = 8
    mask = (1 << bits) - 1
    while h < depth and int(new.sum()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        packed = np.sort((rank << (2 * bits)) | (after << bits) | np.arange(n))
        order = packed & mask
        pair = packed >> bits
        new = np.concatenate([[False], pair[1:] != pair[:-1]])
        rank[order] = np.cumsum(new)
        h *= 2
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a[k] and b[k], at most ``most`` bytes."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    word = np.ndarray(n + 8, "<u8", padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero((a < n) & (b < n))
    step = 0
    while len(live) and step < most:
        x = word[np.minimum(a[live] + step, n)] ^ word[np.minimum(b[live] + step, n)]
        same = x == 0
        cut = ~same
        lowest = x[cut] & (~x[cut] + np.uint64(1))
        out[live[cut]] = step + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
        step += 8
        inside = (a[live] + step < n) & (b[live] + step < n)
        out[live] = step
        live = live[inside]
    limit = np.minimum(n - a, n - b)
    return np.minimum(np.minimum(out, limit), most)


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with sampled run ends.

    ``heads`` and ``starts`` are the runs (byte, first place in suffix order).
    ``samples`` holds for either neighbour in suffix order (above at the first
    row of every run, below at its last, and both at the starts of the parts)
    the places of the sampled suffixes, in text order, and how many bytes they
    share with that neighbour. All have a size in proportion to the number of
    runs; the suffix array that they are read from is not kept.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, depth: int):
        self.n = len(text)
        order = suffix_array(text, depth)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        last_column = text[order - 1]
        change = np.flatnonzero(last_column[1:] != last_column[:-1])
        self.starts = np.concatenate([[0], change + 1])
        self.heads = last_column[self.starts]
        self.samples = [self._sampled(text, order, rank, rows, starts, side, depth) for side, rows in ((-1, change + 1), (1, change))]

    @staticmethod
    def _sampled(text: np.ndarray, order: np.ndarray, rank: np.ndarray, rows: np.ndarray, starts: np.ndarray, side: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(text), dtype=bool)
        mask[order[rows]] = mask[starts] = True
        place = np.flatnonzero(mask)
        neighbour = rank[place] + side
        has = (neighbour >= 0) & (neighbour < len(text))
        shared = np.zeros(len(place), np.int64)
        shared[has] = common_prefix(text, place[has], order[neighbour[has]], depth)
        return place, shared

    def statistics(self) -> np.ndarray:
        """For each place of the text, how many bytes it shares with its nearer neighbour in suffix order, streamed from the samples."""
        out = np.zeros(self.n, np.int64)
        for place, shared in self.samples:
            # the text starts with a part, so the first sample is at place 0
            last = np.repeat(np.arange(len(place)), np.diff(np.append(place, self.n)))
            np.maximum(out, shared[last] - (np.arange(self.n) - place[last]), out=out)
        return out


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its windows of ``length`` bytes start anywhere else in the parts."""
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep.join([*parts, b""]), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    depth = 8
    while depth < max(sizes.max(initial=0) + 1, length):
        depth *= 2
    statistic = RunIndex(text, starts, depth).statistics()
    return [statistic[s : s + max(0, z - length + 1)] >= length for s, z in zip(starts.tolist(), sizes.tolist())]


def spans_of(mask: np.ndarray) -> list[int]:
    """Flattened [from, to) pairs of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


def _cut_out(length: int):
    """Bytes of the wanted segments; of hot anchors' segments the 128-bit hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(raw(text))
                out: list[tuple] = []
                for w in wanted:
                    if w["hot"]:
                        two = digests(data, ((i, length) for i in range(w["at"], w["at"] + w["n"])))
                        out.append((w["anchor"], w["seg"], w["seg2"], w["often"], None, two[:, 0].tolist(), two[:, 1].tolist()))
                    else:
                        out.append((w["anchor"], w["seg"], w["seg2"], w["often"], bytes(data[w["at"] : w["at"] + w["n"] + length - 1]), None, None))
                types = pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["anchor", "seg", "seg2", "often", "cut", "w1", "w2"])

    return run


def _index(length: int, block: int):
    """Marks of the segments of whole anchors, a block at a time; rows come sorted by anchor."""

    def marks(rows: list[tuple[int, int, int, bool, bytes]]) -> pa.RecordBatch:
        found = repeated_starts([r[4] for r in rows], length)
        spans = [[0, len(m)] if r[3] else spans_of(m) for r, m in zip(rows, found)]
        keep = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays([*(pa.array([rows[i][k] for i in keep], pa.int64()) for k in range(3)), pa.array([spans[i] for i in keep], pa.list_(pa.int32()))], names=["anchor", "seg", "seg2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, int, int, bool, bytes]] = []
        group: list[tuple[int, int, int, bool, bytes]] = []
        ready_bytes = group_bytes = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    if ready and ready_bytes + group_bytes > block:
                        yield marks(ready)
                        ready, ready_bytes = [], 0
                    ready += group
                    ready_bytes += group_bytes
                    group, group_bytes = [], 0
                group.append(row)
                group_bytes += len(row[4]) + 1
        for part in ([ready, group] if ready_bytes + group_bytes > block else [ready + group]):
            if part:
                yield marks(part)

    return run


def _removed(length: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = raw(text)
                size.append(len(data))
                if not found:
                    gone.append(0), runs.append(0), kept.append(data)
                    continue
                delta = np.zeros(len(data) + 1, np.int32)
                for f in found:
                    spans = np.array([0, f["n"]] if f["spans"] is None else f["spans"]).reshape(-1, 2) + f["at"]
                    np.add.at(delta, spans[:, 0], 1)
                    np.add.at(delta, spans[:, 1] + length - 1, -1)
                covered = np.cumsum(delta[:-1]) > 0
                gone.append(int(covered.sum()))
                runs.append(len(spans_of(covered)) // 2)
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = 1_000_000, hot: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = with_row_id(docs.select("doc_id", "text"), "row")
    occ = numbered.where(F.octet_length("text") >= length).select("row", "text").mapInArrow(_occurrences(length), "anchor long, seg long, seg2 long, row long, at int, n int, inner boolean")
    occ = materialise(occ, "anchors")
    ends = [f(c).alias(n) for c, low, high in (("seg", "lo", "hi"), ("seg2", "lo2", "hi2")) for f, n in ((F.min, low), (F.max, high))]
    often = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *ends, F.max("inner").alias("inner")).where((F.col("c") > 1) | F.col("inner"))
    # an anchor that stands twice in one segment may repeat within it, so that goes to the index too
    unlike = (F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("c") == 1)
    shared = materialise(occ.drop("inner").join(often.select("anchor", unlike.alias("several")), "anchor"), "shared")
    key = ["anchor", "seg", "seg2"]
    several = shared.where("several").groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("often"), F.min(F.struct("row", "at", "n")).alias("one"))
    per_anchor = several.groupBy("anchor").agg((F.count(F.lit(1)) > hot).alias("hot"))
    wanted = several.join(per_anchor, "anchor").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), *key, "often", "hot")).alias("wanted"))
    cut = numbered.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_cut_out(length), "anchor long, seg long, seg2 long, often boolean, cut binary, w1 array<long>, w2 array<long>")
    cut = materialise(cut, "segments")
    cold = cut.where(F.col("cut").isNotNull()).select(*key, "often", "cut").repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_index(length, block), "anchor long, seg long, seg2 long, spans array<int>")
    windows = cut.where(F.col("w1").isNotNull()).select(*key, "often", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w")).select(*key, "often", "i", "w.w1", "w.w2")
    twice = windows.groupBy("anchor", "w1", "w2").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("anchor", "w1", "w2", F.lit(True).alias("twice"))
    marked = windows.join(twice, ["anchor", "w1", "w2"], "left").where(F.col("often") | F.col("twice"))
    warm = marked.groupBy(*key).agg(F.flatten(F.collect_list(F.array("i", F.col("i") + 1))).alias("spans"))
    marks = materialise(cold.unionByName(warm), "marks")
    whole = shared.where(~F.col("several")).select("row", "at", "n", F.lit(None).cast("array<int>").alias("spans"))
    partly = shared.where("several").join(marks, key).select("row", "at", "n", "spans")
    found = whole.unionByName(partly).groupBy("row").agg(F.collect_list(F.struct("at", "n", "spans")).alias("found"))
    joined = numbered.join(found, "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_removed(length, kind), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats_rlindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"))


#: Bytes as hexadecimal digits; every window of 400 bytes that stands twice is marked, and covered bytes go.
OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, length(h) // 2 - 399)) AS pos, h FROM d WHERE length(h) >= 800),
k AS (SELECT r, pos, md5_number(substring(h, 2 * pos + 1, 800)) AS k FROM w),
m AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
g AS (SELECT *, sum(CASE WHEN pos <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS g FROM (SELECT r, pos, coalesce(lag(pos) OVER (PARTITION BY r ORDER BY pos), -9999) AS before FROM m)),
s AS (SELECT r, g, min(pos) AS a, max(pos) + 400 AS b FROM g GROUP BY 1, 2),
n AS (SELECT *, lead(a) OVER (PARTITION BY r ORDER BY a) AS following FROM s),
p AS (SELECT n.r, sum(b - a)::BIGINT AS gone, count(*) AS spans, min(a) AS first, string_agg(substring(d.h, (2 * b + 1)::BIGINT, (2 * (coalesce(following, length(d.h) // 2) - b))::BIGINT), '' ORDER BY a) AS rest FROM n JOIN d ON d.r = n.r GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN p.r IS NULL THEN h ELSE substring(h, 1, (2 * first)::BIGINT) || rest END)) AS kept_sha256, ((length(h) // 2) - coalesce(gone, 0))::BIGINT AS kept_bytes
FROM d LEFT JOIN p ON p.r = d.r
"""
