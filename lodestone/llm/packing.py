"""Mixture-controlled packing by deficit round-robin over source queues.

Tasks tokenise the documents once and cut them into chunks; a source's chunks
form its queue, each chunk's place being its task's start in the queue plus
what the task has sent before. The queues are spent side by side: a source's
target is its share of all tokens (times its rate, until it runs out), and its
queue is cut into as many slices as there are partitions ("spans"), or into
fewer slices of at least one sequence, which go to evenly spaced spans. What a
span owes a source thus follows from the place in its queue alone, so deficits
carry over from span to span although all spans are packed at once.

Within a span the sources take turns: a source sends a quantum, its share of
a window of ``size`` tokens but at least ``least``, whenever its deficit (its
share of what has been packed, minus what it has sent) reaches one, and what
it sent too much or too little counts for its next turns, across windows. A
turn that would end within half of ``least`` of a document's end ends there.
Spans know how many tokens come before them, so windows run on from one span
to the next, and all sequences but the last are full. The last tokens are cut
by powers of two, so nothing is padded.

A span holds about ``span`` tokens whatever a source's or document's share is:
a hot source has more turns, a long document is cut into slices. The table of
sources and tasks (small: no texts) is joined, and is broadcast only where
Spark finds it below its limit.

Identifiers are those of the tokenizers library. A text is cut where the
tokenizer always cuts, before a space with no space after it; a word that was
met before is looked up; a new one of Latin letters is encoded by tiktoken
with the same vocabulary, any other one (and the special token's own string)
by the tokenizers library itself.

Defined cases: null text counts as empty; an empty text is its end id alone; a
null source is a source; repeated rows and repeated or null ids are documents
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_words import VOCABULARY as RANKS
from .bpe_words import encoding
from .common import by_bytes, materialise, ragged_take, read_table

#: The vocabulary, the id after each document, the length of a sequence.
VOCABULARY = "byte_bpe_50k.json"
END = 1
SIZE = 2048
#: Tokens of a source's turn at least; tokens of a span; bytes of text at once.
LEAST = 256
SPAN = 2_000_000
TAKEN = 2_000_000
#: Rows of the table of queues up to which it is broadcast.
MOST = 200_000
#: Words are remembered up to this length and number.
WORD = 32
WORDS = 600_000
CUT = re.compile(" (?=[^ ])")
#: Below this character both libraries know the same letters, digits and blanks.
LATIN = "ƀ"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def id_type(vocabulary: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


class Words(dict):
    """The ids of words, as bytes of little-endian 32-bit numbers; a word is preceded by a space."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.exact = tokenizer(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.least_special = min(map(len, self.special), default=0)
        latin = encoding(RANKS)
        self.fast, self.piece = (latin.encode_ordinary, latin._encode_single_piece) if vocabulary == VOCABULARY else (None, None)

    def __missing__(self, word: str) -> bytes:
        if self.fast and word.isalpha() and (word.isascii() or max(word) < LATIN):  # the tokenizer leaves it whole
            ids = array("I", self.piece(f" {word}".encode())).tobytes()
        else:
            ids = self.encode(f" {word}")
        if len(word) <= WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        special = self.special and len(text) >= self.least_special and any(s in text for s in self.special)
        if self.fast and not special and (text.isascii() or max(text) < LATIN):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def document(self, text: str) -> np.ndarray:
        parts = CUT.split(text) if "  " in text or text.endswith(" ") else text.split(" ")
        return np.frombuffer(b"".join([self.encode(parts[0]), *map(self.__getitem__, parts[1:])]), "<u4")


CHUNK = "source string, task long, before long, doc long, {id}, start long, length long, doc_tokens long, ids binary"


def _chunks(vocabulary: str, end: int, size: int):
    """Documents as chunks of up to ``size`` ids; before: ids of the same source earlier in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind = Words(vocabulary), id_type(vocabulary)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        task = TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        doc = 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in by_bytes(pc.binary_length(texts).to_pylist(), TAKEN):
                rows: list[tuple] = []
                of: list[int] = []
                for k, (source, text) in enumerate(zip(batch.column("source").slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())):
                    ids = np.append(words.document(text), np.uint32(end))
                    before = sent.get(source, 0)
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        rows.append((source, task, before + at, doc, at, len(piece), len(ids), squeeze(piece.astype(kind).tobytes())))
                        of.append(a + k)
                    sent[source] = before + len(ids)
                    doc += 1
                kinds = (pa.string(), *[pa.int64()] * 6, pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                columns.insert(4, batch.column("doc_id").take(pa.array(of, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["source", "task", "before", "doc", "doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, size: int = SIZE) -> DataFrame:
    """Chunks of the documents' ids, by source and task. A source's name is marked, so that null is a name of its own."""
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    schema = CHUNK.format(id=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    return materialise(rows.mapInArrow(_chunks(vocabulary, end, size), schema), "packing-chunks")


def turns(ends: np.ndarray, stops: np.ndarray, quantum: int, least: int) -> np.ndarray:
    """Ends of a source's turns over the places 0 .. ends[-1]: every ``quantum`` places, or a document's end (``stops``) within least / 2 of it."""
    cut = np.arange(quantum, ends[-1], quantum)
    if len(stops) and len(cut):
        after = np.minimum(np.searchsorted(stops, cut), len(stops) - 1)
        near = np.where(np.abs(stops[after] - cut) <= np.abs(stops[after - 1] - cut), stops[after], stops[after - 1])
        cut = np.where(np.abs(near - cut) <= least // 2, near, cut)
    return np.unique(np.append(cut[(cut > 0) & (cut < ends[-1])], ends[-1]))


def sequence_bounds(first: int, last: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of the sequences that meet places first .. last - 1 of ``total``: every ``size`` places, then the rest by powers of two."""
    full = total // size
    starts = np.arange(first // size, min(-(-last // size), full)) * size
    numbers = starts // size
    at, n = full * size, full
    tail = []
    for bit in reversed(range((total - at).bit_length())):
        if (total - full * size) >> bit & 1:
            if at < last and at + (1 << bit) > first:
                tail.append((at, n))
            at, n = at + (1 << bit), n + 1
    extra = np.array(tail, np.int64).reshape(-1, 2)
    return np.concatenate([starts, extra[:, 0]]), np.concatenate([numbers, extra[:, 1]])


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _span(total: int, size: int, least: int, keep: bool, vocabulary: str):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("source", "ascending"), ("place", "ascending")])
        lo, hi = left.column("lo").to_numpy(), left.column("hi").to_numpy()
        in_doc = left.column("start").to_numpy() + lo - left.column("place").to_numpy()  # where the row's ids start in the document
        length = hi - lo
        doc_tokens = left.column("doc_tokens").to_numpy()
        ends_doc = in_doc + length == doc_tokens
        names = left.column("source").to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        held = int(length.sum())
        rows, at, size_of, tag, turn_of = [], [], [], [], []
        for a, b in zip(bounds, np.append(bounds[1:], len(names))):
            ends = np.cumsum(length[a:b])
            mine = int(ends[-1])
            cut = turns(ends, ends[ends_doc[a:b]], max(least, size * mine // held), least)
            phase = zlib.crc32(f"{key[0].as_py()}{names[a]}".encode()) / 2**32
            edges = np.union1d(ends, cut)
            begins = np.append(0, edges[:-1])
            row = np.searchsorted(ends, begins, side="right")
            turn = np.searchsorted(cut, begins, side="right")
            rows.append(a + row)
            at.append(begins - (ends - length[a:b])[row])
            size_of.append(edges - begins)
            # the part of the span after which the source's deficit reaches the turn
            sent = np.append(0, cut[:-1])
            tag.append(((sent + phase * (cut - sent)) / mine)[turn])
            turn_of.append(np.full(len(row), a))
        row, at, size_of, tag, turn_of = map(np.concatenate, (rows, at, size_of, tag, turn_of))
        order = np.lexsort((at, row, turn_of, tag))
        row, at, size_of = row[order], at[order], size_of[order]

        first = right.column("before")[0].as_py()
        place = first + np.cumsum(size_of) - size_of
        starts, numbers = sequence_bounds(first, first + held, total, size)
        edges = np.union1d(place, starts[starts > first])
        of = np.searchsorted(place, edges, side="right") - 1
        row, at = row[of], at[of] + edges - place[of]
        size_of = np.diff(np.append(edges, first + held))
        seq = np.searchsorted(starts, edges, side="right") - 1
        start = in_doc[row] + at
        doc = left.column("task").to_numpy()[row], left.column("doc").to_numpy()[row]
        # neighbours that go on in the same document and sequence are one piece
        new = np.append(True, (doc[0][1:] != doc[0][:-1]) | (doc[1][1:] != doc[1][:-1]) | (start[1:] != (start + size_of)[:-1]) | (seq[1:] != seq[:-1]))

        unsqueeze, kind = zstandard.ZstdDecompressor().decompress, id_type(vocabulary)
        parts = [np.frombuffer(unsqueeze(p), kind) for p in left.column("ids").to_pylist()]
        skip = lo - left.column("place").to_numpy()
        flat = np.concatenate([p[s : s + n] for p, s, n in zip(parts, skip.tolist(), length.tolist())]).astype("<u4")
        offsets = np.append(0, np.cumsum(length))[row] + at
        span = np.column_stack([offsets, offsets + size_of]).ravel()
        packed, _ = ragged_take(flat, span, 2 * np.arange(len(row)))
        head = np.flatnonzero(new)
        piece_from = (edges - first)[head]
        piece_to = np.append(piece_from[1:], held)
        data = packed.tobytes()
        ids = [data[4 * a : 4 * b] for a, b in zip(piece_from.tolist(), piece_to.tolist())]
        row, seq = row[head], seq[head]
        out = [
            left.column("doc_id").take(pa.array(row)), pa.array(start[head]), pa.array(piece_to - piece_from), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array(doc_tokens[row]), pa.array(numbers[seq]), pa.array(edges[head] - starts[seq]),
        ]
        if keep:
            out += [left.column("source").take(pa.array(row)), pa.array(ids, pa.binary())]
        return pa.table(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["source", "ids"] if keep else [])])

    return run


def pack_documents(
    docs: DataFrame, rates: dict[str | None, float] | None = None, vocabulary: str = VOCABULARY, end: int = END, size: int = SIZE, least: int = LEAST, span: int = SPAN, keep: bool = False
) -> DataFrame:
    """Pieces of the documents (doc_id, text, source) in sequences of at most ``size`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``keep`` also the source (marked by '='; '' for null) and the ids.
    ``rates``: how fast a source is spent in proportion to its size, 1 if it is
    not named; a source of rate 2 has twice its share until it runs out.
    """
    chunks = tokenised(docs, vocabulary, end, size)
    total = chunks.agg(F.sum("length")).first()[0] or 0
    spans = max(1, -(-total // span))
    parts = chunks.groupBy("source", "task").agg(F.sum("length").alias("n"))
    queue = Window.partitionBy("source").orderBy("task")
    # lasting: how long a source lasts in proportion to one of rate 1
    lasting = F.lit(1.0)
    for name, rate in (rates or {}).items():
        lasting = F.when(F.col("source") == ("" if name is None else f"={name}"), 1.0 / rate).otherwise(lasting)
    parts = parts.withColumns({"base": F.sum("n").over(queue) - F.col("n"), "tokens": F.sum("n").over(Window.partitionBy("source")), "most": F.ceil(lasting * spans)})
    parts = parts.withColumn("slices", F.least("most", F.ceil(F.col("tokens") / size)))
    parts = parts.withColumns({
        "slice": F.ceil(F.col("tokens") / F.col("slices")),
        "phase": F.when(F.col("slices") == F.col("most"), 0.0).otherwise(F.crc32("source") / 2.0**32),
    }).select("source", "task", "base", "slice", "slices", "phase", "most")
    # a row for each source of each task: names and numbers only
    parts = materialise(parts, "packing-queues")
    placed = chunks.join(F.broadcast(parts) if parts.limit(MOST + 1).count() <= MOST else parts, ["source", "task"]).withColumn("place", F.col("base") + F.col("before"))
    sliced = placed.withColumn("k", F.explode(F.sequence(F.floor(F.col("place") / F.col("slice")), F.floor((F.col("place") + F.col("length") - 1) / F.col("slice")))))
    rows = sliced.select(
        F.least(F.floor((F.col("k") + F.col("phase")) / F.col("slices") * F.col("most")), F.col("most") - 1).cast("long").alias("span"),
        "source", "task", "doc", "doc_id", "start", "doc_tokens", "place", "ids",
        F.greatest("place", F.col("k") * F.col("slice")).alias("lo"), F.least(F.col("place") + F.col("length"), (F.col("k") + 1) * F.col("slice")).alias("hi"),
    )
    # tokens before a span: by groups of spans, then within them
    spanned = rows.groupBy("span").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).withColumn("far", F.floor(F.col("span") / 1024))
    far = spanned.groupBy("far").agg(F.sum("n").alias("m")).select("far", (F.sum("m").over(Window.orderBy("far")) - F.col("m")).alias("earlier"))
    near = F.sum("n").over(Window.partitionBy("far").orderBy("span")) - F.col("n")
    before = spanned.join(far, "far").select(F.col("span").alias("of_span"), (near + F.col("earlier")).alias("before"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE}" + (", source string, ids binary" if keep else "")
    return rows.groupBy("span").cogroup(before.groupBy("of_span")).applyInArrow(_span(total, size, least, keep, vocabulary), schema)


def packed_sequences(docs: DataFrame, **how) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit, up to the sequence's length) and its pieces (doc_id, source, start, length, offset) in order."""
    pieces = pack_documents(docs, keep=True, **how)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "source", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(held.alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("held", lambda p: F.struct(p["doc_id"], p["source"], p["start"], p["length"], p["offset"])).alias("pieces"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
