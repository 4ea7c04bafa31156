"""Weights of character n-grams, counted in blocks of whole texts; between tasks only packed texts and a block's distinct n-grams move."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import stored

#: Letters of a block.
BLOCK = 2_000_000
#: Texts are packed at this level of zstd, in at most so many rows.
LEVEL, ROWS = 6, 10_000


def _packed(ranks: np.ndarray, bits: int, n: int, room: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """A number of at most ``room`` bits for the n letters from each place on, and the way back to the letters' ranks.

    Where the letters do not fit, those so far are replaced by their rank among all.
    """
    key, width, tables = ranks.astype(np.uint64), bits, {}
    for i in range(1, n):
        if width + bits > room:
            tables[i], inverse = np.unique(key, return_inverse=True)
            key, width = inverse.astype(np.uint64), max(1, len(tables[i]).bit_length())
        key = (key[:-1] << np.uint64(bits)) | ranks[i:]
        width += bits

    def back(keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), n), np.int64)
        for i in range(n - 1, 0, -1):
            out[:, i] = keys & np.uint64((1 << bits) - 1)
            keys = keys >> np.uint64(bits)
            if i in tables:
                keys = tables[i][keys.astype(np.int64)]
        out[:, 0] = keys
        return out

    return key, back


def tally(ids: pa.Array, texts: pa.Array, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, Callable[[], list[str]]]:
    """(distinct ids, each one's end, n-gram numbers, counts, the n-grams) of texts; equal ids count as one.

    N-grams are numbered by length and letters, so the numbers depend on the set of texts alone, not on their order.
    """
    coded = ids.dictionary_encode(null_encoding="encode")
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    owner = coded.indices.to_numpy()[order]
    letters = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    stop = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))
    start = np.concatenate([[0], stop[:-1]])
    place = np.zeros(0x110000, np.uint64)
    place[letters] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    ranks, bits = place[letters], max(1, (len(alphabet) - 1).bit_length())
    room = 64 - max(1, (high - low).bit_length())
    keys, backs = [], []
    for n in range(low, high + 1):
        key, back = _packed(ranks, bits, n, room) if len(ranks) >= n else (np.zeros(0, np.uint64), None)
        keys.append(key | np.uint64((n - low) << room))
        backs.append(back)
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    found, counts = [], []
    for a, b in zip(firsts, np.append(firsts[1:], len(owner))):
        parts = [keys[n - low][start[i] : max(start[i], stop[i] - n + 1)] for i in order[a:b] for n in range(low, high + 1)]
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        found.append(u)
        counts.append(c)
    distinct, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True)

    def names() -> list[str]:
        out = []
        for n in range(low, high + 1):
            mine = distinct[(distinct >> np.uint64(room)) == n - low] & np.uint64((1 << room) - 1)
            if len(mine):
                s = alphabet[backs[n - low](mine)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                out += [s[i : i + n] for i in range(0, len(s), n)]
        return out

    ends = np.cumsum([len(u) for u in found], dtype=np.int64)
    return coded.dictionary.take(pa.array(owner[firsts])), ends, number.astype(np.int64), np.concatenate([np.zeros(0, np.int64), *counts]), names


def gram_vectors(rows: DataFrame, row_id: str, text: Column, low: int, high: int, least_df: int = 2, most_terms: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, places, weights), (term, place)): ``textmine.tfidf`` of the texts' n-grams, a row for each id that has terms.

    Texts are dealt by id to blocks of about ``block`` letters; a block tells
    its distinct n-grams with their counts, gets back the weights of those
    that are kept, and counts its texts once more. Places are the terms' order, ascending in a row,
    if ``most_terms`` is given (whose rows are what reaches one task), else
    null, and the second table is that of all terms.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text).cast("long")).alias("letters")).first()
    blocks = max(1, -(-(size["letters"] or 0) // block))
    dealt = rows.select(F.col(row_id).alias("id"), text.alias("text"), F.pmod(F.xxhash64(row_id), F.lit(blocks)).alias("block")).where(F.col("text").isNotNull())

    def count(key, unit):
        _, _, number, counts, names = tally(unit.column("id").combine_chunks(), unit.column("text").combine_chunks(), low, high)
        terms = names()
        total = np.bincount(number, counts, len(terms)).astype(np.int64)
        return pa.table({"block": pa.array(np.full(len(terms), key[0].as_py())), "number": pa.array(np.arange(len(terms)), pa.int32()), "term": pa.array(terms, pa.string()), "df": pa.array(np.bincount(number, minlength=len(terms)).astype(np.int64)), "tf": pa.array(total)})

    tallies = dealt.groupBy("block").applyInArrow(count, "block long, number int, term string, df long, tf long")
    if most_terms is None:
        kept = tallies.withColumns({"df": F.sum("df").over(Window.partitionBy("term")), "place": F.lit(None).cast("int")}).where(F.col("df") >= least_df)
        terms = tallies.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_df).select("term", F.lit(None).cast("int").alias("place"))
    else:
        tallies = stored(tallies)  # read twice
        most = tallies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= least_df).orderBy(F.col("tf").desc(), "term").limit(most_terms)
        named = most.withColumn("place", F.row_number().over(Window.orderBy("term")) - 1).select("term", "df", "place").checkpoint()
        kept = tallies.drop("df").join(F.broadcast(named), "term")
        terms = named.select("term", "place")
    idf = F.ln((1 + F.lit(size["n"])) / (1 + F.col("df"))) + 1
    entries = kept.select("block", "number", "place", idf.alias("idf"))

    def weigh(unit, known):
        ids, ends, number, counts, _ = tally(unit.column("id").combine_chunks(), unit.column("text").combine_chunks(), low, high)
        here, total = known.column("number").to_numpy(), int(number.max(initial=-1)) + 1
        idf, place = np.full(total, np.nan), np.zeros(total, np.int32)
        idf[here] = known.column("idf").to_numpy()
        if most_terms is not None:
            place[here] = known.column("place").to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(np.append(0, ends)))
        held = ~np.isnan(idf[number])
        owner, number = owner[held], number[held]
        w = (1 + np.log(counts[held])) * idf[number]
        w /= np.sqrt(np.bincount(owner, w * w, len(ids)))[owner]
        if most_terms is not None:  # places ascend within a row
            order = np.argsort((owner << 32) | place[number])
            number, w = number[order], w[order]
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(ids)))), pa.int32())
        places = pa.array(place[number]) if most_terms is not None else pa.nulls(len(number), pa.int32())
        out = pa.table({"id": ids, "places": pa.ListArray.from_arrays(offsets, places), "weights": pa.ListArray.from_arrays(offsets, pa.array(w))})
        return out.filter(pc.greater(pc.list_value_length(out.column("weights")), 0))

    kind = dealt.schema["id"].dataType.simpleString()
    vectors = dealt.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(weigh, f"id {kind}, places array<int>, weights array<double>")
    return vectors.withColumnRenamed("id", row_id), terms


class Texts(NamedTuple):
    """Texts with their ids, dealt by id to blocks: (block, packed), the type of the ids, and the numbers of blocks and of rows, those without a text among them."""

    packed: DataFrame
    kind: str
    blocks: int
    rows: int

    def block_of(self, row_id: str) -> Column:
        return F.pmod(F.xxhash64(row_id), F.lit(self.blocks)).alias("block")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of packed bytes for what a batch has of a block."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            blocks, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            packed = []
            for a, b in zip(first, np.append(first[1:], batch.num_rows)):
                sink = pa.BufferOutputStream()
                rows = batch.select([1, 2]).slice(a, b - a)
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows)
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], names=["block", "packed"])


def _unpacked(unit: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a block that has some."""
    table = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in unit.column("packed")])
    return pa.concat_arrays(table.column(0).chunks), pa.concat_arrays(table.column(1).chunks)


def packed_texts(rows: DataFrame, row_id: str, text: Column, block: int = BLOCK) -> Texts:
    """The texts in blocks of about ``block`` letters, packed, so that they may be dealt several times."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text).cast("long")).alias("letters")).first()
    kind = rows.schema[row_id].dataType.simpleString()
    texts = Texts(rows, kind, max(1, -(-(size["letters"] or 0) // block)), size["n"])
    dealt = rows.where(text.isNotNull()).select(texts.block_of(row_id), F.col(row_id).alias("id"), text.alias("text"))
    return texts._replace(packed=dealt.mapInArrow(_pack, "block long, packed binary"))


class Grams(NamedTuple):
    """The n-grams of ``low`` to ``high`` letters that are kept, ascending, and the weight of each."""

    terms: pa.Array
    idf: np.ndarray
    low: int
    high: int


def frequent_grams(texts: Texts, low: int, high: int, most_terms: int, least_df: int = 2) -> Grams:
    """The ``most_terms`` most frequent n-grams of those in ``least_df`` texts, with ``textmine.tfidf``'s idf; they are held on the driver."""

    def count(unit):
        _, _, number, counts, names = tally(*_unpacked(unit), low, high)
        terms = names()
        total = np.bincount(number, counts, len(terms)).astype(np.int64)
        return pa.table({"term": pa.array(terms, pa.string()), "df": pa.array(np.bincount(number, minlength=len(terms)).astype(np.int64)), "tf": pa.array(total)})

    tallies = texts.packed.groupBy("block").applyInArrow(count, "term string, df long, tf long")
    most = tallies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= least_df).orderBy(F.col("tf").desc(), "term").limit(most_terms)
    held = most.select("term", "df").toArrow().sort_by("term").combine_chunks()
    idf = np.log((1 + texts.rows) / (1 + held.column("df").to_numpy())) + 1
    return Grams(held.column("term").combine_chunks().cast(pa.string()), idf, low, high)


def _counts(unit: pa.Table, kept: Grams, wanted: pa.Array, ascending: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, each one's end, places, counts): how often the kept n-grams, by place, stand in a block's texts of the wanted ids."""
    none = np.zeros(0, np.int64)
    if not unit.num_rows:
        return wanted.slice(0, 0), none, none, none
    ids, texts = _unpacked(unit)
    mine = pc.is_in(ids, value_set=wanted, skip_nulls=True)
    if not mine.true_count:
        return ids.slice(0, 0), none, none, none
    ids, ends, number, counts, names = tally(ids.filter(mine), texts.filter(mine), kept.low, kept.high)
    place = pc.fill_null(pc.index_in(pa.array(names(), pa.string()), value_set=kept.terms), -1).to_numpy()[number]
    held = place >= 0
    ends = np.append(0, np.cumsum(held))[ends]
    place, counts = place[held].astype(np.int64), counts[held]
    if ascending:
        order = np.argsort((np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0)) << 32) | place)
        place, counts = place[order], counts[order]
    return ids, ends, place, counts


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row's values; a row goes up to its end."""
    size = np.diff(ends, prepend=0)
    out = np.zeros(len(ends))
    if len(values):
        out[size > 0] = np.add.reduceat(values, (ends - size)[size > 0])
    return out


def raised(counts: np.ndarray) -> np.ndarray:
    """The weight of a count before those of its n-gram and text: 1 + ln of it."""
    most = int(counts.max(initial=1))
    return 1 + np.log(counts) if most > 1 << 16 else (1 + np.log(np.maximum(np.arange(most + 1), 1)))[counts]


def _shares(idf: np.ndarray, ends: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What each row's weights are multiplied with for a length of 1."""
    squares = row_sums((raised(counts) * idf[places]) ** 2, ends)
    return np.divide(1, np.sqrt(squares), out=np.zeros(len(ends)), where=squares > 0)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as their lowest bytes, then the next ones as far as there are any, packed: most bytes but the lowest are zeros."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    lowest = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]
    return bytes([width]) + pa.compress(lowest.tobytes(), codec="zstd", asbytes=True)


def _numbers(planes: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    width = planes[0]
    lowest = np.frombuffer(pa.decompress(planes[1:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    out = lowest[0].astype(np.uint32)
    for k in range(1, width):
        out |= lowest[k].astype(np.uint32) << np.uint32(8 * k)
    return out


def labelled_counts(texts: Texts, kept: Grams, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """(labels, ends, shares, steps, counts): a row for each block, of the label and the counted n-grams of every row of ``labels``, written once.

    ``steps`` and ``counts`` are packed planes of bytes; a step is that from one
    place to the next, at a row's start the place itself. A row's weights are
    multiplied with its share.
    """
    held = texts.packed.sparkSession.sparkContext.broadcast(kept)

    def join(unit, labels):
        wanted = labels.column("id").combine_chunks()
        ids, ends, places, counts = _counts(unit, held.value, wanted, ascending=True)
        shares = np.append(_shares(held.value.idf, ends, places, counts), 0.0)
        at = pc.fill_null(pc.index_in(wanted, value_set=ids, skip_nulls=True), -1).to_numpy()
        size = np.where(at >= 0, np.append(np.diff(np.append(0, ends)), 0)[at], 0)
        own = np.cumsum(size)
        took = np.repeat(np.append(ends, 0)[at] - own, size) + np.arange(int(size.sum()))
        places, counts = places[took], counts[took]
        steps = np.diff(places, prepend=0)
        steps[(own - size)[size > 0]] = places[(own - size)[size > 0]]
        value = labels.column("label").combine_chunks().to_pylist()
        return pa.table({"labels": pa.array([value], pa.list_(pa.float64())), "ends": pa.array([own], pa.list_(pa.int64())), "shares": pa.array([shares[at]], pa.list_(pa.float64())), "steps": pa.array([_planes(steps)], pa.binary()), "counts": pa.array([_planes(counts)], pa.binary())})

    known = labels.where(F.col(label).isNotNull()).select(texts.block_of(row_id), F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"))
    joined = texts.packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(join, "labels array<double>, ends array<long>, shares array<double>, steps binary, counts binary")
    return stored(joined.where(F.size("labels") > 0))


def counted_rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, ends, shares, places, weights) of a row of ``labelled_counts``; the weights are those before idf and share."""
    ends = np.array(row["ends"], np.int64)
    steps, counts = (_numbers(row[c], int(ends[-1])) for c in ("steps", "counts"))
    size = np.diff(ends, prepend=0)
    upto = np.append(np.uint32(0), np.cumsum(steps, dtype=np.uint32))  # modulo 2**32, as are the differences
    return np.array(row["labels"], float), ends, np.array(row["shares"], float), upto[1:] - np.repeat(upto[ends - size], size), raised(counts)


def gram_scores(texts: Texts, kept: Grams, rows: DataFrame, row_id: str, coefficients: np.ndarray) -> DataFrame:
    """(id, score) of every row: the constant, which is the last coefficient, and the sum of the row's weights times the coefficients of their places."""
    held = texts.packed.sparkSession.sparkContext.broadcast((kept, coefficients))

    def score(unit, rows):
        kept, c = held.value
        wanted = rows.column("id").combine_chunks()
        ids, ends, places, counts = _counts(unit, kept, wanted, ascending=False)
        found = np.append(row_sums(raised(counts) * (kept.idf * c[:-1])[places], ends) * _shares(kept.idf, ends, places, counts), 0.0)
        at = pc.fill_null(pc.index_in(wanted, value_set=ids, skip_nulls=True), -1).to_numpy()
        return pa.table({"id": wanted, "score": pa.array(found[at] + c[-1])})

    own = rows.select(texts.block_of(row_id), F.col(row_id).alias("id"))
    scored = texts.packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, f"id {texts.kind}, score double")
    return scored.withColumnRenamed("id", row_id)
