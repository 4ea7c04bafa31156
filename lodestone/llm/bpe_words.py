"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

Encoding: tasks cut texts into pre-tokens by the tokenizer's pattern and keep,
for a chunk of documents, the chunk's dictionary (each distinct pre-token
once) and every document's pre-tokens as places in it. A dictionary is dealt
to buckets by a checksum of the word, and the buckets go through one shuffle:
all copies of a word meet in one bucket, where each distinct word of the whole
corpus is encoded once. The ids go back to the chunks' places by a second
shuffle, and documents are reassembled by position. A chunk ends after
``chunk_tokens`` pre-tokens (a longer document is a chunk of its own), and the
number of buckets follows the shuffle partitions, so what a task holds is
bounded. A frequent word stands once a chunk only.

Decoding joins ids with the token-byte table. That table is the vocabulary:
its size is fixed by the tokenizer (some 50,000 rows, under 1 MB) whatever the
input, so every worker loads it once from the vocabulary file, as encoding does.

Defined cases: null text counts as empty; an empty text has no ids and decodes
to no bytes; every input row gives one row, repeated rows and repeated or null
ids too (rows are told apart by their chunk and place, never by doc_id);
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, giving_back, ragged_take, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_TOKENS = 500_000


@lru_cache(maxsize=2)
def load_ranks(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, then the next, and so on."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _unsqueeze(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def pack_ragged(lengths: np.ndarray, body: bytes) -> bytes:
    """Items' lengths and their concatenation, compressed."""
    return _squeeze(len(lengths).to_bytes(4, "little") + _planes(lengths) + body)


def unpack_ragged(packed: bytes) -> tuple[np.ndarray, bytes]:
    data = _unsqueeze(packed)
    n = int.from_bytes(data[:4], "little")
    return _numbers(data[4 : 4 + 4 * n]), data[4 + 4 * n :]


def _chunks(id_type: pa.DataType, chunk_tokens: int, buckets: int, dictionary: bool):
    """Either the dictionaries, rows (chunk, bucket, packed words), or the documents, rows (chunk, doc_id, packed places).

    Chunks are named by the task's partition and a counter and cut by the
    texts alone, so both readings, and reruns of a task, agree on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        chunk = TaskContext.get().partitionId() << 32
        places: dict[str, int] = {}
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, places, ids, tokens, held
            words = [w.encode("utf-8", "replace") for w in places]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(of, kind="stable")
            if dictionary and words:
                parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
                packed = [pack_ragged(np.array([len(words[i]) for i in p]), b"".join([words[i] for i in p])) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(parts), pa.int64()), pa.array([int(of[p[0]]) for p in parts], pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bucket", "packed"])
            elif not dictionary and ids:
                # places are numbered by bucket, so that the buckets in turn give the whole dictionary
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ids), pa.int64()), pa.array(ids, id_type), pa.array([_squeeze(_planes(place[t])) for t in tokens], pa.binary())], names=["of_chunk", "doc_id", "packed"])
            places, ids, tokens, held, chunk = {}, [], [], 0, chunk + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(text or "")
                if held and held + len(words) > chunk_tokens:
                    yield from flush()
                for w in dict.fromkeys(words):
                    places.setdefault(w, len(places))
                if not dictionary:
                    ids.append(doc_id)
                    tokens.append(np.fromiter(map(places.__getitem__, words), dtype=np.uint32, count=len(words)))
                held += len(words)
        yield from flush()

    return run


def _encode_words(vocabulary: str):
    """(chunk, bucket, packed ids); rows come sorted by bucket, and a word is encoded when its bucket first has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary)._encode_single_piece
        known: dict[bytes, tuple[int, bytes]] = {}
        now: int | None = None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                lengths, body = unpack_ragged(packed)
                coded = []
                at = 0
                for n in lengths.tolist():
                    word = body[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        fresh = encode(word)
                        ids = known[word] = len(fresh), np.asarray(fresh, dtype="<u4").tobytes()
                    coded.append(ids)
                flat = np.frombuffer(b"".join(c[1] for c in coded), "<u4")
                out.append(pack_ragged(np.array([c[0] for c in coded]), _planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["chunk", "bucket", "packed"])

    return run


def _documents(id_type: pa.DataType, vocabulary: str, digest: bool):
    """The documents of a chunk by position: their ids, or the checksums of decimal ids and decoded bytes."""

    def run(key, words, docs):
        parts = [unpack_ragged(p) for p in words.sort_by("bucket").column("packed").to_pylist()]
        lengths = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([_numbers(p[1]).astype(np.uint32) for p in parts]) if parts else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for packed in docs.column("packed"):
            ids, _ = ragged_take(flat, offsets, _numbers(_unsqueeze(packed.as_py())))
            out.append(digests(ids, vocabulary) if digest else ids.astype("<u4").tobytes())
        names = docs.column("doc_id").cast(id_type)
        if not digest:
            return pa.table([names, pa.array(out, pa.binary())], names=["doc_id", "ids"])
        return pa.table([names, *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _encoded(docs: DataFrame, vocabulary: str, chunk_tokens: int, digest: bool) -> DataFrame:
    field = docs.schema["doc_id"]
    id_type = pa.int64() if field.dataType.simpleString() == "bigint" else pa.int32() if field.dataType.simpleString() == "int" else pa.string()
    id_name = {pa.int64(): "bigint", pa.int32(): "int"}.get(id_type, "string")
    docs = docs.select(F.col("doc_id").cast(id_name).alias("doc_id"), "text")
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.mapInArrow(giving_back(_chunks(id_type, chunk_tokens, buckets, True)), "chunk long, bucket int, packed binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(_encode_words(vocabulary)), "chunk long, bucket int, packed binary")
    texts = docs.mapInArrow(giving_back(_chunks(id_type, chunk_tokens, buckets, False)), f"of_chunk long, doc_id {id_name}, packed binary")
    return coded.groupBy("chunk").cogroup(texts.groupBy("of_chunk")).applyInArrow(_documents(id_type, vocabulary, digest), f"doc_id {id_name}, {DIGESTS if digest else 'ids binary'}")


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (needs doc_id and text); ids: little-endian 32-bit token ids.

    ``docs`` is read twice and must give the same rows in the same partitions
    each time: a file scan or a written table.
    """
    return _encoded(docs, vocabulary, chunk_tokens, False)


def digest_documents(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, n_tokens and the checksums of the decimal ids and of the bytes decoded from them, for every row of ``docs``.

    The work of ``encode_documents`` and ``decode_documents``; the function
    that reassembles a document by position also decodes it and takes the
    checksums, so that ids and bytes never leave the Python worker.
    """
    return _encoded(docs, vocabulary, chunk_tokens, True)


class TokenBytes:
    """The token-byte table and the table of decimal ids, as flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.bytes, self.byte_at = self._flat(tokens)
        self.digits, self.digit_at = self._flat([b"%d " % i for i in range(size)])

    @staticmethod
    def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items], dtype=np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.bytes, self.byte_at, ids)[0].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.digits, self.digit_at, ids)[0].tobytes()[:-1]


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> TokenBytes:
    """One token-byte table a worker."""
    return TokenBytes(load_ranks(vocabulary))


def digests(ids: np.ndarray, vocabulary: str) -> tuple[int, str, str]:
    """Number of ids, and the checksums of the decimal ids and of the decoded bytes."""
    table = token_bytes(vocabulary)
    ids = ids.astype(np.int64)
    return len(ids), hashlib.sha256(table.decimal(ids)).hexdigest(), hashlib.sha256(table.decode(ids)).hexdigest()


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded`` (binary) to a frame with ``ids``, by joining each id with the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            for a, b in by_bytes((len(x) for x in ids), 8_000_000):
                decoded = [table.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids[a:b]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def op5_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``digest_documents`` gives for every row of ``docs``: null text has no tokens, repeated rows give repeated results, extra columns of any name are ignored, an empty table gives no rows."""
    bound_batches(spark)
    return digest_documents(docs)
