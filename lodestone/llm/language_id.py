"""Language identification with language-bitmask n-gram filters.

Training counts letter trigrams (words framed by blanks, lower case) over all
labelled documents in Spark. A trigram belongs to a language when it makes up
at least ``min_share`` of that language's trigrams and at least
``min_ratio`` of its largest share in any language; so each language has at
most 1 / min_share trigrams, whatever the corpus size. The filter is a
bit-sliced Bloom filter: ``slots`` rows of one bit per language; a trigram
sets its languages' bits in ``hashes`` rows, and the AND of those rows gives
all languages containing it at once. A document's trigrams are looked up,
hits are counted per language (a popcount down the language's slice) and
corrected for false positives by (hits - n f) / (1 - f), f being the
language's fill to the power of ``hashes``. The largest corrected count wins.

Defined cases: null text or a text without letters gives ``und`` and score 0;
ties go to the smallest language name; no hit at all gives the language with
most training trigrams and score 0; documents with null language do not
train; no training rows at all gives ``und``; a null doc_id trains and is not
held out. Every input row gives one output row, repeated rows too. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, free_name, giving_back, read_table

BLANK = 32
#: The least share of known trigrams of a document that is kept. Held-out documents of sf0.001, sf0.01 and sf0.1 have 0.58 or more, random letters 0.24 or less.
MIN_COVER = 0.4
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of all texts, the text of each, and the number of letters of each text.

    Runs of other characters count as one blank; trigrams with a blank in
    their middle are left out.
    """
    joined = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[joined]
    # lower() may change lengths, so the texts' places come from lengths of lowered texts
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    owner = np.concatenate([[0], owner, [max(0, len(texts) - 1)]])[: len(joined)].astype(np.int32)
    n_letters = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a word stays
    keep[0] = True
    code = np.where(is_letter, joined, BLANK)[keep].astype(np.uint64)
    owner = owner[keep]
    if len(code) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), n_letters
    mid = code[1:-1] != BLANK
    packed = ((code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:])[mid]
    return packed, owner[1:-1][mid], n_letters


def _spread(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
    h = (grams + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    return (h >> np.uint64(33)) & np.uint64(slots - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in by_bytes((len(t) for t in texts), 500_000):
            packed, owner, _ = trigrams(texts[a:b])
            of = np.fromiter((number[x] for x in langs[a:b]), dtype=np.int64, count=b - a)[owner]
            for i in range(len(names)):
                held.append((np.full(1, i), *np.unique(packed[of == i], return_counts=True)))
        for i, name in enumerate(names):
            mine = [x for x in held if x[0][0] == i]
            gram = np.concatenate([x[1] for x in mine])
            count = np.concatenate([x[2] for x in mine])
            gram, inverse = np.unique(gram, return_inverse=True)
            total = np.bincount(inverse, weights=count).astype(np.int64) if len(gram) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array([name] * len(gram), pa.string()), pa.array(total)], names=["gram", "lang", "n"])


class Filters:
    """The bit-sliced Bloom filter of all languages; its size depends on its parameters only."""

    def __init__(self, names: list[str], default: str, grams: np.ndarray, langs: np.ndarray, slots: int, hashes: int):
        self.names, self.default, self.slots, self.hashes = names, default, slots, hashes
        self.words = max(1, -(-len(names) // 64))
        self.bits = np.zeros((slots, self.words), dtype=np.uint64)
        bit = np.uint64(1) << (langs % 64).astype(np.uint64)
        for k in range(hashes):
            np.bitwise_or.at(self.bits, (_spread(grams, k, slots).astype(np.int64), langs // 64), bit)
        fill = np.array([np.count_nonzero(self.bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / slots for i in range(len(names))])
        self.false = fill**hashes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``predict`` and the share of all trigrams of a text that the best language holds, corrected like the hits."""
        packed, owner, n_letters = trigrams(texts)
        rows = self.bits[_spread(packed, 0, self.slots).astype(np.int64)]
        for k in range(1, self.hashes):
            rows &= self.bits[_spread(packed, k, self.slots).astype(np.int64)]
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.stack([np.bincount(owner, weights=(rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float), minlength=len(texts)) for i in range(len(self.names))], axis=1)
        right = np.maximum(0.0, (hits - n[:, None] * self.false) / np.maximum(1e-12, 1 - self.false))
        best = right.argmax(axis=1)
        total = right.sum(axis=1)
        top = right[np.arange(len(texts)), best]
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        pred = [("und" if not n_letters[i] else self.names[best[i]] if total[i] > 0 else self.default) for i in range(len(texts))]
        return pred, np.where(n_letters > 0, score, 0.0), np.where(n > 0, top / np.maximum(n, 1), 0.0)


def train(labelled: DataFrame, min_share: float = 1e-5, min_ratio: float = 0.1, slots: int = 1 << 20, hashes: int = 3) -> Filters | None:
    """Fit on columns ``text`` and ``lang``. What reaches the driver is at most 1 / min_share trigrams a language."""
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.mapInArrow(giving_back(_count), "gram long, lang string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    spark = labelled.sparkSession
    # the per-language totals come from the same counts; observing them would need a second pass, so they are summed from the kept table
    from .common import materialise

    counts = materialise(counts, "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    table = spark.createDataFrame(sorted(totals.items()), "lang string, total long")
    share = counts.join(F.broadcast(table), "lang").withColumn("share", F.col("n") / F.col("total"))
    share = share.where(F.col("share") >= min_share)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    kept = share.join(top, "gram").where(F.col("share") >= min_ratio * F.col("top")).select("gram", "lang").toPandas()
    names = sorted(totals)
    number = {x: i for i, x in enumerate(names)}
    default = min(names, key=lambda x: (-totals[x], x))
    return Filters(names, default, kept["gram"].to_numpy(dtype=np.int64).astype(np.uint64), kept["lang"].map(number).to_numpy(dtype=np.int64), slots, hashes)


def predict(docs: DataFrame, filters: Filters | None, pred: str = "lang_pred", score: str = "score", cover: str = "_cover") -> DataFrame:
    """All columns of ``docs`` (which needs ``text``) and the three result columns; columns of their names are replaced."""
    docs = docs.drop(pred, score, cover)
    model = docs.sparkSession.sparkContext.broadcast(filters)
    fields = [*docs.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{pred}` string", f"`{score}` double", f"`{cover}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            out: list[str] = []
            scores: list[np.ndarray] = []
            covers: list[np.ndarray] = []
            for a, b in by_bytes((len(t) for t in texts), 500_000):
                if model.value is None:
                    p, s, c = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a)
                else:
                    p, s, c = model.value.judge(texts[a:b])
                out += p
                scores.append(s)
                covers.append(c)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string()), *(pa.array(np.concatenate(x) if x else np.zeros(0)) for x in (scores, covers))],
                names=[*batch.schema.names, pred, score, cover],
            )

    return docs.mapInArrow(giving_back(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Every fourth document by checksum of its id; never trained on. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.0, min_cover: float = MIN_COVER) -> DataFrame:
    """Documents whose language can be told; columns stay, rejected rows go.

    It cannot where the text is null or letterless, or where the best language
    holds less than ``min_cover`` of its trigrams (foreign scripts, gibberish).
    Repeated rows have one fate, other columns of any name are kept, and
    without a labelled document, or without rows, nothing stays.
    """
    bound_batches(spark)
    columns = [f"`{c}`" for c in docs.columns]
    filters = train(docs.where(~held_out()))
    pred, score, cover = (free_name(docs.columns, name) for name in ("lang_pred", "score", "cover"))
    found = predict(docs, filters, pred, score, cover)
    return found.where((F.col(pred) != "und") & (F.col(score) >= min_score) & (F.col(cover) >= min_cover)).select(*columns)
