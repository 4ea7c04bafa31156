"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words by water filling; a document is
included target / source size times on average, which is a whole number of
sure copies and a fractional part. The fractional parts are sampled by the
cube method: in the flight phase the vector of inclusion probabilities moves
through the null space of the constraints (documents and words of the source
stay what they are in expectation) until a document's probability reaches 0
or 1, and so on. The flight runs in blocks of about ``block`` documents of a
source; the few undecided documents of each block (at most two) meet in the
next level's blocks, until one block a source is left. The landing then
settles the last two documents so that the source's words equal its rounded
target; for that one document may be taken in part (its first words).

A source may hold any share of the rows: its documents are dealt to many
blocks. Equal rows are one unit with a count, so repeated rows cannot fill a
block. Reruns agree: order and draws come from checksums of the rows.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; sources of size 0 have target 0; documents of size 0 are taken
0 words; repeated rows share their unit's copies evenly; an empty table gives
no rows; extra columns take part in telling rows apart and are otherwise kept
by ``mix_rows``, whatever their names, and ignored by ``mix_counts``. The table of sources (one row a source) passes through one task.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

#: What a word is, the weights in turn, the share of all words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
FAN_IN = 256
#: So many copies of a row are made at a time.
CHUNK = 100_000
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The k-th source by code point, null last, weighs weights[k mod len]. The
    water level is the one at which min(2 size, weight level) sums to the share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (share * total - F.coalesce(F.sum(2.0 * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = per.withColumn("level", level).withColumn("free", F.col("weight") * F.col("level") <= 2.0 * F.col("source_size"))
    # the level of the first source, by size over weight, that stays below its cap holds for all after it
    held = levels.withColumn("at", F.min_by("level", F.when(F.col("free"), F.col("source_size") / F.col("weight"))).over(Window.partitionBy()))
    return held.select("source", "source_size", F.least(2.0 * F.col("source_size"), F.col("weight") * F.coalesce("at", F.lit(0.0))).alias("target"))


def flight(x: np.ndarray, size: np.ndarray, draw: random.Random) -> np.ndarray:
    """Move fractional ``x`` to 0 or 1, keeping sum(x) and sum(x size); at most two (or one, if sizes agree) stay fractional."""
    x = x.astype(float).tolist()
    s = size.tolist()
    active: list[int] = []
    for k in range(len(x)):
        if EPS < x[k] < 1 - EPS:
            active.append(k)
        else:
            x[k] = float(round(x[k]))
        while len(active) >= 3 or (len(active) == 2 and s[active[0]] == s[active[1]]):
            a = active[:3]
            if len(a) == 3:
                u = [float(s[a[1]] - s[a[2]]), float(s[a[2]] - s[a[0]]), float(s[a[0]] - s[a[1]])]
                if u == [0.0, 0.0, 0.0]:
                    u = [1.0, -1.0, 0.0]
                top = max(abs(v) for v in u)
                u = [v / top for v in u]
            else:
                u = [1.0, -1.0]
            up = min((1 - x[i]) / v if v > 0 else -x[i] / v for i, v in zip(a, u) if v)
            down = min(x[i] / v if v > 0 else (x[i] - 1) / v for i, v in zip(a, u) if v)
            step = up if draw.random() * (up + down) < down else -down
            for i, v in zip(a, u):
                x[i] += step * v
                if x[i] < EPS or x[i] > 1 - EPS:
                    x[i] = float(round(x[i]))
            still = [i for i in a if 0 < x[i] < 1]
            if len(still) == len(a):  # rounding left all inside: settle the nearest
                i = min(a, key=lambda j: min(x[j], 1 - x[j]))
                x[i] = float(round(x[i]))
                still = [j for j in a if 0 < x[j] < 1]
            active = still + active[3:]
    return np.array(x)


UNIT = "_mix1 long, _mix2 long, _mix_doc string, _mix_source string, size long, source_size long, target double, n long, sure long, x double, blk long, part long"


def _level(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_mix1", "_mix2"], kind="stable").reset_index(drop=True)
        seed = int(pdf["_mix1"].iloc[0]) ^ (int(pdf["_mix2"].iloc[-1]) << 1) ^ len(pdf)
        x = flight(pdf["x"].to_numpy(), pdf["size"].to_numpy(), random.Random(seed))
        if last:
            # landing: the words that the undecided still owe are taken from them in turn, the longest first
            left = np.flatnonzero((x > 0) & (x < 1))
            owed = int(round(float((x[left] * pdf["size"].to_numpy()[left]).sum())))
            part = pdf["part"].to_numpy().copy()
            for i in sorted(left, key=lambda j: (-pdf["size"].iloc[j], j)):
                take = min(owed, int(pdf["size"].iloc[i]))
                owed -= take
                x[i], part[i] = (1.0, 0) if take == pdf["size"].iloc[i] else (0.0, take)
            pdf["part"] = part
        pdf["x"] = x
        pdf["blk"] = pdf["blk"] // FAN_IN
        return pdf

    return run


def _units(docs: DataFrame, block: int) -> DataFrame:
    """Decided units: UNIT with x 0 or 1 and part words of a document taken in part."""
    sizes = docs.select("source", "size")
    targets = source_targets(sizes)
    rows = docs.groupBy("_mix1", "_mix2", F.col("doc_id").cast("string").alias("_mix_doc"), "source", "size").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_units"))
    per = targets.join(counted, targets["source"].eqNullSafe(counted["source"])).select(targets["source"].alias("_s"), "source_size", "target", F.ceil(F.col("n_units") / block).cast("long").alias("blocks"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = rows.join(per, rows["source"].eqNullSafe(per["_s"])).select(
        "_mix1", "_mix2", "_mix_doc", F.col("source").alias("_mix_source"), "size", "source_size", "target", "n",
        F.floor(rate * F.col("n") + EPS).cast("long").alias("sure"),
        F.greatest(rate * F.col("n") - F.floor(rate * F.col("n") + EPS), F.lit(0.0)).alias("x"),
        F.pmod(F.xxhash64("_mix1", "_mix2"), F.col("blocks")).alias("blk"),
        F.lit(0).cast("long").alias("part"),
        "blocks",
    )
    units = materialise(units, "mix-units")
    most = units.agg(F.max("blocks")).first()[0]
    todo = units.drop("blocks")
    done: DataFrame | None = None
    while most is not None:
        last = most <= 1
        moved = materialise(todo.groupBy("_mix_source", "blk").applyInPandas(_level(last), UNIT), "mix-level")
        settled = moved if last else moved.where((F.col("x") == 0) | (F.col("x") == 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        todo = moved.where((F.col("x") > 0) & (F.col("x") < 1))
        most = -(-most // FAN_IN)
    return todo if done is None else done


def _prepared(docs: DataFrame) -> DataFrame:
    """The rows packed in ``doc``, with two checksums of the whole row, doc_id, source and size."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*columns).alias("doc"), F.xxhash64(*columns).alias("_mix1"), F.xxhash64(F.lit("mix"), *columns).alias("_mix2"), "doc_id", "source", size.alias("size"))


def repeated(rows: DataFrame, count: str, name: str, chunk: int = CHUNK, deal: bool = False) -> DataFrame:
    """Every row ``count`` times, numbered from 0 in ``name``, ``chunk`` numbers at a time; ``deal``: chunks of the same row go to different tasks."""
    first = F.col("_mix_chunk") * chunk
    parts = rows.where(F.col(count) > 0).withColumn("_mix_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk))))
    if deal:
        parts = parts.where(F.col(count) <= chunk).unionByName(parts.where(F.col(count) > chunk).repartition("_mix_chunk", "_mix1"))
    return parts.withColumn(name, F.explode(F.sequence(first, F.least(first + chunk, F.col(count)) - 1))).drop("_mix_chunk")


def _copies(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per row of a unit: whole copies and a part. The n rows of a unit share its copies evenly."""
    total = F.col("sure") + F.col("x").cast("long")
    rows = repeated(units.withColumn("total", total), "n", "i", chunk, deal=True)
    first = F.col("total") % F.col("n")
    return rows.withColumns({
        "copies": F.floor(F.col("total") / F.col("n")).cast("long") + F.when(F.col("i") < first, 1).otherwise(0),
        "part": F.when(F.col("i") == first, F.col("part")).otherwise(0),
    })


def mix_counts(docs: DataFrame, block: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source, ...)."""
    kind = docs.schema["doc_id"].dataType
    rows = _prepared(docs).drop("doc")
    out = _copies(_units(rows, block), chunk)
    return out.select(F.col("_mix_doc").cast(kind).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, block: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """The mixed corpus: columns of ``docs``, each row as often as it is taken; a document taken in part keeps its first words."""
    keyed = _prepared(docs)
    units = _units(keyed.drop("doc"), block)
    units = units.select("_mix1", "_mix2", "n", (F.col("sure") + F.col("x").cast("long")).alias("_mix_total"), F.col("part").alias("_mix_part"))
    taken = keyed.select("doc", "_mix1", "_mix2").join(units.where((F.col("_mix_total") > 0) | (F.col("_mix_part") > 0)), ["_mix1", "_mix2"])
    # equal rows are kept once and then repeated, so that no row needs a number among its equals
    single = taken.where(F.col("n") == 1).unionByName(taken.where(F.col("n") > 1).dropDuplicates(["_mix1", "_mix2"]))
    times = single.withColumn("_mix_times", F.col("_mix_total") + F.when(F.col("_mix_part") > 0, 1).otherwise(0))
    out = repeated(times, "_mix_times", "_mix_i", chunk).withColumn("_mix_words", F.when(F.col("_mix_i") < F.col("_mix_total"), -1).otherwise(F.col("_mix_part")))
    pieces = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("_mix_words").cast("int")), "")
    whole = F.col("_mix_words") < 0
    doc = F.col("doc").withField("text", F.when(whole, F.col("doc.text")).otherwise(cut))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(whole, F.col("doc.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType))
    return out.select(doc.alias("doc")).select("doc.*")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of ``docs``, all columns kept: rows are left out or repeated, and one a source at most is cut to its first words; the module's text defines nulls, empty texts, repeated rows and empty tables."""
    return mix_rows(docs)
