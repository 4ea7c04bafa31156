"""Samples and splits by checksum: reruns agree, whatever the partitions, and no group is ever cut."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _checkpoints, components
from .order import sums_before


def draw(seed: int | str, key: Column) -> Column:
    """A checksum that orders keys at random for a seed."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def share(key: Column) -> Column:
    """The first 32 bits of the key's MD5 as a number in 0..1."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def hash_sample(rows: DataFrame, key: str, rate: float) -> DataFrame:
    return rows.where(share(F.col(key)) <= rate)


def sample_n(rows: DataFrame, key: str, n: int, seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """n rows (of each ``by``) in an order drawn by checksum."""
    order = [draw(seed, F.col(key)), F.col(key)]
    if not by:
        return rows.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def numbered(rows: DataFrame, order: Column, ties: Column) -> DataFrame:
    """Adds _n (from 1, in ``order``, a hexadecimal checksum) and _total, without a window over all rows.

    Rows are dealt by the checksum's first three digits; the counts of the 4096
    parts give each its offset.
    """
    dealt = rows.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, 3))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_order", ties))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_before") + within).drop("_part", "_order", "_before")


def _part(n: Column, first: Column, second: Column, names: Sequence[str]) -> Column:
    """The part of number n: the first ``first`` numbers, the next ``second``, the rest."""
    return F.when(n <= first, names[0]).when(n <= first + second, names[1]).otherwise(names[2])


def _share(total: Column, share: float, least: int = 1) -> Column:
    return F.greatest(F.floor(total * F.lit(share)), F.lit(least))


NAMES = ("train", "validation", "test")
PARTS = (("train", 0.7), ("validation", 0.15), ("test", 0.15))


def group_split(rows: DataFrame, group: str, seed: int | str = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(group, split) of every group, ordered by checksum; it is an error if no group is left to test."""
    groups = numbered(rows.select(group).where(F.col(group).isNotNull()).distinct(), draw(seed, F.col(group)), F.col(group))
    first, second = _share(F.col("_total"), train), _share(F.col("_total"), validation)
    split = F.when(first + second >= F.col("_total"), F.raise_error(F.lit("no group is left to test"))).otherwise(_part(F.col("_n"), first, second, NAMES))
    return groups.select(group, split.alias("split"))


def stratified_group_split(groups: DataFrame, group: str, stratum: str, seed: int | str = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(group, stratum, split) of a table with one row a group, split within each stratum.

    A stratum of up to three groups has no validation part; the first part
    gives way where nothing else would be left. If no stratum has a test part,
    the last group (by stratum and number) of validation, else of train, is it.
    """
    w = Window.partitionBy(stratum)
    total = F.col("_total")
    n = groups.withColumn("_n", F.row_number().over(w.orderBy(draw(seed, F.col(group)), group))).withColumn("_total", F.count(F.lit(1)).over(w))
    second = F.when(total > 3, _share(total, validation)).otherwise(0)
    first = _share(total, train)
    first = F.when((first + second >= total) & (total > 1), F.greatest(F.lit(1), total - 1 - second)).otherwise(first)
    cut = n.withColumn("_split", _part(F.col("_n"), first, second, NAMES))
    place = F.struct(F.col("_split") == "validation", F.col(stratum), F.col("_n"))
    last = cut.agg(F.count_if(F.col("_split") == "test").alias("_tests"), F.max(place).alias("_last"), F.count(F.lit(1)).alias("_groups"))
    moved = (F.col("_tests") == 0) & (F.col("_last") == place)
    split = F.when(moved & (F.col("_groups") < 2), F.raise_error(F.lit("a split needs two groups"))).when(moved, "test").otherwise(F.col("_split"))
    return cut.crossJoin(F.broadcast(last)).select(group, stratum, split.alias("split"))


def stratified_row_split(rows: DataFrame, key: str, strata: Sequence[str], seed: int | str = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds split: rows of each stratum in an order drawn by checksum, shares rounded down. Rows of one entity may part: see ``entity_split``."""
    w = Window.partitionBy(*strata)
    n = F.row_number().over(w.orderBy(draw(seed, F.col(key)), key))
    total = F.count(F.lit(1)).over(w)
    out = rows.withColumn("_n", n).withColumn("_total", total)
    return out.withColumn("split", _part(F.col("_n"), _share(F.col("_total"), train, 0), _share(F.col("_total"), validation, 0), NAMES)).drop("_n", "_total")


def entity_split(entities: DataFrame, rows: DataFrame, key: str, split: str = "split", order: Sequence[str] = NAMES) -> DataFrame:
    """Entities that have rows, with the first split (in ``order``) that any of their rows is in."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(split))
    first = rows.groupBy(key).agg(F.min_by(split, place).alias(split))
    return entities.join(first, key)


def row_split(rows: DataFrame, key: str, seed: int | str = 42, parts: Sequence[tuple[str, float]] = PARTS) -> DataFrame:
    """Adds split by the row's own checksum alone: no shuffle, shares hold on average."""
    x = F.conv(F.substring(draw(seed, F.col(key)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    out = F.lit(parts[-1][0])
    bounds, total = [], 0.0
    for name, part in parts[:-1]:
        total += part
        bounds.append((name, round(total, 10)))
    for name, bound in reversed(bounds):
        out = F.when(x < bound, name).otherwise(out)
    return rows.withColumn("split", out)


def component_split(rows: DataFrame, group: str, content: str, seed: int | str = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(group, component, split): groups that share a content, directly or by way of others, stay together.

    Components are ordered by the checksum of the seed and the least content
    checksum of their least group, and each part has one at least; fewer than
    three components are an error.
    """
    keyed = rows.select(group, F.sha2(F.col(content).cast("string"), 256).alias("_sha")).where(F.col(group).isNotNull()).distinct()
    lead = keyed.groupBy("_sha").agg(F.min(group).alias("_lead"))
    edges = keyed.join(lead, "_sha").select(F.col(group).alias("src"), F.col("_lead").alias("dst"))
    heads = keyed.groupBy(group).agg(F.min("_sha").alias("_head"))
    groups = heads.join(components(edges), F.col(group) == F.col("node"), "left").select(group, "_head", F.coalesce("component", group).alias("component"))
    each = groups.groupBy("component").agg(F.min_by("_head", group).alias("_head"))
    each = numbered(each, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_head")), 256), F.col("component"))
    total = F.col("_total")
    first = F.greatest(F.lit(1), F.least(F.floor(total * F.lit(train)), total - 2))
    upto = F.greatest(first + 1, F.least(F.floor(total * F.lit(round(train + validation, 10))), total - 1))
    split = F.when(total < 3, F.raise_error(F.lit("a split needs three independent groups"))).otherwise(_part(F.col("_n"), first, upto - first, NAMES))
    return groups.join(each.select("component", split.alias("split")), "component").select(group, "component", "split")


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, n_splits, splits) of keys that stand in several splits."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits"), F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits")).where("n_splits > 1")


def group_folds(rows: DataFrame, group: str, label: str, folds: int, seed: int | str = 42, largest: int = 10_000, classes: int = 100) -> DataFrame:
    """(group, fold from 0): whole groups, dealt so that every fold has its share of each class.

    The ``largest`` groups (by rows, ties by checksum) go one by one, the
    largest first, to the fold that makes the folds' shares of the classes
    most even, ties to the fold with fewer rows: a bounded table, one task.
    All other groups are numbered by checksum among those with the same rows
    of each class, and each such set is shared out by the rows that the folds
    still lack, to a group more or less; no task sees all groups. A null label is a class; a null group takes no part.
    Errors: fewer groups than folds, more than ``classes`` classes.
    """
    known = rows.where(F.col(group).isNotNull())
    names = [r[0] for r in known.select(F.col(label).cast("string")).distinct().orderBy(F.col(label).cast("string")).limit(classes + 1).collect()]
    if len(names) > classes:
        raise ValueError(f"more than {classes} classes")
    per = known.groupBy(group).agg(F.array(*[F.count_if(F.col(label).cast("string").eqNullSafe(F.lit(c))) for c in names]).alias("_c") if names else F.array().cast("array<bigint>").alias("_c"), F.count(F.lit(1)).alias("_size"))
    _checkpoints(rows.sparkSession)
    per = per.withColumn("_draw", draw(seed, F.col(group))).checkpoint()
    if per.limit(folds).count() < folds:
        raise ValueError(f"fewer than {folds} groups")
    first = per.orderBy(F.col("_size").desc(), "_draw", group).limit(largest)
    totals = [max(1, x) for x in (per.agg(*[F.sum(F.col("_c")[i]) for i in range(len(names))]).first() or [])]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_draw"], ascending=[False, True], kind="stable")
        share = np.zeros((folds, len(totals)))
        size = np.zeros(folds)
        out = []
        for counts, n in zip(pdf["_c"], pdf["_size"]):
            add = np.asarray(counts) / totals
            uneven = [np.std(np.where((np.arange(folds) == f)[:, None], share + add, share), axis=0).mean() for f in range(folds)]
            fold = min(range(folds), key=lambda f: (round(uneven[f], 12), size[f], f))
            share[fold] += add
            size[fold] += n
            out.append(fold)
        return pd.DataFrame({group: pdf[group].to_numpy(), "fold": np.array(out, np.int32)})

    kind = rows.schema[group].dataType.simpleString()
    dealt = first.groupBy().applyInPandas(deal, f"`{group}` {kind}, fold int").checkpoint()
    rest = per.join(dealt.select(group), group, "left_anti").withColumn("_set", F.array_join(F.transform("_c", lambda c: c.cast("string")), ","))
    sized = {r["fold"]: r["n"] for r in dealt.join(per, group).groupBy("fold").agg(F.sum("_size").alias("n")).collect()}
    whole = per.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    room = [max(0.0, whole / folds - sized.get(f, 0)) for f in range(folds)]
    bounds = np.cumsum(room) / sum(room) if sum(room) else np.arange(1, folds + 1) / folds
    placed = sums_before(rest, [F.col("_draw").asc(), F.col(group).asc()], {"_at": F.lit(1)}, ["_set"])
    turn = (F.col("_at") + F.crc32(F.col("_set").cast("binary")) / 2.0**32) / F.col("_at_all")
    fold = F.coalesce(*[F.when(turn - F.floor(turn) < float(b), f) for f, b in enumerate(bounds[:-1])], F.lit(folds - 1)) if folds > 1 else F.lit(0)
    return dealt.unionByName(placed.select(group, fold.cast("int").alias("fold")))
