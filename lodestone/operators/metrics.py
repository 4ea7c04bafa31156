"""Ranking and classification metrics, as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.order import sums_before


def ndcg(rows: DataFrame, group: Sequence[str], score: str, relevance: str, row_id: str, k: int = 10) -> DataFrame:
    """(group, ndcg): gain 2^rel - 1, discount log2(rank + 1); 0 where nothing is relevant."""
    w = Window.partitionBy(*group)
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), row_id))).withColumn("_i", F.row_number().over(w.orderBy(F.col(relevance).desc(), row_id)))
    at = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1)).otherwise(0.0))
    return ranked.groupBy(*group).agg(at("_r").alias("_dcg"), at("_i").alias("_ideal")).select(*group, F.coalesce(F.try_divide("_dcg", "_ideal"), F.lit(0.0)).alias("ndcg"))


def reciprocal_rank(rows: DataFrame, group: Sequence[str], score: str, relevance: str, row_id: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), row_id))
    return rows.withColumn("_r", rank).groupBy(*group).agg(F.coalesce(1 / F.min(F.when(F.col(relevance) > 0, F.col("_r"))), F.lit(0.0)).alias("rr"))


def auc(rows: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, n, positives, auc, average_precision); ties count half. Works on one row a distinct score, put in order by runs, so a group may be as large as the table."""
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    return _areas(per, group, score)


def _areas(per: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """``auc`` from the positives _p and the others _q of each group's distinct scores."""
    walked = sums_before(per, [F.col(score).asc()], {"_tn": F.col("_q"), "_fn": F.col("_p")}, group)
    # at and above a score: all positives less those below it
    tp, above = F.col("_fn_all") - F.col("_fn"), F.col("_fn_all") - F.col("_fn") + F.col("_tn_all") - F.col("_tn")
    sums = walked.groupBy(*group).agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"), F.sum(F.col("_p") * (F.col("_tn") + F.col("_q") / 2)).alias("u"), F.sum(F.col("_p") * tp / above).alias("ap"))
    return sums.select(*group, (F.col("p") + F.col("q")).alias("n"), F.col("p").alias("positives"), F.try_divide("u", F.col("p") * F.col("q")).alias("auc"), F.try_divide("ap", "p").alias("average_precision"))


def confusion(rows: DataFrame, group: Sequence[str], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """(group, tp, fp, tn, fn, balanced_accuracy, brier)."""
    yes, true = F.col(score) >= cut, F.col(label) == 1
    s = rows.groupBy(*group).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"), F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, F.col(a) + F.col(b)), F.lit(0.0))
    return s.select(*group, "tp", "fp", "tn", "fn", ((rate("tp", "fn") + rate("tn", "fp")) / 2).alias("balanced_accuracy"), "brier")


def kappa(pairs: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """(group, n, agreement, kappa) of two ratings 0 or 1; null where chance agreement is complete."""
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(F.col(a).cast("double")).alias("_a"), F.avg(F.col(b).cast("double")).alias("_b"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return s.select(*group, "n", "agreement", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def pair_loss(rows: DataFrame, group: Sequence[str], score: str, relevance: str) -> DataFrame:
    """(group, pairs, loss): mean of log(1 + exp(-(s_i - s_j))) over pairs with higher relevance; pairs stay within a group."""
    a, b = (rows.select(*group, F.col(score).alias(f"s{k}"), F.col(relevance).alias(f"r{k}")) for k in (1, 2))
    joined = a.join(b, list(group)).where(F.col("r1") > F.col("r2"))
    return joined.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.log1p(F.exp(-(F.col("s1") - F.col("s2"))))).alias("loss"))


def hit_rate(rows: DataFrame, group: Sequence[str], score: str, label: str, row_id: str) -> DataFrame:
    """One row: groups and the share of groups whose best row is labelled."""
    best = rows.groupBy(*group).agg(F.max_by(label, F.struct(score, F.negate(F.col(row_id)))).alias("_hit"))
    return best.agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("_hit") > 0).cast("double")).alias("accuracy"))


def gate_metrics(rows: DataFrame, passed: Column, known: Column) -> DataFrame:
    n = lambda c: F.greatest(F.count_if(c), F.lit(1))
    return rows.agg(F.count_if(passed).alias("n_passed"), (F.count_if(passed & known) / n(known)).alias("recall"), (F.count_if(passed & known) / n(passed)).alias("precision"))


def _poisson(levels: int = 256, most: int = 6) -> list[int]:
    """The first byte value that gives a weight above k, for each k: a Poisson variable of mean 1 in steps of 1 / levels."""
    out, upto, term = [], 0.0, 1 / 2.718281828459045
    for k in range(most):
        upto += term
        out.append(round(upto * levels))
        term /= k + 1
    return out


def poisson_sql(u: str) -> str:
    """The weight of a byte as SQL text."""
    return "CASE " + " ".join(f"WHEN {u} < {cut} THEN {k}" for k, cut in enumerate(_poisson())) + f" ELSE {len(_poisson())} END"


def replicated(rows: DataFrame, unit: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Rows with replicate and weight (0 left out): a Poisson bootstrap of whole units, for any statistic of weighted rows.

    Weights come from the bytes of checksums of the unit, 16 replicates a
    checksum, so reruns agree. Sum up rows by unit (and what else the
    statistic needs) first: each becomes about 0.63 x replicates rows.
    """
    chunks = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 16))))
    chunks = chunks.withColumn("_h", F.md5(F.concat_ws(":", F.col("_k").cast("string"), F.lit(str(seed)), F.col(unit).cast("string"))))
    drawn = chunks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("replicate", F.col("_k") * 16 + F.col("_i")).where(F.col("replicate") < replicates)
    u = F.conv(F.substr("_h", F.col("_i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return drawn.withColumn("_u", u).withColumn("weight", F.expr(poisson_sql("_u"))).where("weight > 0").select(*rows.columns, "replicate", "weight")


def bootstrap(rows: DataFrame, group: str, value: Column, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, mean) of ``replicated`` groups."""
    per = rows.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return replicated(per, group, replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum(F.col("weight") * F.col("_s")), F.sum(F.col("weight") * F.col("_n"))).alias("mean"))


def bootstrap_auc(rows: DataFrame, unit: str, score: str, label: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, auc, average_precision) of ``replicated`` units, ties counting half; null where a replicate has one class only.

    Rows are summed up by unit and score, replicates by score, and each
    replicate's scores are put in order by runs, all replicates at once; a hot
    score or unit is summed up where it is read.
    """
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(unit, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    weighed = replicated(per, unit, replicates, seed).groupBy("replicate", score).agg(F.sum(F.col("weight") * F.col("_p")).alias("_p"), F.sum(F.col("weight") * F.col("_q")).alias("_q"))
    return _areas(weighed, ["replicate"], score).select("replicate", "auc", "average_precision")


def bootstrap_auc_interval(rows: DataFrame, unit: str, score: str, label: str, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: replicates with both classes, auc (their mean), low, high."""
    areas = bootstrap_auc(rows, unit, score, label, replicates, seed).where(F.col("auc").isNotNull())
    tail = round((1 - level) / 2, 10)
    return areas.agg(F.count(F.lit(1)).alias("replicates"), F.avg("auc").alias("auc"), F.percentile("auc", tail).alias("low"), F.percentile("auc", 1 - tail).alias("high"))


def bootstrap_interval(rows: DataFrame, group: str, value: Column, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: replicates, mean, low, high; the interval of the replicates' means (one row a replicate)."""
    means = bootstrap(rows, group, value, replicates, seed).where(F.col("mean").isNotNull())
    tail = round((1 - level) / 2, 10)
    return means.agg(F.count(F.lit(1)).alias("replicates"), F.avg("mean").alias("mean"), F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def category_kappa(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row (n, agreement, kappa) of two raters' labels of any values, on the keys that both have; null where chance agreement is complete."""
    both = left.select(*keys, F.col(label).alias("_a")).join(right.select(*keys, F.col(label).alias("_b")), list(keys)).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    cells = both.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("_a").alias("v")), F.struct(F.lit("b").alias("s"), F.col("_b").alias("v")))).alias("e"), "_n")
    per = sides.groupBy("e.v").agg(F.sum(F.when(F.col("e.s") == "a", F.col("_n")).otherwise(0)).alias("_x"), F.sum(F.when(F.col("e.s") == "b", F.col("_n")).otherwise(0)).alias("_y"))
    chance = per.agg(F.sum(F.col("_x") * F.col("_y")).alias("_c"))
    total = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    agreement, expected = F.try_divide("_same", "n"), F.try_divide("_c", F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select("n", agreement.alias("agreement"), F.when(expected < 1, (agreement - expected) / (1 - expected)).alias("kappa"))


def gate_rates(rows: DataFrame, passed: Column, known: Column, **spoiled: Column) -> DataFrame:
    """One row: rows passed, recall of the known, and the share of the passed that each ``spoiled`` flag holds for; denominators are 1 at least."""
    n = lambda c: F.greatest(F.count_if(c), F.lit(1))
    return rows.agg(F.count_if(passed).alias("n_passed"), (F.count_if(passed & known) / n(known)).alias("recall"), *[(F.count_if(passed & c) / n(passed)).alias(name) for name, c in spoiled.items()])
