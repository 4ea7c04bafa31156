"""Counts, ranges, pivots and weights of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.order import sums_before


def missing_by_field(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, missing): null or blank values of each column, by one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "field", "missing")


def numeric_ranges(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n, low, high), nulls apart; null range for a column without values."""
    out = rows.agg(*[F.struct(F.lit(c).alias("field"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns])
    return out.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def pivot_counts(rows: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """One row a key with the count of each of ``values`` (0 where there are none)."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(category) == v).alias(v) for v in values])


def category_map(rows: DataFrame, key: str, category: str) -> DataFrame:
    """(key, counts map, total)."""
    per = rows.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "_n")))).alias("counts"), F.sum("_n").alias("total"))


def median_log_ratio(rows: DataFrame, key: str, category: str) -> DataFrame:
    """(key, categories, total, log_ratio): counts at least 1 a category; high over low half by the median; 0 for one category."""
    per = rows.groupBy(key, category).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("v"))
    g = per.groupBy(key).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.median("v").alias("m"))
    low = F.aggregate(F.filter("vs", lambda v: v <= F.col("m")), F.lit(0).cast("long"), lambda a, v: a + v)
    high = F.aggregate(F.filter("vs", lambda v: v > F.col("m")), F.lit(0).cast("long"), lambda a, v: a + v)
    ratio = F.when(F.size("vs") >= 2, F.log2((low + 1) / (high + 1))).otherwise(0.0)
    return g.select(key, F.size("vs").alias("categories"), F.aggregate("vs", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), ratio.alias("log_ratio"))


def tier(total: Column, ratio: Column, low: int = 5, high: int = 50, edge: float = 1.0) -> tuple[Column, Column]:
    """(coverage, call): a ratio below -edge is essential, above edge dispensable."""
    coverage = F.when(total < low, "low").when(total < high, "medium").otherwise("high")
    call = F.when(total < low, "untested").when(ratio < -edge, "essential").when(ratio > edge, "dispensable").otherwise("conditional")
    return coverage, call


def class_weights(rows: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """(label, n, weight): (1 - beta) / (1 - beta^n), scaled to mean 1 over the classes."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("_w", (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n"))))
    mean = per.agg(F.avg("_w").alias("_mean"))  # one row
    return per.crossJoin(F.broadcast(mean)).select(label, "n", (F.col("_w") / F.col("_mean")).alias("weight"))


def noisy_or(rows: DataFrame, group: Sequence[str], p: str) -> DataFrame:
    """(group, n, p_any): 1 - product of (1 - p); null where any p is null."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if(F.col(p).isNull()) == 0, 1 - F.product(1 - F.col(p))).alias("p_any"))


def entropy(rows: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """(group, categories, entropy): of the shares of categories, divided by its largest value; 0 for one."""
    per = rows.groupBy(*group, category).agg(F.count(F.lit(1)).alias("_n"))
    # -sum p ln p = ln N - sum n ln n / N
    s = per.groupBy(*group).agg(F.count(F.lit(1)).alias("categories"), F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.ln("_n")).alias("_x"))
    return s.select(*group, "categories", F.when(F.col("categories") > 1, (F.ln("_t") - F.col("_x") / F.col("_t")) / F.ln("categories")).otherwise(0.0).alias("entropy"))


def upper_median(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, upper_median): the value at place n div 2 (from 0) in order, from counts of distinct values put in order by runs."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = sums_before(per, [F.col(value).asc()], {"_at": F.col("_c")}, group)
    middle = F.floor(F.col("_at_all") / 2)
    return placed.where((F.col("_at") <= middle) & (F.col("_at") + F.col("_c") > middle)).select(*group, F.col("_at_all").alias("n"), F.col(value).alias("upper_median"))


def joined_values(rows: DataFrame, key: str, value: str, order: Sequence[str], separator: str = ";") -> DataFrame:
    """(key, joined): the values in ``order``, joined."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["_v"]), separator).alias("joined"))


def groups_per_class(rows: DataFrame, label: str, group: str) -> DataFrame:
    return rows.groupBy(label).agg(F.countDistinct(group).alias("groups"), F.count(F.lit(1)).alias("n"))


def pre_aggregated_join(left: DataFrame, right: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Left join with the right side summed up by key first, so rows of ``left`` never multiply."""
    return left.join(right.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()]), key, "left")


def positions(rows: DataFrame, key: str, place: str, side: str, sides: Sequence[str]) -> DataFrame:
    """(key, n, places, n_<side>...): rows, distinct places and rows on each side."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(place).alias("places"), *[F.count_if(F.col(side) == s).alias(f"n_{s}") for s in sides])


def aliased(columns: Sequence[str], aliases: Sequence[str]) -> str:
    """The column that has one of the names, whatever its case and a leading ``#``."""
    found = [c for c in columns if c.lstrip("#").casefold() in aliases]
    if not found:
        raise ValueError(f"none of {sorted(aliases)} is among the columns {sorted(columns)}")
    return found[0]


def category_audit(rows: DataFrame, column: str, ineligible: Sequence[str]) -> DataFrame:
    """(value, n, eligible): counts of a column's values (null as empty), eligible unless listed."""
    per = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("eligible", ~F.col("value").isin(list(ineligible)))


def alignment(rows: DataFrame, group: str, row_id: str, text: str, sample: int = 100) -> DataFrame:
    """(group, n, consensus, effective, identity): of rows aligned by character position.

    consensus: the most frequent character of each position that all rows
    reach (ties: the smaller; ``-`` and ``.`` do not count, X if nothing else
    stands there); effective: rows that agree with it in 60 % or more;
    identity: the mean over all pairs of the first ``sample`` rows (by id) of
    the share of equal characters in the shorter length, 1 for a single row.
    """
    texts = rows.select(group, row_id, F.coalesce(text, F.lit("")).alias("_t"))
    size = texts.groupBy(group).agg(F.min(F.length("_t")).alias("_l"), F.count(F.lit(1)).alias("n"))
    cut = texts.join(size, group).withColumn("_c", F.when(F.col("_l") > 0, F.split(F.substr("_t", F.lit(1), F.col("_l")), "")).otherwise(F.array().cast("array<string>")))
    letters = cut.select(group, F.posexplode("_c").alias("_i", "_x")).groupBy(group, "_i", "_x").agg(F.count(F.lit(1)).alias("_n"))
    counted = F.when(~F.col("_x").isin("-", "."), F.struct(-F.col("_n"), F.col("_x")))
    best = letters.groupBy(group, "_i").agg(F.coalesce(F.min(counted)["_x"], F.lit("X")).alias("_x"))
    line = best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_cons"))
    agree = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & ~x.isin("-", ".")), lambda e: e))
    near = cut.join(line, group).groupBy(group).agg(F.max("n").alias("n"), F.max(F.array_join("_cons", "")).alias("consensus"), F.count_if(agree(F.col("_c"), F.col("_cons")) >= 0.6 * F.col("_l")).alias("effective"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(row_id))
    first = texts.withColumn("_r", rank).where(F.col("_r") <= sample)
    a, b = first.select(group, F.col("_r").alias("_ra"), F.split("_t", "").alias("_a"), F.length("_t").alias("_la")), first.select(group, F.col("_r").alias("_rb"), F.split("_t", "").alias("_b"), F.length("_t").alias("_lb"))
    pairs = a.join(b, group).where(F.col("_ra") < F.col("_rb"))
    share = F.coalesce(F.try_divide(agree(F.slice("_a", 1, F.least("_la", "_lb")), F.slice("_b", 1, F.least("_la", "_lb"))), F.least("_la", "_lb")), F.lit(0.0))
    identity = pairs.groupBy(group).agg(F.avg(share).alias("identity"))
    return near.join(identity, group, "left").select(group, "n", "consensus", "effective", F.coalesce("identity", F.lit(1.0)).alias("identity"))


def position_coverage(rows: DataFrame, group: str, text: str, length: int) -> DataFrame:
    """(group, covered): the share of the first ``length`` positions at which some row has a character other than ``-`` and ``.``."""
    spots = rows.select(group, F.posexplode(F.split(F.substring(F.coalesce(text, F.lit("")), 1, length), "")).alias("_i", "_x")).where(~F.col("_x").isin("", "-", "."))
    seen = spots.groupBy(group).agg(F.countDistinct("_i").alias("_n"))
    return rows.select(group).distinct().join(seen, group, "left").select(group, (F.coalesce("_n", F.lit(0)) / length).alias("covered"))


def strata_coverage(strata: DataFrame, inputs: DataFrame, stratum: str, weight: str, factors: Sequence[str], low: str, high: str, members: DataFrame, member: str) -> DataFrame:
    """One row (lower, upper, missing): the weighted mean over strata of the chance that any member covers, with the low and the high chance.

    ``inputs`` holds (member, stratum, factors, low, high); a member covers a
    stratum with the product of the factors and the chance. A pair of member
    and stratum without all of them makes the result null: nothing is assumed.
    Negative or no weights are an error.
    """
    pairs = strata.select(stratum, weight).join(members.select(member).distinct()).join(inputs, [member, stratum], "left")
    share = F.lit(1.0)
    for f in factors:
        share = share * F.col(f)
    known = share.isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    per = pairs.groupBy(stratum, weight).agg(F.count_if(~known).alias("_missing"), *[(1 - F.product(1 - share * F.col(c))).alias(f"_{n}") for n, c in (("low", low), ("high", high))])
    w = F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("a weight is negative")).cast("double"))
    total = per.agg(F.sum("_missing").alias("missing"), F.sum(w).alias("_w"), *[F.sum(F.col(weight) * F.col(f"_{n}")).alias(f"_{n}") for n in ("low", "high")])
    value = lambda n: F.when(F.col("missing") > 0, None).when(F.col("_w") > 0, F.col(f"_{n}") / F.col("_w"))
    return total.select(value("low").alias("lower"), value("high").alias("upper"), "missing")


def spread_density(rows: DataFrame, group: Sequence[str], score: str, power: float = 1.0) -> DataFrame:
    """(group, n, density, evenness, spread): mean score within 0..1, normalised entropy of the scores above 0, and density x evenness^power."""
    x = F.col(score).cast("double")
    with_score = rows.where(F.col(score).isNotNull()).select(*group, F.greatest(x, F.lit(0.0)).alias("_x"), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("_c"))
    totals = with_score.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("_t"), F.avg("_c").alias("density"))
    for g in group:
        totals = totals.withColumnRenamed(g, f"_group_{g}")
    joined = with_score.join(totals, [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group])
    p = F.try_divide("_x", "_t")
    out = joined.groupBy(*group).agg(F.max("n").alias("n"), F.max("density").alias("density"), F.max("_t").alias("_t"), (-F.sum(p * F.ln(p + 1e-12))).alias("_h"))
    evenness = F.when((F.col("_t") > 0) & (F.col("n") > 1), F.col("_h") / F.ln("n")).otherwise(0.0)
    return out.select(*group, "n", "density", evenness.alias("evenness"), (F.col("density") * F.pow(evenness, F.lit(power))).alias("spread"))


def sample_weights(rows: DataFrame, label: str, tier: Column, weights: dict[str, float], beta: float = 0.999) -> DataFrame:
    """Adds weight: the class weight times that of the row's tier; the least of them for other tiers."""
    tiers = F.lit(min(weights.values()))
    for name, value in weights.items():
        tiers = F.when(tier == name, value).otherwise(tiers)
    # one row a class
    return rows.join(F.broadcast(class_weights(rows, label, beta).select(label, F.col("weight").alias("_class"))), label).withColumn("weight", F.col("_class") * tiers).drop("_class")


def filtered_summary(rows: DataFrame, kept: Column, score: str, amount: str, call: str, calls: Sequence[str]) -> DataFrame:
    """One row: all rows, kept rows, kept rows of each call, mean and median score and mean amount of the kept (0 without any)."""
    mean = lambda f, c: F.coalesce(f(F.when(kept, F.col(c))), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), *[F.count_if(kept & (F.col(call) == c)).alias(f"n_{c}") for c in calls], mean(F.avg, score).alias("mean_score"), mean(F.median, score).alias("median_score"), mean(F.avg, amount).alias("mean_amount"))
