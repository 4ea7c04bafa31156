"""Ranks, skylines, consensus, calibration, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import reasons
from lodestone.operators.order import sums_before



def global_rank(rows: DataFrame, score: str, row_id: str, group: Sequence[str] = ()) -> DataFrame:
    """Adds rank (from 1; best score first, ties by id, null last) and percentile (N - rank) / max(1, N - 1), in all rows or in each group."""
    out = sums_before(rows, [F.col(score).desc_nulls_last(), F.col(row_id)], {"_rank": F.lit(1)}, group)
    out = out.withColumn("rank", F.col("_rank") + 1)
    return out.withColumn("percentile", (F.col("_rank_all") - F.col("rank")) / F.greatest(F.lit(1), F.col("_rank_all") - 1)).drop("_rank", "_rank_all")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def skyline(rows: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """Distinct (x, y) that no other pair reaches in both and exceeds in one.

    Skylines of the parts first, then the skyline of what they leave, so the
    last, ordered step sees few pairs. Null or NaN values take no part.
    """

    def survivors(frame: DataFrame, part: Sequence[str]) -> DataFrame:
        best = frame.groupBy(*part, x).agg(F.max(y).alias(y))
        ahead = Window.partitionBy(*part).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return best.withColumn("_ahead", F.max(y).over(ahead)).where(F.col("_ahead").isNull() | (F.col("_ahead") < F.col(y))).drop("_ahead")

    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(x, y)
    local = survivors(pairs.withColumn("_part", F.pmod(F.xxhash64(x, y), F.lit(parts))), ["_part"])
    return survivors(local.select(x, y), [])


def tiers(rows: DataFrame, x: str, y: str, agree: str, veto: str, least_x: float, least_y: float, veto_above: float, least_agree: int = 2) -> DataFrame:
    """Adds tier (A, B, C, unranked, excluded): vetoed rows are excluded, dominated rows are C."""
    vetoed = F.coalesce(F.col(veto) > veto_above, F.lit(False))
    usable = F.col(x).isNotNull() & F.col(y).isNotNull() & ~vetoed
    front = skyline(rows.where(usable), x, y).withColumn("_front", F.lit(True))
    high = (F.col(x) >= least_x) & (F.col(y) >= least_y) & F.coalesce(F.col(agree) >= least_agree, F.lit(False))
    tier = F.when(vetoed, "excluded").when(F.col(x).isNull() | F.col(y).isNull(), "unranked").when(F.col("_front").isNull(), "C").when(high, "A").otherwise("B")
    return rows.join(front, [x, y], "left").withColumn("tier", tier).drop("_front").select(*rows.columns, "tier")


def consensus(rows: DataFrame, row_id: str, scores: Sequence[str], k: int) -> DataFrame:
    """(id, votes): in how many scores' top k a row stands; rows in none are left out."""
    tops = [rows.where(F.col(s).isNotNull()).orderBy(F.col(s).desc(), row_id).limit(k).select(row_id) for s in scores]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.groupBy(row_id).agg(F.count(F.lit(1)).alias("votes"))


def mean_cosine(queries: DataFrame, row_id: str, support: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """(id, group, cosine): the mean of a query's cosines with the support vectors of its group.

    The mean of dot products with unit vectors is the dot product with their
    mean, so the support is summed up once. Zero vectors and nulls take no part.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / norm(F.col(vector)))
    usable = lambda df: df.where(F.coalesce(norm(F.col(vector)) > 0, F.lit(False)))
    mean = usable(support).select(*group, F.posexplode(unit).alias("_k", "_x")).groupBy(*group, "_k").agg(F.avg("_x").alias("_m"))
    mean = mean.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda s: s["_m"]).alias("_mean"))
    dot = F.aggregate(F.zip_with(unit, "_mean", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return usable(queries).select(row_id, *group, vector).join(mean, list(group)).select(row_id, *group, dot.alias("cosine"))


def scaled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column scaled to 0..1 by its own range; the ranges, one row, are broadcast."""
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf"))), F.col(c).cast("double")) for c in columns}
    span = rows.agg(*[f(e).alias(f"_{n}_{c}") for c, e in finite.items() for n, f in (("low", F.min), ("high", F.max))])
    out = rows.crossJoin(F.broadcast(span))
    for c, e in finite.items():
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        out = out.withColumn(f"{c}_scaled", F.when(e.isNull(), None).when(low == high, 0.5).otherwise(F.try_divide(e - low, high - low)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("low", "high")])


def combinations(rows: DataFrame, row_id: str, score: str, most: int = 3, shortlist: int = 60) -> DataFrame:
    """Sets of up to ``most`` of the ``shortlist`` best rows with their noisy-or score; at most C(shortlist, most) rows a size."""
    best = rows.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), row_id).limit(shortlist).select(row_id, score)
    out = level = best.select(F.array(row_id).alias("members"), F.col(row_id).alias("_last"), (1 - F.col(score)).alias("_miss"))
    for _ in range(most - 1):
        level = level.join(F.broadcast(best), F.col("_last") < F.col(row_id)).select(F.concat("members", F.array(row_id)).alias("members"), F.col(row_id).alias("_last"), (F.col("_miss") * (1 - F.col(score))).alias("_miss"))
        out = out.unionByName(level)
    return out.select("members", (1 - F.col("_miss")).alias("score"))


def threshold_grid(rows: DataFrame, a: str, b: str, known: str, steps: int = 10) -> DataFrame:
    """(cut_a, cut_b, n, found, recall) for every pair of thresholds k / steps.

    Rows are counted in grid cells once; the grid then works on at most (steps + 1)^2 cells.
    """
    cell = lambda c: F.least(F.floor(F.col(c) * steps), F.lit(steps)).cast("int")
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(cell(a).alias("_a"), cell(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(known).alias("_k"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i")).crossJoin(rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("j")))
    total = cells.agg(F.sum("_k").alias("_total"))
    joined = grid.join(F.broadcast(cells), (F.col("_a") >= F.col("i")) & (F.col("_b") < F.col("j")), "left").groupBy("i", "j").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("found"))
    return joined.crossJoin(F.broadcast(total)).select((F.col("i") / steps).alias("cut_a"), (F.col("j") / steps).alias("cut_b"), "n", "found", (F.col("found") / F.greatest("_total", F.lit(1))).alias("recall"))


def conformal(pairs: DataFrame, predicted: str, actual: str, alpha: float = 0.1, small: int = 100) -> DataFrame:
    """One row: n, width, status. Width is the ceil((1 - alpha)(n + 1))-th error; under ``small`` rows, or where that place is beyond n, the largest error, widened by 1 / n.

    Errors are counted by value and put in order by runs, so the place is exact.
    """
    errors = pairs.select(F.abs(F.col(predicted) - F.col(actual)).cast("double").alias("_e")).where(F.col("_e").isNotNull())
    counted = errors.groupBy("_e").agg(F.count(F.lit(1)).alias("_c"))
    placed = sums_before(counted, [F.col("_e").asc()], {"_below": F.col("_c")})
    place = F.ceil(F.lit(round(1 - alpha, 10)) * (F.col("_below_all") + 1))
    holds = (F.col("_below") < place) & (F.col("_below") + F.col("_c") >= place)
    picked = placed.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.max("_e").alias("_max"), F.max(F.when(holds, F.col("_e"))).alias("_q"))
    few = F.col("n") < small
    width = F.when(few | F.col("_q").isNull(), F.col("_max") * (1 + F.try_divide(F.lit(1.0), F.col("n")))).otherwise(F.col("_q"))
    status = F.when(F.col("n") == 0, "no_calibration_data").when(few, "small_sample_widened").otherwise("split_conformal")
    return picked.select("n", width.alias("width"), status.alias("status"))


def intervals(rows: DataFrame, point: str, calibration: DataFrame) -> DataFrame:
    """Adds lower, upper and status: the point less and plus ``conformal``'s width, within 0..1; 0..1 without a point or a calibration."""
    finite = F.coalesce(~F.isnan(F.col(point)) & (F.abs(F.col(point)) < F.lit(float("inf"))), F.lit(False))
    known = finite & F.col("width").isNotNull()
    out = rows.crossJoin(F.broadcast(calibration.select("width", F.col("status").alias("_status"))))
    return out.select(
        *rows.columns,
        F.when(known, F.greatest(F.lit(0.0), F.col(point) - F.col("width"))).otherwise(0.0).alias("lower"),
        F.when(known, F.least(F.lit(1.0), F.col(point) + F.col("width"))).otherwise(1.0).alias("upper"),
        F.when(~finite, "unavailable").otherwise(F.col("_status")).alias("status"),
    )


def quadratic_fit(points: DataFrame, group: Sequence[str], t: str, y: str) -> DataFrame:
    """(group, n, c0, c1, c2, status): least squares of y on 1, u, u^2 with u = t / max t, from sums; null where not fitted.

    status: fitted, or why not: too_few_points (under 3), not_finite, negative_time,
    no_positive_time, singular (fewer than 3 different times).
    """
    number = lambda x: F.coalesce(~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) < F.lit(float("inf"))), F.lit(False))
    top = points.groupBy(*group).agg(F.max(t).alias("_top"), F.min(t).alias("_least"), F.count(F.lit(1)).alias("n"), F.count_if(~(number(t) & number(y))).alias("_odd"))
    for g in group:
        top = top.withColumnRenamed(g, f"_group_{g}")
    same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group]
    u = points.join(top, same).select(*group, F.try_divide(F.col(t), F.col("_top")).alias("_u"), F.col(y).alias("_y"), "_top", "_least", "n", "_odd")
    power = lambda k: F.lit(1.0) if k == 0 else F.col("_u") if k == 1 else power(k - 1) * F.col("_u")
    p = [F.sum(power(k)).alias(f"s{k}") for k in range(1, 5)]
    q = [F.sum(power(k) * F.col("_y")).alias(f"y{k}") for k in range(3)]
    # powers of u are at most 1, so three different times show in a determinant above rounding
    s = u.groupBy(*group).agg(F.max("n").alias("n"), F.max("_top").alias("_top"), F.max("_least").alias("_least"), F.max("_odd").alias("_odd"), F.count(F.lit(1)).cast("double").alias("s0"), *p, *q)
    c = F.col

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    m = [[c(f"s{i + j}") for j in range(3)] for i in range(3)]
    whole = det(m)
    put = lambda k: det([[c(f"y{i}") if j == k else m[i][j] for j in range(3)] for i in range(3)])
    status = (
        F.when(c("n") < 3, "too_few_points").when(c("_odd") > 0, "not_finite").when(c("_least") < 0, "negative_time").when(c("_top") <= 0, "no_positive_time")
        .when(F.abs(whole) <= 1e-12 * F.pow(c("s0"), F.lit(3.0)), "singular").otherwise("fitted")
    )
    out = s.withColumn("status", status)
    return out.select(*group, "n", *[F.when(c("status") == "fitted", F.try_divide(put(k), whole)).alias(f"c{k}") for k in range(3)], "status")


def composite(rows: DataFrame, share: str, cost: str, weight: float = 0.5) -> DataFrame:
    """Adds composite: weight x share + (1 - weight) x (cost, turned round and scaled to 0..1 over all rows); null unless both are there."""
    turned = scaled(rows.withColumn("_turned", -F.col(cost)), ["_turned"])
    both = F.col(share).isNotNull() & F.col("_turned_scaled").isNotNull()
    return turned.withColumn("composite", F.when(both, weight * F.col(share) + (1 - weight) * F.col("_turned_scaled"))).drop("_turned", "_turned_scaled")


def combination_scores(rows: DataFrame, edges: DataFrame, row_id: str, gain: str, kept: str, safe: str, worth: str, veto: str, veto_above: float, most: int = 3, shortlist: int = 60) -> DataFrame:
    """(members, gain, retained, safe) of all sets of up to ``most`` of the ``shortlist`` rows with the largest gain x kept x safe.

    Sets with a member whose veto is above ``veto_above`` are left out. gain:
    noisy-or of the members; safe: their least; retained: the share of all
    rows' worth outside the members and their neighbours along ``edges``
    (src, dst, either way); null if there is no worth.
    """
    score = F.col(gain) * F.col(kept) * F.col(safe)
    best = rows.where(score.isNotNull()).orderBy(score.desc(), row_id).limit(shortlist)
    best = best.where(~F.coalesce(F.col(veto) > veto_above, F.lit(False))).select(F.col(row_id).alias("_id"), F.col(gain).alias("_g"), F.col(safe).alias("_s"))
    out = level = best.select(F.array("_id").alias("members"), F.col("_id").alias("_last"), (1 - F.col("_g")).alias("_miss"), F.col("_s").alias("_safe"))
    for _ in range(most - 1):
        # at most C(shortlist, size) rows; the shortlist is the bounded side
        level = level.join(F.broadcast(best), F.col("_last") < F.col("_id")).select(F.concat("members", F.array("_id")).alias("members"), F.col("_id").alias("_last"), (F.col("_miss") * (1 - F.col("_g"))).alias("_miss"), F.least("_safe", "_s").alias("_safe"))
        out = out.unionByName(level)
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    near = best.select("_id").join(edges.select(ends).select(F.col("e.src").alias("_id"), F.col("e.dst").alias("_out")), "_id").unionByName(best.select("_id", F.col("_id").alias("_out"))).distinct()
    priced = near.join(rows.select(F.col(row_id).alias("_out"), F.coalesce(worth, F.lit(0.0)).alias("_w")), "_out")
    lost = out.select("members", F.explode("members").alias("_id")).join(priced, "_id").select("members", "_out", "_w").distinct().groupBy("members").agg(F.sum("_w").alias("_lost"))
    total = rows.agg(F.coalesce(F.sum(worth), F.lit(0.0)).alias("_total"))
    joined = out.join(lost, "members", "left").crossJoin(F.broadcast(total))
    return joined.select("members", (1 - F.col("_miss")).alias("gain"), F.when(F.col("_total") > 0, (F.col("_total") - F.coalesce("_lost", F.lit(0.0))) / F.col("_total")).alias("retained"), F.col("_safe").alias("safe"))


def position_scores(weights: Column, valid: Column) -> Column:
    """Scores of positions from attention weights [head][query][key] and a mask of valid positions: null without a valid one.

    The weights of valid queries are summed over heads and queries, divided by
    the number of valid positions and scaled to 0..1 over them; 0 elsewhere
    and where all are equal.
    """
    zero = F.transform(valid, lambda _: F.lit(0.0))
    add = lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b)
    masked = lambda head: F.zip_with(head, valid, lambda row, v: F.transform(row, lambda x: F.when(v, x.cast("double")).otherwise(0.0)))
    summed = F.aggregate(weights, zero, lambda acc, head: F.aggregate(masked(head), acc, add))
    n = F.size(F.filter(valid, lambda v: v))
    inside = lambda s: F.filter(F.zip_with(s, valid, lambda x, v: F.when(v, x / n)), lambda x: x.isNotNull())
    low, high = F.array_min(inside(summed)), F.array_max(inside(summed))
    return F.when(n > 0, F.zip_with(summed, valid, lambda x, v: F.when(v & (high > low), (x / n - low) / (high - low)).otherwise(0.0)))


def class_ranking(rows: DataFrame, classes: Sequence[str], row_id: str, score: str, cutoffs: dict[str, float], evidence: DataFrame) -> DataFrame:
    """Rows (id, class, score) with rank in the class, call (score at or above the class's cutoff) and status.

    status joins evidence (id, class) and call: known_above, known_below,
    candidate, below. A row of a class that is not listed is an error.
    """
    kind = F.element_at(F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(float(cutoffs[c])))]), F.col("class"))
    listed = F.coalesce(F.col("class").isin(list(classes)), F.lit(False))
    checked = rows.where(F.when(listed, True).otherwise(F.raise_error(F.concat(F.lit("no cutoff for class "), F.coalesce(F.col("class").cast("string"), F.lit("null")))).cast("boolean")))
    ranked = global_rank(checked, score, row_id, ["class"]).drop("percentile")
    known = evidence.select(row_id, "class").distinct().withColumn("_known", F.lit(True))
    out = ranked.join(known, [row_id, "class"], "left").withColumn("call", F.coalesce(F.col(score) >= kind, F.lit(False)))
    status = F.when(F.col("_known") & F.col("call"), "known_above").when(F.col("_known"), "known_below").when(F.col("call"), "candidate").otherwise("below")
    return out.withColumn("status", status).drop("_known")


def recall_at_cutoff(ranked: DataFrame, evidence: DataFrame, classes: Sequence[str], row_id: str) -> DataFrame:
    """(class, known, scored, found, recall) of ``class_ranking``'s rows for every listed class.

    known: distinct ids of the evidence; scored: those among the rows; found:
    those at or above the cutoff; recall: found over known, null without any.
    """
    known = evidence.where(F.col("class").isin(list(classes))).select(row_id, "class").distinct()
    mine = ranked.groupBy(row_id, "class").agg(F.max("call").alias("call"))
    per = known.join(mine, [row_id, "class"], "left").groupBy("class").agg(F.count(F.lit(1)).alias("known"), F.count("call").alias("scored"), F.count_if("call").alias("found"))
    every = ranked.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    out = every.join(per, "class", "left").fillna(0, ["known", "scored", "found"])
    return out.withColumn("recall", F.try_divide("found", "known"))


def screened(rows: DataFrame, group: Sequence[str], score: str, year: str, row_id: str, least: float, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group with at least ``least``: best score first, then the latest year (null as 0), then id."""
    order = [F.col(score).desc(), F.coalesce(year, F.lit(0)).desc(), F.col(row_id)]
    return top_per_group(rows.where(F.col(score) >= least), group, order, quota)


def top_overlap(rows: DataFrame, row_id: str, scores: Sequence[str], k: int, least: float = 0.3) -> DataFrame:
    """One row a pair of scores (a, b, overlap): rows in both top k over k, and ``disagree``: whether the mean overlap of all pairs is below ``least``."""
    tops = {s: rows.where(F.col(s).isNotNull()).orderBy(F.col(s).desc(), row_id).limit(k).select(row_id) for s in scores}
    out = None
    for i, a in enumerate(scores):
        for b in scores[i + 1 :]:
            part = tops[a].join(tops[b], row_id).agg((F.count(F.lit(1)) / max(1, k)).alias("overlap")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "overlap")
            out = part if out is None else out.unionByName(part)
    return out.withColumn("disagree", F.avg("overlap").over(Window.partitionBy()) < least)  # one row a pair of columns


def judged_tiers(rows: DataFrame, x: str, y: str, safe: str, agree: str, veto: str, least_x: float, least_y: float, veto_above: float, powers: tuple[float, float, float] = (1.0, 1.0, 1.0), least_agree: int = 2) -> DataFrame:
    """``tiers`` with reasons (sorted) and utility, x^p y^q safe^r, null unless all three are there; shares outside 0..1 are an error."""
    shares = (x, y, safe, veto)
    odd = F.lit(False)
    for c in shares:
        odd = odd | (F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(0, 1), F.lit(False)))
    checked = rows.where(F.when(odd, F.raise_error(F.lit("a share lies outside 0..1")).cast("boolean")).otherwise(True))
    out = tiers(checked, x, y, agree, veto, least_x, least_y, veto_above, least_agree)
    missing = F.col(x).isNull() | F.col(y).isNull()
    vetoed, below = F.col("tier") == "excluded", ~((F.col(x) >= least_x) & (F.col(y) >= least_y))
    why = reasons(
        ((F.col("tier") == "B") & ~F.coalesce(F.col(agree) >= least_agree, F.lit(False)), "agreement_not_met"), ((F.col("tier") == "B") & below, "below_threshold"),
        (F.col("tier") == "C", "dominated"), (missing | vetoed, "unavailable"), (vetoed, "vetoed"),
    )
    p, q, r = powers
    return out.withColumn("reasons", F.array_sort(why)).withColumn("utility", F.pow(x, F.lit(p)) * F.pow(y, F.lit(q)) * F.pow(safe, F.lit(r)))
