"""The best admissible cuts of three scores, by branch and bound over boxes of cuts."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.order import sums_before

#: Slices an axis of a box is cut into, and boxes counted in one pass over the rows: 256 x 9^3 sums at most reach the driver from a pass.
SLICES, BOXES = 8, 256
COUNTS = ("n", "t", "p", "q")


def choose_thresholds(rows: DataFrame, high: str, low_a: str, low_b: str, target: str, spoiled_a: str, spoiled_b: str, least_recall: float = 0.6, most_a: float = 0.05, most_b: float = 0.02) -> DataFrame:
    """One row: cut_high, cut_a, cut_b, n, recall, rate_a, rate_b of the best admissible thresholds; no row if none is.

    A row is chosen if high >= cut_high, low_a < cut_a and low_b < cut_b, for
    cuts among the columns' own values. Admissible: some rows, recall of
    ``target`` and the shares of ``spoiled_a`` and ``spoiled_b`` within bounds.
    Best: most recall, fewest rows, least rate_a, then the highest cut_high and
    lowest other cuts. Rows with a null score take no part; a null flag is false.

    Scores become ranks of their distinct values, and what a cut chooses only
    grows with its three ranks. So a box of cuts can reach no more targets than
    its last corner has, no fewer rows than lie before its first, and no lower
    rate than the spoiled rows before its first corner among the sound ones of
    its last. A pass over the rows counts up to ``BOXES`` boxes at once, each
    cut into ``SLICES`` an axis: the grid's own cuts are tried exactly, and the
    sub-boxes that may still hold something better are searched on, deepest
    first, which bounds those waiting by BOXES x SLICES^3 a level. Result and
    search are exact for any number of distinct values; only what cannot be
    ruled out by the bounds costs passes.
    """
    axes = {"_a": high, "_b": low_a, "_c": low_b}
    spark = rows.sparkSession
    kinds = {n: rows.schema[c].dataType for n, c in axes.items()}
    shape = T.StructType([T.StructField(n, kinds[a]) for n, a in zip(("cut_high", "cut_a", "cut_b"), axes)] + [T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("recall", "rate_a", "rate_b")]])
    usable = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in axes.values()))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    cells = usable.groupBy(*[F.col(c).alias(n) for n, c in axes.items()]).agg(F.count(F.lit(1)).alias("n"), flag(target).alias("t"), flag(spoiled_a).alias("p"), flag(spoiled_b).alias("q"))
    ranks = {a: sums_before(cells.select(a).distinct(), [F.col(a).desc() if a == "_a" else F.col(a)], {f"{a}_rank": F.lit(1)}).checkpoint() for a in axes}
    for a in axes:
        # a row falls below a low cut of a higher rank, and reaches a high cut of its own
        cells = cells.join(ranks[a].select(a, (F.col(f"{a}_rank") + (0 if a == "_a" else 1)).cast("long").alias(f"{a}_at")), a)
    cells = cells.select(*[f"{a}_at" for a in axes], *COUNTS).checkpoint()
    sizes = [ranks[a].count() for a in axes]
    if not all(sizes):
        return spark.createDataFrame([], shape)
    targets = max(cells.agg(F.sum("t")).first()[0], 1)
    best = _search(spark, cells, sizes, targets, least_recall, most_a, most_b)
    if best is None:
        return spark.createDataFrame([], shape)
    t, n, p, q, *cuts = best
    values = [ranks[a].where(F.col(f"{a}_rank") == cut).first()[a] for a, cut in zip(axes, cuts)]
    return spark.createDataFrame([(*values, n, t / targets, p / n, q / n)], shape)


def _search(spark: SparkSession, cells: DataFrame, sizes: list[int], targets: int, least_recall: float, most_a: float, most_b: float) -> tuple[int, ...] | None:
    """(t, n, p, q, cuts) of the best admissible cuts; None if there are none."""
    best: tuple | None = None  # (-t, n, p / n, cuts..., p, q), smaller is better
    # (level, bound: -t, n, rate, cuts; first and last cut an axis)
    waiting = [(0, (-targets, 0, 0.0, 0, 0, 0), (0, 0, 0), tuple(s - 1 for s in sizes))]
    while waiting:
        boxes = []
        while waiting and len(boxes) < BOXES:
            level, bound, first, last = heapq.heappop(waiting)
            if best is None or bound < best[:6]:
                boxes.append((level, first, last))
        if not boxes:
            break
        grids = _grids(spark, cells, [(f, l) for _, f, l in boxes])
        children = []
        for (level, first, last), grid in zip(boxes, grids):
            first, last = np.array(first), np.array(last)
            steps = -(-(last - first + 1) // SLICES)
            slices = -(-(last - first + 1) // steps)
            n, t, p, q = grid[:, : slices[0] + 1, : slices[1] + 1, : slices[2] + 1]
            hi, lo = (slice(1, None),) * 3, (slice(None, -1),) * 3
            at = np.indices(tuple(slices))
            starts = first[:, None, None, None] + at * steps[:, None, None, None]
            ends = np.minimum(starts + steps[:, None, None, None] - 1, last[:, None, None, None])
            # the grid's own cuts, exactly
            some = np.maximum(n[hi], 1)
            fit = (n[hi] > 0) & (t[hi] / targets >= least_recall) & (p[hi] / some <= most_a) & (q[hi] / some <= most_b)
            if fit.any():
                keys = [-t[hi][fit], n[hi][fit], (p[hi] / some)[fit], *(e[fit] for e in ends)]
                top = np.lexsort(keys[::-1])[0]
                key = tuple(k[top].item() for k in keys) + (p[hi][fit][top].item(), q[hi][fit][top].item())
                if best is None or key < best:
                    best = key
            # what the cuts inside a sub-box can reach at best
            rate = [x[lo] / np.maximum(x[lo] + n[hi] - x[hi], 1) for x in (p, q)]
            open_ = (n[hi] > 0) & (t[hi] / targets >= least_recall) & (rate[0] <= most_a) & (rate[1] <= most_b) & (ends > starts).any(axis=0)
            if best is not None:
                open_ &= (-t[hi] < best[0]) | ((-t[hi] == best[0]) & (n[lo] <= best[1]))
            children.append((level - 1, -t[hi][open_], n[lo][open_], rate[0][open_], starts[:, open_].T, ends[:, open_].T))
        for level, t, n, rate, starts, ends in children:
            for row in zip(t.tolist(), n.tolist(), rate.tolist(), starts.tolist(), ends.tolist()):
                bound = (*row[:3], *row[3])
                if best is None or bound < best[:6]:
                    heapq.heappush(waiting, (level, bound, tuple(row[3]), tuple(row[4])))
    return None if best is None else (-best[0], best[1], best[6], best[7], *best[3:6])


def _grids(spark: SparkSession, cells: DataFrame, boxes: list[tuple]) -> np.ndarray:
    """Of each box the counts chosen by its grid's cuts: box x (n, t, p, q) x places an axis; place 0 lies just before the box."""
    step = lambda f, l: -(-(l - f + 1) // SLICES)
    table = spark.createDataFrame([(i, *f, *l, *map(step, f, l)) for i, (f, l) in enumerate(boxes)], "box int, " + ", ".join(f"{k}{d} long" for k in ("f", "l", "s") for d in range(3)))
    at = [F.col(f"{a}_at") for a in ("_a", "_b", "_c")]
    place = [F.when(at[d] < F.col(f"f{d}"), 0).otherwise(F.expr(f"({n}_at - f{d}) div s{d} + 1")).cast("int").alias(f"g{d}") for d, n in enumerate(("_a", "_b", "_c"))]
    inside = (at[0] <= F.col("l0")) & (at[1] <= F.col("l1")) & (at[2] <= F.col("l2"))
    # at most BOXES rows are broadcast, and a sum for each place of their grids comes back
    sums = cells.join(F.broadcast(table), inside).groupBy("box", *place).agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()
    out = np.zeros((len(boxes), len(COUNTS), *[SLICES + 1] * 3), np.int64)
    index = [sums.column(c).to_numpy() for c in ("box", "g0", "g1", "g2")]
    for k, c in enumerate(COUNTS):
        out[index[0], k, index[1], index[2], index[3]] = sums.column(c).to_numpy()
    return out.cumsum(2).cumsum(3).cumsum(4)
