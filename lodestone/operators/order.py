"""Order statistics of whole tables: sums before each row in a global order, whatever the skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import _checkpoints


def runs(rows: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Adds _run, the number of a row's range of group and order; written, so that the ranges stay as they are."""
    _checkpoints(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("_run", F.spark_partition_id()).checkpoint()


def sums_before(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Adds, for each of ``sums``, its total over the rows of the group that come before a row in ``order``, and ``<name>_all``, over all of the group.

    Rows are range-partitioned by group and order into runs, whose bounds
    Spark takes from samples, so that an outlier or a dense stretch of values
    leaves the runs even; a group may fill many runs and a run may hold many
    groups. The runs are written once (a second sampling could cut them
    elsewhere); a window within each run and the totals of the group's
    earlier runs, a row a run and group, give the sums. Rows equal in group
    and order stay in one run: count equal values first, or add an id to the
    order, which must then be total for the result to be defined.
    """
    cut = runs(rows.withColumns({f"_sum_{n}": c for n, c in sums.items()}), order, group)
    within = Window.partitionBy("_run", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_run", *group).agg(*[F.sum(f"_sum_{n}").alias(f"_t_{n}") for n in sums])
    of_group = Window.partitionBy(*group)
    earlier = of_group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_run").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_t_{n}").over(of_group).alias(f"{n}_all") for n in sums],
    )
    local = cut.withColumns({n: F.coalesce(F.sum(f"_sum_{n}").over(within), F.lit(0)) for n in sums})
    same = F.col("_run") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(offsets, same)
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])
