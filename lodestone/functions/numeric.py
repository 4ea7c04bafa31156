"""Column functions for scores and vectors."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sigmoid(x: Column, limit: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def log_contribution(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(0.0)


def flag_score(flags: Mapping[str, Column], step: float = 0.2, allowed: Collection[str] | None = None) -> Column:
    """Struct (status, score, unassessed): 1 less ``step`` a true flag, if every flag is known; a flag that is not ``allowed`` is an error."""
    if allowed is not None and set(flags) - set(allowed):
        raise ValueError(f"unknown flags: {sorted(set(flags) - set(allowed))}")
    known = sum((c.isNotNull().cast("int") for c in flags.values()), F.lit(0))
    true = sum((F.coalesce(c, F.lit(False)).cast("int") for c in flags.values()), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(c.isNull(), n) for n, c in flags.items()]))
    status = F.when(known == 0, "not_assessed").when(known < len(flags), "partial").otherwise("assessed")
    return F.struct(status.alias("status"), F.when(known == len(flags), 1 - F.least(F.lit(1.0), step * true)).alias("score"), missing.alias("unassessed"))


def min_max(x: Column, over: WindowSpec) -> Column:
    """x scaled to 0..1 among the finite values; 0.5 where all agree, null where x is not finite."""
    value = F.when(is_finite(x), x)
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(value.isNull(), None).when(high == low, 0.5).otherwise(F.try_divide(value - low, high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, null where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.try_divide(dot(a, b), norm))


def density(count: Column, length: Column, unit: float = 1000.0) -> Column:
    return F.when(length > 0, count / F.greatest(length / unit, F.lit(1.0))).otherwise(0.0)
