"""The similarity join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import similar


def all_pairs(ids, groups, x, least):
    n = np.linalg.norm(x, axis=1)
    c = (x @ x.T) / np.outer(n, n)
    return {(groups[i], min(ids[i], ids[j]), max(ids[i], ids[j])): c[i, j] for i in range(len(ids)) for j in range(i) if groups[i] == groups[j] and c[i, j] >= least}


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty directions with narrow clusters, one of which holds a third of all, copies, and stray vectors."""
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(40, 16))
    of = np.where(draw.random(1200) < 0.33, 0, draw.integers(0, 40, 1200))
    x = (centre[of] + 0.08 * draw.normal(size=(1200, 16))) * draw.uniform(0.1, 9, 1200)[:, None]
    x[1100:1150] = draw.normal(size=(50, 16))
    x[1150:] = x[:50]
    groups = ["a" if k % 7 else None for k in range(1200)]
    rows = [(k, g, v.tolist()) for k, (g, v) in enumerate(zip(groups, x))]
    extra = [(5000, "a", None), (5001, "a", [0.0] * 16), (5002, "a", [float("nan")] * 16), (5003, "a", [None] + [1.0] * 15)]
    return groups, x, spark.createDataFrame(rows + extra, "id long, g string, v array<double>").repartition(3)


@pytest.mark.parametrize(("least", "pivots", "block"), [(0.95, 32, 100), (0.3, 5, 64), (0.999999, 64, 512)])
def test_pairs_equal_all_pairs(clustered, least, pivots, block):
    groups, x, table = clustered
    expected = all_pairs(list(range(1200)), ["all"] * 1200, x, least)
    got = similar.similar_pairs(table, "id", "v", least, pivots=pivots, block=block).collect()
    assert len({(r["src"], r["dst"]) for r in got}) == len(got)
    assert {("all", r["src"], r["dst"]) for r in got} == set(expected)
    assert all(abs(r["cosine"] - expected["all", r["src"], r["dst"]]) < 1e-12 for r in got)


def test_pairs_within_groups(clustered):
    groups, x, table = clustered
    got = similar.similar_pairs(table, "id", "v", 0.9, ["g"], pivots=16).collect()
    assert {(r["g"], r["src"], r["dst"]) for r in got} == set(all_pairs(list(range(1200)), groups, x, 0.9))


def test_few_pairs_are_compared(clustered):
    _, _, table = clustered
    met = similar.members(table, "id", "v", 0.97, pivots=64)
    units = met.groupBy("cell", "band", "bi", "bj").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    compared = units.agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("v"))).first()[0]
    assert compared < 0.3 * 1200 * 1199 / 2  # the largest cluster alone has a ninth of all pairs


def test_nothing_to_compare(spark):
    table = spark.createDataFrame([], "id long, v array<float>")
    assert similar.similar_pairs(table, "id", "v", 0.5).count() == 0
    assert similar.similar_pairs(spark.createDataFrame([(1, [1.0, 0.0])], table.schema), "id", "v", 0.5).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.97])
def test_vectors_are_sent_to_few_units(spark, least):
    """However wide the angle, a vector has few places, and they do not grow with the table."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, 64))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    assert similar.members(table, "id", "v", least, block=40).count() <= similar.PLACES * similar.BLOCKS * 3000
    assert similar.members(table, "id", "v", 0.3, block=40).count() == similar.BLOCKS * 3000
    got = {(r["src"], r["dst"]) for r in similar.similar_pairs(table, "id", "v", least, block=40).collect()}
    assert {("all", *p) for p in got} == set(all_pairs(list(range(3000)), ["all"] * 3000, x, least))


def test_dense_pairs_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "STRIP", 7)
    table = spark.createDataFrame([(k, [1.0, 0.01 * k]) for k in range(50)], "id long, v array<double>")
    assert similar.similar_pairs(table, "id", "v", 0.5, block=20).distinct().count() == 50 * 49 // 2
