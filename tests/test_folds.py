"""Folds of whole groups, and the bootstrap of areas against replicates drawn in Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.operators import metrics, splits


@pytest.fixture(scope="module")
def grouped(spark):
    """One group with a third of all rows, some large ones and many small ones; a rare class and a null one."""
    draw = random.Random(6)
    rows = []
    for g in range(400):
        size = 1500 if g == 0 else draw.randrange(30, 80) if g < 20 else draw.randrange(1, 12)
        rows += [(f"g{g}", draw.choices(["a", "b", "c", None], [60, 30, 5, 5])[0]) for _ in range(size)]
    return rows, spark.createDataFrame([*rows, (None, "a")], "g string, y string").repartition(3)


@pytest.mark.parametrize("largest", [10_000, 20, 1])
def test_folds_are_even_and_keep_groups_whole(grouped, largest):
    rows, table = grouped
    got = splits.group_folds(table, "g", "y", 3, largest=largest).collect()
    fold = {r["g"]: r["fold"] for r in got}
    assert len(got) == len(fold) == 400 and set(fold) == {f"g{g}" for g in range(400)} and set(fold.values()) == {0, 1, 2}
    sizes = Counter(fold[g] for g, _ in rows)
    if largest > 1:  # the hot group alone fills a fold, or nearly
        assert max(sizes.values()) < 0.45 * len(rows)
        for y in ("a", "b"):
            n = Counter(fold[g] for g, c in rows if c == y)
            assert max(n.values()) < 0.5 * sum(n.values())
    assert {r["g"]: r["fold"] for r in splits.group_folds(table.repartition(5), "g", "y", 3, largest=largest).collect()} == fold


def test_small_groups_are_dealt_round(spark):
    table = spark.createDataFrame([(g, y) for g in range(300) for y in ((0, 1) if g % 2 else (0, 0, 1))], "g int, y int")
    got = splits.group_folds(table, "g", "y", 5, largest=3).collect()
    per = defaultdict(Counter)
    for r in got:
        per[r["g"] % 2][r["fold"]] += 1
    assert all(max(c.values()) - min(c.values()) <= 4 and len(c) == 5 for c in per.values())


def test_too_few_groups_or_too_many_classes(spark):
    table = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "g int, y int")
    with pytest.raises(ValueError, match="fewer than 3 groups"):
        splits.group_folds(table, "g", "y", 3)
    with pytest.raises(ValueError, match="more than 2 classes"):
        splits.group_folds(table, "g", "y", 2, classes=2)
    assert splits.group_folds(table, "g", "y", 2).count() == 2


def test_bootstrap_of_areas(spark):
    draw = random.Random(2)
    rows = [(f"u{draw.randrange(12)}", draw.choice([0.1, 0.2, 0.5, 0.5, 0.9]), draw.randrange(2)) for _ in range(300)] + [("u1", None, 1), ("u2", 0.4, None)]
    table = spark.createDataFrame(rows, "u string, s double, y int")
    units = spark.createDataFrame([(f"u{k}",) for k in range(12)], "u string")
    weights = defaultdict(Counter)
    for r in metrics.replicated(units, "u", 40, 3).collect():
        weights[r["replicate"]][r["u"]] = r["weight"]
    assert 0.85 < np.mean([weights[k][f"u{u}"] for k in range(40) for u in range(12)]) < 1.15
    got = {r["replicate"]: r["auc"] for r in metrics.bootstrap_auc(table, "u", "s", "y", 40, 3).collect()}
    for k in range(40):
        p, q = ([(s, weights[k][u]) for u, s, y in rows if y == label and s is not None and weights[k][u]] for label in (1, 0))
        expected = sum(w * v * ((a > b) + (a == b) / 2) for a, w in p for b, v in q) / (sum(w for _, w in p) * sum(v for _, v in q))
        assert got[k] == pytest.approx(expected)
    row = metrics.bootstrap_auc_interval(table, "u", "s", "y", 40, seed=3).first()
    assert (row["replicates"], row["low"]) == (40, pytest.approx(np.quantile(list(got.values()), 0.025)))
