"""Choice of three cuts against trying all of them."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import thresholds

SHAPE = "a double, i double, e double, t boolean, x boolean, y boolean"


def scalar(rows, least, most_a, most_b):
    rows = [r for r in rows if None not in r[:3]]
    targets = max(sum(bool(r[3]) for r in rows), 1)
    best = None
    for a in sorted({r[0] for r in rows}, reverse=True):
        for i in sorted({r[1] for r in rows}):
            for e in sorted({r[2] for r in rows}):
                chosen = [r for r in rows if r[0] >= a and r[1] < i and r[2] < e]
                if not chosen:
                    continue
                n = len(chosen)
                recall, x, y = sum(bool(r[3]) for r in chosen) / targets, sum(bool(r[4]) for r in chosen) / n, sum(bool(r[5]) for r in chosen) / n
                if recall >= least and x <= most_a and y <= most_b and (best is None or (recall, -n, -x) > best[0]):
                    best = ((recall, -n, -x), (a, i, e, n, recall, x, y))
    return best and best[1]


@pytest.mark.parametrize("seed, digits, limits", [(1, 3, (0.3, 0.1, 0.05)), (2, 1, (0.5, 0.2, 0.2)), (3, 3, (0.2, 0.02, 0.02)), (4, 3, (0.1, 0.3, 0.3)), (5, 2, (0.9, 0.0, 0.0))])
def test_cuts_equal_trying_all(spark, seed, digits, limits):
    draw = random.Random(seed)
    rows = [(*(round(draw.random(), digits) for _ in range(3)), draw.random() < 0.3, draw.random() < 0.15, None if draw.random() < 0.1 else draw.random() < 0.1) for _ in range(45)]
    rows += rows[:3] + [(None, 0.1, 0.1, True, False, False)]
    got = [tuple(r) for r in thresholds.choose_thresholds(spark.createDataFrame(rows, SHAPE), "a", "i", "e", "t", "x", "y", *limits).collect()]
    expected = scalar(rows, *limits)
    assert got == ([] if expected is None else [expected])


def test_deep_boxes_equal_trying_all(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "SLICES", 2)
    monkeypatch.setattr(thresholds, "BOXES", 64)
    draw = random.Random(7)
    rows = [(draw.random(), draw.random(), draw.random(), draw.random() < 0.4, draw.random() < 0.1, draw.random() < 0.1) for _ in range(16)]
    got = [tuple(r) for r in thresholds.choose_thresholds(spark.createDataFrame(rows, SHAPE), "a", "i", "e", "t", "x", "y", 0.2, 0.1, 0.1).collect()]
    assert got == [scalar(rows, 0.2, 0.1, 0.1)]


def test_no_rows(spark):
    assert thresholds.choose_thresholds(spark.createDataFrame([], SHAPE), "a", "i", "e", "t", "x", "y").collect() == []
