"""Order statistics against sorting in Python, under outliers, hot values and hot groups; the classifier against Newton's method."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregate, linear, metrics, order, ranking, textmine


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one value, one row lies far out, one group holds most rows."""
    draw = random.Random(5)
    rows = [(i, 1.0 if i % 3 == 0 else draw.random(), "a" if draw.random() < 0.9 else draw.choice(["b", "c", None]), int(draw.random() < 0.3)) for i in range(4000)]
    rows += [(4000, 1e300, "a", 1), (4001, -1e300, "a", 0), (4002, None, "a", 1), (4003, 0.5, "d", 1)]
    return rows, spark.createDataFrame(rows, "id long, s double, g string, y int").repartition(5)


def test_runs_are_even(spark, skewed):
    rows, table = skewed
    cut = order.runs(table, [F.col("s").desc_nulls_last(), F.col("id")])
    sizes = [r["count"] for r in cut.groupBy("_run").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * len(rows) / 4


def test_ranks(skewed):
    rows, table = skewed
    place = lambda r: (r[1] is None, -(r[1] or 0), r[0])
    got = {r["id"]: r["rank"] for r in ranking.global_rank(table, "s", "id").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=place), 1)}
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    expected = {r[0]: (k, (len(g) - k) / max(1, len(g) - 1)) for g in groups.values() for k, r in enumerate(sorted(g, key=place), 1)}
    got = {r["id"]: (r["rank"], r["percentile"]) for r in ranking.global_rank(table, "s", "id", ["g"]).collect()}
    assert got == expected


def test_sums_before(skewed):
    rows, table = skewed
    out = order.sums_before(table.where("s IS NOT NULL"), [F.col("s").asc(), F.col("id").asc()], {"ones": F.col("y"), "n": F.lit(1)}, ["g"])
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[2]].append(r)
    expected = {}
    for g in groups.values():
        ones = 0
        for k, r in enumerate(sorted(g, key=lambda r: (r[1], r[0]))):
            expected[r[0]] = (ones, k, sum(x[3] for x in g), len(g))
            ones += r[3]
    assert {r["id"]: (r["ones"], r["n"], r["ones_all"], r["n_all"]) for r in out.collect()} == expected


def test_medians_areas_and_widths(skewed):
    rows, table = skewed
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[2]].append(r)
    got = {r["g"]: (r["n"], r["upper_median"]) for r in aggregate.upper_median(table, ["g"], "s").collect()}
    assert got == {g: (len(v), sorted(r[1] for r in v)[len(v) // 2]) for g, v in groups.items()}
    for r in metrics.auc(table, ["g"], "s", "y").collect():
        p, q = ([x[1] for x in groups[r["g"]] if x[3] == y] for y in (1, 0))
        if p and q:
            assert r["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in q]))
        scores = [x[1] for x in groups[r["g"]]]
        assert r["average_precision"] == pytest.approx(np.mean([sum(b >= a for b in p) / sum(b >= a for b in scores) for a in p]))
    errors = sorted(abs(r[1] - 0.25) for r in rows if r[1] is not None)
    for alpha in (0.1, 0.34, 0.9999):
        width = ranking.conformal(table.withColumn("t", F.lit(0.25)), "s", "t", alpha).first()
        k = int(np.ceil(round(1 - alpha, 10) * (len(errors) + 1)))
        assert (width["n"], width["width"], width["status"]) == (len(errors), errors[k - 1], "split_conformal")


def test_recall_at_cutoffs(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.1), (3, "b", 0.5), (4, "b", None)], "id int, class string, s double")
    known = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (9, "a"), (4, "b"), (5, "z")], "id int, class string")
    ranked = ranking.class_ranking(rows, ["a", "b", "c"], "id", "s", {"a": 0.5, "b": 0.5, "c": 0.5}, known)
    got = {r["class"]: tuple(r)[1:] for r in ranking.recall_at_cutoff(ranked, known, ["a", "b", "c"], "id").collect()}
    assert got == {"a": (3, 2, 1, 1 / 3), "b": (1, 1, 0, 0.0), "c": (0, 0, 0, None)}
    with pytest.raises(Exception, match="no cutoff for class b"):
        ranking.class_ranking(rows, ["a"], "id", "s", {"a": 0.5}, known).collect()


def newton(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(np.eye(len(w)) + (x * (c * p * (1 - p))[:, None]).T @ x, w + x.T @ (c * (p - y)))
        w -= step
        if np.abs(step).max() < 1e-13:
            break
    return w


def test_classifier_equals_newtons_method(spark):
    draw = random.Random(8)
    rows = [(i, int(i % 5 == 0), "".join(draw.choice("ab" if i % 5 else "abc") for _ in range(draw.randrange(0, 15)))) for i in range(120)] + [(999, None, "abc")]
    table = spark.createDataFrame(rows, "id int, y int, t string")
    grams = textmine.tfidf(table, "id", textmine.char_ngrams(F.col("t"), 1, 3), most_terms=12)
    counts = defaultdict(int)
    for _, _, t in rows:
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                counts[t[k : k + n]] += 1
    terms = sorted(sorted(counts, key=lambda g: (-counts[g], g))[:12])
    assert sorted(r["term"] for r in grams.select("term").distinct().collect()) == terms
    fitted = linear.fit_logistic(table, grams, "id", "y", tolerance=1e-12)
    got = {r["term"]: r["coefficient"] for r in fitted.collect()}
    known = [(i, y) for i, y, _ in rows if y is not None]
    place, column = {i: k for k, (i, _) in enumerate(known)}, {g: k for k, g in enumerate(terms)}
    x = np.zeros((len(known), 13))
    x[:, 12] = 1
    for r in grams.collect():
        if r["id"] in place:
            x[place[r["id"]], column[r["term"]]] = r["weight"]
    y = np.array([y for _, y in known], float)
    w = newton(x, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())))
    assert np.allclose([got[t] for t in [*terms, None]], w, atol=1e-5)
    scores = {r["id"]: r["score"] for r in linear.decisions(table, grams, "id", fitted).collect()}
    assert np.allclose([scores[i] for i, _ in known], x @ w, atol=1e-4) and 999 in scores
    with pytest.raises(ValueError, match="more than 5 terms"):
        linear.fit_logistic(table, grams, "id", "y", most_terms=5)
    with pytest.raises(ValueError, match="not 0 and 1"):
        linear.fit_logistic(table.where("y = 1"), grams, "id", "y")
