"""Issues of a labelled collection by hand, with their severities, counts and policy."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import validate


def frames(spark, items, labels):
    return spark.createDataFrame([(i,) for i in items], "k string"), spark.createDataFrame(labels, "k string, task string")


def found(frame):
    return {(r["issue"], r["severity"], r["task"], r["n"]) for r in frame.collect()}


def test_issues_by_hand(spark):
    items, labels = frames(spark, ["a", "b", "b", "b", "c", None, None], [("a", "H1"), ("a", "H1"), ("x", "H2"), ("y", "H2"), ("y", None)])
    assert found(validate.inspect(items, labels, "k", "task", 3)) == {
        ("UNLABELED_SEQUENCES", "warning", None, 3), ("LABELS_WITHOUT_SEQUENCE", "warning", None, 2), ("DUPLICATE_SEQUENCE_IDS", "error", None, 3),
        ("SMALL_TASK", "warning", "H1", 2), ("SMALL_TASK", "warning", "H2", 2), ("SMALL_TASK", "warning", None, 1),
    }
    items, labels = frames(spark, [], [])
    assert found(validate.inspect(items, labels, "k", "task")) == {("EMPTY_SEQUENCES", "blocking", None, 1), ("EMPTY_LABELS", "blocking", None, 1)}


@pytest.mark.parametrize(
    ("items", "labels", "splits", "expected"),
    [
        (["a", "a"], [("a", "H1")] * 5, [], ("warn", "DUPLICATE_SEQUENCE_IDS", False, False)),  # an error does not block
        (["a"], [("a", "H1")] * 5, [], ("pass", "", False, False)),
        (["a"], [("a", "H1"), ("x", "H1")], [], ("warn", "LABELS_WITHOUT_SEQUENCE,SMALL_TASK", False, True)),
        (["a"], [("a", "H1")] * 5, [("a", "t"), ("a", "v")], ("fail", "SPLIT_OVERLAP", True, False)),
        ([], [("a", "H1")] * 5, [], ("fail", "EMPTY_SEQUENCES,LABELS_WITHOUT_SEQUENCE", True, False)),
    ],
)
def test_verdict_by_hand(spark, items, labels, splits, expected):
    a, b = frames(spark, items, labels)
    overlaps = validate.split_overlaps(spark.createDataFrame(splits, "k string, s string"), "k", "s")
    row = validate.verdict(validate.inspect(a, b, "k", "task"), overlaps).first()
    assert tuple(row) == expected


def test_usual_lengths(spark):
    rows = spark.createDataFrame([("A" * n,) for n in (7, 8, 30, 31)], "s string").select(F.length("s").alias("n"), T.normalise(F.col("s"), "ACD", usual=(8, 30)).alias("r"))
    assert {r["n"]: (r["r"]["status"], r["r"]["reasons"]) for r in rows.collect()} == {7: ("review", ["length:outside_8_30"]), 8: ("pass", []), 30: ("pass", []), 31: ("review", ["length:outside_8_30"])}
