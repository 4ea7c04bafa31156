"""Small rules of readers, flags and catalogues."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numeric
from lodestone.operators import validate
from lodestone.sources import readers, sinks


def test_unknown_flags_are_an_error(spark):
    with pytest.raises(ValueError, match="unknown flags"):
        numeric.flag_score({"a": F.lit(True), "b": F.lit(True)}, allowed=["a"])


def test_blocks_with_other_keys_are_an_error(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("id\t1\nname\tx\n//\nname\ty\nid\t2\n//\n")
    assert readers.blocks(spark, str(path), keys=["id", "name"]).count() == 2
    path.write_text("id\t1\nname\tx\n//\nid\t2\n//\n")
    with pytest.raises(Exception, match="a block has the keys id"):
        readers.blocks(spark, str(path), keys=["id", "name"]).collect()


def test_paragraphs(spark):
    good = "<a><p>out</p><sec><title>T</title><p>One  <i>two</i>\n</p><p/><sec><p id='x'>three</p></sec></sec></a>"
    rows = spark.createDataFrame([(good,), ("<a><sec><p>x</sec>",), (None,)], "x string")
    assert [r[0] for r in rows.select(readers.section_paragraphs(F.col("x"))).collect()] == [["One two", "three"], None, None]


def test_vectors_of_a_view_and_track(spark):
    table = spark.createDataFrame([(1, "dna", "t1", "a"), (1, "rna", "t1", "b"), (1, "dna", "t2", "c"), (2, "dna", "t1", "d")], "k int, view string, track string, v string")
    wanted = spark.createDataFrame([(2, 0), (1, 1)], "k int, place int")
    assert [r["v"] for r in readers.vectors(table, wanted, "k", "place", view="dna", track="t1").collect()] == ["d", "a"]
    with pytest.raises(Exception, match="no vector for 2"):
        readers.vectors(table, wanted, "k", "place", view="rna", track="t1").collect()


def test_of_several_rows_of_a_key_the_same_is_taken(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, sha string")
    path = str(tmp_path / "m")
    sinks.append_manifest(spark, rows.repartition(3), path, ["k"], ["sha"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    evidence = spark.createDataFrame([(1, None, "X")], "k int, sha string, c string")
    reference = spark.createDataFrame([(1, "one"), (1, "two")], "k int, t string")
    assert validate.verified_evidence(evidence, reference, "k", "t", "sha", "c", ["X"]).first()["status"] == "accepted"
