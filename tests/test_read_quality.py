"""Mean qualities of reads by hand, and how their time grows."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as T


def test_mean_quality_of_any_characters_by_hand(spark):
    draw = random.Random(4)
    texts = [None, "", "!", " ", "\x00~", "é!", "日本", "a\U0001f600b", *("".join(draw.choice("!IJ~ é日\U0001f600߿￿\U0010ffff") for _ in range(draw.randrange(60))) for _ in range(40))]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, q string")
    got = {r["i"]: r["m"] for r in frame.select("i", T.read_quality(F.lit("ACGT"), F.col("q"))["mean_quality"].alias("m")).collect()}
    for i, x in enumerate(texts):
        want = sum(max(ord(c) - 33, 0) for c in x) / len(x) if x else 0.0
        assert abs(got[i] - want) <= 0.005 + 1e-6


def test_long_qualities_are_summed_at_once(spark):
    """40 MB of qualities: a call a character took minutes."""
    frame = spark.range(400).select(F.repeat(F.lit("IJKL!"), 20_000).alias("q")).coalesce(1)
    begin = time.monotonic()
    assert {r["m"] for r in frame.select(T.read_quality(F.lit("A"), F.col("q"))["mean_quality"].alias("m")).distinct().collect()} == {33.2}
    assert time.monotonic() - begin < 12
    assert T.point_scores(np.frombuffer("a\U0001f600é".encode(), np.uint8)).sum() == sum(ord(c) - 33 for c in "a\U0001f600é")
