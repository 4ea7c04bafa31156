"""Seeds found by hashes and pair counts against Python; long texts take time in line with their length."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import align


@pytest.mark.parametrize("k", [1, 2, 7, 19])
def test_seeds_among_equal_filtered_seeds(spark, k):
    texts = [(1, "abcabcabcabcabcabcabcabcabc" * 30), (2, ""), (3, "ab"), (4, "\U0001f600\0bcabcabcabcabcabcabcabc\0"), (5, "x" * 400)]
    table = spark.createDataFrame(texts, "id long, t string").repartition(2)
    wanted = spark.createDataFrame([(s[i : i + k],) for s in (texts[0][1][:22], texts[3][1], "zz" * 12) for i in range(0, len(s) - k + 1, 2)], "seed string").distinct()
    keep = {r["seed"] for r in wanted.collect()}
    expected = sorted((i, s[p : p + k], p) for i, s in texts for p in range(len(s) - k + 1) if s[p : p + k] in keep)
    assert sorted(map(tuple, align.seeds_among(table, "id", "t", k, wanted).collect())) == expected and expected


def test_no_row_a_letter_of_the_references(spark):
    reads, texts = spark.createDataFrame([("abcdefgh" * 3,)], "read string"), spark.createDataFrame([(1, "abcdefgh" * 9)], "id long, t string")
    found = align.candidates(reads, texts, "id", "t", k=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and found.count() > 0  # the reads' own


def test_pairs_of_a_long_text_in_one_pass(spark):
    text = "aeiou.*aa" * 60_000
    row = spark.createDataFrame([(text,), ("a",), ("",), (None,), ("axe",)], "t string").coalesce(1)
    took = time.monotonic()
    got = [r[0] for r in row.select(T.pair_composition(F.col("t"), {"a": "A", "e": "A", "i": "E", "o": "E", "u": "U", "*": "*"})).collect()]
    assert time.monotonic() - took < 20  # quadratic before: minutes
    reduced = "AAEEU*AA" * 60_000
    pairs = [reduced[i : i + 2] for i in range(len(reduced) - 1)]
    assert got[0] == pytest.approx({p: pairs.count(p) / len(pairs) for p in set(pairs)})
    assert not any(got[1:4]) and got[4] == {"AA": 1.0}


def test_only_texts_with_other_letters_are_folded_in_python(spark):
    table = spark.createDataFrame([("Caf\u00e9  \ufb01ne",), ("plain title",), ("",), (None,)], "t string")
    keys = table.select(T.folded_title_key(F.col("t")))
    assert "rlike" in keys._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r[0] for r in keys.collect()] == ["cafe fine", "plain title", "", None]
