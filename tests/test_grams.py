"""N-grams counted in blocks against exploding and joining them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import grams, linear, textmine
from lodestone.plans import registry

TEXTS = [(1, "abab"), (2, "ab\0"), (3, None), (4, ""), (5, "a"), (6, "b\U0001f600ab\U0001f600a"), (7, "\0\0\0ab"), (8, "zq"), (9, "ééabab " * 40)]


@pytest.mark.parametrize(("block", "most"), [(7, None), (2_000_000, None), (20, 5)])
def test_blocks_equal_exploding(spark, block, most):
    table = spark.createDataFrame(TEXTS, "id int, t string").repartition(3)
    exploded = textmine.tfidf(table, "id", textmine.char_ngrams(F.col("t"), 2, 4), most_terms=most)
    expected = {}
    for r in exploded.collect():
        expected.setdefault(r["id"], {})[r["term"]] = r["weight"]
    vectors, terms = grams.gram_vectors(table, "id", F.col("t"), 2, 4, most_terms=most, block=block)
    got = {r["id"]: r for r in vectors.collect()}
    assert set(got) == set(expected)
    assert all(sorted(got[i]["weights"]) == pytest.approx(sorted(expected[i].values())) for i in expected)
    names = {r["place"]: r["term"] for r in terms.collect()} if most else None
    if most:
        assert [names[p] for p in sorted(names)] == sorted(names.values())
        assert all(dict(zip([names[p] for p in got[i]["places"]], got[i]["weights"])) == pytest.approx(expected[i]) for i in expected)
    else:
        assert {r["term"] for r in terms.collect()} == {g for e in expected.values() for g in e}


def test_equal_and_null_ids_count_as_one(spark):
    table = spark.createDataFrame([(1, "abc"), (1, "abd"), (None, "ab"), (None, "bc"), (2, "bc")], "id int, t string")
    vectors, _ = grams.gram_vectors(table, "id", F.col("t"), 2, 2)
    assert {r["id"]: len(r["weights"]) for r in vectors.collect()} == {1: 2, None: 2, 2: 1}


def test_more_letters_than_fit_a_number():
    text = "".join(map(chr, range(0x4E00, 0x9E00))) + "".join(map(chr, range(0xAC00, 0xD000))) + "一丁丂七"
    assert len(set(text)) > 1 << 14
    text += "".join(map(chr, range(0x20000, 0x28000)))  # 16 bits a letter: four and a length do not fit 64
    _, ends, number, counts, names = grams.tally(pa.array([1]), pa.array([text]), 2, 4)
    terms = names()
    expected = {}
    for n in (2, 3, 4):
        for i in range(len(text) - n + 1):
            expected[text[i : i + n]] = expected.get(text[i : i + n], 0) + 1
    assert {terms[k]: c for k, c in zip(number, counts)} == expected and ends.tolist() == [len(expected)]


def test_no_row_a_gram_and_document(spark, small_tables):
    plan = registry.QUERIES["ngram_tfidf"](spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_classifier_on_vectors_equals_that_on_terms(spark):
    rows = [(i, i % 3 and i % 2, ("abcab" * (i % 4) + "xyzz" * (i % 3))[i % 5 :]) for i in range(60)] + [(99, None, "abcxyz"), (100, 1, None)]
    table = spark.createDataFrame(rows, "id int, y int, t string").repartition(3)
    exploded = textmine.tfidf(table, "id", textmine.char_ngrams(F.col("t"), 1, 3), most_terms=9)
    expected = {r["id"]: r["score"] for r in linear.decisions(table, exploded, "id", linear.fit_logistic(table, exploded, "id", "y", tolerance=1e-12)).collect()}
    vectors, terms = grams.gram_vectors(table, "id", F.col("t"), 1, 3, most_terms=9, block=50)
    assert all(r["places"] == sorted(r["places"]) for r in vectors.collect())
    got = {r["id"]: r["score"] for r in linear.vector_decisions(table, vectors, "id", linear.fit_vectors(table, vectors, terms.count(), "id", "y", tolerance=1e-12)).collect()}
    assert got == pytest.approx(expected, abs=1e-6) and len(got) == 62


def test_decisions_move_no_row_a_gram(spark, small_tables):
    plan = registry.QUERIES["quality_decisions"](spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_counts_give_the_classifier_of_vectors(spark):
    """The same steps as Spark's optimiser, stopped early; equal, null and unlabelled ids, rows without a text or terms."""
    rows = [(f"d{i}", i % 3 and i % 2, ("abcab" * (i % 4) + "xyzz" * (i % 3))[i % 5 :]) for i in range(60)] + [("d1", None, "abcxyz"), (None, 1, "abab"), ("e", None, "abcxyz"), ("f", 1, None), ("g", 0, ""), ("h", None, None)]
    table = spark.createDataFrame(rows, "id string, y int, t string").repartition(3)
    vectors, named = grams.gram_vectors(table, "id", F.col("t"), 1, 3, most_terms=9, block=50)
    texts = grams.packed_texts(table, "id", F.col("t"), block=50)
    kept = grams.frequent_grams(texts, 1, 3, 9)
    assert texts.blocks > 5 and kept.terms.to_pylist() == [r["term"] for r in named.orderBy("place").collect()]
    counted = grams.labelled_counts(texts, kept, table, "id", "y")
    for rounds in (1, 3, 200):
        ml = linear.fit_vectors(table, vectors, 9, "id", "y", rounds=rounds, tolerance=1e-10)
        fitted = linear.fit_counts(counted, kept.idf, rounds=rounds, tolerance=1e-10)
        assert fitted.tolist() == pytest.approx([r["coefficient"] for r in ml.orderBy("place").collect()], abs=1e-7)
        got = sorted(((r["id"] or "", r["score"]) for r in grams.gram_scores(texts, kept, table, "id", fitted).collect()))
        expected = sorted(((r["id"] or "", r["score"]) for r in linear.vector_decisions(table, vectors, "id", ml).collect()))
        assert [i for i, _ in got] == [i for i, _ in expected] and [s for _, s in got] == pytest.approx([s for _, s in expected], abs=1e-6)
    with pytest.raises(ValueError):
        linear.fit_counts(grams.labelled_counts(texts, kept, table.where("y = 1"), "id", "y"), kept.idf)


def test_minimise_finds_the_least_of_a_bent_valley():
    bent = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert linear.minimise(bent, 2, 200, 1e-12).tolist() == pytest.approx([1, 1], abs=1e-4)


def test_decisions_write_little_more_than_the_texts(spark, small_tables, monkeypatch):
    """No document's vector is shuffled, and what is written of the labelled ones is some bytes a count."""
    written = []
    for module in (grams, linear):
        write = module.stored
        monkeypatch.setattr(module, "stored", lambda *a, write=write, **k: written.append(write(*a, **k)) or written[-1])
    plan = registry.QUERIES["quality_decisions"](spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "weights" not in plan and "features" not in plan
    size = sum(f.getLen() for t in written for name in t.inputFiles() for f in spark._jvm.org.apache.hadoop.fs.Path(name).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(name)))
    counts = written[-1].selectExpr("sum(element_at(ends, -1))").first()[0]
    assert len(written) == 1 and counts > 20_000 and size < 3 * counts
