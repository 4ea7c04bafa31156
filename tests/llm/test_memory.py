"""What workers and Arrow batches hold: bounded batches, memory given back, and results that do not depend on where batches end."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from lodestone.llm.common import BATCH_BYTES, bound_batches, materialise

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def spark_with_default(spark):
    before = spark.conf.get(NAME)
    spark.conf.unset(NAME)
    yield spark
    spark.conf.set(NAME, before)


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name != "mix"])
def test_stages_read_texts_in_bounded_batches(spark_with_default, odd_folder, stage):
    spark = spark_with_default
    stage(spark, spark.read.parquet(f"{odd_folder}/documents.parquet"), odd_folder)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 30_000_000 and max(found) <= 1.1 * BATCH_BYTES


def test_a_smaller_bound_stays(spark_with_default):
    spark = spark_with_default
    for own, kept in (("4m", "4m"), ("1000", "1000"), ("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES))):
        spark.conf.set(NAME, own)
        bound_batches(spark)
        assert spark.conf.get(NAME) in (kept, f"{kept}b")


def test_results_do_not_depend_on_where_batches_end(spark_with_default, small_tables):
    spark = spark_with_default

    def chain():
        docs, out = spark.read.parquet(f"{small_tables}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, small_tables), f"test-{name}")
            out.append(sorted(map(str, docs.collect())))
        return out

    whole = chain()
    spark.conf.set(NAME, 20_000)
    assert chain() == whole


CHILD = """
import re
import numpy as np, pyarrow as pa
from lodestone.llm.common import giving_back

def rss():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    held = []
    for batch in batches:
        for _ in range(400):
            held.append(np.ones(65_000))  # below malloc's largest piece of its own
            kept.append(np.ones(10))
        held.clear()
        yield batch

kept = []
batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
start = rss()
for _ in giving_back(run)(iter([batch] * 3)):
    pass
print(rss() - start)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_freed_memory_back():
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", CHILD], cwd=root, capture_output=True, text=True, check=True)
    assert float(said.stdout) < 40
