"""Fixtures of the training-data operators: documents with every defined odd case, as files."""

from __future__ import annotations

import random

import pytest

#: Names that operators use inside; as extra columns they must not disturb anything.
CLASHING = ["row", "n", "score", "lang_pred", "seg", "anchor", "cls", "size", "target", "ids", "media", "payload", "key", "sim", "at", "entry", "word", "chunk", "place", "grp", "links", "held_out", "error"]


def odd_rows() -> list[tuple]:
    draw = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "maïs", "straße", "über", "niño", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]

    def prose(n: int) -> str:
        return "".join(draw.choice(vocabulary) + (".\n" if draw.random() < 0.1 else " ") for _ in range(n))

    shared = prose(120)
    long = prose(30_000)
    near = shared.split(" ")
    near[10] = "omega"
    texts = [
        None, "", " \n\t ", "123 456", "one", "cc by", "The MIT License. cc-by 4.0; GNU General Public License, version 3",
        shared, shared, " ".join(near), prose(80) + shared + prose(40), long, long[:9000] + prose(50),
        "ab" * 600, "x\nx\nx\n", "日本語のテキスト です", "tail newline\n", "a\r\nb", "Straße STRASSE ﬁ İ", "<|endoftext|> word",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s10"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[0], (None, shared, "en", "s1", len(shared)), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_folder(spark, tmp_path_factory) -> str:
    """A folder with documents.parquet of three files: odd rows and clashing extra columns."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("odd"))
    frame = spark.createDataFrame(odd_rows(), SCHEMA).select("*", *(F.lit("odd").alias(c) for c in CLASHING))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def documents():
    """Rows of a folder's documents as dicts."""
    import pyarrow.parquet as pq

    return lambda folder: pq.read_table(f"{folder}/documents.parquet").to_pylist()
