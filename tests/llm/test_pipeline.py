"""The corpus pipeline: every stage on its predecessor's result, against brute force where it can be stated."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe_words, fuzzy_lines, jaccard_forest, language_id, mixing
from lodestone.llm.common import free_name, materialise

HIDDEN = ["_row", "row", "doc", "_lang_pred", "lang_pred", "score", "_score", "cover", "_gone", "gone", "_lines", "lines", "_n_lines", "n_lines", "n_removed", "_mix1", "_mix_words", "size", "n", "cls", "id", "a b"]


@pytest.fixture(scope="module")
def chain(spark, small_tables) -> list:
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], small_tables), f"test-{name}"))
    return out


def test_stages_are_the_five_and_keep_the_columns(spark, chain):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "encode"]
    assert all(frame.schema.names == chain[0].schema.names for frame in chain[:5])
    assert chain[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, chain):
    ids = [{r["doc_id"] for r in frame.select("doc_id").collect()} for frame in chain]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    # language: by the filters themselves, document by document
    docs = chain[0]
    filters = language_id.train(docs.where(~language_id.held_out()))
    want = set()
    for r in docs.collect():
        pred, score, cover = filters.judge([r["text"] or ""])
        if pred[0] != "und" and cover[0] >= language_id.MIN_COVER:
            want.add(r["doc_id"])
    assert ids[1] == want
    # lines: rows stay, each text is the other's lines with some left out
    before, after = ({r["doc_id"]: r for r in frame.collect()} for frame in chain[1:3])
    assert before.keys() == after.keys()
    for k, r in after.items():
        rest = iter(before[k]["text"].split("\n"))
        assert r["text"] == "" or all(line in rest for line in r["text"].split("\n"))
        assert r["n_chars"] == (len(r["text"]) if r["text"] != before[k]["text"] else before[k]["n_chars"])
    assert sum(r["text"] != before[k]["text"] for k, r in after.items()) > 0
    # near duplicates: one of each class, the first
    texts = {r["doc_id"]: (r["text"] or "") for r in chain[2].collect()}
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_forest.jaccard_join(chain[2]).collect()}
    kept = Counter(classes[k] for k in ids[3])
    assert set(kept.values()) == {1} and kept.keys() == set(classes.values()) and len(texts) == len(classes)
    # mix: words by source as the targets say
    targets = {r["source"]: r["target"] for r in mixing.mix_counts(chain[3]).select("source_size", "target", "doc_id").join(chain[3].select("doc_id", "source"), "doc_id").collect()}
    words = Counter()
    for r in chain[4].collect():
        words[r["source"]] += len([w for w in fuzzy_lines.re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])
    assert all(abs(words[s] - t) <= 1 for s, t in targets.items())


def test_the_last_stage_equals_the_library(spark, chain):
    library = bpe_words.encoding(bpe_words.VOCABULARY)
    want: Counter = Counter()
    for r in chain[4].collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in chain[5].collect()) == want


def test_run_gives_the_chain(spark, small_tables, chain):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, small_tables).collect()) == Counter(tuple(r) for r in chain[5].collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, odd_folder, name, stage):
    base = spark.read.parquet(f"{odd_folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    frame = materialise(base.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in HIDDEN}), "hidden")
    out = stage(spark, frame, odd_folder)
    assert out.columns == frame.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in HIDDEN)
    plain = Counter((r["doc_id"], r["text"]) for r in stage(spark, materialise(base, "plain"), odd_folder).collect()) if name != "mix" else None
    assert plain is None or plain == Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, empty_folder, name, stage):
    assert stage(spark, spark.read.parquet(f"{empty_folder}/documents.parquet"), empty_folder).collect() == []


def test_free_names():
    assert free_name(["score", "_Score"], "score") == "__score" and free_name([], "score") == "score"


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from lodestone.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
