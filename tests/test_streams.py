"""Record files read by ranges: the same records however a file is split, and errors that name their place."""

from __future__ import annotations

import gzip
import json
import random

import pytest

from lodestone.sources import streams

LIMIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(params=[1, 3, 17])
def ranges(request, spark):
    """Sets the size of a range so that a file of ``size`` bytes has so many."""
    before = spark.conf.get(LIMIT), spark.conf.get("spark.sql.files.minPartitionNum", None)

    def cut(size: int) -> int:
        spark.conf.set(LIMIT, str(-(-size // request.param)))
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return request.param

    yield cut
    spark.conf.set(LIMIT, before[0])
    spark.conf.unset("spark.sql.files.minPartitionNum")


def reads(n: int) -> list[tuple[str, str, str]]:
    draw = random.Random(4)
    out = []
    for i in range(n):
        length = draw.randrange(20, 60)
        # qualities that begin with the mark of a header or of the third line
        out.append((f"r{i}", "".join(draw.choice("ACGT") for _ in range(length)), draw.choice("@+I") + "".join(draw.choice("@+I#5") for _ in range(length - 1))))
    return out


def test_fastq_is_the_same_in_any_number_of_ranges(spark, tmp_path, ranges):
    records = reads(400)
    text = "".join(f"@{i} x\n{r}\n+\n{q}\n" for i, r, q in records)
    path = tmp_path / "a.fastq"
    path.write_text(text)
    n = ranges(len(text))
    lines = streams.numbered(spark, str(path))
    assert lines.select("_block").distinct().count() == n
    assert [r["_number"] for r in lines.orderBy("_number").collect()] == list(range(1600))
    assert [r["value"] for r in lines.orderBy("_number").collect()] == text.splitlines()
    got = streams.fastq(spark, str(path)).collect()
    assert sorted((r["id"], r["read"], r["quality"]) for r in got) == sorted(records)
    assert not any(r["faulty"] for r in got)


def test_fastq_broken_compressed_and_cut_off(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nacg\n+\nIII\nr2\nAC\n+\nI\n\n\n")
    got = {r["id"]: (r["read"], r["faulty"]) for r in streams.fastq(spark, str(tmp_path / "a.fastq")).collect()}
    assert got == {"r1": ("ACG", False), "r2": ("AC", True)}
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r1\nACG\n+\nIII\n@r2\nAC\n")
    got = {r["id"]: (r["read"], r["quality"], r["faulty"]) for r in streams.fastq(spark, str(tmp_path / "b.fastq.gz")).collect()}
    assert got == {"r1": ("ACG", "III", False), "r2": ("AC", None, True)}
    assert streams.fastq(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz")]).groupBy("file").count().count() == 2


def elements(n: int) -> list[dict]:
    draw = random.Random(7)
    odd = ['}{', '"', "\\", '\\"', "]", "[{", "é日", "\n", "plain", ""]
    return [{"a": i, "s": "".join(draw.choice(odd) for _ in range(draw.randrange(6))), "o": {"x": [1, 2, {"y": draw.choice(odd)}][: draw.randrange(3)], "z": {}}} for i in range(n)]


SCHEMA = "a long, s string, o string"


@pytest.mark.parametrize("layout", [{"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
def test_json_array_is_the_same_in_any_number_of_ranges(spark, tmp_path, ranges, layout):
    records = elements(300)
    records.insert(50, {"a": 1000, "s": "x}{" * 4000, "o": {}})  # longer than some ranges
    text = "﻿ " + json.dumps(records, **layout) + "\n"
    path = tmp_path / "a.json"
    path.write_text(text, encoding="utf-8")
    ranges(len(text.encode()))
    got = streams.json_elements(spark, str(path), "a long, s string, o struct<z: map<string, string>>").collect()
    assert sorted((r["a"], r["s"]) for r in got) == sorted((r["a"], r["s"]) for r in records)


@pytest.mark.parametrize(
    ("text", "message"),
    [('{"a": 1}', "expected a JSON array"), ('[{"a": 1}, 3]', "JSON objects"), ('[{"a": 1}, [{"a": 2}]]', "JSON objects"), ('[{"a": 1}, {"a": 2}', "not closed"), ('[{"a": 1}, {"a": "x', "not closed"), ('[{"a": 1}] x {"a": 2}', "JSON objects|after the array"), ("3", "expected a JSON array")],
)
def test_json_array_errors(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        streams.json_elements(spark, str(tmp_path / "a.json"), "a int").collect()


def test_json_arrays_without_elements_and_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ \n]\n")
    (tmp_path / "b.json").write_text('[{"a": 1},{"a": 2}]')
    assert streams.json_elements(spark, str(tmp_path / "a.json"), "a int").count() == 0
    assert sorted(r["a"] for r in streams.json_elements(spark, str(tmp_path), "a int").collect()) == [1, 2]


LABEL = "gene_id string, task string, label string, evidence_level string, weight double, training_eligible_as_gold boolean, lineage struct<model_version: string, feature_version: string, label_version: string, batch_id: string>"


def label(**changes) -> str:
    sound = {"gene_id": "g", "task": "H1", "label": "1", "evidence_level": "E1", "weight": 0.5, "training_eligible_as_gold": True, "lineage": {"model_version": "1", "feature_version": "1", "label_version": "1", "batch_id": "b"}}
    return json.dumps(sound | changes)


def test_json_lines_errors_name_file_and_line(spark, tmp_path, ranges):
    lines = [label(gene_id=f"g{i}") for i in range(200)]
    lines[60] = ""
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines) + "\n")
    ranges(path.stat().st_size)
    rows = streams.json_records(spark, str(path), LABEL, "label").collect()
    assert {(r["gene_id"], r["_line"]) for r in rows} == {(f"g{i}", i + 1) for i in range(200) if i != 60}
    lines[150] = label(task="H9", label="nan")
    lines[151] = '{"gene_id": '
    path.write_text("\n".join(lines) + "\n")
    odd = {r["_line"]: r["_error"] for r in streams.json_records(spark, str(path), LABEL, "label", strict=False).where("_error IS NOT NULL").collect()}
    assert set(odd) == {151, 152}
    assert odd[151].endswith("a.jsonl:151: task:unknown; label:not_finite")
    with pytest.raises(Exception, match=r"a\.jsonl:15[12]: "):
        streams.json_records(spark, str(path), LABEL, "label").collect()
    with pytest.raises(ValueError, match="no kind"):
        streams.json_records(spark, str(path), LABEL, "other")


def test_feature_rules(spark, tmp_path):
    schema = "gene_id string, view string, track string, embedding array<double>, lineage struct<model_version: string, feature_version: string, label_version: string, batch_id: string>"
    lineage = {"model_version": "1", "feature_version": "1", "label_version": "1", "batch_id": "b"}
    rows = [("protein", "v1_protein", [1.0], lineage), ("dna", "v1_protein", [1.0], lineage), ("protein", "v2_dna", [1.0], lineage), ("x", "y", [], {**lineage, "batch_id": "template"})]
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps(dict(zip(("gene_id", "view", "track", "embedding", "lineage"), ("g", *r)))) for r in rows))
    got = [r["_error"] for r in streams.json_records(spark, str(tmp_path / "f.jsonl"), schema, "feature", strict=False).orderBy("_line").collect()]
    assert got[0] is None and got[1].endswith("view:needs_its_track") and got[2].endswith("track:needs_its_view")
    assert got[3].endswith("view:unknown; track:unknown; embedding:empty; lineage:lineage.batch_id")
