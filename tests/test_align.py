"""Seed votes and extension against a scalar version on short texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import align

TURN = str.maketrans("ACGT", "TGCA")


def scalar_candidates(read: str, references: dict[str, str], k: int, least: int, keep: int, by: str):
    votes: Counter = Counter()
    for strand, way in (("+", read), ("-", read[::-1].translate(TURN))):
        for i in range(len(way) - k + 1):
            seed = way[i : i + k]
            for name, text in references.items():
                for at in range(len(text) - k + 1):
                    if "N" not in seed and text[at : at + k] == seed:
                        votes[(strand, name, at - i if by == "diagonal" else at)] += 1
    rows = sorted((-n, *key) for key, n in votes.items() if n >= least)
    return [(strand, name, place, -n) for n, strand, name, place in rows[:keep]]


def scalar_alignment(read: str, references: dict[str, str], k: int, most: int):
    best = None
    for strand, name, place, _ in scalar_candidates(read, references, k, 3, 10, "diagonal"):
        way = read if strand == "+" else read[::-1].translate(TURN)
        text = references[name]
        floor, whole = len(way), None
        for at in range(max(0, place - most, place - 1), min(len(text), place + len(way) + most) - len(way) + 1):
            part = text[at : at + len(way)]
            known = [x in "ACGT" for x in way], [y in "ACGT" for y in part]
            wrong = sum(x != y and (a or b) for x, y, a, b in zip(way, part, *known)) + 0.5 * sum(not (a and b) for a, b in zip(*known))
            if wrong < floor:
                floor, whole = int(wrong), (len(way) - wrong, at, part)
        if whole and floor <= most and whole[0] >= 0.7 * len(way) and (best is None or whole[0] > best[0]):
            edits = "".join("M" if x == y and x != "N" else "X" for x, y in zip(way, whole[2]))
            best = whole[0], name, strand, whole[1], floor, edits
    return best


def unrolled(edits: str) -> str:
    out, n = "", ""
    for c in edits:
        if c.isdigit():
            n += c
        else:
            out, n = out + c * int(n), ""
    return out


@pytest.fixture(scope="module")
def sequences():
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    unit = text(30)
    references = {"r1": text(700), "r2": text(300) + unit * 6 + text(40), "r3": text(260) + "NNNN" + text(255), "short": "ACG", "r4": ""}
    references["r5"] = references["r1"][100:400]
    reads = [references["r1"][50:110], references["r1"][640:700], references["r2"][0:60], unit * 2, references["r3"][240:290], text(60), "", "ACGT", "N" * 40]
    for k in range(40):
        source = references[draw.choice(["r1", "r2", "r3"])]
        at = draw.randrange(len(source) - 50)
        read = list(source[at : at + 50])
        for _ in range(draw.randrange(4)):
            read[draw.randrange(50)] = draw.choice("ACGTN")
        read = "".join(read)
        reads.append(read if k % 2 else read[::-1].translate(TURN))
    reads.append(text(8) + references["r1"][:40])  # begins before its reference
    return references, reads


@pytest.mark.parametrize("by", ["diagonal", "place"])
def test_candidates_equal_a_scalar_version(spark, sequences, by):
    references, reads = sequences
    table = spark.createDataFrame(list(references.items()), "name string, text string")
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(reads)] + [(99, None), (100, reads[0])], "id int, read string")
    least = 3 if by == "diagonal" else 1
    got = align.candidates(rows, table, "name", "text", k=11, least=least, by=by).collect()
    for read in set(reads):
        mine = [(r.strand, r.name, r.place, r.votes) for r in sorted((r for r in got if r.read == read), key=lambda r: r.turn)]
        assert mine == scalar_candidates(read, references, 11, least, 50, by), read


def test_alignments_equal_a_scalar_version(spark, sequences):
    references, reads = sequences
    table = spark.createDataFrame(list(references.items()), "name string, text string")
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(reads)] + [(99, None), (100, reads[0])], "id int, read string")
    got = {r.id: r for r in align.align(rows, table, "name", "text", k=11).collect()}
    expected = {i: e for i, r in enumerate(reads) if (e := scalar_alignment(r, references, 11, 2))}
    expected[100] = expected[0]
    assert len(expected) > 25 and any(e[2] == "-" for e in expected.values())
    assert set(got) == set(expected)
    for i, (score, name, strand, position, wrong, edits) in expected.items():
        r = got[i]
        assert (r.score, r.name, r.strand, r.position, r.mismatches, unrolled(r.edits)) == (score, name, strand, position, wrong, edits)
        assert r.mapq == int(40 * (1 - wrong / len(r.read)))
        assert r.site == (position if strand == "+" else position + len(r.read))


def test_seeds_across_pieces_and_edit_strings(spark):
    text = "".join(random.Random(2).choice("ACGT") for _ in range(1500))
    table = spark.createDataFrame([("t", text), ("e", ""), ("n", None)], "name string, text string")
    got = sorted((r.at, r.seed) for r in align.seeds(table, "name", "text", 19).collect())
    assert got == [(i, text[i : i + 19]) for i in range(len(text) - 18)]
    assert align.edit_string(np.array([True, True, False, True])) == "2M1X1M"
    assert align.edit_string(np.array([], bool)) == ""


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "name string, text string")
    reads = spark.createDataFrame([(1, "ACGT" * 10)], "id int, read string")
    assert align.align(reads, nothing, "name", "text").count() == 0
    assert align.align(reads.limit(0), spark.createDataFrame([("a", "ACGT" * 30)], "name string, text string"), "name", "text").count() == 0
