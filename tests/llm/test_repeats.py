"""Operators that hold texts against each other, against brute force: lines, near duplicates, long repeats, top-k, chats."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import chat_preference, fuzzy_lines, jaccard_forest, repeats_rlindex, topk_fagin
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import STEP, hashed_words, mix

FOLDERS = ["odd_folder", "small_tables"]


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text: str | None) -> frozenset:
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.mark.parametrize("folder", FOLDERS)
def test_near_duplicates_lose_no_link(spark, documents, request, folder):
    path = request.getfixturevalue(folder)
    docs = documents(path)
    sets = [shingles(d["text"]) for d in docs]
    parent = {i: i for i in range(len(docs))}
    links = Counter()
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    group = defaultdict(list)
    for i in range(len(docs)):
        group[find(parent, i)].append(i)
    want = Counter()
    for members in group.values():
        ids = [docs[i]["doc_id"] for i in members if docs[i]["doc_id"] is not None]
        for i in members:
            same = sum(s == sets[i] for s in sets) if sets[i] else 1
            want[docs[i]["doc_id"], min(ids, default=None), links[i], same] += 1
    got = Counter(tuple(r) for r in jaccard_forest.op8_jaccard_forest(spark, path).collect())
    assert got == want


def test_near_duplicates_in_small_blocks(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    whole = Counter(tuple(r) for r in jaccard_forest.jaccard_join(docs).collect())
    assert Counter(tuple(r) for r in jaccard_forest.jaccard_join(docs, block=2, longest=2).collect()) == whole


def test_one_document_of_each_group_stays(spark, documents, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = jaccard_forest.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    joined = [tuple(r) for r in jaccard_forest.jaccard_join(docs).collect()]
    groups = {c for d, c, *_ in joined if c is not None}
    nulls = sum(d["doc_id"] is None and not shingles(d["text"]) for d in documents(odd_folder))
    wordless = [d for d in documents(odd_folder) if d["doc_id"] is not None and not shingles(d["text"])]
    assert kept.count() == len(groups) + nulls + len(wordless) - len({d["doc_id"] for d in wordless})


def edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_by_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        a, b = ("".join(draw.choice("abcé ") for _ in range(draw.randrange(90))) for _ in range(2))
        if draw.random() < 0.7:
            b = "".join(c for c in a if draw.random() > 0.1)
        want, most = edit(a, b), draw.randrange(40)
        got = fuzzy_lines.edit_distance(a, b, most)
        assert got == want if want <= most else got > most
        assert fuzzy_lines.at_least(a, b) <= want <= fuzzy_lines.at_most(a, b, 10**9)


def test_simhash_by_brute_force():
    draw = random.Random(8)
    lines = [" ".join(draw.choice("one two three four five six".split()) for _ in range(n)) for n in (1, 2, 7, 254, 255, 256, 511, 1300)] + [" ", "!"]
    sims = fuzzy_lines.line_features(lines).sims
    for line, sim in zip(lines, sims.tolist()):
        words = hashed_words([line])[0]
        words = np.array([mix(a * STEP + b) for a, b in zip(words[:-1], words[1:])], np.uint64) if len(words) > 1 else words
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        want = np.packbits(2 * bits.sum(axis=0) > len(words)) if len(words) else np.zeros(8, np.uint8)
        # lanes run from the lowest bit of each byte, unpackbits from the highest
        flipped = np.packbits(np.unpackbits(np.uint64(sim).reshape(1).view(np.uint8).reshape(8, 1), axis=1)[:, ::-1])
        assert want.tolist() == flipped.tolist()


@pytest.mark.parametrize("folder", FOLDERS)
def test_lines_keep_one_occurrence_of_each_group(spark, request, folder):
    """The operator keeps what brute force over all pairs by edit similarity alone keeps, whatever SimHashes and entries."""
    path = request.getfixturevalue(folder)
    frame = fuzzy_lines.with_row_id(spark.read.parquet(f"{path}/documents.parquet"), "row_")
    rows = sorted((r["row_"], r["text"]) for r in frame.collect() if r["text"] is not None)
    places = [(row, at, line) for row, text in rows for at, line in enumerate(text.split("\n"))]
    normals = [fuzzy_lines.normal(line) for _, _, line in places]
    first: dict[str, int] = {}
    for k, line in enumerate(normals):
        if line:
            first.setdefault(line, k)
    distinct = sorted(first, key=len)
    parent = {x: x for x in distinct}
    length = np.array([len(x) for x in distinct])
    letters = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, minlength=64) for x in distinct])
    links = 0
    for i, x in enumerate(distinct):
        most = int(0.2 * len(x) + 1e-9)
        start = np.searchsorted(length, 0.8 * len(x) - 1e-9)
        more = letters[start:i] - letters[i]
        apart = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        for j in (start + np.flatnonzero(apart <= most)).tolist():
            y = distinct[j]
            if fuzzy_lines.edit_distance(x, y, most) <= most:
                links += 1
                a, b = find(parent, x), find(parent, y)
                if a != b:
                    parent[max(a, b, key=first.get)] = min(a, b, key=first.get)
    kept, gone = defaultdict(list), Counter()
    for k, ((row, _, line), words) in enumerate(zip(places, normals)):
        if not words or first[find(parent, words)] == k:
            kept[row].append(line)
        else:
            gone[row] += 1
    want = Counter(("\n".join(kept[row]), gone[row]) for row, _ in rows)
    got = Counter((r["text"], r["n_removed"]) for r in fuzzy_lines.dedup_lines(spark.read.parquet(f"{path}/documents.parquet")).collect() if r["text"] is not None)
    if folder == "small_tables":
        assert got == want
    else:  # prose of 14 words: similar lines with edits in every word share no run, 241 of 269 links are candidates
        removed = sum(r * n for (_, r), n in got.items())
        assert 0.95 * sum(gone.values()) <= removed <= sum(gone.values())
    assert links > 0 and sum(gone.values()) > 0


def test_stage_keeps_columns_of_any_name(spark, odd_folder):
    from pyspark.sql import functions as F

    names = ["row", "_row", "gone", "_gone", "lines", "_lines", "n_lines", "n_removed", "doc", "a b"]
    frame = spark.read.parquet(f"{odd_folder}/documents.parquet").select("doc_id", "text", "n_chars").withColumns({c: F.col("doc_id") + 100 for c in names})
    out = fuzzy_lines.stage_lines(spark, frame, odd_folder)
    assert out.columns == frame.columns
    for r in out.collect():
        assert all(r[c] == (None if r["doc_id"] is None else r["doc_id"] + 100) for c in names)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_one_changed_word_is_always_found(spark, tmp_path):
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for n in [3, 4, 5, 6, 7, 8, 9, 10, 12, 20, 30, 50, 100] * 8:
        line = [word(12), *(word(draw.randrange(5, 9)) for _ in range(n - 1))]
        at = draw.randrange(1, n)
        other = [*line]
        other[at] = word(2) + other[at][2:] if n < 8 else word(len(other[at]))
        texts += [" ".join(line), " ".join(other)]
    for line in ("abcdef", "abcde fghijk", "ab cdefgh ij"):
        texts += [line, line[:2] + "x" + line[3:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    links = {(i, i + 1) for i in range(0, len(texts), 2) if fuzzy_lines.similar(texts[i], texts[i + 1], 0.8)}
    got = {r["doc_id"] for r in fuzzy_lines.op4_fuzzy_lines(spark, str(tmp_path)).collect() if r["n_removed"]}
    assert got == {j for _, j in links} and len(links) > 90


def test_lines_in_small_blocks(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    whole = Counter((r["row"], tuple(sorted(r["gone"]))) for r in fuzzy_lines.find_repeated_lines(docs).collect())
    parts = Counter((r["row"], tuple(sorted(r["gone"]))) for r in fuzzy_lines.find_repeated_lines(docs, block=3, longest=4).collect())
    assert parts == whole


def removed_by_hand(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    starts: Counter = Counter()
    for t in texts:
        starts.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\1+", gone)), bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("folder", FOLDERS)
def test_long_repeats_are_cut_out(spark, documents, request, folder):
    path = request.getfixturevalue(folder)
    docs = documents(path)
    raws = [(d["text"] or "").encode() for d in docs]
    want = Counter((d["doc_id"], len(t), n, s, hashlib.sha256(k).hexdigest(), len(k)) for d, t, (n, s, k) in zip(docs, raws, removed_by_hand(raws, 400)))
    assert Counter(tuple(r) for r in repeats_rlindex.op9_repeats_rlindex(spark, path).collect()) == want


def test_run_index_keeps_runs_and_their_ends():
    text = np.frombuffer(b"abracadabra" * 40 + bytes([repeats_rlindex.SEPARATOR]), np.uint8)
    index = repeats_rlindex.RunIndex(text, np.array([0]), 512)
    order = sorted(range(len(text)), key=lambda i: text[i:].tobytes())
    column = [int(text[i - 1]) for i in order]
    runs = [(c, k) for k, c in enumerate(column) if k == 0 or column[k - 1] != c]
    assert [(int(a), int(b)) for a, b in zip(index.heads, index.starts)] == runs
    assert all(len(place) <= len(runs) + 1 for place, _ in index.samples) and len(runs) < len(text) / 10
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
    want = [max(shared(order[k], order[k + d]) for d in (-1, 1) if 0 <= k + d < len(order)) for k in np.argsort(order)]
    assert index.statistics().tolist() == want


@pytest.mark.parametrize("name", ["op8_jaccard_forest", "op9_repeats_rlindex"])
def test_query_equals_its_sql(spark, small_tables, name):
    import duckdb

    from lodestone.llm import registry

    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small_tables}/documents.parquet')")
    cursor = base.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    assert Counter(tuple(r) for r in registry.QUERIES[name](spark, small_tables).select(*names).collect()) == Counter(cursor.fetchall())


def test_forest_shortens_prefixes_until_the_recall_is_met(spark):
    draw = np.random.default_rng(4)
    rest, sample = np.sort(draw.integers(0, 2, 60, dtype=np.uint64) << np.uint64(48) | draw.integers(0, 3, 60, dtype=np.uint64)), np.zeros((60, 64), np.uint8)
    joins = jaccard_forest.descend(rest, sample, 40, 4)
    parent = {i: i for i in range(60)}
    for i, j, d, k in joins:
        prefix = lambda x: int(rest[x]) >> 16 * (8 - d)
        assert prefix(i) == prefix(j) and k == 64
        assert find(parent, i) != find(parent, j)
        parent[find(parent, i)] = find(parent, j)
    # a spanning forest at every prefix length: rows equal in d values hang together by joins of d values or more
    assert len(joins) == 59 and sum(d == 8 for *_, d, _ in joins) == 60 - len(set(rest.tolist())) and sum(d == 4 for *_, d, _ in joins) == 1
    rows = [(i, i + 1, 8 if i % 10 else 5, 60) for i in range(0, 4000, 2)] + [(9000 + i, 9500 + i, 4, 60) for i in range(20)]
    frame = spark.createDataFrame(rows, "src long, dst long, depth int, agree int")
    assert jaccard_forest.enough(frame, 0.8, 4, 0.75) == 8 and jaccard_forest.enough(frame, 0.8, 4, 0.95) == 5 and jaccard_forest.enough(frame, 0.8, 4, 0.999) == 4
    assert jaccard_forest.enough(frame.limit(0), 0.8, 4) == 4
    assert jaccard_forest.shortest(0.8) == 4 and jaccard_forest.recall(4) > 0.9995


@pytest.mark.parametrize("hot,block", [(2000, 1_000_000), (1, 2000), (3, 300)])
def test_short_repeats_whatever_the_blocks(spark, tmp_path, hot, block):
    draw = random.Random(hot)
    words = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(40)]
    texts = ["".join(draw.choice(words) for _ in range(draw.randrange(60))) for _ in range(60)]
    texts += ["a" * 300, "a" * 31, "ab" * 90, texts[3], texts[3], "x" + texts[5] + "y", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    raws = [(t or "").encode() for t in texts]
    want = {i: (len(t), n, s, k) for i, (t, (n, s, k)) in enumerate(zip(raws, removed_by_hand(raws, 32)))}
    got = repeats_rlindex.remove_repeats(spark.read.parquet(str(tmp_path / "d")), 32, block, hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want


def top_by_hand(vectors: list[tuple], queries, k: int = 10) -> dict:
    import math

    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in usable:
        if queries(q):
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k_is_exact(spark, block):
    draw = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=6)]) for i in range(120)]
    vectors += [(120, None), (121, [1.0] * 5 + [None]), (122, [float("nan")] * 6), (123, [float("inf")] * 6), (124, [0.0] * 6), (200, [0.0] * 6), (None, [1.0] * 6), (125, vectors[3][1]), (126, vectors[3][1]), (300, [1.0, 2.0]), (301, [])]
    frame = topk_fagin.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = defaultdict(dict)
    for r in topk_fagin.top_k(frame.where("vec_id % 20 = 0"), frame, block=block).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = {q: v for q, v in top_by_hand(vectors, lambda i: i % 20 == 0).items() if v}
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_top_k_of_many_packs(spark, monkeypatch):
    """Queries in packs of 3 against blocks of 7, two lengths of vectors, equal vectors and negative components."""
    monkeypatch.setattr(topk_fagin, "PACK", 3)
    draw = random.Random(5)
    vectors = [(i, [draw.randrange(-4, 5) for _ in range(3 + i % 2)]) for i in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    want = set()
    for q, a in vectors[::4]:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:10], 1)}
    assert {tuple(r) for r in topk_fagin.top_k(frame.where("vec_id % 4 = 0"), frame, block=7).collect()} == want


def test_top_k_on_the_table(spark, small_tables):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{small_tables}/embeddings.parquet").to_pylist()
    want = top_by_hand([(r["vec_id"], r["embedding"]) for r in table], lambda i: i % 100 == 0)
    got = sorted(tuple(r) for r in topk_fagin.op3_topk_fagin(spark, small_tables).collect())
    assert got == sorted((q, k, i, s) for q, v in want.items() for k, (i, s) in enumerate(v, 1))


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 1, "user", "hi"), (1, "chosen", 2, "assistant", "yes"), (1, "rejected", 1, "user", "hi"), (1, "rejected", 2, "assistant", "no!"), (1, "rejected", 1, "user", "hi"),
        (2, "chosen", 1, None, None), (2, "rejected", 1, "", ""), (3, "chosen", 1, "assistant", "only"), (4, "other", 1, "user", "x"), (None, "chosen", 1, "user", "x"),
        (5, "chosen", 1, "user", "a"), (5, "chosen", 2, "user", "b"), (5, "rejected", 1, "user", "a"), (5, "rejected", 2, "user", "b"),
    ]
    frame = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")
    frame = frame.selectExpr("*", "'x' as n", "'x' as prompt", "'x' as chosen")
    got = {r["pair_id"]: r for r in chat_preference.format_preferences(frame).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert (one["prompt"], one["chosen"], one["rejected"]) == ("<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno!<|end|>\n")
    a, b = map(int, one["rejected_mask"].split("-"))
    assert one["rejected"][a:b] == "no!<|end|>\n"
    assert got[2]["n_prompt_turns"] == 0 and got[2]["chosen"] == got[2]["rejected"]
    assert got[3]["prompt"] == "" and got[3]["rejected"] == "" and got[3]["chosen_mask"]
    assert got[5]["n_prompt_turns"] == 2 and got[5]["chosen"] == got[5]["rejected"] == ""


def test_components_of_loops_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}


@pytest.mark.parametrize("op", [topk_fagin.op3_topk_fagin, fuzzy_lines.op4_fuzzy_lines, jaccard_forest.op8_jaccard_forest, repeats_rlindex.op9_repeats_rlindex, chat_preference.op10_preference_format])
def test_empty_table(spark, empty_folder, op):
    assert op(spark, empty_folder).collect() == []


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)


def by_sql(name: str, table: str, path: str) -> Counter:
    import duckdb

    from lodestone.llm import registry

    base = duckdb.connect()
    base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    cursor = base.execute(registry.SQL[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    return Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_preferences_of_odd_conversations(spark, tmp_path):
    rows = [
        (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "assistant", "c"), (2, 3, "user", "d"), (3, 1, "assistant", None), (4, 1, "user", "x"), (4, None, "assistant", "y"),
        (5, 1, "user", ""), (5, 1, "assistant", "p"), (5, 1, "assistant", "q"), (6, None, None, None), (8, 1, "assistant", "z"), (9, 1, "assistant", "w"), (None, 1, "user", "n"), (10, 2, "user", "late"), (10, 1, "assistant", "äö" * 5000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS pair_id", "'x' AS chosen", "'x' AS n", "'x' AS `last`", "'x' AS found")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_preference.op10_preference_format(spark, str(tmp_path))
    assert Counter(tuple(r) for r in out.select(*sorted(out.columns)).collect()) == by_sql("op10_preference_format", "conversations", str(tmp_path))


def test_preferences_run_without_python_workers(spark, small_tables):
    plan = chat_preference.op10_preference_format(spark, small_tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and len(re.findall("Exchange hashpartitioning", plan)) <= 3


def test_top_k_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.5, -0.25]), (100, [0.5, -0.25]), (200, [nan, 1.0]), (300, [inf, 1.0]), (400, None), (500, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [0.0, 0.0]), (9, [3.0, -2.0])]
    rows += [(1000 + i, [float(i % 7), float(i % 5) - 2]) for i in range(1, 60) if (1000 + i) % 100]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS blk", "'x' AS dim", "'x' AS score", "'x' AS extra", "'x' AS v")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r[c] for c in ("query_id", "rank", "score", "vec_id")) for r in topk_fagin.op3_topk_fagin(spark, str(tmp_path)).collect())
    usable = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want: Counter = Counter()
    for q, x in {(i, tuple(v)) for i, v in usable if i % 100 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(x, v)), i) for i, v in usable if i != q))[:10]
        want.update((q, k, -s, i) for k, (s, i) in enumerate(scores, 1))
    assert got == want
