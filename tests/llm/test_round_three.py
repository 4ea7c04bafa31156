"""Source divergence, packing and spelling variants against their definitions in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, packing, spelling
from lodestone.llm.registry import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_definition_divergence(rows, least_docs, top):
    terms = lambda t: [w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, found = r["lang"] or "", r["source"] or "", terms(r["text"])
        groups[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = {t for t, n in in_docs[lang].items() if n >= least_docs}
        sources = {s: c for (g, s), c in groups.items() if g == lang}

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = p(sum(sources.values(), Counter()))
        of = {s: p(c) for s, c in sources.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in sources.items():
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            own = sorted((-f(of[s][t], whole[t]), t.encode(), t) for t in kept if c[t] and of[s][t] > whole[t])[:top]
            out |= {(lang, s, part, item, -v, k) for part, rows_ in (("pair", pairs), ("term", own)) for k, (v, _, item) in enumerate(rows_, 1)}
    return out


def result(frame):
    rows = frame.collect()
    out = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("how", [{}, {"terms": 3, "sources": 2, "held": 5}])
def test_divergence_by_definition(spark, odd_folder, documents, how):
    expected = by_definition_divergence(documents(odd_folder), 2, 4)
    assert len(expected) > 20
    assert result(divergence.source_divergence(spark.read.parquet(f"{odd_folder}/documents.parquet"), least_docs=2, top=4, **how)) == expected


def test_divergence_in_small_tiles_equals_its_sql(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS FROM read_parquet('{small_tables}/documents.parquet')")
    expected = connection.execute(divergence.OP11_SQL).fetchall()
    assert result(divergence.source_divergence(docs, terms=50, sources=3)) == set(expected)
    assert len(expected) > 300


def test_scaled_is_exact():
    draw = random.Random(1)
    for _ in range(2000):
        total = draw.randrange(1, 9 * 10 ** draw.randrange(1, 16))
        count = draw.randrange(total + 1)
        assert int(divergence.scaled(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def by_definition_spelling(rows):
    n: Counter = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in cut(max(a, b, key=len))

    out, form = {}, {}
    for w in words:
        others = [o for o in words if o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
        out[w] = [form[w], None, words[w], len(others), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def spelled(draw, word):
    i = draw.randrange(len(word))
    return draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice("aeé") + word[i:], word[:i] + draw.choice("aeé") + word[i + 1 :]])


def test_spelling_by_definition(spark, odd_folder, documents):
    rows = documents(odd_folder)
    draw = random.Random(3)
    base = ["spelling", "aaaaaaaa", "abababab", "straßenbahn", "ÉCOLIERS", "abcdefg"]
    for i in range(300):
        chosen = [draw.choice(base[: 1 + i % 6]) for _ in range(30)]
        chosen = [w if draw.random() < 0.8 else spelled(draw, w) if draw.random() < 0.7 else spelled(draw, spelled(draw, w)) for w in chosen]
        rows.append({"doc_id": 1000 + i, "text": " ".join(chosen)})
    rows.append({"doc_id": 1, "text": "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3001})
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").withColumn("word", F.lit(1))
    got = spelling.spelling_groups(spelling.noisy_words(docs, held=50)).collect()
    expected = by_definition_spelling(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected and len(got) == len(expected)
    assert sum(e[1] is not None for e in expected) > 20 and any(e[1] not in (None, e[2]) for e in expected)


def test_deletions_are_distinct_and_complete():
    for word in ("aab", "abc", "aaaa", "abab", "a"):
        got = list(spelling.deletions(word))
        assert got[0] == (word, -1, -1) and len({k for k, *_ in got[1:]}) == len(got) - 1
        assert sorted((k, i) for k, a, b in got[1:] for i in range(a, b + 1)) == sorted((word[:i] + word[i + 1 :], i) for i in range(len(word)))


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(i, 7) for i in range(100, 140)], "id long, form long")
    assert {(r.id, r.root) for r in spelling.roots(links).collect()} == {(i, 0) for i in [*range(1, 20), *range(100, 140)]}
    with pytest.raises(RuntimeError):
        spelling.roots(links, rounds=2)


def checked_packing(frame, rows, size, vocabulary=packing.VOCABULARY):
    """The pieces by row, held against the tokenizers library: each id in one piece, sequences full and without gaps, nothing padded."""
    exact = packing.tokenizer(vocabulary)
    texts = Counter()
    for r in rows:
        ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4")
        texts[r["doc_id"], ids.tobytes()] += 1
    pieces = frame.collect()
    by_doc = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    for (doc_id, ids), copies in texts.items():
        mine = [p for p in by_doc[doc_id] if p.doc_tokens == len(ids) // 4 and p.ids == ids[4 * p.start : 4 * (p.start + p.length)]]
        covered = Counter(i for p in mine for i in range(p.start, p.start + p.length))
        assert all(covered[i] >= copies for i in range(len(ids) // 4))
    assert sum(p.length for p in pieces) == sum(len(ids) // 4 * n for (_, ids), n in texts.items())
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    total = {}
    for s, parts in held.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        total[s] = at
    assert sorted(total) == list(range(len(total)))
    assert all(total[s] == size for s in range(sum(total.values()) // size))
    assert all(n == size or n & (n - 1) == 0 for n in total.values())  # powers of two need no padding
    return pieces


@pytest.mark.parametrize("how", [{}, {"span": 4000}, {"span": 3000, "size": 64, "least": 16}, {"span": 5000, "rates": {"s1": 3.0, None: 0.5}}])
def test_packing_by_definition(spark, odd_folder, documents, how):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    checked_packing(packing.pack_documents(docs, keep=True, **how), documents(odd_folder), how.get("size", packing.SIZE))


def test_packing_keeps_every_window_near_its_target(spark, small_tables, documents):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    for span in (packing.SPAN, 40_000):
        pieces = checked_packing(packing.pack_documents(docs, keep=True, span=span), documents(small_tables), packing.SIZE)
        counts = defaultdict(Counter)
        for p in pieces:
            counts[p.sequence_id][p.source] += p.length
        whole = sum(counts.values(), Counter())
        tokens = sum(whole.values())
        sent: Counter = Counter()
        for k in range(tokens // packing.SIZE):
            sent += counts[k]
            # a turn more or less; from span to span a slice of a small source more or less
            slack = packing.LEAST + packing.LEAST // 2 if span == packing.SPAN else packing.SIZE + packing.LEAST
            for source, n in whole.items():
                assert abs(sent[source] - n * (k + 1) * packing.SIZE / tokens) <= max(slack, packing.SIZE * n / tokens + packing.LEAST)


def test_packed_sequences_hold_their_pieces(spark, small_tables, documents):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(40)
    exact = packing.tokenizer(packing.VOCABULARY)
    of = {r.doc_id: [*exact.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    for row in packing.packed_sequences(docs).collect():
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == [i for p in row.pieces for i in of[p.doc_id][p.start : p.start + p.length]] and len(ids) <= packing.SIZE


def test_words_are_cut_as_the_tokenizer_cuts(spark):
    words, exact = packing.Words(packing.VOCABULARY), packing.tokenizer(packing.VOCABULARY)
    draw = random.Random(3)
    odd = [" ", " ", "  ", "\n", "\t", "a", "foo", "The", "1", "'s", "'", "é", "ß", ".", "<|endoftext|>", " ", "　", "日本", "\x85", "\x1c", "İ", "ſ", "ﬁ", "​", "²", "ª"]
    for _ in range(4000):
        text = "".join(draw.choice(odd) for _ in range(draw.randrange(14)))
        assert words.document(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text
    for a in range(0x180):
        for text in (chr(a), f"x{chr(a)}x", f" {chr(a)}{chr(a)} 1", f"{chr(a)} b", f"a {chr(a)}"):
            assert words.document(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_sequence_bounds():
    starts, numbers = packing.sequence_bounds(0, 300, 300, 128)
    assert starts.tolist() == [0, 128, 256, 288, 296] and numbers.tolist() == [0, 1, 2, 3, 4]
    assert packing.sequence_bounds(200, 290, 300, 128)[1].tolist() == [1, 2, 3]
    assert packing.sequence_bounds(128, 256, 256, 128)[1].tolist() == [1]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_mixture_packing", "op13_spelling_variants"])
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, small_tables, odd_folder, name):
    for folder in (small_tables, odd_folder):
        connection = duckdb.connect()
        files = f"{folder}/documents.parquet" + ("/*.parquet" if folder == odd_folder else "")
        connection.execute(f"CREATE VIEW documents AS FROM read_parquet('{files}')")
        cursor = connection.execute(SQL[name])
        names = [c[0] for c in cursor.description]
        got = QUERIES[name](spark, folder)
        assert sorted(got.columns) == sorted(names)
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())


def test_spelling_broadcasts_no_table(spark, monkeypatch):
    """Few words on disk are many shared strings, which Spark sizes by the words' file."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    write = spelling.materialise
    monkeypatch.setattr(spelling, "materialise", lambda df, label: plans.append(plan(df)) or write(df, label))
    words = spark.createDataFrame([("spelling", 200), ("speling", 20), ("spling", 2), ("other", 5)], "word string, n long")
    groups = spelling.spelling_groups(words)
    plans.append(plan(groups))
    assert {(r.word, r.root, r.n_near) for r in groups.collect()} == {("spelling", "spelling", 1), ("speling", "spelling", 2), ("spling", "spelling", 1), ("other", "other", 0)}
    assert not [p for p in plans if "Broadcast" in p] and sum("Join" in p for p in plans) >= 3
