"""Operators that treat each text by itself, against plain Python: media, licences, BPE, language, mixing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import bpe_words, jpeg_media, language_id, license_scan, mixing

FOLDERS = ["odd_folder", "small_tables"]


def rows_of(frame) -> list[tuple]:
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("folder", FOLDERS)
def test_media_keeps_every_byte(spark, documents, request, folder):
    path = request.getfixturevalue(folder)
    want = Counter()
    for d in documents(path):
        raw = (d["text"] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[d["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    out = jpeg_media.op1_jpeg_media(spark, path)
    got = [r.asDict() for r in out.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    stored = [r.asDict() for r in jpeg_media.encode_media(spark.read.parquet(f"{path}/documents.parquet")).collect()]
    assert Counter((r["doc_id"], len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in stored) == Counter((r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in got)
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())


def plain_decoder(data: bytes) -> tuple[dict[int, dict[tuple[int, int], list[int]]], list[bytes]]:
    """Coefficients of a progressive JPEG by the standard's scalar procedures: component -> (row, column) -> 64 numbers."""
    at, tables, comps, restart, comments = 2, {}, {}, 0, []
    coef: dict = defaultdict(lambda: defaultdict(lambda: [0] * 64))
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            return coef, comments
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                comps[body[6 + 3 * k]] = (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                lengths, k, code, table = body[i + 1 : i + 17], i + 17, 0, {}
                for bits in range(1, 17):
                    for _ in range(lengths[bits - 1]):
                        table[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[i]] = table
                i = k
        elif marker == 0xDA:
            n = body[0]
            parts = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = at
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            chunks = re.split(rb"\xff[\xd0-\xd7]", data[at:end])
            at = end
            hm, vm = max(h for h, _ in comps.values()), max(v for _, v in comps.values())
            mcus_x, mcus_y = -(-wide // (8 * hm)), -(-high // (8 * vm))
            if n > 1:
                units = [[(c, dc, ac, y * comps[c][1] + j, x * comps[c][0] + i) for c, dc, ac in parts for j in range(comps[c][1]) for i in range(comps[c][0])] for y in range(mcus_y) for x in range(mcus_x)]
            else:
                c, dc, ac = parts[0]
                h, v = comps[c]
                bw, bh = -(-(-(-wide * h // hm)) // 8), -(-(-(-high * v // vm)) // 8)
                units = [[(c, dc, ac, y, x)] for y in range(bh) for x in range(bw)]
            per = restart or len(units)
            for k, chunk in enumerate(chunks):
                bits = "".join(f"{b:08b}" for b in chunk.replace(b"\xff\x00", b"\xff"))
                place, run, last = 0, 0, defaultdict(int)

                def take(m):
                    nonlocal place
                    place += m
                    return int(bits[place - m : place] or "0", 2) if m else 0

                def symbol(table):
                    code = 0
                    for length in range(1, 17):
                        code = code * 2 + take(1)
                        if (length, code) in table:
                            return table[length, code]
                    raise ValueError("no such code")

                def signed(m):
                    v = take(m)
                    return v if not m or v >> (m - 1) else v - (1 << m) + 1

                def refine(block, i):
                    if take(1) and not abs(block[i]) >> al & 1:
                        block[i] += (1 if block[i] > 0 else -1) << al

                for unit in units[k * per : (k + 1) * per]:
                    for c, dc, ac, y, x in unit:
                        block = coef[c][y, x]
                        if ss == 0:
                            if ah:
                                block[0] |= take(1) << al
                            else:
                                last[c] += signed(symbol(tables[dc]))
                                block[0] = last[c] << al
                            continue
                        i = ss
                        if run:
                            run -= 1
                            if ah:
                                for j in range(ss, se + 1):
                                    if block[j]:
                                        refine(block, j)
                            continue
                        while i <= se:
                            s = symbol(tables[16 + ac])
                            r, m = s >> 4, s & 15
                            if not m and r < 15:
                                run = (1 << r) - 1 + take(r)
                                if ah:
                                    for j in range(i, se + 1):
                                        if block[j]:
                                            refine(block, j)
                                break
                            if not ah:
                                i += r
                                if m:
                                    block[i] = signed(m) << al
                                i += 1
                                continue
                            new = (1 if take(1) else -1) << al if m else 0
                            while i <= se:
                                if block[i]:
                                    refine(block, i)
                                elif r == 0:
                                    break
                                else:
                                    r -= 1
                                i += 1
                            if m and i <= se:
                                block[i] = new
                            i += 1
        else:
            assert marker in (0xDB, 0xE0), hex(marker)


@pytest.mark.parametrize("payload", [b"", b"hello world", bytes(range(256)) * 3, "größere Texte über Straßen ".encode() * 60])
def test_media_file_reads_by_the_standards_procedures(payload):
    padded = payload + bytes(-len(payload) % 64 or (0 if payload else 64))
    file = jpeg_media.encode_batch([payload])[0]
    coef, _ = plain_decoder(file)
    image, back, rgb = jpeg_media.decode_batch([file])[0]
    assert back[: len(padded)] == padded
    flat = [v for c in coef for b in sorted(coef[c]) for v in coef[c][b]]
    assert sorted(np.array(flat)[np.nonzero(flat)[0]].tolist()) == sorted(v for v in np.frombuffer(padded, np.int8).tolist() if v)
    # the inverse transform of the first luma block, by definition
    luma = min(coef)
    zig = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    square = np.zeros((8, 8))
    for k, (u, v) in enumerate(zig):
        square[u, v] = coef[luma][0, 0][k]
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    want = np.clip(np.rint(basis.T @ square @ basis + 128), 0, 255)
    got = jpeg_media.samples([image], *jpeg_media.coefficients([image]))
    assert np.abs(got[0].reshape(8, 8).astype(float) - want).max() <= 1
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


@pytest.mark.parametrize("payload", [b"hello world", "größere Texte über Straßen ".encode() * 60])
def test_media_tensor_by_definition(payload):
    """All samples by the inverse transform's definition, chroma repeated to full size, colours by the standard's weights."""
    file = jpeg_media.encode_batch([payload])[0]
    coef, _ = plain_decoder(file)
    image, _, rgb = jpeg_media.decode_batch([file])[0]
    zig = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    most = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    full = []
    for c, (h, v) in zip(sorted(coef), image.sampling):
        plane = np.zeros((8 * (1 + max(r for r, _ in coef[c])), 8 * (1 + max(k for _, k in coef[c]))))
        for (r, k), values in coef[c].items():
            square = np.zeros((8, 8))
            for (a, b), x in zip(zig, values):
                square[a, b] = x
            plane[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] = np.clip(np.floor(basis.T @ square @ basis + 128.5), 0, 255)
        full.append(np.kron(plane, np.ones((most[1] // v, most[0] // h)))[: image.height, : image.width])
    y, cb, cr = (full[0], full[1] - 128, full[2] - 128) if len(full) == 3 else (full[0], 0 * full[0], 0 * full[0])
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    # a sample at the edge of rounding may fall to either side: one unit of chroma is 1.772 of blue, and half a unit is rounded
    apart = np.abs(rgb.astype(float) - np.clip(want, 0, 255))
    assert apart.max() <= 1.772 + 0.51 and (apart > 0.51).mean() < 0.01
    means = [int(rgb[:, :, i].sum(dtype=np.int64)) * 1000 // (image.width * image.height) for i in range(3)]
    assert jpeg_media.feature_of(rgb) == f"{image.width}x{image.height}:{means[0]}:{means[1]}:{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def test_broken_media_gives_a_message(spark):
    good = jpeg_media.encode_batch([b"some text"])[0]
    frame = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"\xff\xd8 nothing")), (4, bytearray(good[: len(good) // 2]))], "doc_id long, media binary")
    frame = frame.selectExpr("*", "'x' as payload", "'x' as error", "'x' as width")
    got = {r["doc_id"]: r for r in jpeg_media.decode_media(frame).collect()}
    assert bytes(got[1]["payload"]) == b"some text" + bytes(55) and not got[1]["error"] and len(got[1]["rgb"]) == got[1]["width"] * got[1]["height"] * 3
    assert all(got[i]["payload"] is None and got[i]["rgb"] is None for i in (2, 3, 4)) and got[3]["error"] and got[4]["error"]


def licence_facts(text: str | None) -> tuple:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("folder", FOLDERS)
def test_licences_stand_where_brute_force_finds_them(spark, documents, request, folder):
    path = request.getfixturevalue(folder)
    docs = documents(path)
    out = license_scan.op2_license_scan(spark, path)
    got = [r.asDict() for r in out.collect()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((d["doc_id"], *licence_facts(d["text"])) for d in docs)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    # templates: every one whose wording stands as a whole is found
    for d in docs:
        words = license_scan.words_of(d["text"])
        for label, wording, _ in license_scan.TEMPLATES:
            w = wording.split()
            if any(words[i : i + len(w)] == w for i in range(len(words))):
                assert all(label in r["labels"].split(",") for r in got if r["doc_id"] == d["doc_id"] and r["n_words"] == len(words))


@pytest.mark.parametrize("df", [{}, dict.fromkeys(license_scan.licence_words(), 900), {"license": 5, "licensed": 5, "software": 5, "mozilla": 999, "unencumbered": 999, "mit": 999}])
def test_scores_are_shares_of_idf_weight_at_the_phrases_places(df):
    index = license_scan.Index(dict(df), 1000)
    for number, template in enumerate(index.full):
        words = ["x", "y", *template.words, "z"]
        assert index.scan(words)[2][template.label] == pytest.approx(1.0)
        # words added between two phrases: what goes on at either place is held
        if len(template.phrases) > 1:
            starts = sorted(p[0] for p in template.phrases)
            cut = starts[1]
            for added in (5, 17, 40, 3000):
                moved = template.words[:cut] + ["new"] * added + template.words[cut:]
                assert index.scan(moved)[2][template.label] == pytest.approx(1.0)
            # in the other order, or with one of them missing, they are no licence
            alone = sum(t.label == template.label for t in index.full) == 1
            assert not alone or template.label not in index.scan(template.words[cut:] + ["new"] + template.words[:cut])[2]
            assert not alone or template.label not in index.scan(template.words[:cut])[2]
        # by brute force: one word of the wording replaced takes its weight
        k = max(i for i in range(len(template.words)) if not any(s <= i < s + len(p) for s, p, *_ in template.phrases)) if len(template.words) > sum(len(p[1]) for p in template.phrases) else None
        if k is not None and sum(t.label == template.label for t in index.full) == 1:
            changed = [*template.words[:k], "other", *template.words[k + 1 :]]
            assert index.scan(changed)[2][template.label] == pytest.approx(1 - index.idf[template.words[k]] / template.weight)


@pytest.mark.parametrize("df", [{}, dict.fromkeys(license_scan.licence_words(), 900), {"license": 5, "licensed": 5, "software": 5, "mozilla": 999, "unencumbered": 999, "mit": 999}])
def test_mandatory_phrases_alone_give_the_label(df):
    index = license_scan.Index(dict(df), 1000)
    for label, wording, phrases in license_scan.TEMPLATES:
        words = wording.split()
        needed = {i for p in (x.split() for x in phrases) for i in range(len(words)) if words[i : i + len(p)] == p for i in range(i, i + len(p))}
        for other in ("other", None):
            text = [w if i in needed else other for i, w in enumerate(words)]
            text = [w for w in text if w] if other is None and needed == set(range(min(needed), max(needed) + 1)) else [w or "other" for w in text]
            assert label in index.scan(["before", *text, "after"])[2], label
            assert label in index.scan(text)[2], label


@pytest.mark.parametrize("folder", FOLDERS)
def test_bpe_equals_the_library(spark, documents, request, folder):
    path = request.getfixturevalue(folder)
    library = bpe_words.encoding(bpe_words.VOCABULARY)
    want = Counter()
    for d in documents(path):
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    assert Counter(rows_of(bpe_words.op5_bpe_words(spark, path))) == want


def test_bpe_in_small_chunks(spark, documents, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    want = Counter(rows_of(bpe_words.op5_bpe_words(spark, odd_folder)))
    assert Counter(rows_of(bpe_words.digest_documents(docs, chunk_tokens=50))) == want
    decoded = bpe_words.decode_documents(bpe_words.encode_documents(docs, chunk_tokens=50)).collect()
    ids = [np.frombuffer(r["ids"], "<u4") for r in decoded]
    assert Counter((r["doc_id"], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r, i in zip(decoded, ids)) == want


def test_language_is_told_on_held_out_documents(spark, documents):
    path = "/root/testdata/sf0.01"
    lang = {d["doc_id"]: d["lang"] for d in documents(path)}
    got = language_id.op6_language_id(spark, path).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_cases(spark, documents, odd_folder):
    docs = documents(odd_folder)
    got = Counter((r["doc_id"], r["lang_pred"] == "und") for r in language_id.op6_language_id(spark, odd_folder).collect())
    assert got == Counter((d["doc_id"], not any(c.isalpha() for c in d["text"] or "")) for d in docs)


def test_language_stage_rejects_what_no_language_holds(spark, small_tables):
    draw = np.random.default_rng(4)
    foreign = ["Это предложение написано на русском языке", "これは日本語の文章です", "ελληνικά γράμματα εδώ", "هذا نص باللغة العربية"]
    random_letters = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz" * 4 + " " * 16), n)) for n in (100, 400, 2000) for _ in range(5)]
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*foreign, *random_letters, "", "12 34", None])], "doc_id long, text string, lang string")
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text", "lang")
    got = Counter(r["doc_id"] for r in language_id.stage_language(spark, docs.unionByName(planted), small_tables).collect())
    assert got == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("slots,apart", [(1 << 20, 1e-3), (1 << 12, 0.04)])
def test_language_filters_against_exact_sets(slots, apart):
    draw = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnop "))
    text = lambda n: "".join(draw.choice(letters, n))
    known = {k: set(language_id.trigrams([text(900)])[0].tolist()) for k in range(70)}  # more languages than bits of a word
    grams = np.array([g for k in known for g in sorted(known[k])], np.uint64)
    langs = np.array([k for k in known for _ in known[k]])
    filters = language_id.Filters([f"l{k:02}" for k in known], "l00", grams, langs, slots, 3)
    # a filter so full that every fifteenth lookup is false is right on average only, so for long texts
    texts = [text(n) for n in ((30, 300, 3000) if slots > 1 << 16 else (3000, 9000))] + ["", "123"]
    pred, score, cover = filters.judge(texts)
    for t, p, s, c in zip(texts, pred, score, cover):
        mine = language_id.trigrams([t])[0].tolist()
        hits = np.array([sum(g in known[k] for g in mine) for k in known], float)
        if not any(x.isalpha() for x in t):
            assert (p, s, c) == ("und", 0.0, 0.0)
        elif not hits.sum():
            assert c <= apart
        else:
            assert abs(c - hits.max() / len(mine)) <= apart and hits[int(p[1:])] >= hits.max() - apart * len(mine)
            assert abs(s - hits[int(p[1:])] / hits.sum()) <= apart


def test_language_trigram_counts_by_brute_force():
    texts = ["Ab c1de", "", "é", "xyz xyz"]
    packed, owner, n_letters = language_id.trigrams(texts)
    want = Counter()
    for i, t in enumerate(texts):
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            framed = f" {word} "
            want.update((i, framed[k : k + 3]) for k in range(len(word)))
    got = Counter((o, "".join(chr(int(p) >> s & 0x1FFFFF) for s in (42, 21, 0))) for p, o in zip(packed.tolist(), owner.tolist()))
    assert got == want and n_letters.tolist() == [5, 0, 1, 6]


def targets_by_hand(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**share, **{s: 2.0 * sizes[s] for s in capped}}
        capped |= over


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("block", [4, 2048])
def test_mixing_meets_its_targets(spark, documents, request, folder, block):
    path = request.getfixturevalue(folder)
    docs = documents(path)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for d in docs:
        per[d["source"]] += size(d["text"])
    frame = spark.read.parquet(f"{path}/documents.parquet")
    got = [r.asDict() for r in mixing.mix_counts(frame.select("doc_id", "text", "source"), block).collect()]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d["doc_id"], size(d["text"])) for d in docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    target, source = targets_by_hand(dict(per)), {}
    for d in docs:
        source.setdefault((d["doc_id"], size(d["text"])), d["source"])
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == per[s] and r["target"] == pytest.approx(target[s])
            taken[s] += r["taken"]
    if folder == "small_tables":
        assert all(abs(taken[s] - target[s]) <= 1 for s in per)
    again = Counter(rows_of(mixing.mix_counts(frame.select("doc_id", "text", "source").repartition(5), block)))
    assert again == Counter(tuple(r.values()) for r in got)


def test_mixed_rows_agree_with_the_counts(spark, small_tables):
    frame = spark.read.parquet(f"{small_tables}/documents.parquet")
    words = Counter()
    for r in mixing.mix_rows(frame).collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(frame.select(*frame.columns)).collect()}
    assert {k: v for k, v in counts.items() if v} == {k: v for k, v in words.items() if v}


@pytest.mark.parametrize("op", [jpeg_media.op1_jpeg_media, license_scan.op2_license_scan, bpe_words.op5_bpe_words, language_id.op6_language_id, mixing.op7_source_mix])
def test_empty_table(spark, empty_folder, op):
    assert op(spark, empty_folder).collect() == []


def test_many_equal_rows_are_copied_in_chunks(spark, tmp_path):
    rows = [(1, "one two three", "s")] * 37 + [(i, "four five", "s") for i in range(2, 9)] + [(20, "six", "t")] * 11
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for run in (mixing.mix_counts, mixing.mix_rows):
        whole, parts = (Counter(tuple(r) for r in run(docs, chunk=n).collect()) for n in (100_000, 4))
        assert whole == parts and sum(whole.values()) > 0
