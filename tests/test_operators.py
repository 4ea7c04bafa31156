"""Edge cases of the operators, by hand-computed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numeric as N
from lodestone.functions import text as T
from lodestone.operators import aggregate, dedup, evidence, graph, metrics, ranking, splits, thresholds, validate
from lodestone.plans import catalogue, records, registry
from lodestone.sources import readers, sinks
from lodestone.streaming import events as stream


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_normalise_cases(spark):
    n = lambda s: one(spark, T.normalise(F.col("s").cast("string"), "ABCD", "X"), s=s)
    bad = n("ab*c?*")
    assert (bad["text"], bad["stop_removed"], bad["invalid"], bad["status"]) == ("ABC", True, ["*", "?"], "invalid")
    assert n(None)["sha256"] is None and n(None)["reasons"] == ["length:none", "length:below_20"]
    assert n("A-" * 20 + "X")["reasons"] == ["letters:ambiguous", "letters:gaps"] and n("A b\n" * 10)["status"] == "pass"


@pytest.mark.parametrize("text,number", [("1_000", None), (" 1.5 ", 1.5), ("nan", None), ("", None), ("-3e2", -300.0), ("N/A", None), ("x", None)])
def test_numbers(spark, text, number):
    assert one(spark, T.to_number(F.col("s")), s=text) == number


def test_a_null_hides_later_keys(spark):
    fields = F.create_map(F.lit("label"), F.lit(None).cast("string"), F.lit("value"), F.lit("1"))
    assert one(spark, T.first_present(fields, "label", "value")) is None
    assert one(spark, T.first_present(fields, "nothing", "value")) == "1"


def test_windows_stop_at_the_end(spark):
    frame = spark.createDataFrame([("ACGT" * 32,), ("",), (None,), ("A" * 64,), ("A" * 65,)], "t string")
    got = {}
    for r in T.text_windows(frame, "t", 64, 8).collect():
        got.setdefault(r["t"], []).append((r["start"], r["stop"]))
    assert got == {"ACGT" * 32: [(0, 64), (56, 120), (112, 128)], "A" * 64: [(0, 64)], "A" * 65: [(0, 64), (56, 65)]}


def test_small_functions(spark):
    assert one(spark, T.reverse_complement(F.col("s")), s="AACG") == "CGTT"
    assert one(spark, T.outcome(F.array(F.lit("Positive-low"), F.lit(None)))) == 1
    assert one(spark, T.outcome(F.array(F.lit("positive"), F.lit("negative")))) is None
    r = one(spark, T.read_quality(F.col("s"), F.col("q"), ["GGG"]), s="ACGNNNGGG", q="!!!!!!!!!")
    assert (r["length"], r["unknown"], r["mean_quality"]) == (9, 0.3333, 0.0) and r["reasons"] == ["too_short", "too_many_unknown", "adapter", "low_quality"]
    assert one(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    row = one(spark, N.flag_score({"a": F.lit(True), "b": F.lit(None).cast("boolean")}))
    assert (row["status"], row["score"], row["unassessed"]) == ("partial", None, ["b"])
    frame = spark.createDataFrame([("x", "9606"), ("fish", None)], "host_name string, host_taxon string")
    assert [r[0] for r in frame.select(T.matches_in_columns(frame, ["host"], "9606|human")).collect()] == [True, False]


def test_evidence_is_not_promoted_by_name(spark):
    level = lambda **k: one(spark, evidence.grade(F.lit(k.get("private")), F.lit(k.get("assay", "")), F.lit(k.get("source", "")), F.lit(k.get("ref")), F.lit(k.get("target")), ["assay"], ["predicted"]))
    assert level(source="Famous") == "E4" and level(private=True, assay="Assay X", ref="r", target=True) == "E2"
    assert level(assay="assay", ref="r", target=True) == "E1" and level(source="predicted") == "E3" and level(assay="assay", ref=" ", target=True) == "E4"


def test_conflicts_are_set_aside(spark):
    rows = [("g", "t", 1.0, "E2"), ("g", "t", 0.0, "E4"), ("h", "t", float("nan"), "E4"), ("h", "t", 1.0, None)]
    got = {r["k"]: r for r in evidence.resolve_labels(spark.createDataFrame(rows, "k string, task string, label double, level string"), ["k", "task"]).collect()}
    assert got["g"]["role"] == "quarantine_conflict" and got["h"]["role"] == "weak_supervision_only" and got["h"]["n_values"] == 1


def test_contracts(spark):
    rows = spark.createDataFrame([("t", 1.0, "E1", 1.0, True), ("t", float("nan"), "E9", 2.0, None), ("u", 1.0, "E4", 0.2, True)], "task string, label double, level string, weight double, gold boolean")
    rules = validate.label_rules(tasks=["t"])
    good, bad = validate.route(rows, rules)
    assert good.count() == 1 and sorted(map(tuple, (r["reasons"] for r in bad.collect()))) == [("label:not_finite", "level:unknown", "weight:outside"), ("task:unknown", "gold:weak_evidence")]
    with pytest.raises(Exception, match="task:unknown|label:not_finite"):
        validate.strict(rows, rules).collect()
    lineage = spark.createDataFrame([("v1", "Unknown"), (None, "b")], "m string, b string")
    assert [r["reasons"] for r in validate.with_reasons(lineage, validate.lineage_rules("m", "b")).collect()] == [["lineage:b"], ["lineage:m"]]


def test_groups_are_never_cut(spark):
    rows = spark.createDataFrame([(f"g{i}", t) for i, ts in enumerate(["ab", "bc", "d", "e", "cf", None]) for t in ts or [None]], "g string, t string")
    got = {r["g"]: (r["component"], r["split"]) for r in splits.component_split(rows.where("t is not null"), "g", "t").collect()}
    assert got["g0"] == got["g1"] == got["g4"] and len(got) == 5


def test_graphs(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(path).collect()}
    assert between == {"a": 0.0, "b": 1.0, "c": 0.0}
    near = spark.createDataFrame([("g", 1, 1, 10), ("g", 2, 51, 60), ("g", 3, 121, 130), ("h", 4, 1, 10)], "grp string, id int, a int, b int")
    assert [tuple(r) for r in graph.range_pairs(near, ["grp"], "id", "a", "b", 60, 50).orderBy("src").collect()] == [("g", 1, 2, 41)]
    assert [(r["src"], r["dst"], r["gap"]) for r in graph.adjacent_pairs(near, ["grp"], "id", "a", "b", 60).orderBy("src").collect()] == [(1, 2, 40), (2, 3, 60)]
    pairs = spark.createDataFrame([("x", "y", 0.9), ("y", "z", 0.9)], "a string, b string, r double")
    assert graph.leaders(pairs, ["x", "y", "z"], 0.8) == {"x": "x", "y": "x", "z": "z"}


def test_components_of_a_long_path_and_a_large_star(spark, small_tables):
    path = [(i + 1, i) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(path + star + [(5000, 5000), (None, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {5000: 5000}
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e in records.customer_edges(catalogue.Tables(spark, small_tables)).collect():
        a, b = top(e["src"]), top(e["dst"])
        parent[max(a, b)] = min(a, b)
    assert {(r["node"], r["component"]) for r in registry.QUERIES["order_components"](spark, small_tables).collect()} == {(x, top(x)) for x in [*parent]}


def test_position_profile_has_every_position(spark, small_tables):
    places: dict = {}
    for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("text").collect():
        for i, c in enumerate(r["text"] or ""):
            counts = places.setdefault(i, {})
            counts[c] = counts.get(c, 0) + 1
    want = {i: (sum(n.values()), min(n, key=lambda c: (-n[c], c)), round(max(n.values()) / sum(n.values()), 9), round(n.get("-", 0) / sum(n.values()), 9)) for i, n in places.items()}
    assert {r[0]: tuple(r[1:]) for r in registry.QUERIES["position_profile"](spark, small_tables).collect()} == want
    assert len(want) > 200


def test_tiers(spark):
    rows = spark.createDataFrame([("a", 0.8, 0.8, 2, None), ("b", 0.4, 0.4, 3, None), ("c", 0.9, 0.9, 3, 0.81), ("d", None, 0.5, 2, None), ("e", 0.8, 0.8, None, None)], "id string, x double, y double, n int, v double")
    got = {r["id"]: r["tier"] for r in ranking.tiers(rows, "x", "y", "n", "v", 0.5, 0.5, 0.8).collect()}
    assert got == {"a": "A", "b": "C", "c": "excluded", "d": "unranked", "e": "B"}


def test_ranks_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i, float(i % 3) if i else None) for i in range(10)], "id int, s double")
    got = [r["id"] for r in ranking.global_rank(rows, "s", "id").orderBy("rank").collect()]
    assert got == [2, 5, 8, 1, 4, 7, 3, 6, 9, 0]
    flat = ranking.global_rank(rows.withColumn("s", F.lit(1.0)), "s", "id").orderBy("rank").collect()
    assert [r["id"] for r in flat] == list(range(10)) and flat[0]["percentile"] == 1.0


def test_calibration_and_fits(spark):
    few = ranking.conformal(spark.createDataFrame([(0.0, 0.5), (1.0, 0.8)], "p double, y double"), "p", "y").first()
    assert few["status"] == "small_sample_widened" and few["width"] == pytest.approx(0.75)
    points = [("g", float(t), 2.0 + 3 * t + t * t) for t in range(1, 6)] + [("h", 1.0, 1.0)] * 3
    fit = {r["k"]: r for r in ranking.quadratic_fit(spark.createDataFrame(points, "k string, t double, y double"), ["k"], "t", "y").collect()}
    assert [fit["g"][f"c{i}"] for i in range(3)] == pytest.approx([2, 15, 25]) and fit["h"]["c0"] is None
    assert metrics.auc(spark.createDataFrame([(0.5, 1), (0.5, 0)], "s double, y int"), [], "s", "y").first()["auc"] == 0.5


def test_names_by_content(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id int, t string")
    known = spark.createDataFrame([("x", "n1"), ("x", "n1"), ("y", "n1"), ("y", "n2")], "t string, name string")
    got = {r["id"]: (r["recovered"], r["status"]) for r in dedup.recover_names(rows, known, "t", "name").collect()}
    assert got == {1: ("n1", "recovered"), 2: (None, "ambiguous"), 3: (None, "no_match"), 4: (None, "not_applicable")}


def write(path, text: str) -> str:
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    rows = readers.json_lines(spark, write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": \n{"a": 2}\n'), "a int").collect()
    assert sorted((r["a"] or 0, r["_corrupt"] is not None) for r in rows) == [(0, True), (1, False), (2, False)]
    assert sorted(r["a"] for r in readers.json_array(spark, write(tmp_path / "b.json", '[{"a": 1},\n {"a": 2}]'), "a int").collect()) == [1, 2]
    semi = readers.delimited(spark, write(tmp_path / "c.csv", "﻿a;b\n1;x,y\n"))
    assert semi.columns == ["a", "b"] and semi.first()["b"] == "x,y"
    found = {r["id"]: (r["description"], r["sequence"]) for r in readers.table(spark, write(tmp_path / "d.fasta", ">p1 first one\nAC\nGT\n>p2\nTT\n")).collect()}
    assert found == {"p1": ("first one", "ACGT"), "p2": ("", "TT")}
    reads = readers.fastq(spark, write(tmp_path / "e.fastq", "@r1\nACG\n+\nIII\nr2\nAC\n+\nI\n"))
    assert [(r["id"], r["faulty"]) for r in reads.collect()] == [("r1", False), ("r2", True)] and not readers.file_integrity(reads).first()["valid"]
    sam = readers.alignments(spark, write(tmp_path / "f.sam", "@HD\nq1\t0\tchr\t5\t1\nq2\t4\t*\t0\t0\nshort\n")).collect()
    assert [(r["id"], r["position"], r["mapped"]) for r in sam] == [("q1", 5, True), ("q2", 0, False)]
    assert readers.intervals(spark, write(tmp_path / "g.bed", "c\t1\t9\tn\t3\t+\nc\t1\n")).first()["stop"] == 9
    block = [r["fields"] for r in readers.blocks(spark, write(tmp_path / "h.txt", "id\t1\nname\tx y\n//\nid\t2\n//\n")).collect()]
    assert block == [{"id": "1", "name": "x y"}, {"id": "2"}]
    bank = "FEATURES\n     CDS             1..9\n                     /gene=\"abc\"\n                     /note=\"two\n                     lines\"\n     gene            1..9\nORIGIN\n"
    entry = readers.features(spark, write(tmp_path / "i.gb", bank)).first()
    assert entry["place"] == "1..9" and entry["qualifiers"] == {"gene": "abc", "note": "two lines"}
    assert one(spark, readers.link_rows(F.col("s")), s="| [a](http://x) | `b` |")[0]["url"] == "http://x"
    assert one(spark, readers.section_titles(F.col("s")), s="<a><sec><title>T</title></sec></a>") == ["T"]
    assert readers.optional(spark, None, "a string").count() == 0
    table, wanted = spark.createDataFrame([(1, "u"), (2, "v")], "k int, v string"), spark.createDataFrame([(0, 2), (1, 1)], "place int, k int")
    assert [r["v"] for r in readers.vectors(table, wanted, "k", "place").collect()] == ["v", "u"]
    with pytest.raises(Exception, match="no vector for"):
        readers.vectors(table.where("k = 1"), wanted, "k", "place").collect()


def test_sinks_never_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, sha string")
    assert sinks.write_json_lines(frame, str(tmp_path / "out")) == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_json_lines(frame, str(tmp_path / "out"))
    manifest = str(tmp_path / "manifest")
    sinks.append_manifest(spark, frame, manifest, ["k"], ["sha"])
    sinks.append_manifest(spark, spark.createDataFrame([(2, "b"), (3, "c")], "k int, sha string"), manifest, ["k"], ["sha"])
    assert spark.read.parquet(manifest).count() == 3
    with pytest.raises(ValueError):
        sinks.append_manifest(spark, spark.createDataFrame([(3, "x")], "k int, sha string"), manifest, ["k"], ["sha"])
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("x\n")
    (tmp_path / "files" / "b.tmp").write_text("")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path / "files"), "*.txt").collect()] == ["a.txt"]
    listed = spark.createDataFrame([("a.txt", 2), ("b.tmp", 0), ("c.BAK", 9)], "path string, bytes long")
    assert [r["verdict"] for r in sinks.judged_files(listed, [".bak"]).collect()] == ["keep", "empty", "bad_suffix"]
    assert sinks.inventory(spark, str(tmp_path / "files"), "*.txt").first()["lines"] == 1


def test_stream_equals_table(spark, small_tables, tmp_path):
    table = spark.read.parquet(f"{small_tables}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    events = stream.read_folder(spark, str(tmp_path / "in"), schema)
    q = stream.windowed(events, "ts", "event_type", "value", late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in stream.windowed(table, "ts", "event_type", "value").collect()}


def test_calls_follow_the_sign_of_the_ratio(spark):
    rows = spark.createDataFrame([(3, 0.0), (10, -1.0), (10, -1.5), (60, 1.5), (60, 1.0)], "total int, ratio double")
    coverage, call = aggregate.tier(F.col("total"), F.col("ratio"))
    got = [tuple(r) for r in rows.select(coverage, call).collect()]
    assert got == [("low", "untested"), ("medium", "conditional"), ("medium", "essential"), ("high", "dispensable"), ("high", "conditional")]


def test_mean_of_cosines(spark):
    query = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.0, 0.0])], "id int, g string, v array<double>")
    support = spark.createDataFrame([("g", [5.0, 0.0]), ("g", [0.0, 1.0]), ("g", None)], "g string, v array<double>")
    assert [(r["id"], r["cosine"]) for r in ranking.mean_cosine(query, "id", support, ["g"], "v").collect()] == [(1, 0.5)]


@pytest.mark.parametrize("n,parts", [(13, (9, 1, 3)), (1, None), (2, (1, 0, 1)), (3, (2, 0, 1)), (4, (2, 1, 1)), (20, (14, 3, 3))])
def test_stratified_group_split_sizes(spark, n, parts):
    groups = spark.createDataFrame([(f"g{i}", "s") for i in range(n)], "g string, s string")
    if parts is None:
        with pytest.raises(Exception, match="two groups"):
            splits.stratified_group_split(groups, "g", "s").collect()
        return
    got = [r["split"] for r in splits.stratified_group_split(groups, "g", "s").collect()]
    assert tuple(got.count(x) for x in splits.NAMES) == parts


def test_single_groups_leave_one_to_test(spark):
    groups = spark.createDataFrame([(f"g{i}", f"s{i}") for i in range(4)], "g string, s string")
    got = {r["g"]: r["split"] for r in splits.stratified_group_split(groups, "g", "s").collect()}
    assert got == {"g0": "train", "g1": "train", "g2": "train", "g3": "test"}


@pytest.mark.parametrize("n,parts", [(2, None), (3, (1, 1, 1)), (4, (2, 1, 1)), (40, (28, 6, 6))])
def test_component_split_sizes(spark, n, parts):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(n)] + [(0, "t0")], "g int, t string")
    if parts is None:
        with pytest.raises(Exception, match="three independent"):
            splits.component_split(rows, "g", "t").collect()
        return
    got = [r["split"] for r in splits.component_split(rows, "g", "t").collect()]
    assert tuple(got.count(x) for x in splits.NAMES) == parts


def test_intervals(spark):
    pairs = spark.createDataFrame([(float(i), i + i / 100) for i in range(1, 201)], "p double, y double")
    width = ranking.conformal(pairs, "p", "y").first()
    assert width["status"] == "split_conformal" and width["width"] == pytest.approx(1.81)
    assert ranking.conformal(pairs, "p", "y", alpha=0.001).first()["width"] == pytest.approx(2.0 * (1 + 1 / 200))
    none = ranking.conformal(pairs.limit(0), "p", "y")
    assert tuple(none.first()) == (0, None, "no_calibration_data")
    points = spark.createDataFrame([(0.4,), (None,), (float("nan"),)], "x double")
    small = ranking.conformal(spark.createDataFrame([(0.0, 0.5), (1.0, 0.8)], "p double, y double"), "p", "y")
    got = [tuple(r)[1:] for r in ranking.intervals(points, "x", small).collect()]
    assert got[0][2] == "small_sample_widened" and got[0][:2] == pytest.approx((0.0, 1.0))
    assert got[1:] == [(0.0, 1.0, "unavailable")] * 2


def test_conformal_of_many_errors_equals_sorting(spark):
    pairs = spark.range(30_000).select(F.lit(0.0).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("y"))
    errors = sorted(r["y"] for r in pairs.collect())
    assert ranking.conformal(pairs, "p", "y").first()["width"] == errors[27_000]


def test_betweenness_counts_pairs_of_all_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "c"), ("x", "y")], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(1 / 6), "c": 0.0, "x": 0.0, "y": 0.0}
    square = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src int, dst int")
    assert [r["betweenness"] for r in graph.betweenness(square).collect()] == pytest.approx([1 / 6] * 4)


def test_fit_reasons(spark):
    points = [("few", 1.0, 1.0), ("few", 2.0, 1.0)] + [("same", 1.0, 1.0)] * 3 + [("nan", float(t), float("nan")) for t in range(3)] + [("minus", float(t), 1.0) for t in (-1, 1, 2)] + [("zero", 0.0, 1.0)] * 3
    got = {r["k"]: r["status"] for r in ranking.quadratic_fit(spark.createDataFrame(points, "k string, t double, y double"), ["k"], "t", "y").collect()}
    assert got == {"few": "too_few_points", "same": "singular", "nan": "not_finite", "minus": "negative_time", "zero": "no_positive_time"}


def test_thresholds_none_and_ties(spark):
    rows = spark.createDataFrame([(0.9, 0.1, 0.1, True, False, False), (0.9, 0.3, 0.2, False, False, False), (0.2, 0.9, 0.9, False, True, True)], "a double, i double, e double, t boolean, x boolean, y boolean")
    best = thresholds.choose_thresholds(rows, "a", "i", "e", "t", "x", "y").collect()
    assert [tuple(r) for r in best] == [(0.9, 0.3, 0.2, 1, 1.0, 0.0, 0.0)]
    assert thresholds.choose_thresholds(rows, "a", "i", "e", "x", "x", "y").collect() == []


def test_combinations_leave_out_vetoed_and_lose_neighbours(spark):
    rows = spark.createDataFrame([("a", 0.5, 1.0, 1.0, 1.0, 0.0), ("b", 0.5, 0.9, 0.8, 1.0, 0.1), ("c", 0.9, 0.9, 0.9, 1.0, 0.9), ("d", None, 1.0, 1.0, 1.0, 0.0)], "id string, g double, k double, s double, w double, v double")
    edges = spark.createDataFrame([("a", "d")], "src string, dst string")
    got = {tuple(r["members"]): (r["gain"], r["retained"], r["safe"]) for r in ranking.combination_scores(rows, edges, "id", "g", "k", "s", "w", "v", 0.5).collect()}
    assert got == {("a",): (0.5, 0.5, 1.0), ("b",): (0.5, 0.75, 0.8), ("a", "b"): (0.75, 0.25, 0.8)}


def test_sequences_and_names(spark):
    row = spark.range(1).select(
        T.canonical_key(F.lit("ac-d*?x"), "ACD").alias("k"), T.strict_sequence(F.lit("ac gt-n")).alias("good"), T.strict_sequence(F.lit("acx")).alias("bad"), T.strict_sequence(F.lit(None).cast("string")).alias("none"),
        T.bracketed_suffix(F.lit("p1 [x] protein [Some organism] ")).alias("s"), T.bracketed_suffix(F.lit("none")).alias("ns"), T.other_class(F.lit("Type VI-secretion"), ["t3ss"], "type(?:vi|iv)secretion").alias("o"), T.other_class(F.lit(None).cast("string"), [], "x").alias("no"),
    ).first()
    assert row["k"]["text"] == "ACD" and row["good"]["status"] == "pass" and row["good"]["text"] == "ACGTN"
    assert row["bad"]["sha256"] is None and row["bad"]["reasons"] == ["invalid_characters"] and row["none"]["status"] == "invalid"
    assert (row["s"], row["ns"], row["o"], row["no"]) == ("Some organism", None, True, False)


def test_label_rows_outside_the_range_are_an_error(spark):
    rows = spark.createDataFrame([("a", "2", "T")], "key string, label string, task string")
    with pytest.raises(Exception, match="outside 0..1"):
        evidence.label_rows(rows, ["key"], ["label"], "s").collect()
    unknown = spark.createDataFrame([("a", "yes", "T"), (" ", "1", "T"), ("b", "1", None), ("c", None, "T")], "key string, label string, task string")
    assert evidence.label_rows(unknown, ["key"], ["label"], "s").collect() == []  # unknown is no negative


def test_gold_lookup_sets_conflicts_apart(spark):
    labels = spark.createDataFrame([("a", "t", 1.0, "E1"), ("a", "t", 0.0, "E2"), ("b", "t", 1.0, "E4"), ("c", "t", 1.0, "E2"), ("c", "t", 1.0, "E2")], "key string, task string, label double, level string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r["key"]: (r["label"], r["status"]) for r in evidence.gold_lookup(wanted, labels, "key", "t").collect()}
    assert got == {"a": (None, "conflict"), "b": (None, "missing"), "c": (1.0, "found")}


def test_attribute_edges_keep_the_last(spark):
    first = spark.createDataFrame([("a", "b", "k", 0.5), ("a", "a", "k", 1.0)], "src string, dst string, kind string, weight double")
    last = spark.createDataFrame([("b", "a", "k", 0.2)], "src string, dst string, kind string, weight double")
    assert sorted(tuple(r) for r in graph.attribute_edges(first, last).collect()) == [("a", "b", "k", 0.2), ("b", "a", "k", 0.2)]
    genes = spark.createDataFrame([("g", 1, 1, 10, "+", None), ("g", 2, 51, 60, "+", None), ("g", 3, 200, 210, "-", "o"), ("g", 4, 900, 910, "+", "o")], "c string, id int, a int, b int, s string, o string")
    assert sorted(tuple(r) for r in graph.neighbour_edges(genes, ["c"], "id", "a", "b", "s", "o").collect()) == [(1, 2, 0.8), (3, 4, 1.0)]


def test_broken_files(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    headless = write(tmp_path / "h.fasta", "ACGT\n>p\nAC\n")
    with pytest.raises(Exception, match="no header"):
        readers.fasta(spark, headless).collect()
    aligned = readers.aligned_texts(spark, write(tmp_path / "a.a3m", ">query\nACD\n>hit\nAc.CD\n")).collect()
    assert [(r["id"], r["sequence"]) for r in aligned] == [("hit", "ACD")]
    sam = readers.alignments(spark, write(tmp_path / "g.sam", "q1\t0\tchr\nq2\t4\n")).collect()
    assert [(r["id"], r["reference"], r["position"], r["mapped"]) for r in sam] == [("q1", "chr", None, True)]
    xml = spark.createDataFrame([("<a><sec><title>One</title></sec><sec><title>Two</title></sec></a>",), ("<a><sec></a>",), ("no xml",), (None,)], "x string")
    assert [r[0] for r in xml.select(readers.section_titles(F.col("x"))).collect()] == [["One", "Two"], None, None, None]
    assert readers.optional(spark, str(tmp_path / "none.tsv"), "a string").collect() == [] == readers.optional(spark, None, "a string").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.tsv", "x\ty\r\n1\t2\n")
        z.writestr("b.txt", "no")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        entry = tarfile.TarInfo("c.fasta")
        entry.size = 7
        t.addfile(entry, io.BytesIO(b">p\nACGT"))
    lines = lambda name, pattern="*": [(r["member"], r["number"], r["line"]) for r in readers.archive_lines(spark, str(tmp_path / name), pattern).orderBy("member", "number").collect()]
    assert lines("z.zip", "*.tsv") == [("in/a.tsv", 0, "x\ty"), ("in/a.tsv", 1, "1\t2")]
    assert lines("t.tar.gz") == [("c.fasta", 0, ">p"), ("c.fasta", 1, "ACGT")]


def test_containment_is_the_same_without_a_broadcast(spark, monkeypatch):
    from lodestone.operators import textmine

    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d x"), (3, None)], "id int, text string")
    probes = spark.createDataFrame([(1, "b c d e"), (2, "a b")], "pid int, text string")
    want = sorted(tuple(r) for r in textmine.containment(texts, "id", probes, "pid", k=3).collect())
    monkeypatch.setattr(textmine, "few", lambda rows: False)
    assert want == sorted(tuple(r) for r in textmine.containment(texts, "id", probes, "pid", k=3).collect()) == [(1, 1, 2, 1.0), (2, 1, 1, 0.5)]


def test_lineage_must_say_something(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    with pytest.raises(ValueError, match="batch_id"):
        validate.with_lineage(rows, [], {"batch_id": " Unknown "})
    with pytest.raises(Exception, match="short"):
        validate.with_lineage(rows, [(F.size("v") < 2, "short")], {"batch_id": "b"}).collect()


def test_labels_keep_duplicates_and_invent_no_negatives(spark):
    part = spark.createDataFrame([("a", "t", 1.0, "s"), ("a", "t", 1.0, "s")], "key string, task string, label double, source string")
    out = evidence.union_sources({"x": part, "y": part}, F.lit("E4")).collect()
    assert len(out) == 4 and all(r["label"] == 1.0 for r in out) and {r["origin"] for r in out} == {"x", "y"}


def test_coverage_of_strata(spark):
    strata = spark.createDataFrame([("s", 2.0)], "s string, w double")
    inputs = spark.createDataFrame([("m", "s", 0.9, 1.0, 0.5, 0.8)], "m string, s string, p double, e double, lo double, hi double")
    one = aggregate.strata_coverage(strata, inputs, "s", "w", ["p", "e"], "lo", "hi", inputs, "m").first()
    assert (one["lower"], one["upper"], one["missing"]) == (pytest.approx(0.45), pytest.approx(0.72), 0)
    more = inputs.select("m").unionByName(spark.createDataFrame([("x",)], "m string"))
    assert tuple(aggregate.strata_coverage(strata, inputs, "s", "w", ["p", "e"], "lo", "hi", more, "m").first()) == (None, None, 1)
    with pytest.raises(Exception, match="negative"):
        aggregate.strata_coverage(strata.withColumn("w", F.lit(-1.0)), inputs, "s", "w", ["p", "e"], "lo", "hi", inputs, "m").collect()


def test_judged_tiers(spark):
    rows = spark.createDataFrame([("a", 0.8, 0.8, 0.8, 2, 0.1), ("b", 0.4, 0.4, 0.4, 2, 0.1), ("c", 0.9, 0.9, 0.9, 3, 0.8), ("d", None, 0.4, None, None, None), ("e", 0.9, 0.2, 1.0, None, None)], "id string, x double, y double, s double, n int, v double")
    got = {r["id"]: (r["tier"], r["reasons"]) for r in ranking.judged_tiers(rows, "x", "y", "s", "n", "v", 0.7, 0.7, 0.5).collect()}
    assert got == {"a": ("A", []), "b": ("C", ["dominated"]), "c": ("excluded", ["unavailable", "vetoed"]), "d": ("unranked", ["unavailable"]), "e": ("B", ["agreement_not_met", "below_threshold"])}
    with pytest.raises(Exception, match="outside"):
        ranking.judged_tiers(rows.withColumn("s", F.lit(1.5)), "x", "y", "s", "n", "v", 0.7, 0.7, 0.5).collect()


def test_folded_titles(spark):
    row = spark.range(1).select(T.folded_title_key(F.lit("Caf\u00e9  \ufb01ne!")).alias("k"), T.folded_title_key(F.lit(None).cast("string")).alias("n")).first()
    assert row["k"] == "cafe fine" and row["n"] is None


def test_file_kinds_edges_and_ids(spark):
    contents = [(bytearray(b"\x1f\x8b\x08"), "gzip"), (bytearray(b"PK\x03\x04xx"), "zip"), (bytearray(b"\x89PNG\r\n"), "png"), (bytearray(b"%PDF-1"), "pdf"), (bytearray(b"PAR1"), "parquet"), (bytearray(b"text"), "other"), (bytearray(b""), "other")]
    rows = spark.createDataFrame(contents, "content binary, want string")
    assert all(r["got"] == r["want"] for r in rows.select(validate.file_kind(F.col("content")).alias("got"), "want").collect())
    edges = spark.createDataFrame([(1, 2, 0.5, 0), (None, 2, 0.5, 0), (1, 2, float("nan"), 0), (1, 2, 0.5, 9)], "s int, d int, w double, k int")
    got = [r["reasons"] for r in validate.with_reasons(edges, validate.edge_rules("s", "d", "w", "k")).collect()]
    assert got == [[], ["edge:missing_end"], ["edge:weight"], ["edge:kind"]]
    ids = spark.createDataFrame([(1, "a", None), (1, "a", ""), (2, "a", None)], "n int, x string, y string").select(T.stable_id("p", F.col("n"), F.col("x"), F.col("y")).alias("id")).collect()
    assert len({r["id"] for r in ids}) == 3 and all(r["id"].startswith("p") and len(r["id"].split("_")[1]) == 16 for r in ids)


def test_first_rows_of_a_key(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    got = sorted((r["k"], r["v"], r["rank"]) for r in dedup.neighbours_kept(rows, ["k"], [F.col("v")], 2).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]


def test_csv_is_never_written_over(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b")], "i int, t string")
    sinks.write_csv(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("1", "a,b")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_csv(rows, str(tmp_path / "out"))


def test_first_events_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:10:00", 2), ("b", "2024-01-01 00:05:00", 3)], "k string, ts string, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = stream.first_seen(stream.read_folder(spark, str(tmp_path / "in"), "k string, ts string, v int"), "k", "ts")
    events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 3)]
