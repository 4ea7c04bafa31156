"""Queries over labels, sequences, thresholds, combinations and graphs built from attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregate, dedup, evidence, graph, grams, linear, ranking, splits, textmine, thresholds, validate
from lodestone.sources import readers, sinks

from .catalogue import Tables, query
from .records import EDGES, SCORES, customer_edges, part_scores, similar_vectors
from .texts import LABELS, graded_labels

#: The letters of the two alphabets.
PROTEIN, NUCLEOTIDE = "ACDEFGHIKLMNPQRSTVWY", "ACGTN"
UPPER = "translate(coalesce({}, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"SELECT doc_id, length(k)::BIGINT AS length, CASE WHEN k <> '' THEN sha256(k) END AS sha256 FROM (SELECT doc_id, regexp_replace({UPPER.format('text')}, '[^{PROTEIN}]', '', 'g') AS k FROM documents)")
def canonical_key(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", T.canonical_key(F.col("text"), PROTEIN).alias("k"))
    return k.select("doc_id", F.length("k.text").cast("long").alias("length"), F.col("k.sha256").alias("sha256"))


@query(rf"""WITH r AS (SELECT p_partkey, replace(regexp_replace({UPPER.format("concat(substring('acgtn-acg', 1 + (p_partkey % 9)::BIGINT), CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE ' ' END)")}, '[ \t\n\r\f\x0B]+', '', 'g'), '-', '') AS s FROM part)
SELECT p_partkey, s AS text, CASE WHEN s <> '' AND NOT regexp_matches(s, '[^{NUCLEOTIDE}]') THEN sha256(s) END AS sha256, CASE WHEN s = '' OR regexp_matches(s, '[^{NUCLEOTIDE}]') THEN 'invalid' ELSE 'pass' END AS status FROM r""")
def strict_sequence(t: Tables) -> DataFrame:
    raw = F.concat(F.substr(F.lit("acgtn-acg"), (1 + F.col("p_partkey") % 9).cast("int")), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(" "))
    s = t.part.select("p_partkey", T.strict_sequence(raw, NUCLEOTIDE).alias("s"))
    return s.select("p_partkey", "s.text", "s.sha256", "s.status")


@query(r"SELECT c_custkey, nullif(trim(regexp_extract(h, '\[([^\]]+)\]\s*$', 1)), '') AS suffix FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || ' [' || c_mktsegment || '] ' ELSE c_name END AS h FROM customer)")
def bracketed_suffix(t: Tables) -> DataFrame:
    header = F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit(" ["), "c_mktsegment", F.lit("] "))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", T.bracketed_suffix(header).alias("suffix"))


@query(r"SELECT p_partkey, x <> '' AND x NOT IN ('promobrushedtin') AND regexp_matches(x, '(?:brushed|plated)(?:tin|steel)') AS other FROM (SELECT p_partkey, regexp_replace(lower(p_type), '[\s_-]+', '', 'g') AS x FROM part)")
def other_class(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.other_class(F.col("p_type"), ["promobrushedtin"], "(?:brushed|plated)(?:tin|steel)").alias("other"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL AND length(text) >= 20 AND NOT contains(text, chr(10) || chr(10)) AND NOT contains(lower(text), 'licen')")
def eligible_rows(t: Tables) -> DataFrame:
    flags = T.reasons((F.col("text").contains("\n\n"), "blank_line"), (F.lower("text").contains("licen"), "licence"))
    rows = t.documents.select("doc_id", "lang", F.when(F.length("text") >= 20, "pass").otherwise("invalid").alias("status"), flags.alias("flags"))
    return validate.eligible(rows, "status", "flags", lang="en").select("doc_id")


@query("SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 15000")
def coverage_filter(t: Tables) -> DataFrame:
    return validate.covered(t.lineitem, ["l_suppkey"], F.col("l_quantity"), 15000)


@query(f"""WITH {SCORES} SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 7 = 0 THEN 'name:empty' END, CASE WHEN p_partkey % 5 = 0 THEN 'level:unknown' END, CASE WHEN a > b THEN 'interval:outside' END, CASE WHEN v > 0.85 THEN 'v:outside' END) AS reasons
FROM (SELECT p_partkey, a, b, CASE WHEN v > 0.85 THEN v + 1 ELSE v END AS v FROM p)""")
def scored_row_rules(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = part_scores(t).select("p_partkey", "a", "b", F.when(F.col("v") > 0.85, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.when(k % 7 == 0, " ").otherwise("n").alias("name"), F.when(k % 5 == 0, "E9").otherwise("E2").alias("level"))
    return validate.with_reasons(rows, validate.scored_rules("name", "level", "a", "b", ["v"])).select("p_partkey", F.array_join("reasons", ";").alias("reasons"))


@query("SELECT count(*) FILTER (coalesce(p_brand, p_name) = 'Brand#11' AND parity IS NOT DISTINCT FROM 0) AS same, count(*) AS n FROM (SELECT p_partkey % 2 AS parity, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS p_brand FROM part)")
def lineage_match(t: Tables) -> DataFrame:
    rows = t.part.select((F.col("p_partkey") % 2).alias("parity"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("p_brand"))
    return rows.agg(F.count_if(validate.compatible({"p_brand": "Brand#11", "parity": 0}, {"p_brand": "p_name"})).alias("same"), F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN '' ELSE sha256(upper(regexp_replace(text, '\\s+', '', 'g'))) END AS sha, source AS category, doc_id % 11 = 0 AS foreign_key, text FROM documents WHERE text IS NOT NULL AND lang = 'en')
SELECT CASE WHEN foreign_key THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN foreign_key THEN 'unknown_key' WHEN sha <> '' AND sha <> sha256(upper(regexp_replace(text, '\\s+', '', 'g'))) THEN 'hash_mismatch' WHEN coalesce(upper(category) NOT IN ('SRC1', 'SRC2'), true) THEN 'out_of_scope' ELSE 'accepted' END AS status FROM e""".replace("\\\\s", "\\s"))
def verified_evidence(t: Tables) -> DataFrame:
    d = t.documents.where("text IS NOT NULL AND lang = 'en'")
    sha = F.when(F.col("doc_id") % 5 == 0, "none").when(F.col("doc_id") % 7 == 0, "").otherwise(F.sha2(F.upper(F.regexp_replace("text", r"\s+", "")), 256))
    rows = d.select(F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), sha.alias("sha"), F.col("source").alias("category"))
    return validate.verified_evidence(rows, d.select("doc_id", "text"), "doc_id", "text", "sha", "category", ["SRC1", "SRC2"]).select("doc_id", "status")


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS places, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'N') AS n_N, count(*) FILTER (l_returnflag = 'R') AS n_R FROM lineitem GROUP BY 1")
def position_counts(t: Tables) -> DataFrame:
    return aggregate.positions(t.lineitem, "l_suppkey", "l_partkey", "l_returnflag", ["A", "N", "R"])


@query("SELECT coalesce(source, '') AS value, count(*) AS n, coalesce(source, '') NOT IN ('src0', '') AS eligible FROM documents GROUP BY 1, 3")
def category_audit(t: Tables) -> DataFrame:
    column = aggregate.aliased(t.documents.columns, {"source", "src"})
    return aggregate.category_audit(t.documents, column, ["src0", ""])


IDENTITY = "list_count(list_filter(list_zip(string_split(substring(a.p_type, 1, least(length(a.p_type), length(b.p_type))), ''), string_split(substring(b.p_type, 1, least(length(a.p_type), length(b.p_type))), '')), lambda z: z[1] = z[2] AND z[1] NOT IN ('-', '.')))"


@query(f"""WITH r AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, min(length(p_type)) OVER (PARTITION BY p_brand) AS l, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
c AS (SELECT p_brand, i, x, count(*) AS c FROM (SELECT p_brand, unnest(range(l)) AS i, unnest(string_split(substring(p_type, 1, l), '')) AS x FROM r) GROUP BY 1, 2, 3),
s AS (SELECT p_brand, string_agg(x, '' ORDER BY i) AS cons FROM (SELECT p_brand, i, coalesce(arg_min(x, (-c, x)) FILTER (x NOT IN ('-', '.')), 'X') AS x FROM c GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT p_brand, count(*) FILTER (list_count(list_filter(list_zip(string_split(substring(p_type, 1, l), ''), string_split(cons, '')), lambda z: z[1] = z[2] AND z[1] NOT IN ('-', '.'))) >= 0.6 * l) AS effective FROM r JOIN s USING (p_brand) GROUP BY 1),
p AS (SELECT a.p_brand, avg({IDENTITY} / least(length(a.p_type), length(b.p_type))) AS identity FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.k < b.k AND b.k <= 100 GROUP BY 1)
SELECT DISTINCT r.p_brand, n, cons AS consensus, effective, round(coalesce(identity, 1), 9) AS identity FROM r JOIN s USING (p_brand) JOIN e USING (p_brand) LEFT JOIN p USING (p_brand)""")
def alignment(t: Tables) -> DataFrame:
    return aggregate.alignment(t.part, "p_brand", "p_partkey", "p_type", 100).withColumn("identity", F.round("identity", 9))


@query("SELECT source, round(count(DISTINCT i) / 500, 9) AS covered FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, i FROM (SELECT source, unnest(string_split(substring(text, 1, 500), '')) AS x, unnest(range(least(length(text), 500))) AS i FROM documents WHERE length(text) > 0) WHERE x NOT IN ('-', '.')) c ON c.source IS NOT DISTINCT FROM s.source WHERE source IS NOT NULL GROUP BY 1".replace("SELECT source, round", "SELECT s.source, round").replace("WHERE source IS NOT NULL GROUP", "WHERE s.source IS NOT NULL GROUP"))
def position_coverage(t: Tables) -> DataFrame:
    """The share of a query's 500 positions that the texts of a source cover: only these positions exist."""
    return aggregate.position_coverage(t.documents.where("source IS NOT NULL"), "source", "text", 500).withColumn("covered", F.round("covered", 9))


@query(f"""WITH {SCORES}, m AS (SELECT min(-b) AS lo, max(-b) AS hi FROM p) SELECT p_partkey, round(0.5 * v + 0.5 * ((-b - lo) / (hi - lo)), 9) AS composite FROM p, m""")
def composite_score(t: Tables) -> DataFrame:
    return ranking.composite(part_scores(t), "v", "b").select("p_partkey", F.round("composite", 9).alias("composite"))


@query(f"""WITH {SCORES}, c AS (SELECT a, round(b, 1) AS b, coalesce(v, 0.0) AS v, count(*) AS n, count(*) FILTER (votes >= 2) AS t, count(*) FILTER (p_partkey % 10 = 0) AS x, count(*) FILTER (p_partkey % 40 = 1) AS y FROM p GROUP BY 1, 2, 3),
g AS (SELECT ca.a AS ta, cb.b AS tb, cc.v AS tv FROM (SELECT DISTINCT a FROM c) ca, (SELECT DISTINCT b FROM c) cb, (SELECT DISTINCT v FROM c) cc),
r AS (SELECT ta, tb, tv, sum(n)::BIGINT AS n, sum(t) / greatest((SELECT sum(t) FROM c), 1) AS recall, sum(x) / sum(n) AS ra, sum(y) / sum(n) AS rb FROM g JOIN c ON c.a >= ta AND c.b < tb AND c.v < tv GROUP BY 1, 2, 3)
SELECT ta AS cut_high, tb AS cut_a, tv AS cut_b, n, round(recall, 9) AS recall, round(ra, 9) AS rate_a, round(rb, 9) AS rate_b FROM r WHERE recall >= 0.3 AND ra <= 0.1 AND rb <= 0.03 ORDER BY recall DESC, n, ra, ta DESC, tb, tv LIMIT 1""")
def choose_thresholds(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = part_scores(t).select("a", F.round("b", 1).alias("b"), F.coalesce("v", F.lit(0.0)).alias("v"), (F.col("votes") >= 2).alias("t"), (k % 10 == 0).alias("x"), (k % 40 == 1).alias("y"))
    best = thresholds.choose_thresholds(rows, "a", "b", "v", "t", "x", "y", 0.3, 0.1, 0.03)
    return best.withColumns({c: F.round(c, 9) for c in ("recall", "rate_a", "rate_b")})


NEAR = "n AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 2 FROM part)"


@query(f"""WITH {SCORES}, {NEAR}, w AS (SELECT p_partkey AS k, a, b, coalesce(v, 0.0) AS v FROM p), s AS (SELECT k, a AS g, 1 - v AS safe FROM (FROM w ORDER BY a * b * (1 - v) DESC, k LIMIT 60) WHERE NOT v > 0.5),
c AS (SELECT [k] AS m, 1 - (1 - g) AS gain, safe FROM s UNION ALL SELECT [x.k, y.k], 1 - (1 - x.g) * (1 - y.g), least(x.safe, y.safe) FROM s x JOIN s y ON x.k < y.k
  UNION ALL SELECT [x.k, y.k, z.k], 1 - (1 - x.g) * (1 - y.g) * (1 - z.g), least(x.safe, y.safe, z.safe) FROM s x JOIN s y ON x.k < y.k JOIN s z ON y.k < z.k),
o AS (SELECT DISTINCT k, o FROM (SELECT k, k AS o FROM s UNION ALL SELECT src, dst FROM n JOIN s ON k = src UNION ALL SELECT dst, src FROM n JOIN s ON k = dst)),
l AS (SELECT m, sum(b) AS lost FROM (SELECT DISTINCT m, o FROM (SELECT m, unnest(m) AS k FROM c) JOIN o USING (k)) JOIN w ON w.k = o GROUP BY 1)
SELECT array_to_string(m, ',') AS members, round(gain, 9) AS gain, round(((SELECT sum(b) FROM w) - lost) / (SELECT sum(b) FROM w), 9) AS retained, round(safe, 9) AS safe FROM c JOIN l USING (m)""")
def combination_scores(t: Tables) -> DataFrame:
    rows = part_scores(t).withColumn("veto", F.coalesce("v", F.lit(0.0))).withColumn("safe", 1 - F.col("veto"))
    k = F.col("p_partkey")
    edges = t.part.select(k.alias("src"), (k + 1).alias("dst")).unionByName(t.part.select(k.alias("src"), (k * 2).alias("dst")))
    c = ranking.combination_scores(rows, edges, "p_partkey", "a", "b", "safe", "b", "veto", 0.5)
    return c.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), *[F.round(x, 9).alias(x) for x in ("gain", "retained", "safe")])


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, 3 + vec_id % 6 AS n FROM embeddings), x AS (SELECT vec_id, n, k, sum(CASE WHEN q < n THEN e[8 * q + k + 1] ELSE 0 END) / n AS s FROM e, (SELECT range AS q FROM range(8)), (SELECT range AS k FROM range(8)) GROUP BY 1, 2, 3),
m AS (SELECT vec_id, min(s) AS lo, max(s) AS hi FROM x WHERE k < n GROUP BY 1)
SELECT vec_id, k::INTEGER AS position, round(CASE WHEN k < n AND hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM x JOIN m USING (vec_id)""")
def attention_positions(t: Tables) -> DataFrame:
    """A vector of 64 stands for one head of 8 queries and 8 keys; the first 3 to 8 positions are valid."""
    eight = F.sequence(F.lit(0), F.lit(7))
    head = F.transform(eight, lambda q: F.slice(F.col("embedding"), q * 8 + 1, F.lit(8)))
    valid = F.transform(eight, lambda q: q < 3 + F.col("vec_id") % 6)
    return t.embeddings.select("vec_id", F.posexplode(ranking.position_scores(F.array(head), valid)).alias("position", "score")).withColumn("score", F.round("score", 6))


CLASSES = """r AS (SELECT o_orderkey AS id, o_orderpriority AS class, o_totalprice / 100000 AS s FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY s DESC, id) AS rank, s >= CASE class WHEN '1-URGENT' THEN 2.5 ELSE 3.5 END AS call FROM r)"""
CUTOFFS = {"1-URGENT": 2.5, "2-HIGH": 3.5, "3-MEDIUM": 3.5, "4-NOT SPECIFIED": 3.5, "5-LOW": 3.5}


def ranked_orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"), (F.col("o_totalprice") / 100000).alias("s"))
    known = rows.where(F.col("id") % 13 == 0).select("id", "class")
    return ranking.class_ranking(rows, list(CUTOFFS), "id", "s", CUTOFFS, known), known


@query(f"WITH {CLASSES} SELECT id, class, rank, call, CASE WHEN id % 13 = 0 AND call THEN 'known_above' WHEN id % 13 = 0 THEN 'known_below' WHEN call THEN 'candidate' ELSE 'below' END AS status FROM k")
def class_ranking(t: Tables) -> DataFrame:
    return ranked_orders(t)[0].select("id", "class", "rank", "call", "status")


@query(f"WITH {CLASSES}, n AS (SELECT class, count(*) AS known, count(*) FILTER (call) AS found FROM k WHERE id % 13 = 0 GROUP BY 1) SELECT class, known, known AS scored, found, round(found / known, 9) AS recall FROM n UNION ALL SELECT '6-NONE', 0, 0, 0, NULL")
def class_recall(t: Tables) -> DataFrame:
    """The share of each class's known orders at or above the class's cutoff; one class has none."""
    ranked, known = ranked_orders(t)
    return ranking.recall_at_cutoff(ranked, known, [*CUTOFFS, "6-NONE"], "id").withColumn("recall", F.round("recall", 9))


@query("SELECT c_nationkey, c_custkey, k AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, coalesce(CASE WHEN c_custkey % 5 > 0 THEN 2000 + c_custkey % 20 END, 0) DESC, c_custkey) AS k FROM customer WHERE floor(c_acctbal / 1000) >= 2) WHERE k <= 12")
def screened_quota(t: Tables) -> DataFrame:
    rows = t.customer.select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("s"), F.when(F.col("c_custkey") % 5 > 0, 2000 + F.col("c_custkey") % 20).alias("y"))
    return ranking.screened(rows, ["c_nationkey"], "s", "y", "c_custkey", 2, 12).select("c_nationkey", "c_custkey", "rank")


STRATA = f"""{LABELS}, n AS (SELECT *, row_number() OVER (PARTITION BY task, level ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY task, level) AS t FROM l),
r AS (SELECT doc_id, task, level, CASE WHEN k <= floor(t * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(t * 0.7::DOUBLE) + floor(t * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM n)"""


@query(f"WITH {STRATA} SELECT doc_id, task, level, split FROM r")
def stratified_row_split(t: Tables) -> DataFrame:
    return splits.stratified_row_split(graded_labels(t).select("doc_id", "task", "level"), "doc_id", ["task", "level"])


@query(f"WITH {STRATA} SELECT d.doc_id, CASE min(CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END) WHEN 1 THEN 'train' WHEN 2 THEN 'validation' ELSE 'test' END AS split FROM documents d JOIN r ON r.doc_id = d.doc_id GROUP BY 1")
def entity_split(t: Tables) -> DataFrame:
    rows = splits.stratified_row_split(graded_labels(t).select("doc_id", "task", "level"), "doc_id", ["task", "level"])
    return splits.entity_split(t.documents.select("doc_id"), rows, "doc_id")


RAW = "r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END AS a, user_id::VARCHAR AS b, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'n/a' ELSE '0.25' END AS label, CASE WHEN event_id % 6 = 0 THEN '1' END AS score, CASE WHEN event_id % 8 > 0 THEN 'T' || event_id % 3 END AS task FROM events)"


def raw_labels(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.events.select(
        F.when(k % 9 == 0, " ").otherwise(F.col("event_type")).alias("a"), F.col("user_id").cast("string").alias("b"), F.when(k % 4 == 1, "n/a").when(k % 4 > 1, "0.25").alias("label"),
        F.when(k % 6 == 0, "1").alias("score"), F.when(k % 8 > 0, F.concat(F.lit("T"), (k % 3).cast("string"))).alias("task"),
    )


LABEL_ROWS = f"{RAW}, x AS (SELECT coalesce(nullif(trim(a), ''), b) AS key, CASE task WHEN 'T2' THEN 'T2b' ELSE task END AS task, TRY_CAST(coalesce(nullif(trim(label), ''), nullif(trim(score), '')) AS DOUBLE) AS label FROM r WHERE task IS NOT NULL)"


@query(f"WITH {LABEL_ROWS} SELECT key, task, label, 'events' AS source, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY 1, 2, 3")
def label_rows(t: Tables) -> DataFrame:
    rows = evidence.label_rows(raw_labels(t), ["a", "b"], ["label", "score"], "events", renamed={"T2": "T2b"})
    return rows.groupBy("key", "task", "label", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT doc_id AS key, 'quality' AS task, quality::DOUBLE AS label, 'reviewed' AS source, 'agreed' AS origin FROM labels WHERE quality = toxic UNION ALL SELECT doc_id, 'quality', quality, 'reviewed', 'single' FROM labels WHERE quality <> toxic UNION ALL SELECT doc_id, 'toxic', toxic, 'screening', 'screen' FROM labels
UNION ALL SELECT doc_id, 'quality', 0.5, 'prediction', 'zero_shot' FROM documents WHERE doc_id % 3 = 0) SELECT *, CASE WHEN source = 'prediction' THEN 'E3' WHEN origin = 'agreed' THEN 'E2' ELSE 'E4' END AS level FROM u""")
def label_union(t: Tables) -> DataFrame:
    part = lambda df, task, label, source: df.select(F.col("doc_id").alias("key"), F.lit(task).alias("task"), label.cast("double").alias("label"), F.lit(source).alias("source"))
    sources = {
        "agreed": part(t.labels.where("quality = toxic"), "quality", F.col("quality"), "reviewed"), "single": part(t.labels.where("quality <> toxic"), "quality", F.col("quality"), "reviewed"),
        "screen": part(t.labels, "toxic", F.col("toxic"), "screening"), "zero_shot": part(t.documents.where("doc_id % 3 = 0"), "quality", F.lit(0.5), "prediction"),
    }
    return evidence.union_sources(sources, evidence.grade(F.col("origin") == "agreed", F.col("source"), F.col("source"), F.lit(None).cast("string"), F.lit(False), ["review"], ["prediction"]))


@query(f"WITH {LABELS}, g AS (SELECT doc_id, count(DISTINCT label) AS n, min(label) AS label FROM l WHERE task = 'quality' AND level IN ('E1', 'E2') GROUP BY 1) SELECT d.doc_id, CASE WHEN n = 1 THEN label END AS label, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'found' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON g.doc_id = d.doc_id")
def gold_lookup(t: Tables) -> DataFrame:
    return evidence.gold_lookup(t.documents.select("doc_id").distinct(), graded_labels(t), "doc_id", "quality")


@query("""SELECT *, sha256('{"lang":"' || lang || '","n":' || n || ',"sources":' || sources || '}') AS report_sha256 FROM (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE lang IS NOT NULL GROUP BY 1)""")
def study_report(t: Tables) -> DataFrame:
    return evidence.study_report(t.documents.where("lang IS NOT NULL"), "lang", n=F.count(F.lit(1)), sources=F.countDistinct("source"))


KINDS = "k AS (SELECT src, dst, CASE kind WHEN 'coex' THEN 'same' ELSE kind END AS kind, kind AS raw, CASE WHEN o % 10 = 0 THEN NULL ELSE (o % 21 - 10) / 10 END AS c FROM (SELECT o_custkey AS src, o_custkey + 7 * (o_orderkey % 5) AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'near' WHEN 1 THEN 'same' WHEN 2 THEN 'coex' ELSE 'odd' END AS kind, o_orderkey AS o FROM orders))"


@query(f"""WITH {KINDS}, c AS (SELECT k.*, coalesce(c, 1.0) AS conf, a.c_mktsegment AS sa, b.c_mktsegment AS sb FROM k LEFT JOIN customer a ON a.c_custkey = src LEFT JOIN customer b ON b.c_custkey = dst),
w AS (SELECT *, CASE WHEN kind = 'same' THEN abs(conf) ELSE conf END AS size FROM c),
d AS (SELECT src, dst, kind, CASE WHEN kind = 'same' THEN conf * conf ELSE conf END AS weight, CASE WHEN kind = 'odd' THEN 'unknown_kind' WHEN src = dst THEN 'self' WHEN sa IS NULL OR sb IS NULL THEN 'missing_split' WHEN sa <> sb THEN 'cross_split' WHEN size < 0 OR size > 1 THEN 'invalid_confidence'
  WHEN size < CASE WHEN raw = 'coex' THEN 0.5 WHEN kind = 'same' THEN 0.8 ELSE 0.3 END THEN 'below_threshold' END AS reason FROM w)
SELECT coalesce(reason, 'kept') AS reason, kind, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT * FROM d UNION ALL SELECT dst, src, kind, weight, reason FROM d WHERE reason IS NULL) GROUP BY 1, 2""")
def edge_build(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    edges = t.orders.select(
        F.col("o_custkey").alias("src"), (F.col("o_custkey") + 7 * (o % 5)).alias("dst"), F.when(o % 4 == 0, "near").when(o % 4 == 1, "same").when(o % 4 == 2, "coex").otherwise("odd").alias("kind"), F.when(o % 10 != 0, (o % 21 - 10) / 10).alias("confidence"),
    )
    built = graph.build_edges(edges, t.customer, "c_custkey", "c_mktsegment", {"coex": "same"}, {"near": 0.3, "same": 0.8}, ["same"], {"coex": 0.5})
    return built.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query(f"""WITH o AS (SELECT vec_id AS src, lead(vec_id) OVER w AS dst, CASE WHEN label % 3 = lead(label % 3) OVER w THEN 1.0 WHEN label % 2 = lead(label % 2) OVER w AND lead(vec_id) OVER w - vec_id - 1 <= 12 THEN 0.8 END AS weight FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
v AS (SELECT *, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {COSINE} AS weight FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
u AS (SELECT src, dst, 'next' AS kind, weight, 0 AS k FROM o WHERE dst IS NOT NULL AND weight IS NOT NULL UNION ALL SELECT src, dst, 'alike', weight, 1 FROM s WHERE weight >= 0.3 UNION ALL SELECT vec_id, vec_id + 1, 'next', 0.9, 2 FROM embeddings WHERE vec_id % 50 = 0)
SELECT src, dst, kind, round(arg_max(weight, (k, weight)), 6) AS weight FROM (SELECT * FROM u UNION ALL SELECT dst, src, kind, weight, k FROM u) WHERE src <> dst GROUP BY 1, 2, 3""")
def attribute_graph(t: Tables) -> DataFrame:
    """Neighbours in order, similar vectors of a label, and given pairs, which count last."""
    e = t.embeddings
    rows = e.select("vec_id", "label", F.col("vec_id").alias("stop"), (F.col("label") % 2).alias("side"), (F.col("label") % 3).alias("unit"))
    near = graph.neighbour_edges(rows, ["label"], "vec_id", "vec_id", "stop", "side", "unit", 12).withColumn("kind", F.lit("next"))
    alike = similar_vectors(e, 0.3).select("src", "dst", F.lit("alike").alias("kind"), F.col("cosine").alias("weight"))
    given = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.lit("next").alias("kind"), F.lit(0.9).alias("weight"))
    return graph.attribute_edges(near, alike, given).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {EDGES}, p AS (SELECT src, dst, kind FROM e WHERE src <> dst), b AS (SELECT DISTINCT * FROM (SELECT * FROM p UNION ALL SELECT dst, src, kind FROM p)), v AS (SELECT c_custkey AS k, c_acctbal / 10000 AS x FROM customer),
m AS (SELECT v.k, (x + coalesce((SELECT sum(w.x) FROM (SELECT DISTINCT dst FROM b WHERE src = v.k AND kind = 'near') d JOIN v w ON w.k = d.dst), 0)) / (1 + (SELECT count(*) FROM (SELECT DISTINCT dst FROM b WHERE src = v.k AND kind = 'near') d JOIN v w ON w.k = d.dst)) AS a,
  (x + coalesce((SELECT sum(w.x) FROM (SELECT DISTINCT dst FROM b WHERE src = v.k AND kind = 'same') d JOIN v w ON w.k = d.dst), 0)) / (1 + (SELECT count(*) FROM (SELECT DISTINCT dst FROM b WHERE src = v.k AND kind = 'same') d JOIN v w ON w.k = d.dst)) AS z FROM v)
SELECT k AS c_custkey, round(exp(-2.0 * CASE WHEN k % 10 = 0 THEN 0.25 ELSE 0 END) * a * z, 6) AS retention FROM m""")
def retention(t: Tables) -> DataFrame:
    edges = customer_edges(t).where("src <> dst")
    values = t.customer.select("c_custkey", (F.col("c_acctbal") / 10000).alias("x"))
    central = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("node"), F.lit(0.25).alias("betweenness"))
    out = graph.retention(values, "c_custkey", "x", edges.where("kind = 'near'"), edges.where("kind = 'same'"), central, 2.0)
    return out.withColumn("retention", F.round("retention", 6))


@query("""SELECT page_id, CASE WHEN NOT starts_with(url, 'http') THEN 'no page' WHEN regexp_matches(url, '[02468]$') THEN 'even' WHEN length(html) > 2000 THEN 'large' END AS reason FROM pages""")
def packaging_reasons(t: Tables) -> DataFrame:
    rules = [(~F.col("url").startswith("http"), "no page"), (F.col("url").rlike("[02468]$"), "even"), (F.length("html") > 2000, "large")]
    return sinks.packaged(t.pages, rules).select("page_id", "reason")


@query("""SELECT url AS path, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS project, nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS accession, 'crawl' AS assay, 0.5::DOUBLE AS label FROM pages""")
def path_records(t: Tables) -> DataFrame:
    return readers.path_records(t.pages.select(F.col("url").alias("path")), {"project": "^https?://([^/]+)", "accession": "([0-9]+)[^0-9]*$"}, {"assay": "crawl", "label": 0.5})


@query("""SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS name FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) <> ''""")
def names_in_paths(t: Tables) -> DataFrame:
    return readers.names_in_paths(t.pages.select(F.col("url").alias("path")), "^https?://([^/]+)")


@query("""SELECT vec_id, embedding[1]::DOUBLE AS first, 'v1' AS model_version, 'b7' AS batch_id FROM embeddings""")
def validated_features(t: Tables) -> DataFrame:
    rules = [(F.col("embedding").isNull() | (F.size("embedding") != 64), "feature:shape")]
    rows = validate.with_lineage(t.embeddings, rules, {"model_version": "v1", "batch_id": "b7"})
    return rows.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), "model_version", "batch_id")


@query()
def quality_decisions(t: Tables) -> DataFrame:
    """Documents' scores by a classifier of their 2- to 4-letter runs, fitted to the labels; without SQL, as it is fitted in rounds."""
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality")
    texts = grams.packed_texts(t.documents, "doc_id", F.col("text"))
    kept = grams.frequent_grams(texts, 2, 4, most_terms=150_000)
    counted = grams.labelled_counts(texts, kept, rows, "doc_id", "quality")
    fitted = linear.fit_counts(counted, kept.idf, rounds=15, tolerance=1e-6)
    return grams.gram_scores(texts, kept, rows, "doc_id", fitted)


@query("""WITH g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substring(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)), list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4)))) AS term FROM benchmark JOIN (SELECT item_id AS doc_id FROM benchmark) ON doc_id = item_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 500),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
SELECT doc_id AS item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def frequent_term_weights(t: Tables) -> DataFrame:
    """The benchmark's passages by the 500 most frequent of their 2- to 4-letter runs."""
    w = textmine.tfidf(t.benchmark, "item_id", textmine.char_ngrams(F.col("text"), 2, 4), most_terms=500)
    return w.withColumn("weight", F.round("weight", 6))


@query("""WITH e AS (SELECT o_custkey AS src, o_custkey + 7 * (o_orderkey % 5) AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'near' WHEN 1 THEN 'same' WHEN 2 THEN 'same' ELSE 'odd' END AS kind, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 21 - 10) / 10 ELSE 1.0 END AS c, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'E' || (1 + o_orderkey % 5) ELSE ' ' END AS level, o_orderpriority AS source FROM orders),
j AS (SELECT e.*, coalesce(nullif(trim(level), ''), CASE kind WHEN 'near' THEN 'E3' ELSE 'E2' END) AS grade, CASE WHEN kind = 'odd' THEN 'unknown_kind' WHEN src = dst THEN 'self' WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 'missing_split' WHEN a.c_mktsegment <> b.c_mktsegment THEN 'cross_split'
  WHEN c < 0 OR c > 1 THEN 'invalid_confidence' WHEN c < CASE kind WHEN 'near' THEN 0.3 ELSE 0.0 END THEN 'below_threshold' WHEN kind = 'same' THEN 'outside_track' END AS reason FROM e LEFT JOIN customer a ON a.c_custkey = src LEFT JOIN customer b ON b.c_custkey = dst),
g AS (SELECT *, coalesce(reason, CASE WHEN grade NOT IN ('E1', 'E2', 'E3', 'E4') THEN 'unknown_level' END) AS why FROM j)
SELECT coalesce(why, 'kept') AS reason, kind, grade AS level, source, CASE WHEN why IS NULL THEN 2 ELSE 1 END * count(*) AS n FROM g GROUP BY why, kind, grade, source""")
def tracked_edges(t: Tables) -> DataFrame:
    """Edges between customers in the track that admits one kind alone, with the grades of their evidence."""
    o = F.col("o_orderkey")
    level = F.when(o % 3 == 1, F.concat(F.lit("E"), (1 + o % 5).cast("string"))).when(o % 3 == 2, " ")
    edges = t.orders.select(
        F.col("o_custkey").alias("src"), (F.col("o_custkey") + 7 * (o % 5)).alias("dst"), F.when(o % 4 == 0, "near").when(o % 4 == 1, "same").when(o % 4 == 2, "coex").otherwise("odd").alias("kind"),
        F.when(o % 10 != 0, (o % 21 - 10) / 10).alias("confidence"), level.alias("level"), F.col("o_orderpriority").alias("source"),
    )
    built = graph.tracked_edges(edges, t.customer, "c_custkey", "c_mktsegment", {"coex": "same"}, {"near": 0.3, "same": 0.0}, "first", {"first": ["near"], "second": ["near", "same"]}, {"near": "E3"})
    return built.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "kind", "level", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, arg_min(doc_id, doc_id) AS representative, count(DISTINCT source) AS files FROM documents GROUP BY 1")
def occurrences_in_sources(t: Tables) -> DataFrame:
    """Each text's rows, its first row, and in how many sources it stands."""
    return dedup.first_occurrence_counts(t.documents, F.col("text"), "doc_id", ["doc_id"], "source")


@query("SELECT p.part, count(x.p_name) AS rows, count(DISTINCT lower(trim(x.p_name))) AS names, p.quota, count(DISTINCT lower(trim(x.p_name))) >= p.quota AS met FROM (VALUES ('Brand#11', 5), ('Brand#22', 100000), ('none', 1)) p(part, quota) LEFT JOIN part x ON x.p_brand = p.part GROUP BY p.part, p.quota")
def catalogue_quotas(t: Tables) -> DataFrame:
    return dedup.catalogue(t.part, "p_name", "p_brand", {"Brand#11": 5, "Brand#22": 100000, "none": 1})
