"""Queries over documents, pages, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregate, dedup, evidence, grams, splits, textmine, validate
from lodestone.sources import readers

from .catalogue import Tables, query

ALLOWED, UNSURE = "ABCDEFGHIKLMNOPRSTUVWY", "JQXZ"
CLEAN = "regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '\\*$', '')"


@query(f"""
WITH a AS (SELECT doc_id, {CLEAN} AS u FROM documents),
b AS (SELECT *, replace(u, '-', '') AS g, regexp_replace(replace(u, '-', ''), '[^A-Z]', '', 'g') AS c FROM a),
d AS (SELECT *, list_sort(list_distinct(regexp_extract_all(g, '[^A-Z]'))) AS inv, list_sort(list_distinct(regexp_extract_all(g, '[JQXZ]'))) AS amb FROM b)
SELECT doc_id, length(c)::BIGINT AS length, CASE WHEN c <> '' THEN sha256(c) END AS sha256, (length(u) - length(g))::BIGINT AS gaps,
  array_to_string(inv, '|') AS invalid, array_to_string(amb, '|') AS ambiguous,
  CASE WHEN len(inv) > 0 OR c = '' OR length(c) > 100000 THEN 'invalid' WHEN length(c) < 20 OR len(amb) > 0 OR length(u) <> length(g) THEN 'review' ELSE 'pass' END AS status,
  array_to_string(list_filter([CASE WHEN len(inv) > 0 THEN 'letters:foreign' END, CASE WHEN len(amb) > 0 THEN 'letters:ambiguous' END, CASE WHEN length(u) <> length(g) THEN 'letters:gaps' END,
    CASE WHEN c = '' THEN 'length:none' END, CASE WHEN length(c) < 20 THEN 'length:below_20' END, CASE WHEN length(c) > 100000 THEN 'length:above_100000' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM d""")
def normalize_text(t: Tables) -> DataFrame:
    n = t.documents.select("doc_id", T.normalise(F.col("text"), ALLOWED, UNSURE).alias("n"))
    joined = lambda c: F.array_join(F.col(f"n.{c}"), "|").alias(c)
    return n.select("doc_id", "n.length", "n.sha256", "n.gaps", joined("invalid"), joined("ambiguous"), "n.status", joined("reasons"))


@query("""SELECT p_partkey, length(c)::BIGINT AS length, CASE WHEN c = '' THEN 'invalid' WHEN length(c) BETWEEN 8 AND 30 THEN 'pass' ELSE 'review' END AS status,
  concat_ws('|', CASE WHEN c = '' THEN 'length:none' END, CASE WHEN NOT length(c) BETWEEN 8 AND 30 THEN 'length:outside_8_30' END) AS reasons FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS c FROM part)""")
def normalize_short(t: Tables) -> DataFrame:
    """Short texts against the range of lengths that is usual for their role."""
    n = t.part.select("p_partkey", T.normalise(F.regexp_replace("p_name", "[^A-Za-z]", ""), ALLOWED + UNSURE, usual=(8, 30)).alias("n"))
    return n.select("p_partkey", "n.length", "n.status", F.array_join("n.reasons", "|").alias("reasons"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(t: Tables) -> DataFrame:
    return dedup.duplicate_groups(t.documents, F.col("text"), "doc_id")


@query("""SELECT sum(n)::BIGINT AS rows, count(s) AS "unique", sum(n - 1)::BIGINT AS excess, count(*) FILTER (n > 1) AS groups FROM (SELECT sha256(text) AS s, count(*) AS n FROM documents GROUP BY 1)""")
def duplicate_stats(t: Tables) -> DataFrame:
    return dedup.duplicate_stats(t.documents, F.col("text"))


@query("SELECT source, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS excess FROM (SELECT source, sha256(text) AS s, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def file_local_duplicates(t: Tables) -> DataFrame:
    return dedup.file_local_duplicates(t.documents, "source", F.col("text"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, arg_min(doc_id, (source, doc_id)) AS representative FROM documents GROUP BY 1")
def first_occurrence_counts(t: Tables) -> DataFrame:
    return dedup.first_occurrence_counts(t.documents, F.col("text"), "doc_id", ["source", "doc_id"])


@query("""
WITH k AS (SELECT sha256(text) AS s, count(DISTINCT source) AS n, min(source) AS name FROM documents WHERE lang = 'en' AND text IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN k.n = 1 THEN k.name END AS recovered,
  CASE WHEN d.text IS NULL THEN 'not_applicable' WHEN k.n IS NULL THEN 'no_match' WHEN k.n > 1 THEN 'ambiguous' ELSE 'recovered' END AS status
FROM documents d LEFT JOIN k ON sha256(d.text) = k.s""")
def alias_recovery(t: Tables) -> DataFrame:
    d = t.documents
    known = d.where("lang = 'en'").select("text", F.col("source").alias("name"))
    return dedup.recover_names(d.select("doc_id", "text"), known, "text", "name").select("doc_id", "recovered", "status")


@query("""SELECT field, count(*) FILTER (v IS NULL OR trim(v) = '') AS missing FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field, unnest([doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR]) AS v FROM documents) GROUP BY 1""")
def missing_by_field(t: Tables) -> DataFrame:
    return aggregate.missing_by_field(t.documents, ["doc_id", "text", "lang", "source", "n_chars"])


@query("""SELECT page_id, coalesce('path:' || nullif(lower(trim(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1))), ''), 'url:' || lower(trim(url))) AS key,
  trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM pages""")
def url_identity_key(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", T.identity_key(("path", path), ("url", F.col("url"))).alias("key"), T.title_key(F.col("url")).alias("title_key"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS text_sha256,
  length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')))::BIGINT AS n_chars FROM pages""")
def strip_markup(t: Tables) -> DataFrame:
    clean = T.strip_markup(F.col("html"))
    return t.pages.select("page_id", F.sha2(clean, 256).alias("text_sha256"), F.length(clean).cast("long").alias("n_chars"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>')) ::BIGINT AS headings,
  len(list_filter(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: contains(lower(h), 'a') OR contains(lower(h), 'e')))::BIGINT AS kept FROM pages""")
def section_filter(t: Tables) -> DataFrame:
    every = F.regexp_count("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>")).cast("long")
    return t.pages.select("page_id", every.alias("headings"), F.size(textmine.sections(F.col("html"), ["a", "e"])).cast("long").alias("kept"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '\[[^\]]*\]\([^)\s]*\)'))::BIGINT AS links, len(regexp_extract_all(html, 'href="([^"]*)"'))::BIGINT AS hrefs FROM pages""")
def link_rows(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(readers.link_rows(F.col("html"))).cast("long").alias("links"), F.regexp_count("html", F.lit('href="([^"]*)"')).cast("long").alias("hrefs"))


def _n(word: str) -> str:
    return f"((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{word}', ''))) // {len(word)})"


@query(f"SELECT doc_id, ({_n('license')} + {_n('the')} - 3 * {_n('und')})::INTEGER AS score FROM documents")
def topic_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.topic_score(F.col("text"), ["license", "the"], ["und"]).cast("int").alias("score"))


@query("""
WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 448)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, start::INTEGER AS start, least(start + 512, n)::INTEGER AS stop, md5(substring(text, (start + 1)::BIGINT, 512)) AS piece_md5 FROM w WHERE start = 0 OR start - 448 + 512 < n""")
def text_windows(t: Tables) -> DataFrame:
    return T.text_windows(t.documents, "text", 512, 64).select("doc_id", "start", "stop", F.md5("piece").alias("piece_md5"))


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM documents""")
def multi_value_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.split_values(F.col("text"))).cast("long").alias("n"))


@query("""SELECT doc_id, sha256(substring(regexp_replace(text, '[^a-z ]', 'X', 'g'), 1, 200)) AS text_sha256, len(regexp_extract_all(text, '[^a-z ]'))::BIGINT AS replaced FROM documents""")
def replace_outside(t: Tables) -> DataFrame:
    r = T.replace_outside(F.col("text"), "a-z ", "X", 200)
    return t.documents.select("doc_id", F.sha2(r["text"], 256).alias("text_sha256"), r["replaced"].alias("replaced"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' WHEN regexp_matches(text, '(?i)@[a-z]+\\.') THEN 'contact' WHEN regexp_matches(text, '(?i)der |die ') THEN 'german' ELSE 'unresolved' END AS category,
  CASE WHEN regexp_extract(lower(text), 'version ([0-9]+)', 1) <> '' THEN regexp_extract(lower(text), 'version ([0-9]+)', 1) WHEN contains(lower(text), 'mit') THEN 'mit' WHEN contains(lower(text), 'gpl') THEN 'gpl' ELSE 'unknown' END AS keyword FROM documents""")
def first_category(t: Tables) -> DataFrame:
    rules = [("licen[sc]e", "licence"), (r"@[a-z]+\.", "contact"), ("der |die ", "german")]
    return t.documents.select("doc_id", T.first_category(F.col("text"), rules).alias("category"), T.keyword(F.col("text"), "version ([0-9]+)", ["mit", "gpl"]).alias("keyword"))


@query("""SELECT page_id, concat_ws(';', CASE WHEN trim(coalesce(url, '')) = '' THEN 'no_url' END, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'no_scheme' END, CASE WHEN regexp_matches(url, '[0-9]$') THEN 'ends_in_number' END, CASE WHEN regexp_matches(url, '//[^/]*[0-9][^/]*/') THEN 'number_in_host' END) AS flags FROM pages""")
def identifier_flags(t: Tables) -> DataFrame:
    rules = [("^(?!https?://)", "no_scheme"), ("[0-9]$", "ends_in_number"), ("//[^/]*[0-9][^/]*/", "number_in_host")]
    return t.pages.select("page_id", F.array_join(T.pattern_flags(F.col("url"), rules, "no_url"), ";").alias("flags"))


@query("""
WITH w AS (SELECT doc_id, regexp_replace(text, '[^aeiou]', '', 'g') AS r FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, length(r)), lambda i: translate(substring(r, i, 2), 'aeiou', 'AAEEU'))) AS pair FROM w WHERE length(r) > 1)
SELECT doc_id, pair, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 9) AS share FROM p GROUP BY doc_id, pair""")
def pair_composition(t: Tables) -> DataFrame:
    c = T.pair_composition(F.col("text"), {"a": "A", "e": "A", "i": "E", "o": "E", "u": "U"})
    return t.documents.select("doc_id", F.explode(c).alias("pair", "share")).select("doc_id", "pair", F.round("share", 9).alias("share"))


@query("""
WITH p AS (SELECT unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS position FROM documents WHERE length(text) > 0),
g AS (SELECT position, c, count(*) AS n FROM p GROUP BY 1, 2)
SELECT position::INTEGER AS position, sum(n)::BIGINT AS n, arg_min(c, (-n, c)) AS consensus, round(max(n) / sum(n), 9) AS share, round(coalesce(sum(n) FILTER (c = '-'), 0) / sum(n), 9) AS gaps FROM g GROUP BY 1""")
def position_profile(t: Tables) -> DataFrame:
    """Every position of every document."""
    p = textmine.position_profile(t.documents, "text")
    return p.select("position", "n", "consensus", F.round("share", 9).alias("share"), F.round("gaps", 9).alias("gaps"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM bw WHERE len(w) >= 8),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n.n), 9) AS contained FROM g JOIN b USING (g) JOIN n USING (item_id) GROUP BY 1, 2""")
def kgram_containment(t: Tables) -> DataFrame:
    out = textmine.containment(t.documents, "doc_id", t.benchmark, "item_id", k=8)
    return out.withColumn("contained", F.round("contained", 9))


@query("""
WITH b AS (SELECT doc_id, lower(text) AS x FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)), list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3)), list_transform(range(1, length(x) - 2), lambda i: substring(x, i, 4)))) AS term FROM b),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS weight, round(max(w) / sqrt(sum(w * w)), 6) AS heaviest FROM r GROUP BY 1""")
def ngram_tfidf(t: Tables) -> DataFrame:
    w, _ = grams.gram_vectors(t.documents, "doc_id", F.lower("text"), 2, 4)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return w.select("doc_id", F.size("weights").cast("long").alias("terms"), F.round(total, 6).alias("weight"), F.round(F.array_max("weights"), 6).alias("heaviest"))


@query("SELECT DISTINCT source, CASE WHEN n <= greatest(floor(t * 0.7::DOUBLE), 1) THEN 'train' WHEN n <= greatest(floor(t * 0.7::DOUBLE), 1) + greatest(floor(t * 0.15::DOUBLE), 1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))")
def group_split(t: Tables) -> DataFrame:
    return splits.group_split(t.documents, "source")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2), m AS (SELECT source, arg_min(lang, (-n, f)) AS lang FROM c GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || source), source) AS k, count(*) OVER (PARTITION BY lang) AS t FROM m),
v AS (SELECT *, CASE WHEN t > 3 THEN greatest(floor(t * 0.15::DOUBLE), 1) ELSE 0 END AS b, greatest(floor(t * 0.7::DOUBLE), 1) AS a FROM k),
p AS (SELECT *, CASE WHEN k <= f THEN 'train' WHEN k <= f + b THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, CASE WHEN a + b >= t AND t > 1 THEN greatest(1, t - 1 - b) ELSE a END AS f FROM v)),
l AS (SELECT count(*) FILTER (part = 'test') AS tests, max((part = 'validation', lang, k)) AS last FROM p)
SELECT source, lang, CASE WHEN tests = 0 AND last = (part = 'validation', lang, k) THEN 'test' ELSE part END AS split FROM p, l""")
def stratified_group_split(t: Tables) -> DataFrame:
    modes = dedup.mode_first_seen(t.documents, "source", "lang", "doc_id")
    return splits.stratified_group_split(modes, "source", "lang")


@query("SELECT doc_id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substring(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS x FROM documents)")
def row_split(t: Tables) -> DataFrame:
    return splits.row_split(t.documents.select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents WHERE ('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 <= 0.25")
def hash_sample(t: Tables) -> DataFrame:
    return splits.hash_sample(t.documents.select("doc_id"), "doc_id", 0.25)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_per_group(t: Tables) -> DataFrame:
    return splits.sample_n(t.documents.select("source", "doc_id"), "doc_id", 5, 7, ["source"])


@query("""
WITH RECURSIVE k AS (SELECT DISTINCT doc_id AS g, sha256(text) AS s FROM documents WHERE doc_id IS NOT NULL), l AS (SELECT s, min(g) AS lead FROM k GROUP BY 1),
c AS (SELECT g, min(lead) AS component FROM k JOIN l USING (s) GROUP BY 1), u AS (SELECT DISTINCT component FROM c),
n AS (SELECT component, row_number() OVER (ORDER BY sha256('42:' || s), component) AS n, count(*) OVER () AS t FROM u JOIN (SELECT g, min(s) AS s FROM k GROUP BY 1) ON g = component),
x AS (SELECT *, greatest(1, least(floor(t * 0.7::DOUBLE), t - 2)) AS a FROM n), y AS (SELECT *, greatest(a + 1, least(floor(t * 0.85::DOUBLE), t - 1)) AS b FROM x)
SELECT g AS doc_id, component, CASE WHEN n <= a THEN 'train' WHEN n <= b THEN 'validation' ELSE 'test' END AS split FROM c JOIN y USING (component)""")
def component_split(t: Tables) -> DataFrame:
    """Documents that share a text stay together (each has one text here, so components are the groups of copies)."""
    return splits.component_split(t.documents, "doc_id", "text")


@query("""
WITH d AS (SELECT sha256(text) AS key, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT text, ('0x' || substring(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS x FROM documents))
SELECT key, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage(t: Tables) -> DataFrame:
    return splits.leaks(splits.row_split(t.documents, "doc_id").select(F.sha2("text", 256).alias("key"), "split"), "key", "split")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def full_outer_coverage(t: Tables) -> DataFrame:
    return validate.coverage(t.documents, t.labels, "doc_id")


LABELS = """l AS (SELECT d.doc_id, sha256(d.text) AS sha, x.task, x.label,
  CASE WHEN d.source IN ('src1', 'src2') AND contains(lower(d.lang), 'e') THEN 'E2' WHEN contains(lower(d.lang), 'e') AND d.n_chars > 1000 AND d.n_chars % 2 = 0 THEN 'E1' WHEN contains(lower(d.source || ' ' || d.lang), 'src3') THEN 'E3' ELSE 'E4' END AS level
  FROM documents d JOIN (SELECT doc_id, 'quality' AS task, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) x ON x.doc_id = d.doc_id)"""


def graded_labels(t: Tables) -> DataFrame:
    """Label rows of the two tasks with evidence levels; columns of documents stand in for provenance."""
    rows = t.labels.unpivot(["doc_id"], ["quality", "toxic"], "task", "label").join(t.documents, "doc_id")
    level = evidence.grade(F.col("source").isin("src1", "src2"), F.col("lang"), F.col("source"), F.when(F.col("n_chars") > 1000, "ref"), F.col("n_chars") % 2 == 0, ["e"], ["src3"])
    return rows.select("doc_id", F.sha2("text", 256).alias("sha"), "task", "label", level.alias("level"))


@query(f"WITH {LABELS} SELECT doc_id, task, label, level, CASE level WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.8 WHEN 'E3' THEN 0.4 ELSE 0.2 END::DOUBLE AS weight FROM l")
def evidence_grade(t: Tables) -> DataFrame:
    return graded_labels(t).select("doc_id", "task", "label", "level", evidence.level_weight(F.col("level")).alias("weight"))


ROLE = "CASE WHEN count(DISTINCT label) > 1 THEN 'quarantine_conflict' WHEN bool_or(level IN ('E1', 'E2')) THEN 'direct_supervision' ELSE 'weak_supervision_only' END"


@query(f"WITH {LABELS} SELECT sha, task, count(*) AS n, count(DISTINCT label) AS n_values, count(DISTINCT label) > 1 AS conflict, {ROLE} AS role FROM l GROUP BY 1, 2")
def label_conflicts(t: Tables) -> DataFrame:
    return evidence.resolve_labels(graded_labels(t), ["sha", "task"]).select("sha", "task", "n", "n_values", "conflict", "role")


@query(f"WITH {LABELS}, r AS (SELECT sha, task, {ROLE} AS role FROM l GROUP BY 1, 2) SELECT doc_id, l.task, label, role FROM l JOIN r ON l.sha = r.sha AND l.task = r.task")
def resolved_rows(t: Tables) -> DataFrame:
    return evidence.with_resolved(graded_labels(t), ["sha", "task"]).select("doc_id", "task", "label", "role")


@query(f"""WITH {LABELS}, r AS (SELECT sha, task, {ROLE} AS role FROM l GROUP BY 1, 2)
SELECT sha, coalesce(string_agg(task, ',' ORDER BY task) FILTER (role = 'direct_supervision'), '') AS direct, coalesce(string_agg(task, ',' ORDER BY task) FILTER (role = 'weak_supervision_only'), '') AS weak,
  coalesce(string_agg(task, ',' ORDER BY task) FILTER (role = 'quarantine_conflict'), '') AS conflicts, CASE WHEN bool_or(role = 'quarantine_conflict') THEN 'conflict' WHEN bool_or(role = 'direct_supervision') THEN 'direct' ELSE 'weak' END AS status FROM r GROUP BY 1""")
def training_manifest(t: Tables) -> DataFrame:
    m = evidence.training_manifest(graded_labels(t), "sha", "task")
    return m.select("sha", F.array_join("direct_tasks", ",").alias("direct"), F.array_join("weak_tasks", ",").alias("weak"), F.array_join("conflict_tasks", ",").alias("conflicts"), "status")


@query(f"WITH {LABELS} SELECT doc_id, min(level) AS best_level FROM l GROUP BY 1")
def best_level(t: Tables) -> DataFrame:
    return evidence.best_level(graded_labels(t), ["doc_id"])


@query(f"""WITH {LABELS} SELECT doc_id, task, concat_ws(';', CASE WHEN level NOT IN ('E1', 'E2') AND label = 1 THEN 'gold:weak_evidence' END) AS reasons FROM l""")
def contract_quarantine(t: Tables) -> DataFrame:
    rows = graded_labels(t).withColumn("weight", evidence.level_weight(F.col("level"))).withColumn("gold", F.col("label") == 1)
    return validate.with_reasons(rows, validate.label_rules()).select("doc_id", "task", F.array_join("reasons", ";").alias("reasons"))


INSPECTED = f"""{LABELS}, i AS (
  SELECT 'UNLABELED_SEQUENCES' AS issue, 'warning' AS severity, NULL AS task, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)) UNION ALL
  SELECT 'LABELS_WITHOUT_SEQUENCE', 'warning', NULL, count(*) FROM (SELECT DISTINCT doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
  SELECT 'DUPLICATE_SEQUENCE_IDS', 'error', NULL, count(*) - count(DISTINCT doc_id) FROM documents UNION ALL
  SELECT 'SMALL_TASK', 'warning', level, count(*) FROM l GROUP BY level HAVING count(*) < 200)"""


@query(f"WITH {INSPECTED} SELECT * FROM i WHERE n > 0")
def inspect_issues(t: Tables) -> DataFrame:
    return validate.inspect(t.documents, graded_labels(t), "doc_id", "level", 200)


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_titles FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def identity_conflicts(t: Tables) -> DataFrame:
    return evidence.identity_conflicts(t.documents, "source", F.col("lang"))


@query("""SELECT sha256(text) AS sha, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT (lang, source)) > 1 AS conflict FROM documents GROUP BY 1""")
def merge_ledger(t: Tables) -> DataFrame:
    rows = t.documents.select(F.sha2("text", 256).alias("sha"), "doc_id", "lang", "source")
    return evidence.merge_ledger(rows, "sha", ["doc_id"], ["lang", "source"], "source").select("sha", "lang", "source", F.array_join("gathered", ",").alias("sources"), "conflict")


@query("SELECT d.doc_id, CASE WHEN v = 'reject' THEN 'rejected' WHEN v = 'accept' THEN 'accepted' ELSE 'pending' END AS review_status FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END) AS v FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def review_status(t: Tables) -> DataFrame:
    reviews = t.labels.select("doc_id", F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"))
    return evidence.review_status(t.documents.select("doc_id"), reviews, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_yet_done(t: Tables) -> DataFrame:
    return evidence.not_yet_done(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("SELECT conv_id, turn, role, next_turn - turn - 1 AS gap FROM (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL")
def adjacent_turns(t: Tables) -> DataFrame:
    from lodestone.operators.graph import adjacent_pairs

    rows = t.conversations.select("conv_id", F.struct("turn", "role").alias("id"), "turn", F.col("turn").alias("stop"))
    return adjacent_pairs(rows, ["conv_id"], "id", "turn", "stop").select("conv_id", "src.turn", "src.role", "gap")


@query("SELECT conv_id, string_agg(role || ':' || turn, ';' ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def joined_ids(t: Tables) -> DataFrame:
    return aggregate.joined_values(t.conversations.select("conv_id", "turn", F.concat_ws(":", "role", "turn").alias("v")), "conv_id", "v", ["turn"])


@query("SELECT label, count(DISTINCT source) AS groups, count(*) AS n FROM (SELECT l.quality AS label, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY 1")
def groups_per_class(t: Tables) -> DataFrame:
    return aggregate.groups_per_class(t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("label"), "source"), "label", "source")


@query("SELECT quality AS label, count(*) AS n, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT quality, count(*) AS c, 0.001 / (1 - pow(0.999, count(*))) AS w FROM labels GROUP BY 1) JOIN labels USING (quality) GROUP BY quality, w, c".replace("round(w / avg(w) OVER (), 9)", "round(w / (SELECT avg(x) FROM (SELECT 0.001 / (1 - pow(0.999, count(*))) AS x FROM labels GROUP BY quality)), 6)"))
def class_weights(t: Tables) -> DataFrame:
    return aggregate.class_weights(t.labels.select(F.col("quality").alias("label")), "label").withColumn("weight", F.round("weight", 6))


@query("SELECT count(*) AS n, round(avg((quality = toxic)::INT), 9) AS agreement, round((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 9) AS kappa FROM labels")
def kappa(t: Tables) -> DataFrame:
    from lodestone.operators.metrics import kappa as run

    return run(t.labels, [], "quality", "toxic").withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


@query("""SELECT 'documents' AS set, count(DISTINCT text) AS n FROM documents UNION ALL SELECT 'both', count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)
UNION ALL SELECT 'only_benchmark', count(*) FROM (SELECT text FROM benchmark EXCEPT SELECT text FROM documents) UNION ALL SELECT 'all', count(*) FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)""")
def set_operations(t: Tables) -> DataFrame:
    d, b = t.documents.select("text"), t.benchmark.select("text")
    named = {"documents": d.distinct(), "both": d.intersect(b), "only_benchmark": b.subtract(d), "all": d.union(b).distinct()}
    out = None
    for name, frame in named.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("set"), "n")
        out = one if out is None else out.unionByName(one)
    return out
