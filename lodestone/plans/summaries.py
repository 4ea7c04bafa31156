"""Queries over coverage, weights, tiers, agreement and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregate, evidence, metrics, ranking, textmine, validate

from .catalogue import Tables, query
from .records import RATIO, SCORES, part_scores
from .texts import INSPECTED, LABELS, graded_labels


@query("""WITH i AS (SELECT p_brand AS m, (p_size % 2)::BIGINT AS s, avg(p_size) / 100 AS f, min(p_size) / 60 AS lo, max(p_size) / 60 AS hi FROM part GROUP BY 1, 2), w AS (SELECT range AS s, range + 1.0 AS w FROM range(2)),
p AS (SELECT w.s, w.w, b.m, f, lo, hi FROM w CROSS JOIN (SELECT DISTINCT m FROM i) b LEFT JOIN i ON i.m = b.m AND i.s = w.s), g AS (SELECT s, w, count(*) FILTER (f IS NULL) AS missing, 1 - product(1 - f * lo) AS lo, 1 - product(1 - f * hi) AS hi FROM p GROUP BY 1, 2)
SELECT round(CASE WHEN sum(missing) = 0 THEN sum(w * lo) / sum(w) END, 9) AS lower, round(CASE WHEN sum(missing) = 0 THEN sum(w * hi) / sum(w) END, 9) AS upper, sum(missing)::BIGINT AS missing FROM g""")
def strata_coverage(t: Tables) -> DataFrame:
    inputs = t.part.groupBy(F.col("p_brand").alias("m"), (F.col("p_size") % 2).cast("long").alias("s")).agg((F.avg("p_size") / 100).alias("f"), (F.min("p_size") / 60).alias("lo"), (F.max("p_size") / 60).alias("hi"))
    strata = t.spark.range(2).select(F.col("id").alias("s"), (F.col("id") + 1.0).alias("w"))
    out = aggregate.strata_coverage(strata, inputs, "s", "w", ["f"], "lo", "hi", inputs, "m")
    return out.withColumns({c: F.round(c, 9) for c in ("lower", "upper")})


@query("""WITH x AS (SELECT l_suppkey, greatest(l_discount - 0.02, 0) AS x, least(greatest(l_discount - 0.02, 0), 1) AS c FROM lineitem), t AS (SELECT l_suppkey, count(*) AS n, sum(x) AS t, avg(c) AS density FROM x GROUP BY 1),
h AS (SELECT x.l_suppkey, -sum(x / t * ln(x / t + 1e-12)) AS h FROM x JOIN t ON t.l_suppkey = x.l_suppkey GROUP BY 1)
SELECT l_suppkey, n, round(density, 9) AS density, round(CASE WHEN t > 0 AND n > 1 THEN h / ln(n) ELSE 0 END, 6) AS evenness, round(density * pow(CASE WHEN t > 0 AND n > 1 THEN h / ln(n) ELSE 0 END, 2), 6) AS spread FROM t JOIN h USING (l_suppkey)""")
def spread_density(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", (F.col("l_discount") - 0.02).alias("x"))
    out = aggregate.spread_density(rows, ["l_suppkey"], "x", 2.0)
    return out.withColumns({"density": F.round("density", 9), "evenness": F.round("evenness", 6), "spread": F.round("spread", 6)})


@query(f"""WITH {LABELS}, c AS (SELECT label, 0.001 / (1 - pow(0.999, count(*))) AS w FROM l GROUP BY 1)
SELECT doc_id, task, l.label, level, round(w / (SELECT avg(w) FROM c) * CASE level WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.8 WHEN 'E3' THEN 0.4 ELSE 0.2 END, 6) AS weight FROM l JOIN c ON c.label = l.label""")
def sample_weights(t: Tables) -> DataFrame:
    rows = graded_labels(t).select("doc_id", "task", "label", "level")
    return aggregate.sample_weights(rows, "label", F.col("level"), evidence.WEIGHTS).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {RATIO}, k AS (SELECT *, CASE WHEN log_ratio < -1 THEN 'essential' WHEN log_ratio > 1 THEN 'dispensable' ELSE 'conditional' END AS call FROM r)
SELECT count(*) AS n, count(*) FILTER (total >= 50) AS kept, count(*) FILTER (total >= 50 AND call = 'essential') AS n_essential, count(*) FILTER (total >= 50 AND call = 'conditional') AS n_conditional,
  round(coalesce(avg(log_ratio) FILTER (total >= 50), 0), 6) AS mean_score, round(coalesce(median(log_ratio) FILTER (total >= 50), 0), 6) AS median_score, round(coalesce(avg(total) FILTER (total >= 50), 0), 6) AS mean_amount FROM k""")
def filtered_summary(t: Tables) -> DataFrame:
    r = aggregate.median_log_ratio(t.events, "user_id", "event_type")
    r = r.withColumn("call", aggregate.tier(F.col("total"), F.col("log_ratio"))[1])
    out = aggregate.filtered_summary(r, F.col("total") >= 50, "log_ratio", "total", "call", ["essential", "conditional"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "median_score", "mean_amount")})


@query("""WITH b AS (SELECT l.doc_id, l.quality + (d.doc_id % 3) AS a, l.quality + (d.n_chars % 3) AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS p FROM b),
c AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, count(*) AS n FROM b GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM b GROUP BY 1) y ON x.a = y.b)
SELECT n, round(p, 9) AS agreement, round((p - c / (n * n)) / (1 - c / (n * n)), 9) AS kappa FROM n, c""")
def category_kappa(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents, "doc_id")
    a, b = (d.select("doc_id", (F.col("quality") + F.col(c) % 3).alias("label")) for c in ("doc_id", "n_chars"))
    return metrics.category_kappa(a, b, ["doc_id"], "label").withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


@query(f"""WITH {SCORES}, s AS (SELECT *, a >= 0.5 AND b < 0.7 AS k FROM p) SELECT count(*) FILTER (k) AS n_passed, round(count(*) FILTER (k AND votes >= 2) / greatest(count(*) FILTER (votes >= 2), 1), 9) AS recall,
  round(count(*) FILTER (k AND v > 0.5) / greatest(count(*) FILTER (k), 1), 9) AS rate_v, round(count(*) FILTER (k AND p_partkey % 9 = 0) / greatest(count(*) FILTER (k), 1), 9) AS rate_nine FROM s""")
def gate_rates(t: Tables) -> DataFrame:
    out = metrics.gate_rates(part_scores(t), (F.col("a") >= 0.5) & (F.col("b") < 0.7), F.col("votes") >= 2, rate_v=F.coalesce(F.col("v") > 0.5, F.lit(False)), rate_nine=F.col("p_partkey") % 9 == 0)
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "rate_v", "rate_nine")})


@query(f"""WITH {SCORES}, x AS (FROM p ORDER BY a DESC, p_partkey LIMIT 50), y AS (FROM p ORDER BY b DESC, p_partkey LIMIT 50), z AS (FROM p WHERE v IS NOT NULL ORDER BY v DESC, p_partkey LIMIT 50),
o AS (SELECT 'a' AS a, 'b' AS b, (SELECT count(*) FROM x JOIN y USING (p_partkey)) / 50 AS overlap UNION ALL SELECT 'a', 'v', (SELECT count(*) FROM x JOIN z USING (p_partkey)) / 50 UNION ALL SELECT 'b', 'v', (SELECT count(*) FROM y JOIN z USING (p_partkey)) / 50)
SELECT *, (SELECT avg(overlap) FROM o) < 0.3 AS disagree FROM o""")
def top_overlap(t: Tables) -> DataFrame:
    return ranking.top_overlap(part_scores(t), "p_partkey", ["a", "b", "v"], 50)


@query(f"""WITH {SCORES}, q AS (SELECT p_partkey, least(a, 1.0) AS a, b, votes, v FROM p), u AS (SELECT * FROM q WHERE NOT coalesce(v > 0.5, false)),
k AS (SELECT *, CASE WHEN coalesce(v > 0.5, false) THEN 'excluded' WHEN EXISTS (SELECT 1 FROM u WHERE u.a >= q.a AND u.b >= q.b AND (u.a > q.a OR u.b > q.b)) THEN 'C' WHEN a >= 0.5 AND b >= 0.5 AND votes >= 2 THEN 'A' ELSE 'B' END AS tier FROM q)
SELECT p_partkey, tier, concat_ws(';', CASE WHEN tier = 'B' AND NOT votes >= 2 THEN 'agreement_not_met' END, CASE WHEN tier = 'B' AND NOT (a >= 0.5 AND b >= 0.5) THEN 'below_threshold' END, CASE WHEN tier = 'C' THEN 'dominated' END, CASE WHEN tier = 'excluded' THEN 'unavailable' END, CASE WHEN tier = 'excluded' THEN 'vetoed' END) AS reasons,
  round(a * pow(b, 2) * v, 9) AS utility FROM k""")
def judged_tiers(t: Tables) -> DataFrame:
    rows = part_scores(t).select("p_partkey", F.least("a", F.lit(1.0)).alias("a"), "b", "votes", "v", F.col("v").alias("safe"))
    out = ranking.judged_tiers(rows, "a", "b", "safe", "votes", "v", 0.5, 0.5, 0.5, (1.0, 2.0, 1.0))
    return out.select("p_partkey", "tier", F.array_join("reasons", ";").alias("reasons"), F.round("utility", 9).alias("utility"))


@query("""WITH s AS (SELECT p_brand, max(length(p_type)) AS l, count(*) AS n FROM part GROUP BY 1), c AS (SELECT p_brand, unnest(string_split(p_type, '')) AS c, unnest(range(length(p_type))) AS i FROM part),
k AS (SELECT c.p_brand, least(floor(i / greatest(l / 32, 1.0)), 31)::INTEGER AS bin, count(*) / any_value(n) / any_value(l) AS v FROM c JOIN s ON s.p_brand = c.p_brand WHERE c <> 'N' GROUP BY 1, 2)
SELECT s.p_brand, b.range::INTEGER AS bin, round(coalesce(v, 0), 9) AS value FROM s CROSS JOIN range(32) b LEFT JOIN k ON k.p_brand = s.p_brand AND k.bin = b.range""")
def spectrum(t: Tables) -> DataFrame:
    return textmine.spectrum(t.part, "p_brand", "p_type").withColumn("value", F.round("value", 9))


@query(f"""WITH {INSPECTED}, r AS (SELECT DISTINCT doc_id, task FROM l), o AS (FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.task < b.task LIMIT 1), f AS (SELECT issue, severity FROM i WHERE n > 0 UNION ALL SELECT 'SPLIT_OVERLAP', 'blocking' FROM o)
SELECT CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues, count(*) FILTER (severity = 'blocking') > 0 AS review, count(*) FILTER (issue = 'SMALL_TASK') > 0 AS repeated FROM f""")
def dataset_verdict(t: Tables) -> DataFrame:
    """The two tasks stand for two splits that share documents."""
    labels = graded_labels(t)
    return validate.verdict(validate.inspect(t.documents, labels, "doc_id", "level", 200), validate.split_overlaps(labels, "doc_id", "task"))


@query(f"WITH {LABELS} SELECT level, count(*) AS n, CASE level WHEN 'E1' THEN 'direct assay on the target with a reference' WHEN 'E2' THEN 'direct assay in private data' WHEN 'E3' THEN 'computed' ELSE 'no direct assay stated' END AS reason FROM l GROUP BY 1")
def grade_reasons(t: Tables) -> DataFrame:
    return graded_labels(t).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", "n", evidence.grade_reason(F.col("level")).alias("reason"))


@query("""WITH x AS (SELECT p_partkey, translate(regexp_replace(lower(p_name), '[^aeiou]', '', 'g'), 'aeiou', 'AAEEU') AS x FROM part), q AS (SELECT p_partkey, unnest(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) AS q FROM x WHERE length(x) > 1),
c AS (SELECT p_partkey, (strpos('AEU', q[1]) - 1) * 3 + strpos('AEU', q[2]) - 1 AS k, count(*) / sum(count(*)) OVER (PARTITION BY p_partkey) AS s FROM q GROUP BY 1, 2, p_partkey, q)
SELECT p_partkey, i::INTEGER AS cell, round(coalesce((SELECT sum(s) FROM c WHERE c.p_partkey = x.p_partkey AND c.k = i), 0) + CASE WHEN i < 2 THEN coalesce((SELECT sum(s) FROM c WHERE c.p_partkey = x.p_partkey AND c.k = 7 + i), 0) / 2 ELSE 0 END, 9) AS share FROM x, (SELECT range AS i FROM range(7))""")
def pooled_pairs(t: Tables) -> DataFrame:
    cells = T.pooled_pairs(F.lower("p_name"), {"a": "A", "e": "A", "i": "E", "o": "E", "u": "U"}, "AEU", 7)
    return t.part.select("p_partkey", F.posexplode(cells).alias("cell", "share")).withColumn("share", F.round("share", 9))


@query()
def folded_title_key(t: Tables) -> DataFrame:
    """Without SQL: DuckDB has no compatibility decomposition."""
    return t.documents.select("doc_id", F.md5(T.folded_title_key(F.col("text"))).alias("key"))
