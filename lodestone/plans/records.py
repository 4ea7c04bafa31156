"""Queries over events, orders, lineitem, parts, suppliers, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import numeric as N
from lodestone.functions import text as T
from lodestone.operators import aggregate, dedup, graph, metrics, ranking, similar, splits, validate
from lodestone.streaming import events as stream

from .catalogue import Tables, query

KINDS = ["click", "error", "purchase", "signup", "view"]


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount
FROM lineitem GROUP BY 1, 2""")
def audit_summary(t: Tables) -> DataFrame:
    """Flagship: one pass over the largest table."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("""SELECT 'l_quantity' AS field, count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), min(l_discount), max(l_discount) FROM lineitem""")
def numeric_ranges(t: Tables) -> DataFrame:
    return aggregate.numeric_ranges(t.lineitem, ["l_quantity", "l_discount"])


@query("""SELECT event_id, trim(props) AS props, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, event_type || ':' || user_id AS label FROM events""")
def props_parse(t: Tables) -> DataFrame:
    number = T.to_number(F.regexp_extract("props", "([0-9]+)", 1))
    return t.events.select("event_id", T.missing_to_null(F.col("props")).alias("props"), number.alias("k"), F.concat_ws(":", T.first_filled(F.col("event_type"), F.lit("none")), "user_id").alias("label"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def pivot_matrix(t: Tables) -> DataFrame:
    return aggregate.pivot_counts(t.events, "user_id", "event_type", KINDS)


@query("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def category_counts(t: Tables) -> DataFrame:
    m = aggregate.category_map(t.events, "user_id", "event_type")
    joined = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("user_id", joined.alias("counts"), "total")


RATIO = """c AS (SELECT user_id, event_type, greatest(count(*), 1) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, median(v) AS m, count(*) AS k, sum(v)::BIGINT AS t FROM c GROUP BY 1),
r AS (SELECT user_id, k::INTEGER AS categories, t AS total, CASE WHEN k >= 2 THEN log2((coalesce(sum(v) FILTER (v <= m), 0) + 1) / (coalesce(sum(v) FILTER (v > m), 0) + 1)) ELSE 0 END AS log_ratio FROM c JOIN m USING (user_id) GROUP BY user_id, k, t)"""


@query(f"""WITH {RATIO} SELECT user_id, categories, total, round(log_ratio, 6) AS log_ratio, CASE WHEN total < 5 THEN 'low' WHEN total < 50 THEN 'medium' ELSE 'high' END AS coverage,
CASE WHEN total < 5 THEN 'untested' WHEN log_ratio < -1 THEN 'essential' WHEN log_ratio > 1 THEN 'dispensable' ELSE 'conditional' END AS call FROM r""")
def call_tiers(t: Tables) -> DataFrame:
    r = aggregate.median_log_ratio(t.events, "user_id", "event_type")
    coverage, call = aggregate.tier(F.col("total"), F.col("log_ratio"))
    return r.select("user_id", "categories", "total", F.round("log_ratio", 6).alias("log_ratio"), coverage.alias("coverage"), call.alias("call"))


@query("SELECT l_suppkey, count(*) AS n, round(CASE WHEN sum(l_quantity) > 0 THEN count(*) / greatest(sum(l_quantity) / 1000, 1) ELSE 0 END, 6) AS per_unit FROM lineitem GROUP BY 1")
def density(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("_q"))
    return g.select("l_suppkey", "n", F.round(N.density(F.col("n"), F.col("_q")), 6).alias("per_unit"))


@query("SELECT l_orderkey, count(*) AS n, round(1 - product(1 - l_discount), 9) AS p_any FROM lineitem GROUP BY 1")
def noisy_or(t: Tables) -> DataFrame:
    return aggregate.noisy_or(t.lineitem, ["l_orderkey"], "l_discount").withColumn("p_any", F.round("p_any", 9))


@query("SELECT user_id, count(*) AS categories, round(CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def entropy(t: Tables) -> DataFrame:
    return aggregate.entropy(t.events, ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 6))


@query("SELECT p_brand, count(*) AS n, (list_sort(list(p_size)))[count(*) // 2 + 1] AS upper_median FROM part GROUP BY 1")
def upper_median(t: Tables) -> DataFrame:
    return aggregate.upper_median(t.part, ["p_brand"], "p_size")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, round(coalesce(total, 0), 2) AS total, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, max(o_orderpriority) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def prefagg_left_join(t: Tables) -> DataFrame:
    j = aggregate.pre_aggregated_join(t.customer.withColumnRenamed("c_custkey", "k"), t.orders.withColumnRenamed("o_custkey", "k"), "k", n=F.count(F.lit(1)), s=F.sum("o_totalprice"), last=F.max("o_orderpriority"))
    return j.select(F.col("k").alias("c_custkey"), F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"), "last")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def fanout_left_join(t: Tables) -> DataFrame:
    """A left join without grouping: repeated keys on the right multiply rows, as they should here."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM supplier")
def semi_flag(t: Tables) -> DataFrame:
    hit = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("_hit", F.lit(True))
    return t.supplier.join(hit, "s_suppkey", "left").select("s_suppkey", F.coalesce("_hit", F.lit(False)).alias("returned"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def orphans(t: Tables) -> DataFrame:
    """Customers without an urgent order."""
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def lookup_join(t: Tables) -> DataFrame:
    """Lookups in small dimension tables: Spark broadcasts them by their size, up to its threshold."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("""SELECT a.user_id, a.event_id AS src, b.event_id AS dst, greatest(b.s - a.s, 0) AS gap FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) a JOIN (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) b
ON a.user_id = b.user_id AND (b.s > a.s OR (b.s = a.s AND b.event_id > a.event_id)) AND b.s - a.s <= 3600""")
def range_join(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return graph.range_pairs(rows, ["user_id"], "event_id", "s", "s", 3600, 3600)


@query("""SELECT user_id, src, dst, gap FROM (SELECT user_id, event_id AS src, lead(event_id) OVER w AS dst, greatest(lead(s) OVER w - s - 1, 0) AS gap FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) WHERE dst IS NOT NULL AND gap <= 86400""")
def adjacent_pairs(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return graph.adjacent_pairs(rows, ["user_id"], "event_id", "s", "s", 86400)


@query("""SELECT label, src, dst, round(cosine, 9) AS cosine FROM (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS cosine
FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE cosine >= 0.3""")
def pair_cosine(t: Tables) -> DataFrame:
    """Pairs within a label."""
    return similar_vectors(t.embeddings, 0.3).withColumn("cosine", F.round("cosine", 9))


def similar_vectors(e: DataFrame, least: float) -> DataFrame:
    """(label, src, dst, cosine) of pairs within a label."""
    return similar.similar_pairs(e, "vec_id", "embedding", least, ["label"])


@query("""SELECT src, dst, round(cosine, 9) AS cosine FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS cosine
FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id < b.vec_id) WHERE cosine >= 0.4""")
def similar_pairs(t: Tables) -> DataFrame:
    """All pairs of vectors with a cosine of 0.4 or more, whatever their labels."""
    return similar.similar_pairs(t.embeddings, "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 9))


@query("""SELECT a.vec_id, a.label, round(avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS cosine
FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label GROUP BY 1, 2""")
def prototype_cosine(t: Tables) -> DataFrame:
    """The mean of the cosines with all vectors of the label; by way of the mean unit vector, so no pairs are formed."""
    return ranking.mean_cosine(t.embeddings, "vec_id", t.embeddings, ["label"], "embedding").withColumn("cosine", F.round("cosine", 6))


@query("SELECT l_suppkey, count(*) AS n, round(CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)) END, 6) AS r FROM lineitem GROUP BY 1")
def pair_pearson(t: Tables) -> DataFrame:
    r = F.try_divide(F.covar_pop("l_quantity", "l_extendedprice"), F.stddev_pop("l_quantity") * F.stddev_pop("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("r"))


EDGES = "e AS (SELECT o_custkey AS src, o_custkey + 7 * (o_orderkey % 5) AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'near' WHEN 1 THEN 'same' WHEN 2 THEN 'coex' ELSE 'odd' END AS kind FROM orders)"


def customer_edges(t: Tables) -> DataFrame:
    key = F.col("o_orderkey") % 4
    kind = F.when(key == 0, "near").when(key == 1, "same").when(key == 2, "coex").otherwise("odd")
    return t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 7 * (F.col("o_orderkey") % 5)).alias("dst"), kind.alias("kind"))


@query(f"""WITH {EDGES} SELECT coalesce(reason, 'kept') AS reason, kind, count(*) AS n FROM (SELECT e.*, CASE WHEN kind NOT IN ('near', 'same', 'coex') THEN 'unknown_kind' WHEN src = dst THEN 'self' WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 'missing_split' WHEN a.c_mktsegment <> b.c_mktsegment THEN 'cross_split' END AS reason
FROM e LEFT JOIN customer a ON a.c_custkey = src LEFT JOIN customer b ON b.c_custkey = dst) GROUP BY 1, 2""")
def edge_filter_reasons(t: Tables) -> DataFrame:
    checked = graph.drop_reasons(customer_edges(t), t.customer, "c_custkey", "c_mktsegment", ["near", "same", "coex"])
    return checked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS degree, count(DISTINCT dst) AS neighbours FROM (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst) GROUP BY 1")
def degree(t: Tables) -> DataFrame:
    return graph.degrees(customer_edges(t).where("src <> dst"))


@query(f"""WITH {EDGES}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst)), s AS (SELECT src, sum(c_acctbal) AS s, count(*) AS n FROM b JOIN customer ON c_custkey = dst GROUP BY 1)
SELECT c_custkey, c_acctbal AS own, round((c_acctbal + coalesce(s, 0)) / (1 + coalesce(n, 0)), 6) AS around FROM customer LEFT JOIN s ON src = c_custkey""")
def neighbor_mean(t: Tables) -> DataFrame:
    return graph.neighbour_mean(customer_edges(t).where("src <> dst"), t.customer, "c_custkey", "c_acctbal").withColumn("around", F.round("around", 6))


REACH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS c FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1"


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS src, c_custkey - c_custkey % 10 AS dst FROM customer), {REACH}")
def components(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return graph.components(t.customer.select(k.alias("src"), (k - k % 10).alias("dst")))


@query(f"WITH RECURSIVE {EDGES}, {REACH}")
def order_components(t: Tables) -> DataFrame:
    """Components of all customer edges, which form long chains."""
    return graph.components(customer_edges(t))


def _walks(levels: int) -> str:
    """Numbers of shortest paths between all nodes, a level at a time."""
    steps = ["w0 AS (SELECT node AS s, node AS t, 0 AS d, 1.0 AS paths FROM v)"]
    for d in range(1, levels + 1):
        steps.append(f"w{d} AS (SELECT * FROM w{d - 1} UNION ALL SELECT s, b.dst, {d}, sum(paths) FROM w{d - 1} w JOIN b ON b.src = w.t WHERE d = {d - 1} AND (s, b.dst) NOT IN (SELECT (s, t) FROM w{d - 1}) GROUP BY 1, 2)")
    return ", ".join(steps)


@query(f"""WITH sold AS (SELECT l_suppkey, c_nationkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT n_nationkey + 100 AS src, n_regionkey AS dst FROM nation UNION ALL SELECT r_regionkey, (r_regionkey + 1) % 5 FROM region UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier
UNION ALL SELECT l_suppkey + 1000, arg_min(c_nationkey, (-q, c_nationkey)) + 100 FROM sold GROUP BY l_suppkey), b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
v AS (SELECT DISTINCT src AS node FROM b), {_walks(6)}, n AS (SELECT count(*) AS n FROM v)
SELECT v.node, round(coalesce(sum(a.paths * z.paths / w.paths), 0) / any_value((n - 1) * (n - 2)), 9) AS betweenness FROM v CROSS JOIN n LEFT JOIN w6 a ON a.t = v.node AND a.s <> v.node
LEFT JOIN w6 z ON z.s = v.node AND z.t <> v.node AND a.s <> z.t LEFT JOIN w6 w ON w.s = a.s AND w.t = z.t AND w.d = a.d + z.d GROUP BY 1""")
def betweenness(t: Tables) -> DataFrame:
    """All suppliers hang on their nation and on the nation they sold most to; nations hang on their regions, regions form a ring."""
    sold = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("l_suppkey", "c_nationkey").agg(F.sum("l_quantity").alias("q"))
    markets = sold.groupBy("l_suppkey").agg(F.min_by("c_nationkey", F.struct(-F.col("q"), "c_nationkey")).alias("to"))
    ends = [
        t.nation.select((F.col("n_nationkey") + 100).alias("src"), F.col("n_regionkey").alias("dst")), t.region.select(F.col("r_regionkey").alias("src"), ((F.col("r_regionkey") + 1) % 5).alias("dst")),
        t.supplier.select((F.col("s_suppkey") + 1000).alias("src"), (F.col("s_nationkey") + 100).alias("dst")), markets.select((F.col("l_suppkey") + 1000).alias("src"), (F.col("to") + 100).alias("dst")),
    ]
    edges = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    return graph.betweenness(edges).withColumn("betweenness", F.round("betweenness", 9))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, round((count(*) OVER () - row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)) / greatest(1, count(*) OVER () - 1), 9) AS percentile FROM supplier")
def rank_percentile(t: Tables) -> DataFrame:
    return ranking.global_rank(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", "rank", F.round("percentile", 9).alias("percentile"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS price, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 9) AS size FROM part")
def minmax(t: Tables) -> DataFrame:
    s = ranking.scaled(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])
    return s.select("p_partkey", F.round("p_retailprice_scaled", 9).alias("price"), F.round("p_size_scaled", 9).alias("size"))


SCORES = "p AS (SELECT p_partkey, p_size / 50 AS a, (p_retailprice % 100) / 100 AS b, (p_partkey % 4)::BIGINT AS votes, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 10) / 10 END AS v FROM part)"


def part_scores(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", (F.col("p_size") / 50).alias("a"), ((F.col("p_retailprice") % 100) / 100).alias("b"), (k % 4).alias("votes"), F.when(k % 3 > 0, (k % 10) / 10).alias("v"))


@query(f"""WITH {SCORES}, u AS (SELECT * FROM p WHERE NOT coalesce(v > 0.8, false)) SELECT p_partkey, CASE WHEN coalesce(v > 0.8, false) THEN 'excluded' WHEN EXISTS (SELECT 1 FROM u WHERE u.a >= p.a AND u.b >= p.b AND (u.a > p.a OR u.b > p.b)) THEN 'C'
WHEN a >= 0.5 AND b >= 0.5 AND votes >= 2 THEN 'A' ELSE 'B' END AS tier FROM p""")
def pareto_tiers(t: Tables) -> DataFrame:
    return ranking.tiers(part_scores(t), "a", "b", "votes", "v", 0.5, 0.5, 0.8).select("p_partkey", "tier")


@query(f"""WITH {SCORES}, x AS (SELECT p_partkey FROM (FROM p ORDER BY a DESC, p_partkey LIMIT 50) UNION ALL SELECT p_partkey FROM (FROM p ORDER BY b DESC, p_partkey LIMIT 50) UNION ALL SELECT p_partkey FROM (FROM p WHERE v IS NOT NULL ORDER BY v DESC, p_partkey LIMIT 50)) SELECT p_partkey, count(*) AS votes FROM x GROUP BY 1""")
def topk_consensus(t: Tables) -> DataFrame:
    return ranking.consensus(part_scores(t), "p_partkey", ["a", "b", "v"], 50)


@query(f"""WITH {SCORES}, m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(v) AS v0, max(v) AS v1 FROM p) SELECT p_partkey, round((a - a0) / (a1 - a0) * ((b - b0) / (b1 - b0)) * (1 - (v - v0) / (v1 - v0)), 9) AS acquisition FROM p, m""")
def acquisition(t: Tables) -> DataFrame:
    s = ranking.scaled(part_scores(t), ["a", "b", "v"])
    return s.select("p_partkey", F.round(F.col("a_scaled") * F.col("b_scaled") * (1 - F.col("v_scaled")), 9).alias("acquisition"))


@query(f"""WITH {SCORES}, s AS (SELECT p_partkey AS k, b FROM p ORDER BY b DESC, p_partkey LIMIT 60) SELECT k::VARCHAR AS members, round(b, 9) AS score FROM s UNION ALL SELECT x.k || ',' || y.k, round(1 - (1 - x.b) * (1 - y.b), 9) FROM s x JOIN s y ON x.k < y.k
UNION ALL SELECT x.k || ',' || y.k || ',' || z.k, round(1 - (1 - x.b) * (1 - y.b) * (1 - z.b), 9) FROM s x JOIN s y ON x.k < y.k JOIN s z ON y.k < z.k""")
def combinations3(t: Tables) -> DataFrame:
    c = ranking.combinations(part_scores(t), "p_partkey", "b", 3, 60)
    return c.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.round("score", 9).alias("score"))


@query(f"""WITH {SCORES}, g AS (SELECT i.range::INTEGER AS i, j.range::INTEGER AS j FROM range(11) i, range(11) j), c AS (SELECT least(floor(a * 10), 10) AS x, least(floor(b * 10), 10) AS y, votes >= 2 AS k FROM p)
SELECT i / 10 AS cut_a, j / 10 AS cut_b, count(x) AS n, count(*) FILTER (k) AS found, round(count(*) FILTER (k) / greatest((SELECT count(*) FILTER (k) FROM c), 1), 9) AS recall FROM g LEFT JOIN c ON x >= i AND y < j GROUP BY 1, 2""")
def threshold_grid(t: Tables) -> DataFrame:
    g = ranking.threshold_grid(part_scores(t).withColumn("known", F.col("votes") >= 2), "a", "b", "known")
    return g.withColumn("recall", F.round("recall", 9))


@query("""WITH e AS (SELECT abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem), n AS (SELECT count(*) AS n FROM e), r AS (SELECT e, row_number() OVER (ORDER BY e) AS k FROM e) SELECT n, round(e, 6) AS width, 'split_conformal' AS status FROM r, n WHERE k = ceil(0.9 * (n + 1))""")
def conformal(t: Tables) -> DataFrame:
    pairs = t.lineitem.select((F.col("l_quantity") * 1500).alias("p"), F.col("l_extendedprice").alias("y"))
    return ranking.conformal(pairs, "p", "y").withColumn("width", F.round("width", 6))


@query("""WITH u AS (SELECT l_suppkey, l_quantity / max(l_quantity) OVER (PARTITION BY l_suppkey) AS u, l_extendedprice AS y FROM lineitem),
s AS (SELECT l_suppkey, count(*) AS n, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS y0, sum(u * y) AS y1, sum(u * u * y) AS y2 FROM u GROUP BY 1),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS w FROM s)
SELECT l_suppkey, n, round((y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / w, 3) AS c0, round((s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / w, 3) AS c1,
  round((s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / w, 3) AS c2, 'fitted' AS status FROM d""")
def quadratic_fit(t: Tables) -> DataFrame:
    fit = ranking.quadratic_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice")
    return fit.select("l_suppkey", "n", *[F.round(f"c{k}", 3).alias(f"c{k}") for k in range(3)], "status")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 8")
def topk_per_group(t: Tables) -> DataFrame:
    return ranking.top_per_group(t.part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 8).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def topk(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(100)


REL = "l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS score, (l_partkey % 4)::INTEGER AS rel FROM lineitem)"


def order_relevance(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 4).cast("int").alias("rel"))


@query(f"""WITH {REL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY rel DESC, l_linenumber) AS i FROM l)
SELECT l_orderkey, round(CASE WHEN sum(CASE WHEN i <= 5 THEN (pow(2, rel) - 1) / log2(i + 1) ELSE 0 END) = 0 THEN 0 ELSE sum(CASE WHEN r <= 5 THEN (pow(2, rel) - 1) / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 5 THEN (pow(2, rel) - 1) / log2(i + 1) ELSE 0 END) END, 6) AS ndcg FROM r GROUP BY 1""")
def ndcg(t: Tables) -> DataFrame:
    return metrics.ndcg(order_relevance(t), ["l_orderkey"], "score", "rel", "l_linenumber", 5).withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {REL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS r FROM l) SELECT l_orderkey, coalesce(round(1 / min(r) FILTER (rel > 0), 9), 0) AS rr FROM r GROUP BY 1")
def mrr(t: Tables) -> DataFrame:
    return metrics.reciprocal_rank(order_relevance(t), ["l_orderkey"], "score", "rel", "l_linenumber").withColumn("rr", F.round("rr", 9))


@query("""WITH s AS (SELECT l_returnflag, l_quantity AS s, count(*) FILTER (l_linestatus = 'O') AS p, count(*) FILTER (l_linestatus <> 'O') AS q FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY l_returnflag ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER d AS tp, sum(p + q) OVER d AS al FROM s WINDOW d AS (PARTITION BY l_returnflag ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_returnflag, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auc, round(sum(p * tp / al) / nullif(sum(p), 0), 6) AS average_precision FROM w GROUP BY 1""")
def auc_ap(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    return metrics.auc(rows, ["l_returnflag"], "l_quantity", "y").withColumns({c: F.round(c, 6) for c in ("auc", "average_precision")})


@query("""WITH s AS (SELECT l_shipdate IS NOT NULL AS x, l_returnflag, l_quantity / 50 AS s, (l_linestatus = 'O')::INT AS y FROM lineitem), c AS (SELECT l_returnflag, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp, count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s < 0.5 AND y = 1) AS fn, round(avg(pow(s - y, 2)), 6) AS brier FROM s GROUP BY 1)
SELECT l_returnflag, tp, fp, tn, fn, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy, brier FROM c""")
def brier_confusion(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", (F.col("l_quantity") / 50).alias("s"), (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return metrics.confusion(rows, ["l_returnflag"], "s", "y").withColumns({"balanced_accuracy": F.round("balanced_accuracy", 9), "brier": F.round("brier", 6)})


@query(f"WITH {REL} SELECT a.l_orderkey, count(*) AS pairs, round(avg(ln(1 + exp(-(a.score - b.score) / 10000))), 6) AS loss FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.rel > b.rel GROUP BY 1")
def pair_loss(t: Tables) -> DataFrame:
    rows = order_relevance(t).withColumn("score", F.col("score") / 10000)
    return metrics.pair_loss(rows, ["l_orderkey"], "score", "rel").withColumn("loss", F.round("loss", 6))


@query(f"WITH {REL}, b AS (SELECT rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS k FROM l) SELECT count(*) AS groups, round(avg((rel > 0)::INT), 9) AS accuracy FROM b WHERE k = 1")
def retrieval_acc(t: Tables) -> DataFrame:
    return metrics.hit_rate(order_relevance(t), ["l_orderkey"], "score", "rel", "l_linenumber").withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {SCORES} SELECT count(*) FILTER (a >= 0.5 AND b < 0.7) AS n_passed, round(count(*) FILTER (a >= 0.5 AND b < 0.7 AND votes >= 2) / greatest(count(*) FILTER (votes >= 2), 1), 9) AS recall, round(count(*) FILTER (a >= 0.5 AND b < 0.7 AND votes >= 2) / greatest(count(*) FILTER (a >= 0.5 AND b < 0.7), 1), 9) AS \"precision\" FROM p")
def gate_metrics(t: Tables) -> DataFrame:
    m = metrics.gate_metrics(part_scores(t), (F.col("a") >= 0.5) & (F.col("b") < 0.7), F.col("votes") >= 2)
    return m.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


@query(f"WITH {SCORES} SELECT p_partkey FROM p WHERE a >= 0.5 AND b < 0.7 AND v < 0.5")
def hard_gate(t: Tables) -> DataFrame:
    return validate.hard_gate(part_scores(t), {"a": 0.5}, {"b": 0.7, "v": 0.5}).select("p_partkey")


@query("SELECT event_id, CASE WHEN value > 0 AND event_type = 'purchase' AND n >= 2 THEN 'E2' ELSE 'E4' END AS level FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE props IS NOT NULL AND props <> '' AND value IS NOT NULL")
def effect_gate(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = t.events.join(counts, ["user_id", "event_type"]).withColumn("high", F.col("value") > 0).withColumn("bought", F.col("event_type") == "purchase")
    return validate.effect_gate(rows, ["props", "value"], ["high", "bought"], "n").select("event_id", "level")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def dedup_keep_best(t: Tables) -> DataFrame:
    return dedup.one_per_key(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [-F.col("value"), F.col("event_id")])


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedup_keep_first(t: Tables) -> DataFrame:
    return dedup.one_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(t: Tables) -> DataFrame:
    return dedup.one_per_key(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [-F.col("event_id")])


@query("SELECT user_id, arg_min(event_type, (-n, f)) AS event_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def mode_first_seen(t: Tables) -> DataFrame:
    return dedup.mode_first_seen(t.events, "user_id", "event_type", "event_id")


@query("SELECT p_brand, count(DISTINCT sha256(p_type)) AS contents FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def conflicting_content(t: Tables) -> DataFrame:
    return dedup.conflicting_content(t.part, "p_brand", F.col("p_type"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return dedup.duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN 'not_assessed' WHEN k < 3 THEN 'partial' ELSE 'assessed' END AS status, CASE WHEN k = 3 THEN round(1 - least(1, 0.2 * ((c_acctbal < 0)::INT + (c_nationkey % 2 = 1)::INT + (c_custkey % 7 > 3)::INT)), 9)::DOUBLE END AS score
FROM (SELECT *, 2 + (CASE WHEN c_custkey % 7 > 0 THEN 1 ELSE 0 END) AS k FROM customer)""")
def flag_score(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    s = N.flag_score({"debt": F.col("c_acctbal") < 0, "odd": F.col("c_nationkey") % 2 == 1, "late": F.when(c % 7 > 0, c % 7 > 3)})
    return t.customer.select("c_custkey", s["status"].alias("status"), F.round(s["score"], 9).alias("score"))


@query("SELECT p_partkey, round(1 / (1 + exp(-least(greatest(p_size - 25, -60), 60))), 9) AS p, round(CASE WHEN p_size / 50 > 0 THEN ln(p_size / 50) ELSE 0 END, 9) AS contribution, CASE WHEN p_size >= 40 THEN 'recent' WHEN p_size >= 20 THEN 'middle' ELSE 'old' END AS band FROM part")
def score_maths(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", F.round(N.sigmoid((size - 25).cast("double")), 9).alias("p"), F.round(N.log_contribution(size / 50), 9).alias("contribution"), T.recency_band(size, 40, 20).alias("band"))


@query("""SELECT p_partkey, i::INTEGER AS position, a, b FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS a, unnest(string_split(p_brand, '#')) AS b, unnest(range(greatest(len(string_split(p_type, ' ')), len(string_split(p_brand, '#'))))) AS i FROM part)""")
def expand_lists(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(";")).alias("a"), F.replace("p_brand", F.lit("#"), F.lit(";")).alias("b"))
    return T.expand_lists(rows, ["a", "b"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(t: Tables) -> DataFrame:
    """An addition: the aggregate that also runs as a stream."""
    w = stream.windowed(t.events, "ts", "event_type", "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_summary(t: Tables) -> DataFrame:
    """An addition: totals by region and nation."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""WITH g AS (SELECT o_custkey AS g, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT range AS k FROM range(63)),
h AS (SELECT g, s, n, k, md5(k || ':0:' || g) AS h FROM g, k), d AS (SELECT s, n, 16 * k + p - 1 AS replicate, ('0x' || substring(h, 2 * p - 1, 2))::INTEGER AS u FROM h, (SELECT range AS p FROM range(1, 17)) WHERE 16 * k + p - 1 < 1000),
m AS (SELECT replicate, sum(w * s) / sum(w * n) AS mean FROM (SELECT *, {metrics.poisson_sql('u')} AS w FROM d) GROUP BY 1)
SELECT count(*) AS replicates, round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m""")
def bootstrap(t: Tables) -> DataFrame:
    """The 95 % interval of the mean price from 1000 draws of whole customers."""
    out = metrics.bootstrap_interval(t.orders, "o_custkey", F.col("o_totalprice"), 1000)
    return out.select("replicates", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH g AS (SELECT p_brand AS g, p_size AS s, count(*) FILTER (p_retailprice > 905) AS p, count(*) FILTER (NOT p_retailprice > 905) AS q FROM part GROUP BY 1, 2), k AS (SELECT range AS k FROM range(63)),
h AS (SELECT g, k, md5(k || ':0:' || g) AS h FROM (SELECT DISTINCT g FROM g), k), d AS (SELECT g, 16 * k + i - 1 AS replicate, ('0x' || substring(h, 2 * i - 1, 2))::INTEGER AS u FROM h, (SELECT range AS i FROM range(1, 17)) WHERE 16 * k + i - 1 < 1000),
w AS (SELECT replicate, s, sum(w * p) AS p, sum(w * q) AS q FROM (SELECT g, replicate, {metrics.poisson_sql('u')} AS w FROM d) x JOIN g USING (g) GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w), a AS (SELECT replicate, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM b GROUP BY 1)
SELECT count(*) AS replicates, round(avg(auc), 6) AS auc, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM a""")
def bootstrap_area(t: Tables) -> DataFrame:
    """The 95 % interval of the area under the curve of sizes against dear parts, from 1000 draws of whole brands."""
    rows = t.part.select("p_brand", "p_size", (F.col("p_retailprice") > 905).cast("int").alias("dear"))
    out = metrics.bootstrap_auc_interval(rows, "p_brand", "p_size", "dear", 1000)
    return out.select("replicates", *[F.round(c, 6).alias(c) for c in ("auc", "low", "high")])


@query()
def group_folds(t: Tables) -> DataFrame:
    """Suppliers in five folds with even shares of the return flags; without SQL, as groups are dealt one by one."""
    return splits.group_folds(t.lineitem, "l_suppkey", "l_returnflag", 5)
