"""Edges from order, intervals and tables; components, degrees, neighbour means, centrality."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def adjacent_pairs(rows: DataFrame, group: Sequence[str], row_id: str, start: str, stop: str, most: int | None = None) -> DataFrame:
    """(group, src, dst, gap) of neighbours in order of start within a group; gap: whole places between them."""
    w = Window.partitionBy(*group).orderBy(start, row_id)
    out = rows.select(*group, F.col(row_id).alias("src"), F.lead(row_id).over(w).alias("dst"), F.greatest(F.lead(start).over(w) - F.col(stop) - 1, F.lit(0)).alias("gap")).where(F.col("dst").isNotNull())
    return out if most is None else out.where(F.col("gap") <= most)


def range_pairs(rows: DataFrame, group: Sequence[str], row_id: str, start: str, stop: str, most: int, width: int) -> DataFrame:
    """(group, src, dst, gap) of all pairs of intervals in a group that lie at most ``most`` apart.

    Intervals are entered in every bin of ``width`` they touch once widened on
    the right; a pair is taken in the bin in which the later one starts or the
    first both share, so it comes once and the join is an equi-join.
    """
    a = rows.select(*group, F.col(row_id).alias("src"), F.col(start).alias("a0"), F.col(stop).alias("a1"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a0") / width), F.floor((F.col("a1") + most) / width))))
    b = rows.select(*group, F.col(row_id).alias("dst"), F.col(start).alias("b0"), F.col(stop).alias("b1")).withColumn("bin", F.floor(F.col("b0") / width))
    later = (F.col("b0") > F.col("a0")) | ((F.col("b0") == F.col("a0")) & (F.col("dst") > F.col("src")))
    gap = F.greatest(F.col("b0") - F.col("a1"), F.lit(0))
    return a.join(b, [*group, "bin"]).where(later & (F.col("b0") - F.col("a1") <= most)).select(*group, "src", "dst", gap.alias("gap"))


def drop_reasons(edges: DataFrame, nodes: DataFrame, node: str, split: str, kinds: Sequence[str]) -> DataFrame:
    """Adds reason (null: kept) to (src, dst, kind): unknown kind, self, missing or crossing split."""
    a = nodes.select(F.col(node).alias("src"), F.col(split).alias("_a"))
    b = nodes.select(F.col(node).alias("dst"), F.col(split).alias("_b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False)), "unknown_kind").when(F.col("src") == F.col("dst"), "self")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "missing_split").when(F.col("_a") != F.col("_b"), "cross_split")
    )
    return joined.withColumn("reason", reason).drop("_a", "_b")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge (src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("e"), *rest).select("e.src", "e.dst", *rest)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("dst").alias("neighbours"))


def neighbour_mean(edges: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """(node, own, around): a node's value and the mean over itself and its neighbours."""
    near = both_ways(edges.select("src", "dst")).distinct().join(values.select(F.col(node).alias("dst"), F.col(value).alias("_v")), "dst")
    per = near.groupBy(F.col("src").alias(node)).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    around = (F.col(value) + F.coalesce("_s", F.lit(0.0))) / (1 + F.coalesce("_n", F.lit(0)))
    return values.select(node, value).join(per, node, "left").select(node, F.col(value).alias("own"), around.alias("around"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of (src, dst): the smallest node it is connected with.

    Each round every node goes over to the one of least checksum among itself
    and its neighbours (checksums differ from round to round), and what they
    go over to, with the edges between, is the next round's graph: on
    average a part of the nodes and edges, so all rounds together take a
    few times the work of the first, and their number grows with the logarithm
    of a component's size; it is an error if ``rounds`` do not suffice. Back
    from the last round, nodes take the component of the one they went over
    to. Each round is written into the cluster's shared folder.
    """
    known = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = stored(known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    # of each round: the nodes, the smallest first node gone over to each, and where each goes (null: it has no neighbour)
    members = both_ways(pairs).select(F.col("src").alias("node")).distinct().withColumn("least", F.col("node"))
    pairs = pairs.where(F.col("src") != F.col("dst"))
    steps: list[DataFrame] = []
    for k in range(rounds + 1):
        drawn = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("_h"), F.col(c).alias("_to"))  # noqa: E731, B023
        chosen = both_ways(pairs).groupBy(F.col("src").alias("node")).agg(F.min(drawn("dst")).alias("_m")).select("node", F.least("_m", drawn("node"))["_to"].alias("to"))
        step = stored(members.join(chosen, "node", "left").select("node", "least", "to"))
        steps.append(step)
        gone = step.where(F.col("to").isNotNull())
        if gone.isEmpty():
            break
        members = gone.groupBy(F.col("to").alias("node")).agg(F.min("least").alias("least"))
        ends = [gone.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst")]
        moved = pairs.join(ends[0], "src").select("_src", "dst").distinct().join(ends[1], "dst").where(F.col("_src") != F.col("_dst"))
        pairs = stored(moved.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = steps.pop().select("node", F.col("least").alias("component"))
    while steps:
        step = steps.pop()
        onward = step.where(F.col("to").isNotNull()).join(labels.withColumnRenamed("node", "to"), "to").select("node", "component")
        labels = stored(onward.unionByName(step.where(F.col("to").isNull()).select("node", F.col("least").alias("component"))))
    return labels


def _checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder: the cluster's shared one, or on one machine a temporary one."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)


def stored(rows: DataFrame, schema: StructType | None = None) -> DataFrame:
    """The rows, written into the checkpoint folder and read back (by ``schema``, if given)."""
    spark = rows.sparkSession
    _checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(schema or rows.schema).parquet(path)


def betweenness(edges: DataFrame, batch: int = 10_000) -> DataFrame:
    """(node, betweenness) of an undirected graph: the share of shortest paths between other nodes that pass a node, of all pairs of nodes.

    Nodes with the same neighbours lie on the same shortest paths, so paths are
    counted between such classes, weighted by their numbers of members: the
    work is that of the classes, however many nodes share one. Sources (one
    a class) are taken some ``batch`` at a time (dealt by a checksum): breadth-first
    levels from all of them at once, then the dependencies back from the
    farthest level; each level is a join with the edges and a sum by (source,
    class), written before the next. A batch leaves a sum for each class, so
    what is held at a time is a row for each source of one batch and class it
    is connected with. Loops and repeated edges change nothing; fewer than
    three nodes give 0.
    """
    _checkpoints(edges.sparkSession)
    both = both_ways(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())).distinct().checkpoint()
    near = both.where(F.col("src") != F.col("dst"))
    alike = _alike(both.select(F.col("src").alias("node")).distinct(), near).checkpoint()
    classes = alike.groupBy(F.col("class").alias("node")).agg(F.count(F.lit(1)).alias("size")).checkpoint()
    n = alike.count()
    # an edge of two nodes stands for those of all members of their classes
    ends = [alike.where(F.col("node") == F.col("class")).select(F.col("node").alias(c)) for c in ("src", "dst")]
    sized = near.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").join(classes.select(F.col("node").alias("dst"), "size"), "dst").checkpoint()
    batches = max(1, -(-classes.count() // batch))
    # of two members of a class each neighbour lies on one of as many shortest paths as they have neighbours
    degree = sized.groupBy(F.col("src").alias("node")).agg(F.sum("size").alias("_degree"))
    between = classes.join(degree, "node").select(F.col("node").alias("src"), (F.col("size") * (F.col("size") - 1) / F.col("_degree")).alias("d"))
    sums = sized.join(between, "src").select(F.col("dst").alias("node"), "d")
    for k in range(batches):
        part = _dependencies(classes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k), sized).checkpoint()
        sums = sums.unionByName(part)
    pairs = (n - 1) * (n - 2)
    total = sums.groupBy(F.col("node").alias("class")).agg(F.sum("d").alias("_d"))
    return alike.join(total, "class").select("node", (F.col("_d") / pairs if pairs > 0 else F.lit(0.0)).alias("betweenness"))


def _alike(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, class): the smallest of the nodes with the same neighbours; sets of neighbours are told apart by their number and 128 bits of checksums."""
    sets = near.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("dst")).alias("_h"), F.bit_xor(F.xxhash64(F.lit("second"), "dst")).alias("_g"))
    key = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_n", "_h", "_g")]
    known = nodes.join(sets, "node", "left").select("node", *key)
    least = known.groupBy("_n", "_h", "_g").agg(F.min("node").alias("class"))
    return known.join(least, ["_n", "_h", "_g"]).select("node", "class")


def _dependencies(sources: DataFrame, near: DataFrame) -> DataFrame:
    """(node, d): the dependencies of the sources' members on a member of each class they reach, summed up; 0 of a source on itself.

    ``sources`` (node, size) are classes, ``near`` (src, dst, size of dst) their edges. Other members of
    the source's own class are on no shortest path from it, so they are no row.
    """
    levels = [sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths"), F.lit(1).cast("long").alias("ways"))]
    seen = levels[0].select("s", "node")
    while True:
        reached = levels[-1].join(near, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.col("paths") * F.col("ways")).alias("paths"), F.any_value("size").alias("ways"))
        fresh = reached.join(seen, ["s", "node"], "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("s", "node")).checkpoint()
    through = levels[-1].withColumn("d", F.lit(0.0))
    total = through.select("s", "node", "d")
    for level in reversed(levels[:-1]):
        later = through.select("s", F.col("node").alias("dst"), (F.col("ways") * (1 + F.col("d")) / F.col("paths")).alias("x"))
        back = near.join(later, "dst").groupBy("s", F.col("src").alias("node")).agg(F.sum("x").alias("x"))
        through = level.join(back, ["s", "node"], "left").select("s", "node", "paths", "ways", F.coalesce(F.col("paths") * F.col("x"), F.lit(0.0)).alias("d")).checkpoint()
        total = total.unionByName(through.select("s", "node", "d"))
    each = total.join(sources.select(F.col("node").alias("s"), "size"), "s")
    return each.groupBy("node").agg(F.sum(F.when(F.col("s") != F.col("node"), F.col("d") * F.col("size")).otherwise(0.0)).alias("d"))


def leaders(pairs: DataFrame, names: Sequence[str], least: float) -> dict[str, str]:
    """Greedy clusters of a short list of names by (a, b, r): each joins the first leader it agrees with.

    ``names`` are the few categories of a column, not rows.
    """
    strong = {(r["a"], r["b"]) for r in pairs.where(F.col("r") >= least).select("a", "b").collect()}
    out: dict[str, str] = {}
    heads: list[str] = []
    for name in names:
        head = next((h for h in heads if (h, name) in strong or (name, h) in strong), None)
        if head is None:
            heads.append(name)
        out[name] = head or name
    return out


def build_edges(edges: DataFrame, nodes: DataFrame, node: str, split: str, aliases: dict[str, str], least: dict[str, float], signed: Sequence[str] = (), strict: dict[str, float] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(src, dst, kind, weight, reason) of edges (src, dst, kind, confidence): accepted ones both ways, the others once with their reason.

    Kinds are trimmed, lower-cased and renamed by ``aliases``; ``least`` names
    the kinds and the least confidence of each (``strict``: of a kind by its
    name before renaming), for ``signed`` kinds of the absolute value, whose
    square is the weight. Reasons: those of ``drop_reasons``, invalid_confidence
    and below_threshold. Repeated edges stay. ``keep``: columns to be kept.
    """
    raw = F.lower(F.trim("kind"))
    named = edges.select("src", "dst", *keep, raw.alias("_raw"), F.coalesce(*[F.when(raw == a, k) for a, k in aliases.items()], raw).alias("kind"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    checked = drop_reasons(named, nodes, node, split, list(least))
    odd = F.col("kind").isin(list(signed))
    size = F.when(odd, F.abs("confidence")).otherwise(F.col("confidence"))
    limits = {**least, **(strict or {})}
    limit = F.coalesce(*[F.when(F.col("_raw") == k, float(v)) for k, v in limits.items()], *[F.when(F.col("kind") == k, float(v)) for k, v in least.items()])
    reason = F.coalesce("reason", F.when(~F.coalesce(size.between(0, 1), F.lit(False)), "invalid_confidence").when(size < limit, "below_threshold"))
    weight = F.when(odd, F.col("confidence") * F.col("confidence")).otherwise(F.col("confidence"))
    done = checked.select("src", "dst", "kind", weight.alias("weight"), reason.alias("reason"), *keep)
    return both_ways(done.where(F.col("reason").isNull())).unionByName(done.where(F.col("reason").isNotNull()))


def tracked_edges(edges: DataFrame, nodes: DataFrame, node: str, split: str, aliases: dict[str, str], least: dict[str, float], track: str, kinds_of: dict[str, Sequence[str]], levels: dict[str, str], default: str = "E2", **how) -> DataFrame:
    """``build_edges`` with level and source (columns of ``edges``): the graph of one track, each edge with the grade of its evidence.

    ``kinds_of``: the kinds that a track admits; ``levels``: the level of a
    kind's edges that state none (null or blank), ``default`` for other kinds.
    Reasons besides those of ``build_edges``, which come first: outside_track,
    unknown_level (none of E1 to E4).
    """
    kind = F.lower(F.trim("kind"))
    kind = F.coalesce(*[F.when(kind == a, k) for a, k in aliases.items()], kind)
    usual = F.coalesce(*[F.when(kind == k, level) for k, level in levels.items()], F.lit(default))
    level = F.coalesce(F.when(F.trim("level") != "", F.trim("level")), usual)
    built = build_edges(edges.withColumn("_edge", F.struct(level.alias("level"), "source")), nodes, node, split, aliases, least, keep=["_edge"], **how)
    gate = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("kind").isin(list(kinds_of[track])), "outside_track").when(~F.col("_edge.level").isin("E1", "E2", "E3", "E4"), "unknown_level")
    out = built.select("src", "dst", "kind", "weight", F.col("_edge.level").alias("level"), F.col("_edge.source").alias("source"), built["reason"].isNull().alias("_both"), gate.alias("reason"))
    # a refused edge is one row: of the two directions the one from the smaller end
    return out.where(F.col("reason").isNull() | ~F.col("_both") | (F.col("src") < F.col("dst"))).drop("_both")


def attribute_edges(*sources: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) both ways from several edge tables of these columns; of edges with the same ends and kind the last table's (there, the heaviest) stays."""
    out = None
    for k, edges in enumerate(sources):
        part = both_ways(edges.select("src", "dst", "kind", "weight").where(F.col("src") != F.col("dst"))).withColumn("_source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("src", "dst", "kind").agg(F.max_by("weight", F.struct("_source", "weight")).alias("weight"))


def neighbour_edges(rows: DataFrame, group: Sequence[str], row_id: str, start: str, stop: str, side: str, unit: str, most: int = 60, together: float = 1.0, near: float = 0.8) -> DataFrame:
    """(src, dst, weight) of neighbours in a group that share a unit (weight ``together``), or are on one side at most ``most`` apart (``near``)."""
    w = Window.partitionBy(*group).orderBy(start, row_id)
    out = rows.select(F.col(row_id).alias("src"), F.lead(row_id).over(w).alias("dst"), (F.col(unit) == F.lead(unit).over(w)).alias("_unit"), (F.col(side) == F.lead(side).over(w)).alias("_side"), F.greatest(F.lead(start).over(w) - F.col(stop) - 1, F.lit(0)).alias("_gap"))
    weight = F.when(F.coalesce("_unit", F.lit(False)), together).when(F.coalesce("_side", F.lit(False)) & (F.col("_gap") <= most), near)
    return out.where(F.col("dst").isNotNull()).select("src", "dst", weight.alias("weight")).where(F.col("weight").isNotNull())


def retention(values: DataFrame, node: str, value: str, first: DataFrame, second: DataFrame, central: DataFrame, rate: float) -> DataFrame:
    """(node, retention): exp(-rate x centrality) times the node's mean with its neighbours along ``first`` and that along ``second``; centrality (node, betweenness), 0 where missing."""
    around = [neighbour_mean(e, values, node, value).select(node, F.col("around").alias(f"_{i}")) for i, e in enumerate((first, second))]
    joined = around[0].join(around[1], node).join(central.select(F.col("node").alias(node), "betweenness"), node, "left")
    return joined.select(node, (F.exp(-rate * F.coalesce("betweenness", F.lit(0.0))) * F.col("_0") * F.col("_1")).alias("retention"))
