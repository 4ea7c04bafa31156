"""Contracts, quarantine and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import is_finite
from lodestone.functions.text import reasons

Rule = tuple[Column, str]
#: Spellings of a version that say nothing.
PLACEHOLDERS = ["", "unspecified", "unknown", "replace_with_batch_id", "template"]


def with_reasons(frame: DataFrame, rules: Sequence[Rule], name: str = "reasons") -> DataFrame:
    """Adds the messages of all broken rules; a rule is (condition of the fault, message)."""
    return frame.withColumn(name, reasons(*rules))


def route(frame: DataFrame, rules: Sequence[Rule], name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, rows that do with their reasons)."""
    checked = with_reasons(frame, rules, name)
    return checked.where(F.size(name) == 0).drop(name), checked.where(F.size(name) > 0)


def strict(frame: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows; reading one that breaks a rule raises its first message."""
    checked = with_reasons(frame, rules, "_reasons")
    return checked.where(F.when(F.size("_reasons") > 0, F.raise_error(F.element_at("_reasons", 1)).cast("boolean")).otherwise(True)).drop("_reasons")


def lineage_rules(*names: str) -> list[Rule]:
    return [(F.coalesce(F.lower(F.trim(F.col(n))).isin(PLACEHOLDERS), F.lit(True)), f"lineage:{n}") for n in names]


def label_rules(label: str = "label", level: str = "level", weight: str = "weight", gold: str = "gold", tasks: Sequence[str] | None = None, task: str = "task") -> list[Rule]:
    """Rules of a label row: finite label, known level, weight in 0..1, gold only with direct evidence."""
    out: list[Rule] = [
        (~is_finite(F.col(label).cast("double")), "label:not_finite"),
        (F.coalesce(~F.col(level).rlike("^[EL][1-4]$"), F.lit(True)), "level:unknown"),
        (F.coalesce(~F.col(weight).between(0, 1), F.lit(True)), "weight:outside"),
        (F.col(gold) & ~F.coalesce(F.col(level).isin("E1", "E2"), F.lit(False)), "gold:weak_evidence"),
    ]
    return out if tasks is None else [(~F.coalesce(F.col(task).isin(list(tasks)), F.lit(False)), "task:unknown"), *out]


def edge_rules(src: str, dst: str, weight: str, kind: str, kinds: int = 6) -> list[Rule]:
    return [(F.col(src).isNull() | F.col(dst).isNull(), "edge:missing_end"), (~is_finite(F.col(weight).cast("double")), "edge:weight"), (F.coalesce(~F.col(kind).between(0, kinds - 1), F.lit(True)), "edge:kind")]


#: Views and tracks of a feature, the views of the second track, tasks, and names of versions.
VIEWS = ["protein", "protein_residue", "annotation", "structure_3di", "msa", "pssm", "omics", "dna", "dna_window", "rna"]
TRACKS = ["v1_protein", "v2_dna", "private_omics", "SOM", "INT"]
DNA_VIEWS = ["dna", "dna_window"]
DNA_TRACK = "v2_dna"
TASKS = ["H1", "H2", "H3", "H4", "H5", "T1", "T2", "T3a", "T3b", "T4"]
VERSIONS = ["model_version", "feature_version", "label_version", "batch_id"]


def feature_rules(key: str = "gene_id", view: str = "view", track: str = "track", embedding: str = "embedding") -> list[Rule]:
    """Rules of a feature row: a key, a known view and track that belong together, a vector that is not empty."""
    known = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    dna_view, dna_track = known(view, DNA_VIEWS), F.coalesce(F.col(track) == DNA_TRACK, F.lit(False))
    return [
        (F.col(key).isNull(), f"{key}:missing"), (~known(view, VIEWS), "view:unknown"), (~known(track, TRACKS), "track:unknown"),
        (dna_view & ~dna_track, "view:needs_its_track"), (dna_track & ~dna_view, "track:needs_its_view"), (F.coalesce(F.size(embedding), F.lit(0)) <= 0, "embedding:empty"),
    ]


def record_rules(kind: str) -> list[Rule]:
    """The rules of a kind of record (feature, label, graph), its lineage included; an absent field counts as null."""
    lineage = lineage_rules(*[f"lineage.{v}" for v in VERSIONS])
    if kind == "feature":
        return [*feature_rules(), *lineage]
    if kind == "label":
        return [(F.col("gene_id").isNull(), "gene_id:missing"), *label_rules(level="evidence_level", gold="training_eligible_as_gold", tasks=TASKS), *lineage]
    if kind == "graph":
        return edge_rules("src", "dst", "weight", "relation")
    raise ValueError(f"no kind of record: {kind}")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only, by one full outer join."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(key, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def effect_gate(rows: DataFrame, needed: Sequence[str], quality: Sequence[str], replicates: str, least: int = 2) -> DataFrame:
    """Rows with all ``needed`` fields, graded E2 if every quality flag holds and there are enough replicates, else E4."""
    full = rows.where(" AND ".join(f"`{c}` IS NOT NULL AND cast(`{c}` AS string) <> ''" for c in needed))
    good = F.coalesce(F.col(replicates) >= least, F.lit(False))
    for q in quality:
        good = good & F.coalesce(F.col(q), F.lit(False))
    return full.withColumn("level", F.when(good, "E2").otherwise("E4"))


def hard_gate(frame: DataFrame, above: dict[str, float], below: dict[str, float]) -> DataFrame:
    for name, limit in above.items():
        frame = frame.where(F.col(name) >= limit)
    for name, limit in below.items():
        frame = frame.where(F.col(name) < limit)
    return frame


#: Issues of a labelled collection and how grave they are.
ISSUES = {
    "EMPTY_SEQUENCES": "blocking", "EMPTY_LABELS": "blocking", "UNLABELED_SEQUENCES": "warning", "LABELS_WITHOUT_SEQUENCE": "warning",
    "DUPLICATE_SEQUENCE_IDS": "error", "SMALL_TASK": "warning", "SPLIT_OVERLAP": "blocking",
}


def inspect(items: DataFrame, labels: DataFrame, key: str, task: str, least: int = 5) -> DataFrame:
    """(issue, severity, task, n): what is wrong with a labelled collection; no row for issues without cases.

    n: 1 for an empty side, distinct keys without a label or an item, rows
    beyond the first of each key, labels of a task with fewer than ``least``
    (one row a task, which alone names it). A null key is a key.
    """
    same = lambda a, b: a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    n = F.count(F.lit(1))
    mine, theirs = items.select(key).distinct(), labels.select(key).distinct()
    found = [
        ("EMPTY_SEQUENCES", items.limit(1).agg((1 - n).alias("n"))),
        ("EMPTY_LABELS", labels.limit(1).agg((1 - n).alias("n"))),
        ("UNLABELED_SEQUENCES", same(mine, theirs).agg(n.alias("n"))),
        ("LABELS_WITHOUT_SEQUENCE", same(theirs, mine).agg(n.alias("n"))),
        ("DUPLICATE_SEQUENCE_IDS", items.groupBy(key).agg(n.alias("_c")).agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n"))),
        ("SMALL_TASK", labels.groupBy(F.col(task).cast("string").alias("task")).agg(n.alias("n")).where(F.col("n") < least)),
    ]
    out = None
    for issue, frame in found:
        named = frame.select(F.lit(issue).alias("issue"), F.lit(ISSUES[issue]).alias("severity"), F.col("task") if "task" in frame.columns else F.lit(None).cast("string").alias("task"), F.col("n").cast("long").alias("n"))
        out = named if out is None else out.unionByName(named)
    return out.where("n > 0")


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    magic = F.hex(F.substring(content, 1, 8))
    return F.when(magic.startswith("1F8B"), "gzip").when(magic.startswith("504B0304"), "zip").when(magic.startswith("89504E47"), "png").when(magic.startswith("25504446"), "pdf").when(magic.startswith("50415231"), "parquet").otherwise("other")


def eligible(rows: DataFrame, status: str, flags: str, **wanted: str) -> DataFrame:
    """Rows whose status is not invalid, that have no flags, and whose columns have the ``wanted`` values."""
    out = rows.where((F.col(status) != "invalid") & (F.size(flags) == 0))
    for column, value in wanted.items():
        out = out.where(F.col(column) == value)
    return out


def covered(rows: DataFrame, keys: Sequence[str], amount: Column, least: float) -> DataFrame:
    """(keys, total) of keys whose total amount is at least ``least``."""
    return rows.groupBy(*keys).agg(F.sum(amount).alias("total")).where(F.col("total") >= least)


def scored_rules(name: str, level: str, low: str, high: str, shares: Sequence[str]) -> list[Rule]:
    """Rules of a scored row: a name, a known level, an interval within 0..1, shares null or within 0..1."""
    inside = lambda c: is_finite(F.col(c).cast("double")) & F.col(c).between(0, 1)
    return [
        (F.coalesce(F.trim(F.col(name)), F.lit("")) == "", f"{name}:empty"),
        (F.coalesce(~F.col(level).isin("E1", "E2", "E3", "E4"), F.lit(True)), f"{level}:unknown"),
        (F.coalesce(~(inside(low) & inside(high) & (F.col(low) <= F.col(high))), F.lit(True)), "interval:outside"),
        *[(F.col(c).isNotNull() & ~F.coalesce(inside(c), F.lit(False)), f"{c}:outside") for c in shares],
    ]


def compatible(required: dict[str, object], aliases: dict[str, str]) -> Column:
    """Whether the version columns have the required values; ``aliases`` names the column that stands in for a null one."""
    out = F.lit(True)
    for column, value in required.items():
        own = F.coalesce(F.col(column), F.col(aliases[column])) if column in aliases else F.col(column)
        out = out & own.eqNullSafe(F.lit(value))
    return out


def verified_evidence(evidence: DataFrame, reference: DataFrame, key: str, text: str, sha: str, category: str, scope: Sequence[str]) -> DataFrame:
    """Curated rows against a reference table, with status: unknown_key, hash_mismatch (blanks apart, in upper case), out_of_scope, accepted."""
    actual = F.sha2(F.upper(F.regexp_replace(F.col(text), r"\s+", "")), 256)
    known = reference.groupBy(key).agg(F.min(actual).alias("_actual"), F.lit(True).alias("_known"))  # of several texts of a key the one with the smallest checksum
    stated = F.coalesce(F.col(sha), F.lit(""))
    status = (
        F.when(F.col("_known").isNull(), "unknown_key").when((stated != "") & ~F.col("_actual").eqNullSafe(stated), "hash_mismatch")
        .when(~F.coalesce(F.upper(F.col(category)).isin(list(scope)), F.lit(False)), "out_of_scope").otherwise("accepted")
    )
    return evidence.join(known, key, "left").withColumn("status", status).drop("_actual", "_known")


def with_lineage(rows: DataFrame, rules: Sequence[Rule], lineage: dict[str, str]) -> DataFrame:
    """The rows, which must break no rule, with constant version columns, which must say something."""
    empty = [n for n, v in lineage.items() if v.strip().lower() in PLACEHOLDERS]
    if empty:
        raise ValueError(f"versions that say nothing: {empty}")
    return strict(rows, rules).withColumns({n: F.lit(v) for n, v in lineage.items()})


def split_overlaps(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(a, b, n): pairs of splits with keys in both."""
    pairs = rows.select(key, F.col(split).alias("a")).distinct().join(rows.select(key, F.col(split).alias("b")).distinct(), key).where(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def verdict(issues: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row: status (fail if an issue is blocking, splits that share keys included; warn if there is any; else pass), the issues, and the training policy that follows.

    Policy: review (by hand before training: where it fails) and repeated
    (repeated grouped cross-validation: where a task is small); dropping
    duplicates and weights by number and by evidence always hold.
    """
    split = overlaps.limit(1).select(F.lit("SPLIT_OVERLAP").alias("issue"), F.lit(ISSUES["SPLIT_OVERLAP"]).alias("severity"))
    found = issues.select("issue", "severity").unionByName(split)
    worst = found.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity") == "blocking").alias("_f"), F.count_if(F.col("issue") == "SMALL_TASK").alias("_s"), F.array_sort(F.collect_set("issue")).alias("_i"))
    status = F.when(F.col("_f") > 0, "fail").when(F.col("_n") > 0, "warn").otherwise("pass")
    return worst.select(status.alias("status"), F.array_join("_i", ",").alias("issues"), (status == "fail").alias("review"), (F.col("_s") > 0).alias("repeated"))
