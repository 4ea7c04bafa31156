"""Grading of evidence, resolving of labels, manifests. Unknown is never turned into a negative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import is_finite

#: Weights of the evidence levels.
WEIGHTS = {"E1": 1.0, "E2": 0.8, "E3": 0.4, "E4": 0.2}


def _any(text: Column, tokens: Sequence[str]) -> Column:
    lowered, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for t in tokens:
        out = out | lowered.contains(t)
    return out


def grade(private: Column, assay: Column, source: Column, reference: Column, target: Column, direct_tokens: Sequence[str], computed_tokens: Sequence[str]) -> Column:
    """Level E1 to E4 by an ordered list of decisions; a source's name alone never promotes."""
    direct = _any(assay, direct_tokens)
    referenced = F.coalesce(F.trim(reference) != "", F.lit(False))
    return (
        F.when(F.coalesce(private, F.lit(False)) & direct, "E2")
        .when(direct & referenced & F.coalesce(target, F.lit(False)), "E1")
        .when(_any(F.concat_ws(" ", source, assay), computed_tokens), "E3")
        .otherwise("E4")
    )


def grade_reason(level: Column) -> Column:
    """In words, why a row has its level."""
    texts = {"E1": "direct assay on the target with a reference", "E2": "direct assay in private data", "E3": "computed", "E4": "no direct assay stated"}
    return F.coalesce(*[F.when(level == name, text) for name, text in texts.items()])


def level_weight(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in WEIGHTS.items():
        out = F.when(level == name, weight).otherwise(out)
    return out


#: Roles of a group of labels.
ROLES = ("quarantine_conflict", "direct_supervision", "weak_supervision_only")


def resolve_labels(labels: DataFrame, keys: Sequence[str], label: str = "label", level: str = "level") -> DataFrame:
    """One row a key: n, n_values, conflict, role. Opposite finite labels are set aside, not averaged."""
    value = F.when(is_finite(F.col(label).cast("double")), F.col(label).cast("double"))
    out = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("n_values"), F.max(F.coalesce(F.col(level).isin("E1", "E2"), F.lit(False))).alias("_direct"))
    role = F.when(F.col("n_values") > 1, ROLES[0]).when(F.col("_direct"), ROLES[1]).otherwise(ROLES[2])
    return out.withColumn("conflict", F.col("n_values") > 1).withColumn("role", role).drop("_direct")


def with_resolved(labels: DataFrame, keys: Sequence[str], label: str = "label", level: str = "level") -> DataFrame:
    """The label rows, each with its group's conflict and role (an aggregate joined back, so a hot key stays split)."""
    return labels.join(resolve_labels(labels, keys, label, level).select(*keys, "conflict", "role"), list(keys))


def training_manifest(labels: DataFrame, key: str, task: str, label: str = "label", level: str = "level") -> DataFrame:
    """One row an entity: its tasks by role (sorted, distinct) and its status: conflict, then direct, then weak."""
    per_task = resolve_labels(labels, [key, task], label, level)
    pick = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col(task))))
    out = per_task.groupBy(key).agg(pick("direct_supervision").alias("direct_tasks"), pick("weak_supervision_only").alias("weak_tasks"), pick("quarantine_conflict").alias("conflict_tasks"))
    status = F.when(F.size("conflict_tasks") > 0, "conflict").when(F.size("direct_tasks") > 0, "direct").otherwise("weak")
    return out.withColumn("status", status)


def best_level(labels: DataFrame, keys: Sequence[str], level: str = "level") -> DataFrame:
    return labels.groupBy(*keys).agg(F.min(level).alias("best_level"))


def identity_conflicts(rows: DataFrame, key: str, title: Column) -> DataFrame:
    """Keys that stand for several titles."""
    return rows.withColumn("_title", title).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_title").alias("n_titles")).where("n_titles > 1")


def not_yet_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among those done before."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def review_status(rows: DataFrame, reviews: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """Adds review_status: accepted, rejected or pending, of the last verdict by name."""
    last = reviews.groupBy(key).agg(F.max(verdict).alias("_verdict"))
    return rows.join(last, key, "left").withColumn("review_status", F.when(F.col("_verdict") == "accept", "accepted").when(F.col("_verdict").isNotNull(), "rejected").otherwise("pending")).drop("_verdict")


def merge_ledger(rows: DataFrame, key: str, order: Sequence[str], first: Sequence[str], gathered: str) -> DataFrame:
    """One row a key: fields of its first row, the distinct values of ``gathered``, and whether the fields differ."""
    head = [F.min_by(F.struct(*first), F.struct(*order)).alias("_first"), F.sort_array(F.collect_set(gathered)).alias("gathered"), (F.countDistinct(F.struct(*first)) > 1).alias("conflict")]
    return rows.groupBy(key).agg(*head).select(key, *[F.col(f"_first.{c}").alias(c) for c in first], "gathered", "conflict")


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor blank, as text."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns])


def label_rows(rows: DataFrame, keys: Sequence[str], values: Sequence[str], source: str, task: Column | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """(key, task, label, source) of raw rows, from the first filled key and value column; rows without a key, a task or a number go, numbers outside 0..1 are an error."""
    key = first_of(*[F.col(c) for c in keys])
    named = first_of(task if task is not None else F.lit(None).cast("string"), F.col("task") if "task" in rows.columns else F.lit(None).cast("string"))
    for old, new in (renamed or {}).items():
        named = F.when(named == old, new).otherwise(named)
    number = F.expr(f"try_cast({_first_sql(values)} AS double)")
    out = rows.select(key.alias("key"), named.alias("task"), number.alias("label"), F.coalesce(first_of(F.col("source")) if "source" in rows.columns else F.lit(None).cast("string"), F.lit(source)).alias("source"))
    kept = out.where(F.col("key").isNotNull() & F.col("task").isNotNull() & F.col("label").isNotNull())
    label = F.when(F.col("label").between(0, 1), F.col("label")).otherwise(F.raise_error(F.lit("a label lies outside 0..1")).cast("double"))
    return kept.withColumn("label", label)


def _first_sql(columns: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(cast(`{c}` AS string)), '')" for c in columns) + ")"


def union_sources(sources: dict[str, DataFrame], level: Column) -> DataFrame:
    """(key, task, label, source, origin, level) of several tables of (key, task, label, source): origin names the table and is kept as such; ``level`` grades each row anew."""
    out = None
    for origin, frame in sources.items():
        part = frame.select("key", "task", "label", "source").withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("level", level)


def gold_lookup(wanted: DataFrame, labels: DataFrame, key: str, task: str, levels: Sequence[str] = ("E1", "E2")) -> DataFrame:
    """Adds label and status (found, missing, conflict) to the wanted keys, from labels of one task with direct evidence only; null levels: any."""
    rows = labels.where(F.col("task") == task)
    rows = rows.where(F.col("level").isin(list(levels))) if levels else rows
    per = rows.groupBy(key).agg(F.countDistinct("label").alias("_n"), F.min("label").alias("_label"))
    status = F.when(F.col("_n").isNull() | (F.col("_n") == 0), "missing").when(F.col("_n") > 1, "conflict").otherwise("found")
    return wanted.join(per, key, "left").withColumn("label", F.when(F.col("_n") == 1, F.col("_label"))).withColumn("status", status).drop("_n", "_label")


def study_report(rows: DataFrame, study: str, **summaries: Column) -> DataFrame:
    """One row a study with the summaries, and the checksum of the row as JSON."""
    per = rows.groupBy(study).agg(*[c.alias(n) for n, c in summaries.items()])
    return per.withColumn("report_sha256", F.sha2(F.to_json(F.struct(*per.columns)), 256))
