"""Reads of versioned tables: current, as of a time, history, and the feed of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(versions: DataFrame, **equal) -> DataFrame:
    """Open rows, with equality predicates on columns that are given a value."""
    out = versions.where("valid_to is null")
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """Rows valid at a time: from valid_from on, until before valid_to."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def history(versions: DataFrame, entity_id) -> DataFrame:
    return versions.where(F.col("id") == entity_id).orderBy("valid_from")


def graph_as_of(cis: DataFrame, edges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges valid at a time; edges only between such items."""
    nodes = as_of(cis, at)
    ids = nodes.select("id")
    links = as_of(edges, at).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, links


def changes(versions: DataFrame, entity: str, since: Column, until: Column) -> DataFrame:
    """(entity, kind, at, id, type, name, from_id, to_id) of changes in [since, until), unordered.

    A version opened in it is `updated` if its predecessor ends where it begins, else `created`; one closed in it whose
    successor doesn't begin there is `removed`. One window over each id's versions stands for the look-ups of both
    neighbours, as versions of an id don't overlap."""
    by_id = Window.partitionBy("id").orderBy("valid_from")
    seen = versions.withColumn("_before", F.lag("valid_to").over(by_id)).withColumn("_after", F.lead("valid_from").over(by_id))
    within = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    opened = F.when(within("valid_from"), F.struct(F.when(F.col("_before") == F.col("valid_from"), "updated").otherwise("created").alias("kind"), F.col("valid_from").alias("at")))
    closed = F.when(within("valid_to") & ~F.col("_after").eqNullSafe(F.col("valid_to")), F.struct(F.lit("removed").alias("kind"), F.col("valid_to").alias("at")))
    none = F.lit(None).cast("string")
    name, ends = ("name", (none, none)) if entity == "ci" else (none, ("from_id", "to_id"))
    return (
        seen.withColumn("_e", F.explode(F.array_compact(F.array(opened, closed))))
        .select(F.lit(entity).alias("entity"), "_e.kind", "_e.at", "id", "type", (F.col(name) if isinstance(name, str) else name).alias("name"), *((F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(ends, ("from_id", "to_id"))))
    )


def change_feed(cis: DataFrame, edges: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Changes of items and edges in the `days` before now, newest first, items before edges."""
    since = now - F.make_dt_interval(days=F.lit(days))
    return changes(cis, "ci", since, now).unionByName(changes(edges, "edge", since, now)).orderBy(F.desc("at"), "entity", "id", "kind")


def count_by_type(cis: DataFrame) -> DataFrame:
    return current(cis).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def open_findings(findings: DataFrame, rule_id: str | None = None) -> DataFrame:
    """Open findings, newest first."""
    out = findings.where("valid_to is null and status = 'open'")
    return (out if rule_id is None else out.where(F.col("rule_id") == rule_id)).orderBy(F.desc("detected_at"), F.desc("id"))


def finding_for_subject(findings: DataFrame, rule_id: str, subject_ci_id: str) -> DataFrame:
    """The open finding of a rule on an item: one row (the newest, should there be several) or none."""
    return open_findings(findings.where(F.col("subject_ci_id") == subject_ci_id), rule_id).limit(1)


def top(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last `limit` rows by some columns; a negative limit is none."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(max(0, limit))
