"""Connected groups of rows that share buckets. Buckets are compared block by block, and no pair leaves its block but as a
link that joins two groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Times the size of a block from which a bucket that still holds several components is dealt to finer buckets before its parts are
#: compared with each other.
SPLIT_FROM = 16


def sized(members: DataFrame) -> DataFrame:
    """members (key, id) of buckets of two ids and more, with the bucket's count n. Members are shuffled once, as buckets are counted where they
    meet: a join of the counts would shuffle all again when these are too many to broadcast."""
    return members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")


def dealt(members: DataFrame, limit: int) -> DataFrame:
    """Adds `block` to members (key, id, n): a bucket of up to `limit` is one block. A larger one is dealt out twice, by two
    hashes of the id, so that each member meets two random parts of about half of `limit` members, through which
    groups that are alike throughout become one."""
    parts = F.ceil(F.col("n") / (limit / 2)).cast("long")
    many = F.col("n") > limit
    twice = members.withColumn("_deal", F.explode(F.when(many, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumn("block", F.when(many, parts * F.col("_deal") + F.pmod(F.xxhash64("id", "_deal"), parts)).otherwise(0)).drop("_deal", "n")


def crossed(members: DataFrame, limit: int) -> DataFrame:
    """Adds `block` to members (key, id, n) so that each two of a bucket meet in one block of about `limit` members."""
    parts = F.ceil(F.col("n") / (limit / 2)).cast("long")
    own = members.withColumn("_part", F.pmod(F.xxhash64("id"), parts))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return each.withColumn("block", F.least("_part", "_other") * parts + F.greatest("_part", "_other")).drop("_part", "_other", "n")


def linked_components(
    members: DataFrame,
    compare: Callable[[DataFrame, DataFrame | None], DataFrame],
    limit: int,
    split: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, component) of the graph whose links are the pairs of ids that share a bucket and pass `compare`.

    members has (key, id, n) with the count of its bucket's members, two or more; with the columns beside them, which
    go along. compare(blocks, components) gets (key, block, id) and gives links (a, b) that decide each
    pair of a block: two ids of a block that pass are linked, or joined through others. Buckets of more than `limit`
    members that then hold several components go on: `split`, if there is one, deals the members (key, id) of those of more
    than SPLIT_FROM * limit to finer buckets, in which most of what is alike becomes one; it decides nothing. Each bucket that is then still
    mixed is compared part by part, each part with each, so a pair is decided alike in a bucket of any size. Null ids are not among the members."""
    links = compare(dealt(members, limit), None)
    components = common.written(common.connected_components(links, "a", "b"), "components")
    common.discard(links)
    many = members.where(F.col("n") > limit)
    large = _mixed(many, components)
    huge = large.where(F.col("n") > SPLIT_FROM * limit)
    if split is not None and not huge.isEmpty():
        finer = common.written(sized(split(huge)), "finer")
        links = compare(dealt(finer, limit), components)
        components, before = joined(components, links), components
        common.discard(links, finer, large, *([before] if before is not components else []))
        large = _mixed(many, components)
    if not large.isEmpty():
        links = compare(crossed(large, limit), components)
        components, before = joined(components, links), components
        common.discard(links, *([before] if before is not components else []))
    return components


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after some more links, of which there may be none; else a new table. Links join components, which are few rows."""
    if links.isEmpty():
        return components
    a = components.select(F.col("id").alias("a"), F.col("component").alias("_a"))
    b = components.select(F.col("id").alias("b"), F.col("component").alias("_b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
    merged = common.written(common.connected_components(between, "a", "b"), "merged")
    old = components.join(merged.select(F.col("id").alias("component"), F.col("component").alias("_new")), "component", "left")
    kept = old.select("id", F.coalesce("_new", "component").alias("component"))
    born = merged.join(components, "id", "left_anti").select("id", "component")
    out = common.written(kept.unionByName(born), "components")
    common.discard(merged)
    return out


def with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """rows with the component of their id, which is the id itself where there is none."""
    named = rows.join(components.withColumnRenamed("component", "_of"), "id", "left")
    return named.withColumn("component", F.coalesce("_of", "id")).drop("_of")


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members of buckets of several components."""
    named = with_component(members, components)
    keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return common.written(members.join(keys, "key", "left_semi"), "mixed")
