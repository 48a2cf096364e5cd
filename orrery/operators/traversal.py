"""Blast radius, reachability, root cause, what-if and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import timedelta_text
from ..schema import KIND_WEIGHTS
from . import graph


def _walked(cis: DataFrame, edges: DataFrame, walk: str, least: float, kept: graph.Projection | graph.Walks | None) -> DataFrame:
    return kept.walk(walk, least) if kept else graph.adjacency(edges, walk, least, cis)


def _steps(cis: DataFrame, edges: DataFrame, walk: str, least: float, max_fanout: int | None, kept: graph.Projection | graph.Walks | None):
    """What graph.bfs() expands by: the capped adjacency, looked up for the nodes of a level where it is kept."""
    return (graph.looked_up if kept else graph.capped)(_walked(cis, edges, walk, least, kept), max_fanout)


def blast_radius(cis: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, min_confidence: float = 0.0, max_fanout: int | None = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, id, type, name, distance) of what a failure of each seed affects, nearest first. With kept, here and below, steps
    come from a projection of the graph in place of edges."""
    adj = _steps(cis, edges, "impact", min_confidence, max_fanout, kept)
    found = graph.current_details(graph.bfs(adj, seeds, max_depth, kept=bool(kept)).where("distance > 0"), cis)
    return found.select("seed", F.col("node").alias("id"), "type", "name", "distance").orderBy("seed", "distance", "type", "id")


def truncated(cis: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, min_confidence: float = 0.0, max_fanout: int = 1000, walk: str = "impact", kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, id, degree, depth) of the supernodes at which a search was cut."""
    adj = _walked(cis, edges, walk, min_confidence, kept)
    return graph.supernodes(adj, graph.bfs((graph.looked_up if kept else graph.capped)(adj, max_fanout), seeds, max_depth, kept=bool(kept)), max_depth, max_fanout)


def reachability(cis: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 6, min_confidence: float = 0.0, max_fanout: int | None = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, id, type, name, distance, is_internet, path) of what can reach each target: path runs from the source
    to the target, one (type, from_id, to_id) for each of its `distance` hops."""
    adj = _steps(cis, edges, "reach", min_confidence, max_fanout, kept)
    reached = graph.bfs(adj, targets, max_depth, parents=True, kept=bool(kept))
    found = graph.current_details(reached.where("distance > 0").select("seed", "node", "distance"), cis)
    paths = graph.chained(found, reached.select("seed", "node", "parent", graph.hop().alias("hop")), ["seed"], max_depth)
    return paths.select("seed", F.col("node").alias("id"), "type", "name", "distance", (F.col("type") == "internet").alias("is_internet"), F.reverse("hops").alias("path")).orderBy("seed", "distance", "type", "id")


def reached_by_internet(sources: DataFrame) -> DataFrame:
    """(seed, reached_by_internet) of targets with a source, from reachability()."""
    return sources.groupBy("seed").agg(F.bool_or("is_internet").alias("reached_by_internet"))


def nearest_internet(cis: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 6, min_confidence: float = 0.0, max_fanout: int | None = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, internet_id, distance, path) of the targets that an internet item reaches, by the nearest one (ties: least id): what
    reachability() finds for each, by one search from all internet items whatever the number of targets."""
    adj = graph.capped(_walked(cis, edges, "reach", min_confidence, kept), max_fanout)
    near = graph.nearest(adj, cis.where("type = 'internet'").select("id"), max_depth, kept.buckets if kept else None)
    wanted = near.where("distance > 0").join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", F.col("source").alias("internet_id"), "distance")
    # Steps lead from a target to what reaches it, so a parent is nearer to the internet and the step itself is walked against its edge.
    toward = F.struct("type", F.when(F.col("dir") == 0, F.col("node")).otherwise(F.col("parent")).alias("from_id"), F.when(F.col("dir") == 0, F.col("parent")).otherwise(F.col("node")).alias("to_id"))
    paths = graph.chained(wanted, near.select("node", "parent", toward.alias("hop")), [], max_depth)
    return paths.select(F.col("node").alias("seed"), "internet_id", "distance", F.col("hops").alias("path"))


def exposure(cis: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 6, min_confidence: float = 0.0, max_fanout: int | None = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, reached_by_internet) of every target."""
    adj = graph.capped(_walked(cis, edges, "reach", min_confidence, kept), max_fanout)
    near = graph.nearest(adj, cis.where("type = 'internet'").select("id"), max_depth, kept.buckets if kept else None)
    hit = near.where("distance > 0").select(F.col("node").alias("seed"), F.lit(True).alias("_hit"))
    return targets.select(F.col("id").alias("seed")).distinct().join(hit, "seed", "left").select("seed", F.coalesce("_hit", F.lit(False)).alias("reached_by_internet"))


def edges_of_hops(hops: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """hops (type, from_id, to_id and more) with `edge`: some columns of its open edge, the one of the least edge_key where edges are parallel; null
    without one. Edges are cut to those of the hops before they are gathered."""
    key = ["type", "from_id", "to_id"]
    known = edges.join(hops.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*columns), "edge_key").alias("edge"))
    return hops.join(known, key, "left")


def with_hop_evidence(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """paths (key, path) as one row per hop with the source, confidence and evidence of its open edge; a hop without one has no evidence."""
    hops = paths.select(*key, F.posexplode("path").alias("pos", "hop")).select(*key, "pos", "hop.*")
    joined = edges_of_hops(hops, edges, "source", "confidence", "evidence")
    return joined.select(*key, "pos", "type", "from_id", "to_id", "edge.source", "edge.confidence", F.coalesce("edge.evidence", F.array()).alias("evidence"))


def rca_neighborhood(cis: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 3, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(seed, id, type, name, distance): what each target depends on, itself at 0, without a fan-out cap."""
    adj = _steps(cis, edges, "upstream", 0.0, None, kept)
    found = graph.current_details(graph.bfs(adj, targets, max_depth, kept=bool(kept)), cis)
    return found.select("seed", F.col("node").alias("id"), "type", "name", "distance")


def rca_score(kind, distance, age_seconds, lookback_seconds: float):
    """Weight of the kind of change, times nearness in the graph plus nearness in time."""
    weight = F.lit(1.0)
    for name, w in KIND_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(w)).otherwise(weight)
    return weight * (1.0 / (1.0 + distance) + lookback_seconds / (lookback_seconds + age_seconds))


def root_cause(neighborhood: DataFrame, changes: DataFrame, incident_at, lookback_hours: float = 24) -> DataFrame:
    """Candidate changes in [incident - lookback, incident) in the neighbourhood, best first. changes is a change feed
    (entity, kind, at, id, type, name, from_id, to_id); an edge is as near as its nearest end."""
    incident = F.lit(incident_at)
    lookback = lookback_hours * 3600.0
    window = changes.where((F.col("at") >= incident - F.expr(f"interval {int(lookback)} seconds")) & (F.col("at") < incident))
    ends = window.withColumn("_end", F.explode(F.when(F.col("entity") == "ci", F.array("id")).otherwise(F.array("from_id", "to_id"))))
    near = neighborhood.select("seed", F.col("id").alias("_end"), "distance")
    key = ["seed", "entity", "kind", "at", "id", "type", "name", "from_id", "to_id"]
    found = ends.join(near, "_end").groupBy(*key).agg(F.min("distance").alias("distance"))
    age = (F.unix_micros(incident.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    out = found.withColumn("age_seconds", age).withColumn("score", rca_score(F.col("kind"), F.col("distance"), F.col("age_seconds"), lookback))
    hops = F.when(F.col("distance") == 1, "hop").otherwise("hops")
    told = F.concat_ws("", F.col("entity"), F.lit(" "), F.coalesce("name", "id"), F.lit(" was "), F.col("kind"), F.lit(" "), timedelta_text(F.floor("age_seconds")), F.lit(" before the incident, "), F.col("distance"), F.lit(" "), hops, F.lit(" upstream"))
    return out.withColumn("evidence", told).orderBy("seed", F.desc("score"), "distance", "age_seconds", "entity", "id")


WHATIF_METHOD = "Bounded walk of dependencies; a path's confidence is the product of its hops' confidences."
WHATIF_DISCLAIMER = "An estimate from the recorded graph: what was not recorded is not seen."


def what_if(
    cis: DataFrame, edges: DataFrame, seeds: DataFrame, change_kind: str, max_depth: int = 4, min_confidence: float = 0.0, max_fanout: int | None = 1000, compat: bool = False, kept: graph.Projection | graph.Walks | None = None
) -> DataFrame:
    """(seed, id, type, name, distance, confidence, hops_text) of what removing or modifying each seed affects.

    confidence is the product of the hops' confidences, halved for `modify`. With compat, a hop walked against its edge counts
    as declared and certain, as a look-up in walking direction would have it. edges are needed with kept too, for their confidences."""
    if change_kind not in ("remove", "modify"):
        raise ValueError("change_kind must be remove or modify")
    adj = _steps(cis, edges, "impact", min_confidence, max_fanout, kept)
    reached = graph.bfs(adj, seeds, max_depth, parents=True, kept=bool(kept))
    steps = reached.where("distance > 0").select("seed", "node", "parent", "dir", graph.hop().alias("h")).select("seed", "node", "parent", "dir", "h.*")
    known = edges_of_hops(steps, edges, "confidence")
    certain = F.lit(1.0) if compat else F.col("edge.confidence")
    c = F.coalesce(F.when(F.col("dir") == 0, F.col("edge.confidence")).otherwise(certain), F.lit(1.0))
    found = graph.current_details(reached.where("distance > 0").select("seed", "node", "distance"), cis).withColumnRenamed("type", "_type")
    paths = graph.chained(found, known.select("seed", "node", "parent", F.struct("type", c.alias("c")).alias("hop")), ["seed"], max_depth)
    product = F.aggregate("hops", F.lit(1.0), lambda a, x: a * x["c"]) * (1.0 if change_kind == "remove" else 0.5)
    out = paths.select("seed", F.col("node").alias("id"), F.col("_type").alias("type"), "name", "distance", product.alias("confidence"), F.array_join("hops.type", ">").alias("hops_text"))
    return out.orderBy("seed", "distance", F.desc("confidence"), "type", "id")


def topology(cis: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first `limit` open items by (type, external_id, id), and the open edges between them."""
    nodes = cis.orderBy("type", "external_id", "id").limit(limit)
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, inside
