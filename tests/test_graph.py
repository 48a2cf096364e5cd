"""Traversals on small graphs, hand-worked."""

import datetime as dt

from orrery.operators import graph, rules, temporal, traversal
from orrery.session import TenantSession
from pyspark.sql import functions as F

EV = "array<struct<source:string,observed_at:timestamp,detail:string>>"


def items(spark, *rows):
    return spark.createDataFrame([(i, t, i, i.upper()) for i, t in rows], "id string, type string, external_id string, name string")


def links(spark, *rows):
    rows = [(t, a, b, *(list(more) + ["", 1.0][len(more) :])) for t, a, b, *more in rows]
    df = spark.createDataFrame(rows, "type string, from_id string, to_id string, edge_key string, confidence double")
    return df.withColumns({"source": F.lit("declared"), "evidence": F.array(F.struct(F.lit("s").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.col("edge_key").alias("detail")))})


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def chain(spark):
    return items(spark, ("vpc-1", "vpc"), ("sub-1", "subnet"), ("i-1", "ec2_instance"), ("db-1", "rds")), links(spark, ("CONTAINS", "vpc-1", "sub-1"), ("CONTAINS", "sub-1", "i-1"), ("DEPENDS_ON", "i-1", "db-1"))


def test_blast_radius_of_a_chain(spark):
    cis, edges = chain(spark)
    got = {(r.seed, r.id): r.distance for r in traversal.blast_radius(cis, edges, seeds(spark, "vpc-1", "db-1")).collect()}
    assert got == {("vpc-1", "sub-1"): 1, ("vpc-1", "i-1"): 2, ("db-1", "i-1"): 1}
    assert traversal.blast_radius(cis, edges, seeds(spark, "vpc-1"), max_depth=0).count() == 0
    assert traversal.blast_radius(cis, edges, seeds(spark, "vpc-1"), max_depth=1).count() == 1


def test_supernode_and_cap(spark):
    cis = items(spark, ("v", "vpc"), *((f"s{k}", "subnet") for k in range(5)))
    edges = links(spark, *(("CONTAINS", "v", f"s{k}") for k in range(5)))
    assert [r.id for r in traversal.blast_radius(cis, edges, seeds(spark, "v"), max_fanout=2).collect()] == ["s0", "s1"]
    assert [tuple(r)[1:] for r in traversal.truncated(cis, edges, seeds(spark, "v"), max_fanout=2).collect()] == [("v", 5, 0)]
    assert traversal.truncated(cis, edges, seeds(spark, "v"), max_fanout=5).count() == 0


def test_loops_parallel_edges_thresholds_and_closed_ends(spark):
    cis = items(spark, ("a", "vpc"), ("b", "subnet"), ("c", "subnet"))
    edges = links(spark, ("CONTAINS", "a", "a"), ("CONTAINS", "a", "b", "x", 0.7), ("CONTAINS", "a", "b", "y", 0.2), ("CONTAINS", "b", "a"), ("CONTAINS", "b", "c", "", 0.69), ("CONTAINS", "b", "gone"))
    assert {r.id for r in traversal.blast_radius(cis, edges, seeds(spark, "a"), min_confidence=0.7).collect()} == {"b"}
    assert {(r.id, r.distance) for r in traversal.blast_radius(cis, edges, seeds(spark, "a")).collect()} == {("b", 1), ("c", 2)}


def test_reachability_paths_and_evidence(spark):
    cis = items(spark, ("net", "internet"), ("l", "elb"), ("m", "elb"), ("db", "rds"))
    edges = links(spark, ("CONNECTS_TO", "net", "l"), ("CONNECTS_TO", "net", "m"), ("ROUTES_TO", "l", "db", "b"), ("ROUTES_TO", "l", "db", "a"), ("ROUTES_TO", "m", "db"))
    found = traversal.reachability(cis, edges, seeds(spark, "db"))
    net = {r.id: r for r in found.collect()}["net"]
    assert net.is_internet and net.distance == 2 == len(net.path) and [(h.from_id, h.to_id) for h in net.path] == [("net", "l"), ("l", "db")]
    hops = traversal.with_hop_evidence(found.where("id = 'net'"), edges, ["id"]).orderBy("pos").collect()
    assert [h.evidence[0].detail for h in hops] == ["", "a"]
    assert traversal.reached_by_internet(found).first().reached_by_internet
    assert [r.subject_ci_id for r in rules.internet_databases(cis, edges).collect()] == ["db"]


def test_what_if_multiplies_confidences(spark):
    cis = items(spark, ("db", "rds"), ("i", "ec2_instance"), ("j", "ec2_instance"))
    edges = links(spark, ("DEPENDS_ON", "i", "db", "", 0.8), ("RUNS_ON", "j", "i", "", 0.5))
    got = {r.id: r.confidence for r in traversal.what_if(cis, edges, seeds(spark, "db"), "modify").collect()}
    assert got == {"i": 0.4, "j": 0.2}
    assert {r.confidence for r in traversal.what_if(cis, edges, seeds(spark, "db"), "remove", compat=True).collect()} == {1.0}


def versions(spark, *rows):
    t = lambda d: None if d is None else dt.datetime(2024, 1, d)
    return spark.createDataFrame([(i, "vpc", n, t(a), t(b)) for i, n, a, b in rows], "id string, type string, name string, valid_from timestamp, valid_to timestamp")


def test_change_feed_and_as_of(spark):
    v = versions(spark, ("a", "x", 1, 5), ("a", "y", 5, 8), ("b", "x", 5, None), ("c", "x", 2, 8), ("c", "x", 9, None))
    at = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    got = {(r.id, r.kind, r.at.day) for r in temporal.changes(v, "ci", at(5), at(9)).collect()}
    assert got == {("a", "updated", 5), ("a", "removed", 8), ("b", "created", 5), ("c", "removed", 8)}
    assert {(r.id, r.name) for r in temporal.as_of(v, at(5)).collect()} == {("a", "y"), ("b", "x"), ("c", "x")}
    edges = v.withColumns({"from_id": F.lit("a"), "to_id": F.lit("b")})
    assert temporal.change_feed(v, edges, at(9), 0).count() == 0
    assert [r.at.day for r in temporal.change_feed(v, edges, at(9), 4).collect()] == [8, 8, 8, 8, 5, 5, 5, 5]


def test_root_cause_prefers_near_and_recent(spark):
    cis, edges = chain(spark)
    near = traversal.rca_neighborhood(cis, edges, seeds(spark, "i-1"))
    assert {(r.id, r.distance) for r in near.collect()} == {("i-1", 0), ("db-1", 1), ("sub-1", 1), ("vpc-1", 2)}
    rows = [("ci", "updated", dt.datetime(2024, 1, 1, 23), "db-1", "rds", "DB", None, None), ("ci", "removed", dt.datetime(2024, 1, 1, 1), "vpc-1", "vpc", None, None, None), ("edge", "created", dt.datetime(2024, 1, 1, 12), "e", "CONTAINS", None, "far", "i-1"), ("ci", "updated", dt.datetime(2024, 1, 2), "db-1", "rds", "DB", None, None)]
    feed = spark.createDataFrame(rows, "entity string, kind string, at timestamp, id string, type string, name string, from_id string, to_id string")
    got = traversal.root_cause(near, feed, dt.datetime(2024, 1, 2)).collect()
    assert [r.id for r in got] == ["db-1", "vpc-1", "e"]
    assert got[0].evidence == "ci DB was updated 1:00:00 before the incident, 1 hop upstream"
    assert abs(got[0].score - 2 * (0.5 + 24 / 25)) < 1e-12


def test_tenants_are_apart(spark):
    t = spark.createDataFrame([("a", "x"), ("b", "x")], "tenant_id string, id string").withColumn("valid_to", F.lit(None).cast("timestamp"))
    assert TenantSession(spark, "a", tables={"cis": t}).open("cis").count() == 1
    assert TenantSession(spark, None, tables={"cis": t}).table("cis").count() == 0


def test_adjacency_plan_prunes_columns(spark, data, tmp_path):
    cis, edges = chain(spark)
    edges.write.parquet(str(tmp_path / "e"))
    plan = graph.adjacency(spark.read.parquet(str(tmp_path / "e")), "impact", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "evidence" not in plan and "PushedFilters: [IsNotNull(confidence), GreaterThanOrEqual(confidence,0.5)" in plan
