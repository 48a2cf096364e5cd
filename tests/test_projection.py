"""Searches against a queue in plain Python, and the kept projection."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, rules, traversal
from orrery.schema import WALKS
from test_graph import items, links, seeds


def random_graph(seed, nodes=14, count=40):
    draw = random.Random(seed)
    kinds = ["internet", "elb", "ec2_instance", "rds", "vpc"]
    cis = [(f"n{k:02d}", kinds[k % 5]) for k in range(nodes)]
    types = ["CONTAINS", "DEPENDS_ON", "ROUTES_TO", "CONNECTS_TO", "HAS_ACCESS_TO", "EXPOSES"]
    edges = {(draw.choice(types), f"n{draw.randrange(nodes):02d}", f"n{draw.randrange(nodes):02d}", draw.choice(["", "", "k"])): draw.choice([0.5, 0.75, 1.0]) for _ in range(count)}
    return cis, [(*e, c) for e, c in edges.items()]


def queue(edges, seed, walk, depth, cap, least=0.0):
    """{node: (distance, path of (type, from, to))} as one queue finds them."""
    forward, backward = WALKS[walk]
    near = {}
    for t, a, b, key, c in edges:
        if c >= least:
            if t in forward:
                near.setdefault(a, {}).setdefault(b, []).append((0, t, key, a, b))
            if t in backward:
                near.setdefault(b, {}).setdefault(a, []).append((1, t, key, a, b))
    found, todo = {seed: (0, [])}, deque([seed])
    while todo:
        at = todo.popleft()
        distance, path = found[at]
        if distance == depth:
            continue
        steps = sorted((min(s)[0], b, min(s)) for b, s in near.get(at, {}).items())
        for _, b, (_, t, _, x, y) in steps[:cap]:
            if b not in found:
                found[b] = (distance + 1, [*path, (t, x, y)])
                todo.append(b)
    return found


@pytest.mark.parametrize("seed,cap", [(2, 2)])
def test_searches_find_what_a_queue_finds(spark, seed, cap):
    nodes, edges = random_graph(seed)
    cis, e = items(spark, *nodes), links(spark, *edges)
    kept = graph.Projection.build(cis, e, buckets=3)
    everything = [i for i, _ in nodes]
    for depth in (4,):
        want = {(s, n): (d, p[::-1]) for s in everything for n, (d, p) in queue(edges, s, "reach", depth, cap).items() if d}
        for k in (None, kept):
            got = traversal.reachability(cis, e, seeds(spark, *everything), depth, 0.0, cap, k).collect()
            assert {(r.seed, r.id): (r.distance, [tuple(h) for h in r.path]) for r in got} == want
    kind, confidence = dict(nodes), {tuple(x[:3]): c for *x, c in sorted(edges, key=lambda r: r[3], reverse=True)}
    want = {}
    for s in everything:
        for n, (d, p) in queue(edges, s, "impact", 3, cap, 0.6).items():
            if d:
                product = 0.5
                for h in p:
                    product *= confidence[h]
                want[s, n] = (d, product, ">".join(h[0] for h in p))
    got = traversal.what_if(cis, e, seeds(spark, *everything), "modify", 3, 0.6, cap, kept=kept).collect()
    assert {(r.seed, r.id): (r.distance, r.confidence, r.hops_text) for r in got} == want
    near = {}
    for s in everything:
        hits = sorted((d, n, p[::-1]) for n, (d, p) in queue(edges, s, "reach", 6, cap).items() if d and kind[n] == "internet")
        if hits and kind[s] == "rds":
            near[s] = (hits[0][1], hits[0][0], hits[0][2])
    for k in (None, kept):
        got = rules.internet_databases(cis, e, max_fanout=cap, kept=k).collect()
        assert {r.subject_ci_id: (r.internet_id, r.distance, [tuple(h) for h in r.path]) for r in got} == near
    exposed = {r.seed: r.reached_by_internet for r in traversal.exposure(cis, e, cis.where("type = 'rds'").select("id"), max_fanout=cap, kept=kept).collect()}
    assert exposed == {i: i in near for i, t in nodes if t == "rds"}
    kept.drop()


def test_no_seeds_no_edges_depth_0(spark):
    cis, none = items(spark, ("a", "rds"), ("net", "internet")), links(spark, ("CONTAINS", "a", "a")).limit(0)
    assert traversal.reachability(cis, none, seeds(spark, "a")).count() == 0
    assert traversal.blast_radius(cis, none, seeds(spark, "a").limit(0)).count() == 0
    assert graph.bfs(graph.capped(graph.adjacency(none, "reach", 0.0, cis), 5), seeds(spark, "a"), 0).count() == 1
    assert rules.internet_databases(cis, none).count() == 0
    assert [tuple(r) for r in traversal.exposure(cis, none, seeds(spark, "a", "gone")).orderBy("seed").collect()] == [("a", False), ("gone", False)]


def test_the_adjacency_isn_t_shuffled(spark):
    nodes, edges = random_graph(9)
    kept = graph.Projection.build(items(spark, *nodes), links(spark, *edges), buckets=4)
    plan = graph.capped(kept.walk("impact", 0.7), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "Window" in plan
    kept.drop()


def files(kept):
    """Paths of the files of each bucket."""
    out = {}
    for f in kept.steps.sparkSession.table(kept.table).inputFiles():
        bucket = int(f.split("bucket=")[1].split("/")[0])
        out.setdefault(bucket, set()).add(os.path.basename(f))
    return out


def test_a_change_writes_its_buckets_alone(spark):
    nodes, edges = random_graph(5, 30, 60)
    cis = items(spark, *nodes)
    kept = graph.Projection.build(cis, links(spark, *edges), buckets=8)
    before = files(kept)
    assert all(len(v) == 1 for v in before.values())
    gone, new = edges[:2], [("CONTAINS", "n03", "n04", "new", 0.9)]
    after = [*edges[2:], *new]
    kept = kept.update(links(spark, *new), links(spark, *gone), cis, links(spark, *after))
    ends = [i for e in [*gone, *new] for i in e[1:3]]
    touched = {r[0] for r in seeds(spark, *ends).selectExpr("pmod(hash(id), 8)").collect()}
    now = files(kept)
    assert {b for b in before if before[b] != now.get(b)} <= touched and len(touched) < 8
    again = graph.Projection.build(cis, links(spark, *after), buckets=8)
    rows = lambda k: sorted(map(tuple, k.steps.collect()))
    assert rows(kept) == rows(again)
    # All edges of a node go: its bucket may be left without a row.
    alone = graph.Projection.build(cis, links(spark, ("CONTAINS", "n00", "n01")), buckets=8)
    alone = alone.update(links(spark, ("CONTAINS", "n00", "n01")).limit(0), links(spark, ("CONTAINS", "n00", "n01")), cis, links(spark, ("CONTAINS", "n00", "n01")).limit(0))
    assert alone.steps.count() == 0
    same = kept.update(links(spark, *new).limit(0), links(spark, *new).limit(0), cis, links(spark, *after))
    assert files(same) == now
    for k in (kept, again, alone):
        k.drop()


def test_first_items_need_no_projection(spark, data, monkeypatch):
    from orrery.plans import fixture, queries

    monkeypatch.setattr(fixture, "kept", lambda *_: pytest.fail("a projection was built"))
    got = queries.topology_nodes(spark, data).collect()
    every = fixture.cis(spark, data).select("id", "type", "external_id", "name").collect()
    assert got == sorted(every, key=lambda r: (r.type, r.external_id, r.id))[:500]


def test_buckets_grow_with_the_steps(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_STEPS", 10)
    cis, edges = random_graph(3)
    kept = graph.Projection.build(items(spark, *cis), links(spark, *edges))
    assert kept.buckets == -(-2 * len(edges) // 10) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = []
    monkeypatch.setattr(graph, "bucketed", lambda df, name, by, buckets, f=graph.bucketed: asked.append(buckets) or f(df, name, by, buckets))
    found = {r.seed: r.reached_by_internet for r in traversal.exposure(kept.nodes, kept.edges, kept.nodes.select("id"), kept=kept).collect()}
    assert asked == [kept.buckets]
    alone = {r.seed: r.reached_by_internet for r in traversal.exposure(kept.nodes, kept.edges, kept.nodes.select("id")).collect()}
    assert found == alone
    kept.drop()


def test_walks_hold_the_steps_that_they_take(spark):
    nodes, edges = random_graph(4, 20, 80)
    cis, e = items(spark, *nodes), links(spark, *edges, ("CONTAINS", "n00", "gone"), ("ROUTES_TO", "gone", "n01"))
    kept = graph.Walks.build(cis, e, 10, buckets=3)
    assert kept.tables == {}
    for name in WALKS:
        for least in (0.0, 0.7):
            want = graph.adjacency(e, name, least, cis)
            assert sorted(map(str, kept.walk(name, least).collect())) == sorted(map(str, want.collect()))
        plan = graph.capped(kept.walk(name), 10)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    everything = seeds(spark, *(i for i, _ in nodes))
    for search in (lambda k: traversal.reachability(cis, e, everything, 4, 0.0, 2, k), lambda k: traversal.what_if(cis, e, everything, "modify", 3, 0.6, 2, kept=k), lambda k: rules.internet_databases(cis, e, max_fanout=2, kept=k)):
        assert sorted(map(str, search(kept).collect())) == sorted(map(str, search(None).collect()))
    kept.drop()


def test_a_query_builds_its_walk_alone(spark, data):
    from orrery.plans import fixture, queries

    fixture._kept.cache_clear()
    assert queries.g_fanout_cap(spark, data).count() > 0
    kept = fixture.kept(spark, data)
    assert list(kept.tables) == ["impact"]
    assert {r.type for r in spark.table(kept.tables["impact"]).select("type").distinct().collect()} == {"CONTAINS", "DEPENDS_ON", "ROUTES_TO"}


def test_a_level_ranks_the_neighbours_of_its_nodes_alone(spark):
    nodes, edges = random_graph(6)
    kept = graph.Walks.build(items(spark, *nodes), links(spark, *edges), 10, buckets=3)
    plan = graph.looked_up(kept.walk("impact"), 5)(seeds(spark, "n00").withColumnRenamed("id", "src"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate") < plan.index("LeftSemi")  # the outermost operator comes first
    reached = graph.bfs(graph.looked_up(kept.walk("impact"), 2), seeds(spark, "n00", "n05"), 3, kept=True)
    assert sorted(reached.collect()) == sorted(graph.bfs(graph.capped(kept.walk("impact"), 2), seeds(spark, "n00", "n05"), 3).collect())
    cut = graph.supernodes(kept.walk("impact"), reached, 3, 2)
    degrees = {r.src: r.n for r in graph.neighbours(kept.walk("impact")).groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert {(r.seed, r.id, r.degree, r.depth) for r in cut.collect()} == {(r.seed, r.node, degrees[r.node], r.distance) for r in reached.collect() if r.distance < 3 and degrees.get(r.node, 0) > 2}
    kept.drop()
