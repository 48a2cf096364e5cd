"""Registered queries: each operator on the fixture tables, with DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import names
from ..operators import events, graph, merges, resolution, rules, temporal, traversal, versions
from ..session import written
from ..sources import aws, clouds, kubernetes, telemetry
from . import fixture as fx
from . import sql, templates

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _graph(spark: SparkSession, sf_dir: str) -> dict:
    """The projection, and its open items and edges: the first arguments of a search."""
    kept = fx.kept(spark, sf_dir)
    return {"cis": kept.nodes, "edges": kept.edges, "kept": kept}


def _sql(tail: str, walk: str, seeds: str, depth: int, least: float = 0.0, cap: int | None = 1000, path: bool = False) -> str:
    return sql.with_(sql.CI, sql.EDGE, sql.adjacency(walk, least, cap), sql.paths(seeds, depth) if path else sql.reached(seeds, depth), recursive=not path) + tail


def _hops(path: str) -> Column:
    return F.array_join(F.transform(path, lambda h: F.concat_ws("|", h["type"], h["from_id"], h["to_id"])), " > ")


REGION, PARTS = "SELECT 'region:0' AS id", "SELECT id FROM ci WHERE id IN ('rds:5','rds:7','rds:11')"
FOUND = "SELECT seed, id, type, name, distance FROM dist JOIN ci ON id = node WHERE distance > 0"
NEAR = sql.with_(sql.CI, sql.EDGE, sql.adjacency("reach"), sql.internet(6), recursive=True)

# Traversal


@query(_sql(FOUND, "impact", REGION, 4))
def blast_radius(spark, sf_dir):
    return traversal.blast_radius(seeds=_seed(spark, "region:0"), **_graph(spark, sf_dir))


@query(_sql(FOUND, "impact", REGION, 4, 0.7, 20))
def blast_radius_capped(spark, sf_dir):
    return traversal.blast_radius(seeds=_seed(spark, "region:0"), min_confidence=0.7, max_fanout=20, **_graph(spark, sf_dir))


@query(_sql("SELECT DISTINCT seed, node AS id, degree, distance AS depth FROM dist JOIN ranked ON src = node WHERE distance < 4 AND degree > 20", "impact", REGION, 4, 0.0, 20))
def supernodes(spark, sf_dir):
    return traversal.truncated(seeds=_seed(spark, "region:0"), max_fanout=20, **_graph(spark, sf_dir))


@query(sql.with_(sql.CI, sql.EDGE, sql.adjacency("impact", 0.8)) + "SELECT src, dst, dir, type FROM step")
def g_neighbors(spark, sf_dir):
    return fx.kept(spark, sf_dir).walk("impact", 0.8).select("src", "dst", "dir", "type")


@query(sql.with_(sql.CI, sql.EDGE, sql.adjacency("impact", 0.0, 20)) + "SELECT src, dst, dir, type, CAST(rank AS INTEGER) AS rank, degree FROM adj")
def g_fanout_cap(spark, sf_dir):
    return graph.capped(fx.kept(spark, sf_dir).walk("impact"), 20, degree=True).select("src", "dst", "dir", "type", "rank", "degree")


@query(sql.with_(sql.CI, sql.EDGE, sql.adjacency("reach")) + "SELECT src, dst, type FROM one")
def g_reach_neighbors(spark, sf_dir):
    return graph.neighbours(fx.kept(spark, sf_dir).walk("reach")).select("src", "dst", "type")


@query(sql.with_(sql.CI, sql.EDGE, sql.adjacency("upstream")) + "SELECT src, dst, dir, type FROM one")
def g_upstream_neighbors(spark, sf_dir):
    return graph.neighbours(fx.kept(spark, sf_dir).walk("upstream")).select("src", "dst", "dir", "type")


@query(_sql("SELECT seed, node, distance FROM dist", "impact", "SELECT id FROM ci WHERE type = 'region'", 4))
def g_bfs(spark, sf_dir):
    kept = fx.kept(spark, sf_dir)
    return graph.bfs(graph.looked_up(kept.walk("impact"), 1000), kept.nodes.where("type = 'region'").select("id"), 4, kept=True).select("seed", "node", "distance")


@query(_sql("SELECT seed, id, type, name, distance, type = 'internet' AS is_internet FROM dist JOIN ci ON id = node WHERE distance > 0", "reach", PARTS, 6))
def reachability(spark, sf_dir):
    return traversal.reachability(targets=_seed(spark, "rds:5", "rds:7", "rds:11"), **_graph(spark, sf_dir)).drop("path")


@query(_sql("SELECT seed, id, distance, array_to_string(list_reverse(hops), ' > ') AS path FROM best JOIN ci ON id = node WHERE distance > 0", "reach", PARTS, 6, path=True))
def reachability_paths(spark, sf_dir):
    found = traversal.reachability(targets=_seed(spark, "rds:5", "rds:7", "rds:11"), **_graph(spark, sf_dir))
    return found.select("seed", "id", "distance", _hops("path").alias("path"))


@query(NEAR + "SELECT id AS seed, id IN (SELECT node FROM far) AS reached_by_internet FROM ci WHERE type = 'rds'")
def reach_internet(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return traversal.exposure(targets=g["cis"].where("type = 'rds'").select("id"), **g)


@query(_sql("""SELECT b.seed, b.id, b.pos, split_part(h, '|', 1) AS type, split_part(h, '|', 2) AS from_id, split_part(h, '|', 3) AS to_id, e.source, e.confidence, 'fixture/2024-01-01' AS evidence
 FROM (SELECT seed, node AS id, unnest(list_reverse(hops)) AS h, CAST(generate_subscripts(hops, 1) - 1 AS INTEGER) AS pos FROM best WHERE distance > 0) b
 JOIN edge e ON e.type = split_part(h, '|', 1) AND e.from_id = split_part(h, '|', 2) AND e.to_id = split_part(h, '|', 3)""", "reach", PARTS, 6, path=True))
def g_hop_lookup(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = traversal.reachability(targets=_seed(spark, "rds:5", "rds:7", "rds:11"), **g)
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["source"], F.date_format(e["observed_at"], "yyyy-MM-dd"), e["detail"])), ",")
    return traversal.with_hop_evidence(found, g["edges"], ["seed", "id"]).withColumn("evidence", told)


@query(_sql("SELECT seed, id, type, name, distance FROM dist JOIN ci ON id = node", "upstream", "SELECT 'ec2_instance:1' AS id UNION ALL SELECT 'rds:5'", 3, 0.0, None))
def rca_neighborhood(spark, sf_dir):
    return traversal.rca_neighborhood(targets=_seed(spark, "ec2_instance:1", "rds:5"), **_graph(spark, sf_dir))


def _what_if_sql(factor: str) -> str:
    return _sql(f"SELECT seed, id, type, name, distance, conf * {factor} AS confidence, array_to_string(list_transform(hops, lambda h: split_part(h, '|', 1)), '>') AS hops_text FROM best JOIN ci ON id = node WHERE distance > 0", "impact", "SELECT id FROM ci WHERE id IN ('rds:5','vpc:3')", 4, 0.0, 1000, True)


@query(_what_if_sql("1.0"))
def whatif_remove(spark, sf_dir):
    return traversal.what_if(seeds=_seed(spark, "rds:5", "vpc:3"), change_kind="remove", **_graph(spark, sf_dir))


@query(_what_if_sql("0.5"))
def whatif_modify(spark, sf_dir):
    return traversal.what_if(seeds=_seed(spark, "rds:5", "vpc:3"), change_kind="modify", **_graph(spark, sf_dir))


INCIDENT = "2024-01-20 12:00:00"
_RCA = (
    sql.with_(sql.CI, sql.EDGE, sql.VERSION, sql.adjacency("upstream", 0.0, None), sql.reached("SELECT 'region:0' AS id UNION ALL SELECT 'ec2_instance:1'", 3), f"feed AS ({sql.changes('ci', f'TIMESTAMP {chr(39)}{INCIDENT}{chr(39)} - INTERVAL 24 HOUR', f'TIMESTAMP {chr(39)}{INCIDENT}{chr(39)}')})", recursive=True)
    + f"""SELECT seed, f.kind, f.at, f.id, distance, (epoch_us(TIMESTAMP '{INCIDENT}') - epoch_us(f.at)) / 1e6 AS age_seconds,
 CASE f.kind WHEN 'removed' THEN 3.0 WHEN 'updated' THEN 2.0 ELSE 1.0 END * (1.0/(1.0+distance) + 86400.0/(86400.0 + ((epoch_us(TIMESTAMP '{INCIDENT}') - epoch_us(f.at)) / 1e6))) AS score,
 'ci ' || f.name || ' was ' || f.kind || ' ' || CASE WHEN s >= 86400 THEN '1 day, ' ELSE '' END || format('{{:d}}:{{:02d}}:{{:02d}}', s % 86400 // 3600, s % 3600 // 60, s % 60) || ' before the incident, ' || distance || CASE distance WHEN 1 THEN ' hop' ELSE ' hops' END || ' upstream' AS evidence
 FROM (SELECT *, (epoch_us(TIMESTAMP '{INCIDENT}') - epoch_us("at")) // 1000000 AS s FROM feed) f JOIN dist ON node = 'ec2_instance:' || f.id"""
)


@query(_RCA)
def rca(spark, sf_dir):
    near = traversal.rca_neighborhood(targets=_seed(spark, "region:0", "ec2_instance:1"), **_graph(spark, sf_dir))
    until = F.lit(INCIDENT).cast("timestamp_ntz")
    feed = temporal.changes(fx.versions(spark, sf_dir), "ci", until - F.expr("interval 24 hours"), until).withColumn("id", F.concat(F.lit("ec2_instance:"), "id"))
    found = traversal.root_cause(near, feed, until)
    return found.select("seed", "kind", "at", F.regexp_replace("id", "^ec2_instance:", "").alias("id"), "distance", "age_seconds", "score", "evidence")


@query(sql.with_(sql.CI) + "SELECT id, type, external_id, name FROM ci ORDER BY type, external_id, id LIMIT 500")
def topology_nodes(spark, sf_dir):
    return traversal.topology(fx.cis(spark, sf_dir), fx.edges(spark, sf_dir))[0].select("id", "type", "external_id", "name")


@query(sql.with_(sql.CI, sql.EDGE, "top AS (SELECT id FROM ci ORDER BY type, external_id, id LIMIT 2000)") + "SELECT type, from_id, to_id FROM edge WHERE from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top)")
def topology_edges(spark, sf_dir):
    kept = fx.kept(spark, sf_dir)
    return traversal.topology(kept.nodes, kept.edges, 2000)[1].select("type", "from_id", "to_id")


# Temporal reads

V = "SELECT id, type, name, valid_from, valid_to FROM version "
AT = "2024-01-15 00:00:00"


@query(sql.with_(sql.VERSION) + V + "WHERE valid_to IS NULL")
def ci_current(spark, sf_dir):
    return temporal.current(fx.versions(spark, sf_dir)).select("id", "type", "name", "valid_from", "valid_to")


@query(sql.with_(sql.VERSION) + V + "WHERE valid_to IS NULL AND id = '7'")
def ci_by_id(spark, sf_dir):
    return temporal.current(fx.versions(spark, sf_dir), id="7").select("id", "type", "name", "valid_from", "valid_to")


@query(sql.with_(sql.VERSION) + V + f"WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def ci_as_of(spark, sf_dir):
    return temporal.as_of(fx.versions(spark, sf_dir), F.lit(AT).cast("timestamp_ntz")).select("id", "type", "name", "valid_from", "valid_to")


@query(sql.with_(sql.VERSION) + V + "WHERE id = '7'")
def ci_history(spark, sf_dir):
    return temporal.history(fx.versions(spark, sf_dir), "7").select("id", "type", "name", "valid_from", "valid_to")


@query(sql.with_(sql.EDGE_VERSION) + "SELECT id, from_id, to_id, valid_from FROM link WHERE valid_to IS NULL")
def edge_current(spark, sf_dir):
    return temporal.current(fx.edge_versions(spark, sf_dir)).select("id", "from_id", "to_id", "valid_from")


@query(sql.with_(sql.EDGE_VERSION) + f"SELECT id, from_id, to_id, valid_from FROM link WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def edge_as_of(spark, sf_dir):
    return temporal.as_of(fx.edge_versions(spark, sf_dir), F.lit(AT).cast("timestamp_ntz")).select("id", "from_id", "to_id", "valid_from")


@query(sql.with_(sql.VERSION, sql.FLOW, f"live AS (SELECT 'ec2_instance:'||id AS id FROM version WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}'))") + f"SELECT DISTINCT 'ec2_instance:'||src AS from_id, 'ec2_instance:'||dst AS to_id FROM flow WHERE seen <= TIMESTAMP '{AT}' AND 'ec2_instance:'||src IN (SELECT id FROM live) AND 'ec2_instance:'||dst IN (SELECT id FROM live)")
def graph_as_of(spark, sf_dir):
    nodes = fx.versions(spark, sf_dir).withColumn("id", F.concat(F.lit("ec2_instance:"), "id"))
    links = fx.flows(spark, sf_dir).select(F.concat(F.lit("ec2_instance:"), "src").alias("from_id"), F.concat(F.lit("ec2_instance:"), "dst").alias("to_id"), F.col("at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return temporal.graph_as_of(nodes, links, F.lit(AT).cast("timestamp_ntz"))[1].select("from_id", "to_id").distinct()


@query(sql.with_(sql.CI) + "SELECT id, type, external_id, name FROM ci WHERE type = 'vpc'")
def inventory(spark, sf_dir):
    return fx.cis(spark, sf_dir).where("type = 'vpc'").select("id", "type", "external_id", "name")


@query(sql.with_(sql.CI) + "SELECT type, count(*) AS n FROM ci GROUP BY type")
def count_by_type(spark, sf_dir):
    return temporal.count_by_type(fx.cis(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("timestamp")))


SINCE, UNTIL = "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-17'"


def _window():
    return F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-17").cast("timestamp_ntz")


@query(sql.with_(sql.VERSION) + sql.changes("ci", SINCE, UNTIL))
def change_feed_ci(spark, sf_dir):
    return temporal.changes(fx.versions(spark, sf_dir), "ci", *_window())


@query(sql.with_(sql.EDGE_VERSION) + sql.changes("edge", SINCE, UNTIL, "link"))
def change_feed_edge(spark, sf_dir):
    return temporal.changes(fx.edge_versions(spark, sf_dir), "edge", *_window())


@query(sql.with_(sql.VERSION, sql.EDGE_VERSION) + sql.changes("ci", SINCE, UNTIL) + " UNION ALL " + sql.changes("edge", SINCE, UNTIL, "link"))
def change_feed(spark, sf_dir):
    return temporal.change_feed(fx.versions(spark, sf_dir), fx.edge_versions(spark, sf_dir), F.lit("2024-01-17").cast("timestamp_ntz"), 7)


# Confidence and versioned writes


@query("SELECT n, CASE WHEN n >= 1 THEN least(1.0 - (1.0 - CAST(0.6 AS DOUBLE)) * pow(0.5, n - 1), 1 - 1e-15) END AS confidence FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem UNION SELECT 0)")
def conf_curve(spark, sf_dir):
    n = fx.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().unionByName(spark.range(1).select(F.lit(0).alias("n")))
    return n.select("n", F.when(F.col("n") >= 1, conf.for_observations(F.col("n"))).alias("confidence"))


NOW = "2024-02-01 00:00:00"
_DAYS = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0"


@query(f"SELECT event_id, round(CASE WHEN d <= 7 THEN 0.9 ELSE greatest(0.2, least(0.9, 0.9 - CAST(0.05 AS DOUBLE) * (d - 7))) END, 9) AS confidence FROM (SELECT event_id, {_DAYS} AS d FROM events)")
def decay_curve(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    return e.select("event_id", F.round(conf.decayed(F.lit(0.9), conf.age_days(F.col("ts"), F.lit(NOW))), 9).alias("confidence"))


def _observed(spark, sf_dir) -> DataFrame:
    """Inferred edges with a count marker: pairs of hosts by accepted flows."""
    f = fx.flows(spark, sf_dir).where("action = 'ACCEPT'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    at = F.col("at").cast("timestamp")
    evidence = F.array(F.struct(F.lit("aws-flowlogs-count").alias("source"), at.alias("observed_at"), F.col("n").cast("string").alias("detail")), F.struct(F.lit("aws-flowlogs").alias("source"), at.alias("observed_at"), F.lit(None).cast("string").alias("detail")))
    pair = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
    return f.select(pair.alias("id"), F.lit(fx.TENANT).alias("tenant_id"), F.lit("CONNECTS_TO").alias("type"), F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.lit("").alias("edge_key"), F.lit("inferred").alias("source"), conf.for_observations(F.col("n")).alias("confidence"), evidence.alias("evidence"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


_OBS = sql.with_(sql.FLOW, "obs AS (SELECT src, dst, count(*) AS n, max(seen) AS seen, 1.0 - (1.0 - CAST(0.6 AS DOUBLE)) * pow(0.5, count(*) - 1) AS confidence FROM flow WHERE action = 'ACCEPT' GROUP BY src, dst)")


@query(_OBS + f"""SELECT src || '>' || dst AS id, action, CASE WHEN action = 'decay' THEN round(low, 9) END AS new_confidence FROM (SELECT *, CASE WHEN d > 30 THEN 'close' WHEN d > 7 AND low < confidence THEN 'decay' ELSE 'untouched' END AS action FROM
 (SELECT *, greatest(0.2, least(confidence, confidence - CAST(0.05 AS DOUBLE) * (d - 7))) AS low FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(seen)) / 86400000000.0 AS d FROM obs)))""")
def aging_sweep(spark, sf_dir):
    out = versions.aging_actions(_observed(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select("id", "action", F.round("new_confidence", 9).alias("new_confidence"))


@query(_OBS + """, again AS (SELECT DISTINCT src, dst FROM flow WHERE event_id % 3 = 0)
SELECT o.src || '>' || o.dst AS id, CASE WHEN a.src IS NULL THEN 'none' ELSE 'accumulate' END AS action, CASE WHEN a.src IS NOT NULL THEN CAST(o.n + 1 AS INTEGER) ELSE 0 END AS count, CASE WHEN a.src IS NOT NULL THEN 1.0 - (1.0 - CAST(0.6 AS DOUBLE)) * pow(0.5, o.n) ELSE 0.0 END AS confidence FROM obs o LEFT JOIN again a ON a.src = o.src AND a.dst = o.dst
UNION ALL SELECT a.src || '>' || a.dst, 'create', 1, 0.6 FROM again a LEFT JOIN obs o ON a.src = o.src AND a.dst = o.dst WHERE o.src IS NULL""")
def edge_accumulate(spark, sf_dir):
    state = _observed(spark, sf_dir)
    again = fx.flows(spark, sf_dir).where("event_id % 3 = 0").groupBy("src", "dst").agg(F.min("at").alias("at"))
    evidence = F.array(F.struct(F.lit("aws-flowlogs").alias("source"), F.col("at").cast("timestamp").alias("observed_at"), F.lit("again").alias("detail")))
    batch = again.select(F.lit("CONNECTS_TO").alias("type"), F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.lit("").alias("edge_key"), F.lit("inferred").alias("source"), F.lit(0.6).alias("confidence"), evidence.alias("evidence"))
    acted = versions.edge_actions(state, batch)
    pair = F.concat_ws(">", "from_id", "to_id")
    done = acted.select(pair.alias("id"), "action", versions.observation_count(F.col("new_evidence")).alias("count"), F.col("new_confidence").alias("confidence"))
    rest = state.join(batch, ["from_id", "to_id"], "left_anti").select("id", F.lit("none").alias("action"), F.lit(0).alias("count"), F.lit(0.0).alias("confidence"))
    return done.unionByName(rest)


def _old_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Open items and a batch: customers, of which some are renamed and some new."""
    c = fx.read(spark, sf_dir, "customer")
    base = c.select(F.lit("ec2_instance").alias("type"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("name"), F.to_json(F.struct("c_mktsegment")).alias("attributes"), F.lit(1.0).alias("confidence"), "c_custkey")
    old = base.where("c_custkey % 5 <> 0").withColumns({"id": F.concat(F.lit("id-"), "external_id"), "tenant_id": F.lit(fx.TENANT), "first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-01").cast("timestamp"), "valid_from": F.lit("2024-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    new = base.where("c_custkey % 7 <> 0").withColumn("name", F.when(F.col("c_custkey") % 3 == 0, F.concat("name", F.lit("-new"))).otherwise(F.col("name")))
    cols = ["id", "tenant_id", "type", "external_id", "name", "attributes", "confidence", "first_seen", "last_seen", "valid_from", "valid_to"]
    return old.select(*cols), new.drop("c_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN c_custkey % 5 = 0 THEN 'create' WHEN c_custkey % 3 = 0 THEN 'update' ELSE 'touch' END AS action FROM customer WHERE c_custkey % 7 <> 0")
def ci_upsert_actions(spark, sf_dir):
    return versions.ci_actions(*_old_and_new(spark, sf_dir)).select("external_id", "action")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name || CASE WHEN new AND c_custkey % 3 = 0 THEN '-new' ELSE '' END AS name, first, fromday, closed FROM (
 SELECT c_custkey, c_name, FALSE AS new, '2024-01-01' AS first, '2024-01-01' AS fromday, c_custkey % 7 <> 0 AND c_custkey % 3 = 0 AS closed FROM customer WHERE c_custkey % 5 <> 0
 UNION ALL SELECT c_custkey, c_name, TRUE, CASE WHEN c_custkey % 5 = 0 THEN '2024-02-01' ELSE '2024-01-01' END, '2024-02-01', FALSE FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 = 0))""")
def ci_upsert(spark, sf_dir):
    out = versions.upsert_cis(*_old_and_new(spark, sf_dir), fx.TENANT, F.lit(NOW).cast("timestamp"))
    return out.select("external_id", "name", F.date_format("first_seen", "yyyy-MM-dd").alias("first"), F.date_format("valid_from", "yyyy-MM-dd").alias("fromday"), F.col("valid_to").isNotNull().alias("closed"))


@query("SELECT action, count(*) AS count FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'create' WHEN c_custkey % 3 = 0 THEN 'update' ELSE 'touch' END AS action FROM customer WHERE c_custkey % 7 <> 0) GROUP BY action UNION ALL SELECT 'closed', count(*) FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0 UNION ALL SELECT 'edges_written', count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey > 1 AND (c_custkey - 1) % 7 <> 0 UNION ALL SELECT 'edges_closed', CAST(0 AS BIGINT)")
def reconcile_counts(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp")
    keys = old.select("tenant_id", F.lit("crm").alias("source"), F.col("external_id").alias("native_id"), F.col("id").alias("ci_id"), F.col("valid_from").alias("observed_at"))
    none = spark.createDataFrame([], "tenant_id string, alias_key string, ci_id string, ci_type string, source string, observed_at timestamp")
    evidence = F.array(F.struct(F.lit("crm").alias("source"), now.alias("observed_at"), F.lit(None).cast("string").alias("detail")))
    links = new.select(F.lit("CONNECTS_TO").alias("type"), F.lit("ec2_instance").alias("from_type"), F.col("external_id").alias("from_ext"), F.lit("ec2_instance").alias("to_type"), (F.col("external_id").cast("long") - 1).cast("string").alias("to_ext"), F.lit("declared").alias("source"), F.lit(1.0).alias("confidence"), evidence.alias("evidence"), F.lit("").alias("edge_key"))
    from ..schema import EDGE

    state = {"cis": old, "edges": spark.createDataFrame([], EDGE), "source_keys": keys, "alias_keys": none}
    out = versions.reconcile(state, new.withColumn("alias_keys", F.array().cast("array<string>")), links, fx.TENANT, "crm", ["ec2_instance"], ["CONNECTS_TO"], now)
    return out["counts"]


HORIZON = "2024-01-12 00:00:00"
_RET = sql.with_(sql.VERSION, f"cut AS (SELECT *, valid_to IS NOT NULL AND valid_to < TIMESTAMP '{HORIZON}' AND valid_from < (SELECT max(m.valid_from) FROM version m WHERE m.id = v.id AND m.valid_to IS NOT NULL) AS gone FROM version v)")


@query(_RET + "SELECT id, count(*) AS version_count, min(valid_from) AS first_from, max(valid_to) AS last_to FROM cut WHERE gone GROUP BY id")
def retention_agg(spark, sf_dir):
    return versions.retention_sweep(fx.versions(spark, sf_dir), F.lit(HORIZON).cast("timestamp_ntz"))[1].select("id", "version_count", "first_from", "last_to")


@query(_RET + "SELECT id, valid_from FROM cut WHERE NOT gone")
def retention_kept(spark, sf_dir):
    return versions.retention_sweep(fx.versions(spark, sf_dir), F.lit(HORIZON).cast("timestamp_ntz"))[0].select("id", "valid_from")


# Rules


@query(NEAR + "SELECT node AS subject_ci_id, 'internet:0' AS internet_id, distance, path FROM near JOIN ci ON id = node WHERE type = 'rds'")
def rule_internet_db(spark, sf_dir):
    return rules.internet_databases(**_graph(spark, sf_dir)).withColumn("path", _hops("path"))


@query(sql.with_(sql.CI, sql.EDGE) + "SELECT from_id AS subject_ci_id, count(DISTINCT to_id) AS target_count, string_agg(DISTINCT to_id, ',' ORDER BY to_id) AS targets FROM edge JOIN ci ON id = from_id WHERE edge.type = 'HAS_ACCESS_TO' AND ci.type = 'ec2_instance' GROUP BY from_id HAVING count(DISTINCT to_id) >= 10")
def rule_iam_breadth(spark, sf_dir):
    kept = fx.kept(spark, sf_dir)
    found = rules.broad_access(kept.nodes, kept.edges, types=("ec2_instance",))
    return found.withColumn("targets", F.array_join("targets", ","))


@query(sql.with_(sql.VERSION, f"feed AS ({sql.changes('edge', SINCE, UNTIL)})") + "SELECT to_id AS subject_ci_id, count(DISTINCT id) AS edge_count FROM feed WHERE kind = 'created' GROUP BY to_id")
def anom_sg_world(spark, sf_dir):
    v = fx.versions(spark, sf_dir).withColumn("type", F.lit("CONNECTS_TO"))
    return rules.opened_groups(fx.cis(spark, sf_dir), temporal.changes(v, "edge", *_window()), "ec2_instance")


def _part_changes(spark, sf_dir) -> DataFrame:
    """Each event as a new edge that leads to a part, of a type that matters but for views."""
    e = fx.read(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    part = F.concat(F.lit("rds:"), F.get_json_object("props", "$.k"))
    return e.select(F.lit("edge").alias("entity"), F.lit("created").alias("kind"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "OWNS").otherwise("ROUTES_TO").alias("type"), none.alias("name"), none.alias("from_id"), part.alias("to_id"))


@query(NEAR + "SELECT 'rds:' || json_extract_string(props, '$.k') AS subject_ci_id, count(*) AS triggers FROM events WHERE event_type <> 'view' AND 'rds:' || json_extract_string(props, '$.k') IN (SELECT node FROM far JOIN ci ON id = node WHERE type = 'rds') GROUP BY 1")
def anom_public_db(spark, sf_dir):
    return rules.public_databases(changes=_part_changes(spark, sf_dir), **_graph(spark, sf_dir))


@query("SELECT 'r' AS rule_id, CAST(p_partkey AS VARCHAR) AS subject_ci_id, CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 'keep' WHEN p_size > 25 THEN 'resolve' ELSE 'open' END AS action FROM part WHERE p_size > 25 OR p_retailprice > 1000")
def finding_reconcile(spark, sf_dir):
    part = fx.read(spark, sf_dir, "part").select(F.lit("r").alias("rule_id"), F.col("p_partkey").cast("string").alias("subject_ci_id"), "p_size", "p_retailprice")
    return rules.reconcile_findings(part.where("p_size > 25"), part.where("p_retailprice > 1000"))


_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC NULLS LAST, run_id) AS n FROM run) WHERE n = 1)"
_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(finished_at)) / 1e6"


@query(sql.with_(sql.RUN, _LAST) + f"SELECT source, run_id, status, {_AGE} AS age_seconds, coalesce({_AGE} > 86400, TRUE) AS stale FROM last")
def run_latest(spark, sf_dir):
    return rules.latest_runs(fx.runs(spark, sf_dir), F.lit(NOW)).select("source", "run_id", "status", "age_seconds", "stale")


@query(sql.with_(sql.RUN, _LAST, "slo(source, secs) AS (VALUES ('click', 86400), ('error', 259200), ('purchase', 2592000), ('never', 60), ('view', 3456000))") + f"SELECT slo.source, secs AS expected_interval_seconds, status, {_AGE} AS age_seconds, coalesce(status = 'ok' AND {_AGE} <= secs, FALSE) AS fresh FROM slo LEFT JOIN last ON last.source = slo.source")
def freshness_eval(spark, sf_dir):
    return rules.freshness(fx.slos(spark), fx.runs(spark, sf_dir), F.lit(NOW))


@query("SELECT count(*) AS used, greatest(100000 - count(*), 0) AS remaining, count(*) >= 100000 AS exhausted FROM events WHERE ts >= TIMESTAMP '2024-01-01'")
def usage_month(spark, sf_dir):
    return rules.month_usage(fx.read(spark, sf_dir, "events").withColumnRenamed("ts", "occurred_at"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_topn(spark, sf_dir):
    return temporal.top(fx.read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 200, "ts", "event_id")


# Entity resolution


@query(sql.with_(sql.RECORD) + f"SELECT id, {sql.NORM.format('name')} AS norm FROM record")
def er_normalize(spark, sf_dir):
    return fx.records(spark, sf_dir).select("id", names.normalized(F.col("name")).alias("norm"))


_TOK = sql.with_(sql.RECORD, f"t AS (SELECT *, {sql.NORM.format('name')} AS norm FROM record)", "w AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS toks FROM t)")
_JAC = "CAST(len(list_intersect(a.toks, b.toks)) AS DOUBLE) / len(list_distinct(list_concat(a.toks, b.toks)))"


@query(_TOK + f"SELECT a.id AS ci_id_a, b.id AS ci_id_b, a.type, CASE WHEN a.norm = b.norm THEN 1.0 ELSE {_JAC} END AS score FROM w a JOIN w b ON a.type = b.type AND a.id < b.id AND a.source <> b.source WHERE a.norm <> '' AND b.norm <> '' AND (a.norm = b.norm OR {_JAC} >= 0.5)")
def er_candidates(spark, sf_dir):
    return resolution.scored_pairs(fx.records(spark, sf_dir)).drop("evidence")


@query("""WITH inc AS (SELECT p_partkey, p_type, split_part(p_name,' ',1) AS alias FROM part WHERE p_partkey % 2 = 0), own AS (SELECT p_partkey, p_type, split_part(p_name,' ',1) AS alias FROM part WHERE p_partkey % 2 = 1)
SELECT CAST(i.p_partkey AS VARCHAR) AS external_id, min('ci-' || o.p_partkey) AS ci_id, min(i.alias) AS matched_key FROM inc i JOIN (SELECT alias, p_type, max(p_partkey) AS p_partkey FROM own GROUP BY alias, p_type) o ON i.alias = o.alias AND i.p_type = o.p_type GROUP BY i.p_partkey HAVING count(DISTINCT o.p_partkey) = 1""")
def er_deterministic(spark, sf_dir):
    part = fx.read(spark, sf_dir, "part")
    word = lambda n: F.split("p_name", " ")[n]
    incoming = part.where("p_partkey % 2 = 0").select(F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("external_id"), F.array(word(0)).alias("alias_keys"))
    known = part.where("p_partkey % 2 = 1").groupBy(word(0).alias("alias_key"), F.col("p_type").alias("ci_type")).agg(F.max("p_partkey").alias("k"))
    known = known.select("alias_key", "ci_type", F.concat(F.lit("ci-"), "k").alias("ci_id"), F.lit("other").alias("source"))
    items = part.select(F.concat(F.lit("ci-"), "p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("external_id"))
    return resolution.deterministic(incoming, known, items, "mine").select("external_id", "ci_id", "matched_key")


@query("""WITH h AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_mktsegment AS type, CAST(c_custkey // 40 AS VARCHAR) AS ip, c_custkey % 3 AS source FROM customer)
SELECT a.id AS ci_id_a, b.id AS ci_id_b, a.type, CAST(0.9 AS DOUBLE) AS score, 'probable match: ip 0.90' AS evidence FROM h a JOIN h b ON a.ip = b.ip AND a.type = b.type AND a.id < b.id AND a.source <> b.source""")
def er_ip_pairs(spark, sf_dir):
    """Customers as hosts without names, of which some of a type share an address."""
    c = fx.read(spark, sf_dir, "customer")
    address = F.floor(F.col("c_custkey") / 40).cast("string")
    hosts = c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_mktsegment").alias("type"), F.lit(None).cast("string").alias("name"), F.to_json(F.struct(address.alias("private_ip"))).alias("attributes"), F.array().cast("array<string>").alias("aliases"), F.array((F.col("c_custkey") % 3).cast("string")).alias("sources"))
    return resolution.scored_pairs(hosts)


_HOSTS = """WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_mktsegment AS type, c_custkey % 3 AS source, c_custkey % 2 = 0 AS plain, [{0}] AS values FROM customer),
 h AS (SELECT *, list_transform(values, lambda v: lower(replace(v, '-', ''))) AS toks FROM c),
 j AS (SELECT a.id AS ci_id_a, b.id AS ci_id_b, a.type, len(list_intersect(a.values, b.values)) > 0 AS shared, len(list_intersect(a.toks, b.toks)) AS n, a.plain = b.plain AS alike FROM h a JOIN h b ON a.type = b.type AND a.id < b.id AND a.source <> b.source),
 s AS (SELECT *, CAST(n AS DOUBLE) / (6 - n) AS jac FROM j)
"""
_DNS = [f"CASE WHEN c_custkey % 2 = 0 THEN '{k}' || {v} ELSE '{k.upper()}-' || {v} END" for k, v in (("h", "c_custkey // 40"), ("g", "c_custkey // 80"), ("n", "c_nationkey"))]


def _bare_hosts(spark, sf_dir, dns: Column | None, aliases: Column | None) -> DataFrame:
    """Customers as hosts without names."""
    c = fx.read(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    return c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_mktsegment").alias("type"), F.lit(None).cast("string").alias("name"), (F.lit("{}") if dns is None else F.to_json(dns)).alias("attributes"), (none if aliases is None else aliases).alias("aliases"), F.array((F.col("c_custkey") % 3).cast("string")).alias("sources"))


def _parts() -> dict[str, Column]:
    return {"h": F.floor(F.col("c_custkey") / 40).cast("string"), "g": F.floor(F.col("c_custkey") / 80).cast("string"), "n": F.col("c_nationkey").cast("string")}


@query(_HOSTS.format(", ".join(_DNS)) + "SELECT ci_id_a, ci_id_b, type, CASE WHEN shared THEN 1.0 ELSE jac END AS score, 'probable match: dns ' || CASE WHEN shared OR jac = 1 THEN '1.00' ELSE '0.50' END AS evidence FROM s WHERE shared OR jac >= 0.5")
def er_dns_pairs(spark, sf_dir):
    """Host names of which even and odd hosts have other spellings: pairs share one, or their tokens are alike."""
    even = F.col("c_custkey") % 2 == 0
    h, g, n = (F.when(even, F.concat(F.lit(k), v)).otherwise(F.concat(F.lit(f"{k.upper()}-"), v)) for k, v in _parts().items())
    return resolution.scored_pairs(_bare_hosts(spark, sf_dir, F.struct(h.alias("dns_name"), g.alias("hostname"), n.alias("fqdn")), None))


@query(_HOSTS.format("'h' || (c_custkey // 40), 'g' || (c_custkey // 80), 'n' || c_nationkey") + "SELECT ci_id_a, ci_id_b, type, least(jac, 0.8) AS score, 'probable match: alias ' || CASE WHEN jac = 1 THEN '0.80' ELSE '0.50' END AS evidence FROM s WHERE jac >= 0.5 AND NOT (n = 3 AND alike)")
def er_alias_pairs(spark, sf_dir):
    """Aliases of the same words in two orders: equal ones are no candidates, alike ones score 0.8 at most."""
    h, g, n = (F.concat(F.lit(k), v) for k, v in _parts().items())
    alias = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", h, g, n)).otherwise(F.concat_ws(" ", n, g, h))
    return resolution.scored_pairs(_bare_hosts(spark, sf_dir, None, F.array(alias)))


@query("""SELECT 'ci-' || p_partkey AS id, first_value('ci-' || p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_name, 'ci-' || p_partkey) AS root
FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1""")
def er_merge_groups(spark, sf_dir):
    """Parts of a brand and size, each linked with the one before it alone: a chain is one group, named by its least (name, id)."""
    from pyspark.sql import Window

    part = fx.read(spark, sf_dir, "part").select(F.concat(F.lit("ci-"), "p_partkey").alias("id"), F.col("p_name").alias("rank"), "p_brand", "p_size", "p_partkey")
    before = F.lag("id").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return merges.components(part.select(F.col("id").alias("a"), before.alias("b")).where("b is not null"), part.select("id", "rank"))


# Sources


@query("SELECT '10.0.' || CAST(c_custkey % 97 AS VARCHAR) AS ip, min(lpad(CAST(c_custkey AS VARCHAR),9,'0')) AS external_id FROM customer GROUP BY 1")
def ip_map(spark, sf_dir):
    return telemetry.address_map(_hosts(spark, sf_dir))


def _hosts(spark, sf_dir) -> DataFrame:
    c = fx.read(spark, sf_dir, "customer")
    ip = F.concat(F.lit("10.0."), (F.col("c_custkey") % 97).cast("string"))
    return c.select(F.lit("ec2_instance").alias("type"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("external_id"), F.to_json(F.struct(ip.alias("private_ip"))).alias("attributes"), F.lit(None).cast("timestamp").alias("valid_to"))


@query("""WITH m AS (SELECT '10.0.' || CAST(c_custkey % 97 AS VARCHAR) AS ip, min(lpad(CAST(c_custkey AS VARCHAR),9,'0')) AS ext FROM customer GROUP BY 1),
f AS (SELECT '10.0.' || CAST(user_id AS VARCHAR) AS s, '10.0.' || json_extract_string(props,'$.k') AS d, event_id, event_type FROM events)
SELECT a.ext AS from_ext, b.ext AS to_ext, min(event_id) AS first_start FROM f JOIN m a ON a.ip = s JOIN m b ON b.ip = d WHERE event_type <> 'error' GROUP BY 1, 2""")
def flow_edges(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    address = lambda c: F.concat(F.lit("10.0."), c)
    flows = e.select(address(F.col("user_id").cast("string")).alias("srcaddr"), address(F.get_json_object("props", "$.k")).alias("dstaddr"), F.lit(1).alias("srcport"), F.lit(443).alias("dstport"), F.lit(6).alias("protocol"), F.when(F.col("event_type") == "error", "REJECT").otherwise("ACCEPT").alias("action"), F.col("event_id").alias("start"), F.col("event_id").alias("end"))
    found = telemetry.flow_edges(flows, telemetry.address_map(_hosts(spark, sf_dir)))
    return found.select("from_ext", "to_ext", F.unix_seconds(F.element_at("evidence", 1)["observed_at"]).alias("first_start"))


@query("""WITH b AS (SELECT lower(replace(p_type, ' ', '-')) || '-' || p_partkey AS name, p_partkey FROM part), r AS (SELECT s_suppkey, left(name, 3 + s_suppkey % 7) AS prefix FROM supplier JOIN b ON p_partkey = s_suppkey)
SELECT 'role-' || s_suppkey AS from_ext, name AS to_ext, 'inline:p grants s3:GetObject,inline:p grants s3:PutObject' AS actions FROM r JOIN b ON starts_with(name, prefix)""")
def src_bucket_grants(spark, sf_dir):
    part = fx.read(spark, sf_dir, "part")
    buckets = part.select(F.concat_ws("-", F.lower(F.translate("p_type", " ", "-")), F.col("p_partkey").cast("string")).alias("Name"), "p_partkey")
    roles = fx.read(spark, sf_dir, "supplier").join(buckets, F.col("p_partkey") == F.col("s_suppkey"))
    resource = F.concat(F.lit("arn:aws:s3:::"), F.expr("left(Name, 3 + s_suppkey % 7)"), F.lit("*"))
    statement = F.struct(F.lit("Allow").alias("Effect"), F.array(F.lit("s3:GetObject"), F.lit("s3:PutObject"), F.lit("ec2:RunInstances")).alias("Action"), resource.alias("Resource"))
    policies = roles.select(F.lit("iam_role").alias("principal_type"), F.concat(F.lit("role-"), "s_suppkey").alias("principal"), F.lit("inline:p").alias("label"), F.to_json(F.struct(F.array(statement).alias("Statement"))).alias("policy"))
    found = aws.bucket_grants(policies, buckets.select("Name"), F.lit(NOW).cast("timestamp"))
    return found.select("from_ext", "to_ext", F.array_join("evidence.detail", ",").alias("actions"))


@query("""WITH pod AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS n FROM customer), want AS (SELECT s_suppkey, s_nationkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' END AS seg FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS owner, CAST(c_custkey AS VARCHAR) AS pod FROM want JOIN pod ON pod.n = want.n AND (want.seg IS NULL OR want.seg = pod.seg)""")
def src_pod_selectors(spark, sf_dir):
    c, s = fx.read(spark, sf_dir, "customer"), fx.read(spark, sf_dir, "supplier")
    labels = F.create_map(F.lit("app"), F.lit("web"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("seg"), F.col("c_mktsegment"))
    pods = c.select(F.struct(F.col("c_custkey").cast("string").alias("uid"), labels.alias("labels")).alias("metadata"))
    seg = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY")
    selector = F.create_map(F.lit("app"), F.lit("web"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    selector = F.when(seg.isNull(), selector).otherwise(F.map_concat(selector, F.create_map(F.lit("seg"), F.coalesce(seg, F.lit("")))))
    services = s.select(F.struct(F.col("s_suppkey").cast("string").alias("uid")).alias("metadata"), F.struct(selector.alias("selector")).alias("spec"))
    return kubernetes.selected(services, "spec.selector", pods)


def _told(edges: DataFrame) -> DataFrame:
    return edges.select("type", "from_ext", "to_ext", "edge_key", F.array_join("evidence.detail", ",").alias("details"))


@query("""WITH tg AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A')
SELECT t AS type, 'lb-' || l_suppkey AS from_ext, 'i-' || o_custkey AS to_ext, '' AS edge_key, 'aws:elbv2:describe_target_health' AS details FROM tg, (VALUES ('ROUTES_TO'), ('EXPOSES')) v(t)
UNION ALL SELECT 'CONTAINS', 'vpc-' || s_nationkey, 'lb-' || s_suppkey, '', 'aws:elbv2:describe_load_balancers' FROM supplier
UNION ALL SELECT 'RESOLVES_TO', lower(s_name), 'lb-' || s_suppkey, '', 'aws:elbv2:describe_load_balancers' FROM supplier WHERE s_acctbal > 0""")
def src_aws_balancers(spark, sf_dir):
    """Suppliers as load balancers with a target group each, whose targets are the customers they sold to."""
    s, line, orders = (fx.read(spark, sf_dir, t) for t in ("supplier", "lineitem", "orders"))
    arn = lambda c: F.concat(F.lit("lb-"), c)
    none = F.lit(None).cast("string")
    lbs = s.select(arn("s_suppkey").alias("LoadBalancerArn"), F.col("s_name").alias("LoadBalancerName"), none.alias("Type"), none.alias("Scheme"), F.when(F.col("s_acctbal") > 0, F.lower("s_name")).alias("DNSName"), F.concat(F.lit("vpc-"), "s_nationkey").alias("VpcId"))
    groups = s.select(F.concat(F.lit("tg-"), "s_suppkey").alias("TargetGroupArn"), F.array(arn("s_suppkey")).alias("LoadBalancerArns"))
    sold = line.where("l_returnflag = 'A'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    health = sold.select(F.concat(F.lit("tg-"), "l_suppkey").alias("TargetGroupArn"), F.struct(F.concat(F.lit("i-"), "o_custkey").alias("Id")).alias("Target"))
    return _told(aws.balancers(lbs, groups, health, F.lit(NOW).cast("timestamp"))[1])


@query("""WITH placed AS (SELECT 'i-' || c_custkey AS i, 'sn-' || c_nationkey AS sn, c_nationkey % 5 AS net, c_mktsegment AS tag FROM customer),
 fw AS (SELECT 'fw-' || s_suppkey AS f, s_suppkey % 5 AS net, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' END AS tag, s_suppkey % 7 <> 0 AS live, s_suppkey AS k FROM supplier)
SELECT DISTINCT 'CONNECTS_TO' AS type, f AS from_ext, sn AS to_ext, '' AS edge_key, 'gcp:firewall:rule:' || f || ' allows tcp/' || k || ' from *' AS details FROM fw JOIN placed p ON p.net = fw.net AND (fw.tag IS NULL OR p.tag = fw.tag) WHERE live
UNION ALL SELECT 'RUNS_ON', i, sn, '', 'gcp:instance:nic:subnetwork' FROM placed
UNION ALL SELECT 'CONTAINS', 'p', i, '', 'gcp:project:instance' FROM placed
UNION ALL SELECT 'CONTAINS', 'net-' || (n_nationkey % 5), 'sn-' || n_nationkey, '', 'gcp:network:subnetwork' FROM nation
UNION ALL SELECT DISTINCT 'CONTAINS', 'p', 'net-' || (n_nationkey % 5), '', 'gcp:project:network' FROM nation""")
def src_gcp(spark, sf_dir):
    """Nations as subnetworks of five networks, customers as instances in them, suppliers as firewalls, some off or with a target tag."""
    n, c, s = (fx.read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    none, strings = F.lit(None).cast("string"), F.array().cast("array<string>")
    net = lambda k: F.concat(F.lit("net-"), (F.col(k) % 5).cast("string"))
    networks = n.select(net("n_nationkey").alias("selfLink")).distinct().select("selfLink", none.alias("name"), F.lit(None).cast("boolean").alias("autoCreateSubnetworks"), F.struct(none.alias("routingMode")).alias("routingConfig"))
    subnets = n.select(F.concat(F.lit("sn-"), "n_nationkey").alias("selfLink"), F.col("n_name").alias("name"), net("n_nationkey").alias("network"), none.alias("region"), none.alias("ipCidrRange"))
    instances = c.select(F.concat(F.lit("i-"), "c_custkey").alias("selfLink"), F.col("c_name").alias("name"), none.alias("machineType"), none.alias("zone"), F.struct(F.array("c_mktsegment").alias("items")).alias("tags"), F.array(F.struct(F.concat(F.lit("sn-"), "c_nationkey").alias("subnetwork"))).alias("networkInterfaces"))
    name, k = F.concat(F.lit("fw-"), "s_suppkey"), F.col("s_suppkey")
    targets = F.when(k % 3 == 0, F.array(F.lit("BUILDING"))).when(k % 3 == 1, F.array(F.lit("MACHINERY"))).otherwise(strings)
    firewalls = s.select(name.alias("selfLink"), name.alias("name"), net("s_suppkey").alias("network"), F.lit("INGRESS").alias("direction"), (k % 7 == 0).alias("disabled"), F.array(F.struct(F.lit("tcp").alias("IPProtocol"), F.array(k.cast("string")).alias("ports"))).alias("allowed"), targets.alias("targetTags"), strings.alias("sourceRanges"), strings.alias("sourceTags"))
    return _told(clouds.gcp("p", networks, subnets, firewalls, instances, F.lit(NOW).cast("timestamp"))[1])


@query("""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'app-' || (p_partkey % 25) AS app, p_size FROM part), g AS (SELECT DISTINCT o_custkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT 'CONTAINS' AS type, 'acme/' || app AS from_ext, 'acme/' || app || '/' || id AS to_ext, '' AS edge_key, 'saas:app:resource' AS details FROM r WHERE CAST(split_part(app, '-', 2) AS INTEGER) IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'DEPENDS_ON', 'acme/' || app || '/' || id, 'acme/x/' || p_size, 'acme/x/' || p_size, 'saas:resource:depends_on:acme/x/' || p_size FROM r WHERE p_size > 40
UNION ALL SELECT 'CONTAINS', 'acme/app-' || c_nationkey, 'acme/' || c_custkey, '', 'saas:app:account' FROM customer
UNION ALL SELECT 'HAS_ACCESS_TO', 'acme/' || o_custkey, 'acme/' || app || '/' || id, CAST(l_linenumber AS VARCHAR), 'saas:grant:' || l_linenumber || ' (scope=read)' FROM g JOIN r ON id = CAST(l_partkey AS VARCHAR)""")
def src_saas(spark, sf_dir):
    """Nations as applications, customers as accounts, parts as resources, returned lines as grants."""
    n, c, p, line, orders = (fx.read(spark, sf_dir, t) for t in ("nation", "customer", "part", "lineitem", "orders"))
    none, app = F.lit(None).cast("string"), lambda k: F.concat(F.lit("app-"), k)
    apps = n.select(app("n_nationkey").alias("id"), F.col("n_name").alias("name"), none.alias("vendor"), none.alias("category"))
    accounts = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), none.alias("email"), none.alias("kind"), app("c_nationkey").alias("app_id"))
    handle = F.when(F.col("p_size") > 40, F.concat(F.lit("acme/x/"), "p_size"))
    resources = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), none.alias("kind"), app((F.col("p_partkey") % 25).cast("string")).alias("app_id"), handle.alias("external_handle"))
    given = line.where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    grants = given.select(F.col("l_linenumber").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("account_id"), F.col("l_partkey").cast("string").alias("resource_id"), F.lit("read").alias("scope"))
    return _told(clouds.saas("acme", apps, accounts, resources, grants, F.lit(NOW).cast("timestamp"))[1])


@query("""SELECT type, f AS from_ext, t AS to_ext, "at", CASE WHEN gone THEN 3 ELSE 1 END AS step, CASE WHEN NOT gone THEN name || ' (eventID=' || event_id || ')' END AS detail FROM
 (SELECT 'CONNECTS_TO' AS type, 'sg-' || json_extract_string(props, '$.k') AS f, 'sg-' || user_id AS t, ts AS "at", event_type = 'error' AS gone, 'AuthorizeSecurityGroupIngress' AS name, event_id FROM events)""")
def src_cloudtrail(spark, sf_dir):
    """Each event as a rule that one group's traffic may come from another, or for errors that it no longer may."""
    e = fx.read(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    peer = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("sg-"), F.get_json_object("props", "$.k")).alias("groupId"))).alias("items")).alias("groups"))).alias("items"))
    request = F.struct(F.concat(F.lit("sg-"), "user_id").alias("groupId"), peer.alias("ipPermissions"))
    name = F.when(gone, "RevokeSecurityGroupIngress").otherwise("AuthorizeSecurityGroupIngress")
    text = F.to_json(F.struct(name.alias("eventName"), F.col("event_id").cast("string").alias("eventID"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"), request.alias("requestParameters")))
    log, _ = aws.cloudtrail_log(e.select(text.alias("value")))
    return log.select("type", "from_ext", "to_ext", F.col("at").cast("timestamp_ntz").alias("at"), "step", F.get("evidence", F.lit(0))["detail"].alias("detail"))


# Events and evaluations


@query("""WITH e AS (SELECT user_id, event_type AS name, ts, event_id, event_type <> 'error' AS up, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
 a AS (SELECT *, CASE WHEN up AND (before IS NULL OR before = 'error') THEN 'create' WHEN up AND before <> name THEN 'update' WHEN up THEN 'touch' WHEN before <> 'error' THEN 'close' END AS action FROM e),
 v AS (SELECT *, count(*) FILTER (action IN ('create', 'update')) OVER w AS nth, count(*) FILTER (action = 'create') OVER w AS life FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM v WHERE action IN ('create', 'update', 'close')),
 seen AS (SELECT user_id, nth, max(ts) AS last_seen FROM v WHERE up GROUP BY ALL), born AS (SELECT user_id, life, min(ts) AS first_seen FROM v WHERE action = 'create' GROUP BY ALL)
SELECT CAST(m.user_id AS VARCHAR) AS external_id, name, first_seen, last_seen, ts AS valid_from, valid_to FROM m JOIN seen USING (user_id, nth) JOIN born USING (user_id, life) WHERE action <> 'close'""")
def event_fold(spark, sf_dir):
    """Events as upserts and removals of items, folded in two batches; the SQL knows of no batches."""
    from ..schema import CI

    e = fx.read(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    log = e.select(
        F.lit("ec2_instance").alias("type"), F.col("user_id").cast("string").alias("external_id"), F.col("event_type").alias("name"), F.lit("{}").alias("attributes"), F.lit(1.0).alias("confidence"),
        F.when(gone, "remove").otherwise("upsert").alias("op"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"), F.col("event_id").cast("string").alias("event_id"), F.when(gone, events.REMOVE_CI).otherwise(events.UPSERT_CI).alias("step"),
    )
    state = spark.createDataFrame([], CI)
    new_id = conf.canonical_id(F.col("type"), F.col("external_id"), F.col("at").cast("string"))
    half = F.lit(AT).cast("timestamp")
    for batch in (log.where(F.col("at") < half), log.where(F.col("at") >= half)):
        state = written(events.folded(state, batch, ["type", "external_id"], ["name", "attributes", "confidence"], new_id, "first_seen", "last_seen")[0], "state")
    return state.select("external_id", "name", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen", "valid_from", "valid_to")))


@query(NEAR.rstrip() + """, broad AS (SELECT from_id FROM edge JOIN ci ON id = from_id WHERE edge.type = 'HAS_ACCESS_TO' AND ci.type = 'ec2_instance' GROUP BY from_id HAVING count(DISTINCT to_id) >= 10),
 found AS (SELECT (SELECT count(*) FROM far JOIN ci ON id = node WHERE type = 'rds') + (SELECT count(*) FROM broad) AS n)
SELECT (SELECT count(*) FROM ci WHERE type IN ('rds', 'ec2_instance')) AS evaluated, n AS opened, CAST(0 AS BIGINT) AS resolved, n AS open_count FROM found""")
def findings_eval(spark, sf_dir):
    from ..schema import FINDING

    kept = fx.kept(spark, sf_dir)
    return rules.evaluate_findings(spark.createDataFrame([], FINDING), kept.nodes, kept.edges, fx.TENANT, F.lit(NOW).cast("timestamp"), principals=("ec2_instance",), kept=kept)[1]


_WEEKS = ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22")


def _triggered(k: int) -> str:
    since, until = (f"TIMESTAMP '{d}'" for d in _WEEKS[k])
    return f"""w{k} AS (SELECT 'anomaly_public_ip_on_database' AS rule_id, 'rds:' || json_extract_string(props, '$.k') AS subject, count(*) AS n FROM events WHERE event_type <> 'view' AND ts >= {since} AND ts < {until}
  AND 'rds:' || json_extract_string(props, '$.k') IN (SELECT node FROM far JOIN ci ON id = node WHERE type = 'rds') GROUP BY 2
 UNION ALL SELECT 'anomaly_security_group_opened_to_world', to_id, count(*) FROM ({sql.changes('edge', since, until)}) WHERE kind = 'created' GROUP BY 2)"""


@query(NEAR.rstrip() + f", {sql.VERSION}, {_triggered(0)}, {_triggered(1)} SELECT b.rule_id, b.subject AS subject_ci_id, CASE WHEN a.subject IS NULL THEN '{_WEEKS[1][0]}' ELSE '{_WEEKS[0][0]}' END AS since, coalesce(a.n, b.n) AS triggers FROM w1 b LEFT JOIN w0 a ON a.rule_id = b.rule_id AND a.subject = b.subject")
def anomalies_eval(spark, sf_dir):
    """Open findings after two windows: those of the first that the second doesn't trigger are resolved, those that it does stay as they were."""
    import datetime as dt

    from ..schema import FINDING

    kept = fx.kept(spark, sf_dir)
    seen = fx.versions(spark, sf_dir).withColumn("type", F.lit("CONNECTS_TO"))
    feed = _part_changes(spark, sf_dir).unionByName(temporal.changes(seen, "edge", F.lit(_WEEKS[0][0]).cast("timestamp_ntz"), F.lit(_WEEKS[1][1]).cast("timestamp_ntz")))
    findings = spark.createDataFrame([], FINDING)
    for since, until in _WEEKS:
        findings, _ = rules.evaluate_anomalies(findings, kept.nodes, kept.edges, feed, fx.TENANT, dt.datetime.fromisoformat(since), dt.datetime.fromisoformat(until), F.lit(until).cast("timestamp"), group_type="ec2_instance", kept=kept)
    triggers = F.size(F.from_json(F.get_json_object("evidence", "$.triggering_events"), "array<string>")).cast("long")
    return temporal.open_findings(findings).select("rule_id", "subject_ci_id", F.substring(F.get_json_object("evidence", "$.window.since"), 1, 10).alias("since"), triggers.alias("triggers"))


# Questions

_ASKED = {
    "inventory": {"type": "vpc"}, "count_by_type": {}, "recent_changes": {"days": 7}, "blast_radius": {"external_id": "000000001"},
    "reachability": {"external_id": "000000001"},
}
_CHANGED = f"""SELECT count(*) FROM ({sql.changes('ci', SINCE, UNTIL)} UNION ALL {sql.changes('edge', SINCE, UNTIL, 'link')})"""
_FIRST = "SELECT min_by(id, type || id) AS id FROM ci WHERE external_id = '000000001'"


@query(
    sql.with_(sql.CI, sql.EDGE, sql.adjacency("impact"), sql.reached(_FIRST, 4), "hit AS MATERIALIZED (SELECT count(*) AS n FROM dist JOIN ci ON id = node WHERE distance > 0)", recursive=True)
    + f"""SELECT 'inventory' AS template, 'Found ' || count(*) || ' configuration items of type vpc.' AS summary FROM ci WHERE type = 'vpc'
 UNION ALL SELECT 'count_by_type', count(*) || ' configuration items across ' || count(DISTINCT type) || ' type(s).' FROM ci
 UNION ALL SELECT 'recent_changes', (WITH {sql.VERSION}, {sql.EDGE_VERSION} {_CHANGED}) || ' changes in the last 7 days.'
 UNION ALL SELECT 'blast_radius', n || CASE n WHEN 1 THEN ' resource' ELSE ' resources' END || ' would be impacted if ''000000001'' failed.' FROM hit
 UNION ALL SELECT 'reachability', (WITH RECURSIVE {sql.adjacency("reach")}, {sql.reached(_FIRST, 6)} SELECT count(*) || CASE count(*) WHEN 1 THEN ' source' ELSE ' sources' END FROM dist JOIN ci ON id = node WHERE distance > 0) || ' can reach ''000000001''.'"""
)
def answers(spark, sf_dir):
    """The sentence of each template: items of the graph, changes of the versions of hosts and links."""
    kept = fx.kept(spark, sf_dir)
    open_ = {"cis": kept.nodes.withColumn("valid_to", F.lit(None).cast("timestamp")), "open": kept.nodes, "open_edges": kept.edges, "kept": kept}
    past = {"cis": fx.versions(spark, sf_dir), "edges": fx.edge_versions(spark, sf_dir), "now": F.lit("2024-01-17").cast("timestamp_ntz")}
    told = [templates.answer(past if name == "recent_changes" else open_, name, templates.TEMPLATES[name].checked(args))[1].select(F.lit(name).alias("template"), "summary") for name, args in _ASKED.items()]
    out = told[0]
    for one in told[1:]:
        out = out.unionByName(one)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blast_radius(spark, sf_dir)
