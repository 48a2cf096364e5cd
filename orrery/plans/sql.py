"""DuckDB SQL of the same derivations and queries, written apart from the DataFrame code."""

from __future__ import annotations

CI = """ci AS (
 SELECT 'region:'||r_regionkey AS id, 'region' AS type, lpad(CAST(r_regionkey AS VARCHAR),9,'0') AS external_id, r_name AS name FROM region
 UNION ALL SELECT 'vpc:'||n_nationkey, 'vpc', lpad(CAST(n_nationkey AS VARCHAR),9,'0'), n_name FROM nation
 UNION ALL SELECT 'elb:'||s_suppkey, 'elb', lpad(CAST(s_suppkey AS VARCHAR),9,'0'), s_name FROM supplier
 UNION ALL SELECT 'ec2_instance:'||c_custkey, 'ec2_instance', lpad(CAST(c_custkey AS VARCHAR),9,'0'), c_name FROM customer
 UNION ALL SELECT 'rds:'||p_partkey, 'rds', lpad(CAST(p_partkey AS VARCHAR),9,'0'), p_name FROM part
 UNION ALL SELECT 'internet:0', 'internet', 'internet', 'internet')"""

FLOW = """flow AS (SELECT event_id, user_id AS src, CAST(json_extract_string(props,'$.k') AS BIGINT) AS dst,
 CASE WHEN event_type='error' THEN 'REJECT' ELSE 'ACCEPT' END AS action, ts AS seen FROM events)"""

EDGE = FLOW + """, edge AS (
 SELECT 'CONTAINS' AS type, 'region:'||n_regionkey AS from_id, 'vpc:'||n_nationkey AS to_id, 'declared' AS source, CAST(1.0 AS DOUBLE) AS confidence FROM nation
 UNION ALL SELECT 'CONTAINS', 'vpc:'||c_nationkey, 'ec2_instance:'||c_custkey, 'declared', 1.0 FROM customer
 UNION ALL SELECT 'CONTAINS', 'vpc:'||s_nationkey, 'elb:'||s_suppkey, 'declared', 1.0 FROM supplier
 UNION ALL SELECT DISTINCT 'ROUTES_TO', 'elb:'||l_suppkey, 'rds:'||l_partkey, 'declared', 1.0 FROM lineitem WHERE l_returnflag='R'
 UNION ALL SELECT 'DEPENDS_ON', 'ec2_instance:'||o_custkey, 'rds:'||l_partkey, 'inferred', 1.0 - (1.0 - CAST(0.6 AS DOUBLE)) * pow(0.5, count(*) - 1) FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY o_custkey, l_partkey
 UNION ALL SELECT DISTINCT 'HAS_ACCESS_TO', 'ec2_instance:'||o_custkey, 'rds:'||l_partkey, 'declared', 1.0 FROM lineitem JOIN orders ON l_orderkey=o_orderkey
 UNION ALL SELECT 'CONNECTS_TO', 'internet:0', 'elb:'||s_suppkey, 'declared', 1.0 FROM supplier WHERE s_acctbal > 8000
 UNION ALL SELECT DISTINCT 'CONNECTS_TO', 'ec2_instance:'||src, 'ec2_instance:'||dst, 'inferred', CAST(0.6 AS DOUBLE) FROM flow WHERE action='ACCEPT')"""

WALKS = {
    "impact": ("'CONTAINS'", "'DEPENDS_ON','RUNS_ON','ROUTES_TO','EXPOSES'"),
    "reach": ("''", "'CONNECTS_TO','ROUTES_TO','HAS_ACCESS_TO','EXPOSES'"),
    "upstream": ("'DEPENDS_ON','RUNS_ON','ROUTES_TO','EXPOSES'", "'CONTAINS'"),
}


def adjacency(walk: str, least: float = 0.0, cap: int | None = 1000) -> str:
    """adj: deduplicated, ranked and cut neighbours with the confidence of the chosen edge."""
    out, back = WALKS[walk]
    return f"""live AS (SELECT * FROM edge WHERE confidence >= {least} AND from_id IN (SELECT id FROM ci) AND to_id IN (SELECT id FROM ci)),
 step AS (SELECT from_id AS src, to_id AS dst, 0 AS dir, type, confidence, from_id, to_id FROM live WHERE type IN ({out})
  UNION ALL SELECT to_id, from_id, 1, type, confidence, from_id, to_id FROM live WHERE type IN ({back})),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY dir, type) AS n FROM step) WHERE n = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dir, dst) AS rank, count(*) OVER (PARTITION BY src) AS degree FROM one),
 adj AS (SELECT * FROM ranked{f' WHERE rank <= {cap}' if cap else ''})"""


def reached(seeds: str, depth: int) -> str:
    """dist(seed, node, distance) of a search over adj."""
    return f"""walk AS (SELECT s.id AS seed, s.id AS node, 0 AS d FROM ({seeds}) s
  UNION SELECT w.seed, a.dst, w.d + 1 FROM walk w JOIN adj a ON a.src = w.node WHERE w.d < {depth}),
 dist AS (SELECT seed, node, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY seed, node)"""


def paths(seeds: str, depth: int) -> str:
    """best(seed, node, distance, hops, conf), level by level as a queue goes: within a seed, nodes stand in the order in which they came, and a
    node comes by the first in the queue that has it as a neighbour."""
    levels = [f"lv0 AS MATERIALIZED (SELECT id AS seed, id AS node, 0 AS distance, CAST(1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS hops, CAST(1.0 AS DOUBLE) AS conf FROM ({seeds}))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM lv{j}" for j in range(k))
        levels.append(
            f"""lv{k} AS MATERIALIZED (SELECT seed, node, {k} AS distance, row_number() OVER (PARTITION BY seed ORDER BY before, rank) AS pos, hops, conf FROM
 (SELECT l.seed, a.dst AS node, l.pos AS before, a.rank, list_append(l.hops, a.type || '|' || a.from_id || '|' || a.to_id) AS hops, l.conf * a.confidence AS conf,
  row_number() OVER (PARTITION BY l.seed, a.dst ORDER BY l.pos, a.rank) AS n FROM lv{k - 1} l JOIN adj a ON a.src = l.node ANTI JOIN ({seen}) v ON v.seed = l.seed AND v.node = a.dst) WHERE n = 1)"""
        )
    return ", ".join(levels) + ", best AS (" + " UNION ALL ".join(f"SELECT * FROM lv{k}" for k in range(depth + 1)) + ")"


def internet(depth: int) -> str:
    """near(node, distance, path): nodes that internet:0 reaches, found from there against adj of the walk `reach`; path runs from
    it to the node, at each node by the neighbour of the least rank among those one step nearer."""
    return f"""toward AS (SELECT 'internet:0' AS node, 0 AS d UNION SELECT a.src, t.d + 1 FROM toward t JOIN adj a ON a.dst = t.node WHERE t.d < {depth}),
 far AS (SELECT node, CAST(min(d) AS INTEGER) AS distance FROM toward GROUP BY node),
 nextstep AS (SELECT src, dst, type || '|' || from_id || '|' || to_id AS hop FROM (SELECT a.*, row_number() OVER (PARTITION BY a.src ORDER BY a.rank) AS nth FROM adj a JOIN far f ON f.node = a.src JOIN far g ON g.node = a.dst WHERE g.distance = f.distance - 1) WHERE nth = 1),
 near AS (SELECT node, distance, '' AS path FROM far WHERE distance = 0 UNION ALL SELECT s.src, n.distance + 1, n.path || CASE WHEN n.path = '' THEN '' ELSE ' > ' END || s.hop FROM near n JOIN nextstep s ON s.dst = n.node)"""


VERSION = """version AS (SELECT CAST(user_id AS VARCHAR) AS id, 'ec2_instance' AS type, event_type AS name, 'internet:0' AS from_id, 'ec2_instance:'||user_id AS to_id, ts AS valid_from, value,
 CASE WHEN nx IS NULL THEN NULL WHEN nx <= ts + INTERVAL 1 DAY THEN nx ELSE ts + INTERVAL 1 DAY END AS valid_to
 FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events))"""

EDGE_VERSION = """link AS (SELECT user_id || '>' || k AS id, 'CONNECTS_TO' AS type, 'ec2_instance:' || user_id AS from_id, 'ec2_instance:' || k AS to_id, ts AS valid_from,
 CASE WHEN nx IS NULL THEN NULL WHEN nx <= ts + INTERVAL 1 DAY THEN nx ELSE ts + INTERVAL 1 DAY END AS valid_to
 FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS nx FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)))"""

RUN = """run AS (SELECT event_id AS run_id, event_type AS source, CASE WHEN k % 17 = 0 THEN 'partial' WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END AS status, ts AS started_at,
 CASE WHEN k % 17 <> 0 THEN ts + INTERVAL 5 MINUTE END AS finished_at FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))"""

RECORD = """record AS (SELECT lpad(CAST(doc_id AS VARCHAR),9,'0') AS id, lang AS type, source, text AS name FROM documents)"""
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\x0B\x{{85}}\p{{Z}}]', '', 'g'), '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " "


def changes(entity: str, since: str, until: str, table: str = "version") -> str:
    """A feed by look-ups of predecessor and successor, where the DataFrame code uses a window."""
    ci = entity == "ci"
    cols = f"'{entity}' AS entity, {{kind}} AS kind, {{at}} AS at, v.id, v.type, {'v.name' if ci else 'CAST(NULL AS VARCHAR)'} AS name, {'CAST(NULL AS VARCHAR)' if ci else 'v.from_id'} AS from_id, {'CAST(NULL AS VARCHAR)' if ci else 'v.to_id'} AS to_id"
    before = f"CASE WHEN EXISTS (SELECT 1 FROM {table} p WHERE p.id = v.id AND p.valid_to = v.valid_from) THEN 'updated' ELSE 'created' END"
    opened = f"SELECT {cols.format(kind=before, at='v.valid_from')} FROM {table} v WHERE v.valid_from >= {since} AND v.valid_from < {until}"
    gone = f"SELECT {cols.format(kind=chr(39) + 'removed' + chr(39), at='v.valid_to')} FROM {table} v WHERE v.valid_to >= {since} AND v.valid_to < {until} AND NOT EXISTS (SELECT 1 FROM {table} s WHERE s.id = v.id AND s.valid_from = v.valid_to)"
    return f"{opened} UNION ALL {gone}"
