"""Risk and drift rules, findings, freshness, usage and notification payloads."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import canonical_id
from ..schema import ACCESS_BREADTH, DATABASE_TYPES, MONTHLY_QUOTA, STALE_SECONDS
from ..session import written
from . import graph, traversal

INTERNET_DATABASE = ("internet_reachable_database", "critical", "Database reachable from the internet")
BROAD_ACCESS = ("over_permissive_iam_role", "high", "Principal with access to many resources")
PUBLIC_DATABASE = ("anomaly_public_ip_on_database", "critical", "Database became reachable from the internet")
OPEN_GROUP = ("anomaly_security_group_opened_to_world", "high", "Security group opened to the world")


def internet_databases(cis: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("rds",), max_depth: int = 6, max_fanout: int = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(subject_ci_id, internet_id, distance, path): databases that an internet node reaches, by the nearest one. One search from the internet
    serves all databases."""
    targets = cis.where(F.col("type").isin(*types)).select("id")
    return traversal.nearest_internet(cis, edges, targets, max_depth, 0.0, max_fanout, kept).withColumnRenamed("seed", "subject_ci_id")


def broad_access(cis: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("iam_role", "iam_user"), least: int = ACCESS_BREADTH) -> DataFrame:
    """(subject_ci_id, target_count, targets) of principals with `least` or more different HAS_ACCESS_TO targets."""
    who = cis.where(F.col("type").isin(*types)).select(F.col("id").alias("from_id"))
    held = edges.where("type = 'HAS_ACCESS_TO'").join(who, "from_id", "left_semi").groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("targets"))
    return held.where(F.size("targets") >= least).select(F.col("from_id").alias("subject_ci_id"), F.size("targets").cast("long").alias("target_count"), "targets")


DATABASE_EDGES = ("CONNECTS_TO", "EXPOSES", "ROUTES_TO", "RESOLVES_TO")


def public_databases(cis: DataFrame, edges: DataFrame, changes: DataFrame, types: tuple[str, ...] = DATABASE_TYPES, max_depth: int = 6, max_fanout: int = 1000, kept: graph.Projection | graph.Walks | None = None) -> DataFrame:
    """(subject_ci_id, triggers): databases that changed, or got a new edge that leads to them, among `changes`, and that an
    internet node reaches now."""
    databases = cis.where(F.col("type").isin(*types)).select("id")
    edge_hit = changes.where("entity = 'edge' and kind = 'created'").where(F.col("type").isin(*DATABASE_EDGES)).select(F.col("to_id").alias("id"))
    own_hit = changes.where("entity = 'ci' and kind in ('created', 'updated')").select("id")
    hit = edge_hit.unionByName(own_hit).join(databases, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("triggers"))
    # Only what was hit is looked for, so paths are made for no other database.
    reached = traversal.nearest_internet(cis, edges, hit.select("id"), max_depth, 0.0, max_fanout, kept)
    return hit.join(reached.select(F.col("seed").alias("id")), "id", "left_semi").select(F.col("id").alias("subject_ci_id"), "triggers")


def opened_groups(cis: DataFrame, changes: DataFrame, group_type: str = "security_group") -> DataFrame:
    """(subject_ci_id, edge_count): groups to which an edge from the internet was created among `changes`; both ends must be
    open, the edge needn't be."""
    made = changes.where("entity = 'edge' and kind = 'created' and type = 'CONNECTS_TO'").select("from_id", "to_id", F.col("id").alias("edge_id"))
    made = made.join(cis.where("type = 'internet'").select(F.col("id").alias("from_id")), "from_id", "left_semi")
    made = made.join(cis.where(F.col("type") == group_type).select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return made.groupBy(F.col("to_id").alias("subject_ci_id")).agg(F.count_distinct("edge_id").alias("edge_count"))


def reconcile_findings(open_findings: DataFrame, desired: DataFrame) -> DataFrame:
    """(rule_id, subject_ci_id, action): `open` for what is new, `keep` for both, `resolve` for what is gone."""
    a = open_findings.select("rule_id", "subject_ci_id").withColumn("_old", F.lit(True))
    b = desired.select("rule_id", "subject_ci_id").distinct().withColumn("_new", F.lit(True))
    both = a.join(b, ["rule_id", "subject_ci_id"], "full_outer")
    return both.select("rule_id", "subject_ci_id", F.when(F.col("_old").isNull(), "open").when(F.col("_new").isNull(), "resolve").otherwise("keep").alias("action"))


def apply_findings(findings: DataFrame, desired: DataFrame, rule: tuple[str, str, str], tenant_id: str, now: Column) -> DataFrame:
    """The table of findings after an evaluation of one rule; desired has (subject_ci_id, evidence). A finding that comes back
    gets a new id."""
    rule_id, severity, title = rule
    is_open = (F.col("rule_id") == rule_id) & F.col("valid_to").isNull() & (F.col("status") == "open")
    wanted = desired.select("subject_ci_id").distinct().withColumn("_wanted", F.lit(True))
    seen = findings.join(wanted, "subject_ci_id", "left")
    gone = is_open & F.col("_wanted").isNull()
    kept = seen.withColumns({"valid_to": F.when(gone, now).otherwise(F.col("valid_to")), "status": F.when(gone, "resolved").otherwise(F.col("status"))}).select(*findings.columns)
    new = desired.join(findings.where(is_open).select("subject_ci_id"), "subject_ci_id", "left_anti")
    new = new.select(
        canonical_id(F.lit(tenant_id), F.lit(rule_id), F.col("subject_ci_id"), now.cast("string")).alias("id"), F.lit(tenant_id).alias("tenant_id"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"),
        "subject_ci_id", F.lit(title).alias("title"), F.concat(F.lit(f"{title}: "), "subject_ci_id").alias("description"), "evidence", F.lit("open").alias("status"), now.alias("detected_at"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return kept.unionByName(new.select(*findings.columns))


def evaluate_findings(findings: DataFrame, cis: DataFrame, edges: DataFrame, tenant_id: str, now: Column, principals: tuple[str, ...] = ("iam_role", "iam_user"), databases: tuple[str, ...] = ("rds",), kept: graph.Projection | graph.Walks | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of findings after both rules, and one row (evaluated, opened, resolved, open_count): open items of the rules' types, and
    findings of both rules. cis and edges are the open ones. Both results read `findings`: write the table before the next evaluation."""
    reached = internet_databases(cis, edges, databases, kept=kept).select("subject_ci_id", F.to_json(F.struct("internet_id", "distance")).alias("evidence"))
    broad = broad_access(cis, edges, principals).select("subject_ci_id", F.to_json(F.struct("target_count")).alias("evidence"))
    after = apply_findings(apply_findings(findings, reached, INTERNET_DATABASE, tenant_id, now), broad, BROAD_ACCESS, tenant_id, now)
    count = lambda c: F.count(F.when(c, 1))
    is_open = F.col("valid_to").isNull() & (F.col("status") == "open")
    own = F.col("rule_id").isin(INTERNET_DATABASE[0], BROAD_ACCESS[0])
    was = findings.where(own & is_open).select("id", F.lit(True).alias("_was"))
    told = after.where(own).join(was, "id", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    counters = told.agg(F.lit(0).alias("evaluated"), count(is_open & ~F.col("_was")).alias("opened"), count(~is_open & F.col("_was")).alias("resolved"), count(is_open).alias("open_count"))
    zero = F.lit(0)
    examined = cis.agg(count(F.col("type").isin(*principals, *databases)).alias("evaluated"), zero.alias("opened"), zero.alias("resolved"), zero.alias("open_count"))
    return after, examined.unionByName(counters).agg(*(F.sum(c).alias(c) for c in counters.columns))


def _label(cis: DataFrame) -> DataFrame:
    return cis.select(F.col("id").alias("subject_ci_id"), "external_id")


def evaluate_anomalies(
    findings: DataFrame, cis: DataFrame, edges: DataFrame, changes: DataFrame, tenant_id: str, since: datetime, until: datetime, now: Column, databases: tuple[str, ...] = DATABASE_TYPES, group_type: str = "security_group", kept: graph.Projection | graph.Walks | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table of findings after both anomaly rules over the changes in [since, until), and one row (scanned_events, opened, resolved, open_count).

    Findings of other rules are neither counted nor touched. What was found in an earlier window and isn't in this one is resolved. A finding's
    evidence has its rule, its subject, the window, the changes that triggered it by (at, id), and for databases the nearest internet item; it is as long as
    there are such changes. cis and edges are the open ones. since must be before until. Both rules scan each change."""
    if since >= until:
        raise ValueError("since must be before until")
    window = changes.where((F.col("at") >= F.lit(since)) & (F.col("at") < F.lit(until)))
    own = F.struct("at", "id", "entity", "kind", "type", "from_id", "to_id")
    span = F.struct(F.lit(since.isoformat()).alias("since"), F.lit(until.isoformat()).alias("until")).alias("window")
    gathered = lambda hits: hits.groupBy("subject_ci_id").agg(F.array_sort(F.collect_list("event")).alias("triggering_events")).join(_label(cis), "subject_ci_id")

    subjects = cis.where(F.col("type").isin(*databases)).select(F.col("id").alias("subject_ci_id"))
    to_it = window.where("entity = 'edge' and kind = 'created'").where(F.col("type").isin(*DATABASE_EDGES)).select(F.col("to_id").alias("subject_ci_id"), own.alias("event"))
    itself = window.where("entity = 'ci' and kind in ('created', 'updated')").select(F.col("id").alias("subject_ci_id"), own.alias("event"))
    hit = to_it.unionByName(itself).join(subjects, "subject_ci_id", "left_semi")
    near = traversal.nearest_internet(cis, edges, hit.select(F.col("subject_ci_id").alias("id")), kept=kept).select(F.col("seed").alias("subject_ci_id"), F.struct(F.col("internet_id").alias("id"), "distance").alias("reaching_source"))
    public = gathered(hit).join(near, "subject_ci_id")
    public = public.select("subject_ci_id", F.to_json(F.struct(F.lit(PUBLIC_DATABASE[0]).alias("rule_id"), F.col("external_id").alias("subject_external_id"), "triggering_events", "reaching_source", span)).alias("evidence"))

    made = window.where("entity = 'edge' and kind = 'created' and type = 'CONNECTS_TO'").select("from_id", F.col("to_id").alias("subject_ci_id"), own.alias("event"))
    made = made.join(cis.where("type = 'internet'").select(F.col("id").alias("from_id")), "from_id", "left_semi").join(cis.where(F.col("type") == group_type).select(F.col("id").alias("subject_ci_id")), "subject_ci_id", "left_semi")
    opened = gathered(made).select("subject_ci_id", F.to_json(F.struct(F.lit(OPEN_GROUP[0]).alias("rule_id"), F.col("external_id").alias("subject_external_id"), F.lit("0.0.0.0/0").alias("world_cidr"), "triggering_events", span)).alias("evidence"))

    after = written(apply_findings(apply_findings(findings, public, PUBLIC_DATABASE, tenant_id, now), opened, OPEN_GROUP, tenant_id, now), "findings")
    is_open = F.col("valid_to").isNull() & (F.col("status") == "open")
    mine = F.col("rule_id").isin(PUBLIC_DATABASE[0], OPEN_GROUP[0])
    was = findings.where(mine & is_open).select("id", F.lit(True).alias("_was"))
    told = after.where(mine).join(was, "id", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    counters = told.agg(count(is_open & ~F.col("_was")).alias("opened"), count(~is_open & F.col("_was")).alias("resolved"), count(is_open).alias("open_count"))
    scanned = window.agg((2 * F.count(F.lit(1))).alias("scanned_events"))
    return after, scanned.crossJoin(F.broadcast(counters))


def latest_runs(runs: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """The latest run of each source, its age in seconds since it finished, and whether it is stale (or never finished)."""
    newest = F.struct(F.col("started_at").isNull().alias("no_start"), (-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("back"), F.col("run_id").alias("run_id"))
    best = runs.groupBy("source").agg(F.min_by(F.struct(*runs.columns), newest).alias("r")).select("r.*")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("finished_at").cast("timestamp"))) / 1e6
    out = best.withColumn("age_seconds", age)
    return out.withColumn("stale", F.coalesce(F.col("age_seconds") > stale_seconds, F.lit(True)))


def freshness(slos: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(source, expected_interval_seconds, status, age_seconds, fresh): an SLO is met by a latest run that ended ok in time."""
    last = latest_runs(runs, now).select("source", "status", "age_seconds")
    out = slos.select("source", "expected_interval_seconds").join(last, "source", "left")
    ok = (F.col("status") == "ok") & (F.col("age_seconds") <= F.col("expected_interval_seconds"))
    return out.withColumn("fresh", F.coalesce(ok, F.lit(False))).orderBy("source")


def month_usage(usage: DataFrame, now: Column, quota: int = MONTHLY_QUOTA) -> DataFrame:
    """(used, remaining, exhausted) since the start of the calendar month of now."""
    used = usage.where(F.col("occurred_at") >= F.date_trunc("month", now)).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(quota) - F.col("used"), F.lit(0))).withColumn("exhausted", F.col("used") >= quota)


def payloads(findings: DataFrame, kind: str) -> DataFrame:
    """(id, payload) to send for each finding: the finding as JSON to a webhook, a line of text to a chat."""
    if kind == "slack":
        body = F.to_json(F.struct(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(" ("), "subject_ci_id", F.lit(")")).alias("text")))
    else:
        body = F.to_json(F.struct("id", "rule_id", "severity", "subject_ci_id", "title", "description", "status", "detected_at"))
    return findings.select("id", body.alias("payload"))


def dispatch(payload_rows: DataFrame, send, attempts: int = 3, sleep=time.sleep):
    """(id, attempt, status) of each delivery, sent by the executors with send(payload) -> bool: up to `attempts` tries, 1, 2, ...
    seconds apart, then a row `dead_letter`. Deliveries are made once, before the result is returned, which is a written table of them;
    only a lost task sends again: receivers must accept repeats."""

    def deliver(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n in range(1, attempts + 1):
                    ok = bool(send(p))
                    rows.append((i, n, "delivered" if ok else "failed"))
                    if ok:
                        break
                    sleep(2 ** (n - 1))
                else:
                    rows.append((i, attempts + 1, "dead_letter"))
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "attempt", "status"), r)) for r in rows], schema=pa.schema([("id", pa.string()), ("attempt", pa.int32()), ("status", pa.string())]))

    return written(payload_rows.select("id", "payload").mapInArrow(deliver, "id string, attempt int, status string"), "deliveries")
