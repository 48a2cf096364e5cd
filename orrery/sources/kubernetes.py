"""Kubernetes lists and watch events, from their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import canonical_json, iso_timestamp
from ..operators import events
from . import common

SOURCE = "kubernetes"
META = "metadata struct<uid:string,name:string,namespace:string,labels:map<string,string>,creationTimestamp:string,ownerReferences:array<struct<kind:string,uid:string>>>"
NODES, NAMESPACES = META, META
DEPLOYMENTS = f"{META}, spec struct<selector:struct<matchLabels:map<string,string>>>"
SERVICES = f"{META}, spec struct<selector:map<string,string>>"
PODS = f"{META}, spec struct<nodeName:string>, status struct<phase:string>"
#: A selector is read as JSON: a Deployment's has the labels one level deeper than a Service's.
WATCH = "type string, object struct<kind:string,metadata:struct<uid:string,name:string,namespace:string,resourceVersion:string,labels:map<string,string>,creationTimestamp:string>,spec:struct<nodeName:string,selector:string>,status:struct<phase:string>>"
KINDS = {"Node": "k8s_node", "Namespace": "k8s_namespace", "Deployment": "k8s_workload", "Service": "k8s_service", "Pod": "k8s_pod"}

#: Parts that the pods of a selector are dealt to.
POD_SALTS = 64


def selects(selector: Column, labels: Column) -> Column:
    """Whether all of a selector's labels are among some labels; an empty selector selects nothing."""
    pairs = F.map_entries(selector)
    return F.coalesce((F.size(pairs) > 0) & F.forall(pairs, lambda p: F.try_element_at(labels, p["key"]).eqNullSafe(p["value"])), F.lit(False))


def selected(owners: DataFrame, selector: str, pods: DataFrame) -> DataFrame:
    """(owner, pod): pods of any namespace by selector. Each different selector is looked up once, by that one of its labels that the fewest pods have, and then
    checked in full: a label like app=web that most pods carry brings none of them in where a rarer one is asked for too. Its pods then go to all its
    owners, dealt out by a hash of the pods, so that a selector of many owners and pods isn't one task's."""
    labelled = pods.select(F.col("metadata.uid").alias("pod"), F.col("metadata.labels").alias("labels")).withColumn("one", F.explode(F.map_entries("labels")))
    frequent = labelled.groupBy("one").agg(F.count(F.lit(1)).alias("_n"))
    asked = owners.select(F.col("metadata.uid").alias("owner"), F.array_sort(F.map_entries(selector)).alias("sel")).where(F.size("sel") > 0)
    asked = asked.withColumn("key", F.to_json("sel"))
    kinds = asked.groupBy("key").agg(F.first("sel").alias("sel"))
    # A label that no pod has is the rarest of all, and selects none.
    each = kinds.withColumn("one", F.explode("sel")).join(frequent, "one", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = each.groupBy("key").agg(F.min_by("one", F.struct("_n", "one")).alias("one"), F.first("sel").alias("sel"))
    met = rarest.join(labelled, "one").where(selects(F.map_from_entries("sel"), F.col("labels"))).select("key", "pod", F.pmod(F.xxhash64("pod"), F.lit(POD_SALTS)).alias("_salt"))
    dealt = asked.select("owner", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POD_SALTS - 1).cast("long"))).alias("_salt"))
    # The number of partitions is given, as few rows make many pairs: by their bytes they would be brought together into few tasks.
    tasks = int(pods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key", "_salt").join(met.repartition(tasks, "key", "_salt"), ["key", "_salt"]).select("owner", "pod")


def inventory(cluster: str, nodes: DataFrame, namespaces: DataFrame, deployments: DataFrame, services: DataFrame, pods: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a cluster."""
    top, c = nodes.sparkSession.range(1), F.col
    uid, name, space = c("metadata.uid"), c("metadata.name"), c("metadata.namespace")
    plain = F.coalesce(F.nullif(name, F.lit("")), uid)
    full = F.when(F.coalesce(space, F.lit("")) == "", plain).otherwise(F.concat(space, F.lit("/"), plain))
    none = F.create_map().cast("map<string,string>")
    items = common.union(
        common.item(top, "k8s_cluster", F.lit(cluster), F.lit(cluster)),
        common.item(nodes, "k8s_node", uid, plain, node_name=plain),
        common.item(namespaces, "k8s_namespace", uid, plain),
        common.item(deployments, "k8s_workload", uid, full, namespace=space, kind=F.lit("Deployment"), selector=F.coalesce("spec.selector.matchLabels", none)),
        common.item(services, "k8s_service", uid, full, namespace=space, selector=F.coalesce("spec.selector", none)),
        common.item(pods, "k8s_pod", uid, full, namespace=space, node_name=c("spec.nodeName"), phase=c("status.phase"), labels=F.coalesce("metadata.labels", none)),
    )
    spaces = namespaces.select(c("metadata.name").alias("_space"), uid.alias("_space_uid"))
    inside = lambda df: df.join(spaces, space == F.col("_space"))
    hosts = pods.join(nodes.select(c("metadata.name").alias("_node"), uid.alias("_node_uid")), c("spec.nodeName") == c("_node"))
    owned = selected(deployments, "spec.selector.matchLabels", pods)
    by_ref = pods.select(uid.alias("pod"), F.explode("metadata.ownerReferences").alias("o")).where("o.kind = 'Deployment'").select(c("o.uid").alias("owner"), "pod").join(owned, "pod", "left_anti").select("owner", "pod")
    routed = selected(services, "spec.selector", pods)
    e = common.edge
    edges = common.union(
        e(nodes, "CONTAINS", ("k8s_cluster", F.lit(cluster)), ("k8s_node", uid), SOURCE, now),
        e(namespaces, "CONTAINS", ("k8s_cluster", F.lit(cluster)), ("k8s_namespace", uid), SOURCE, now),
        *(e(inside(df), "CONTAINS", ("k8s_namespace", c("_space_uid")), (t, uid), SOURCE, now) for df, t in ((deployments, "k8s_workload"), (services, "k8s_service"), (pods, "k8s_pod"))),
        e(hosts, "RUNS_ON", ("k8s_pod", uid), ("k8s_node", c("_node_uid")), SOURCE, now),
        e(owned.unionByName(by_ref), "MEMBER_OF", ("k8s_pod", c("pod")), ("k8s_workload", c("owner")), SOURCE, now),
        e(routed, "ROUTES_TO", ("k8s_service", c("owner")), ("k8s_pod", c("pod")), SOURCE, now),
        e(routed, "EXPOSES", ("k8s_service", c("owner")), ("k8s_pod", c("pod")), SOURCE, now),
    )
    return items, edges


def watch_log(records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(log, rejected) of watch events, one JSON record in `value` each: ADDED and MODIFIED objects of five kinds are upserts, DELETED ones remove the item and
    the edge that it had. The log (events.LOG) is in the order of column `at`, where there is one, else of now, and of the objects' resource versions.
    Evidence is as old as the object, or as now. Edges name namespaces and nodes by name."""
    at = F.col("at") if "at" in records.columns else now
    c, o = F.col, "w.object"
    read = records.select("value", at.alias("at"), F.from_json("value", WATCH).alias("w"))
    type_ = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[c(f"{o}.kind")]
    reason = F.when(c("w.type").isNull() | c(f"{o}.kind").isNull(), "unreadable").when(c(f"{o}.metadata.uid").isNull(), "no uid").when(type_.isNull(), "unsupported kind").when(~c("w.type").isin("ADDED", "MODIFIED", "DELETED"), "unsupported event")
    made = iso_timestamp(c(f"{o}.metadata.creationTimestamp"))
    read = read.withColumns({"reason": reason, "t": type_, "kind": c(f"{o}.kind"), "uid": c(f"{o}.metadata.uid"), "space": F.coalesce(f"{o}.metadata.namespace", F.lit("")), "node": F.nullif(c(f"{o}.spec.nodeName"), F.lit("")), "made": F.coalesce(made, now)})
    ok = read.where("reason is null").withColumn("seq", F.coalesce(c(f"{o}.metadata.resourceVersion").try_cast("long"), F.lit(0).cast("long")))
    own = (F.concat_ws("/", "uid", c("seq").cast("string"), "w.type"), c("at"), c("seq"))
    plain = F.coalesce(F.nullif(c(f"{o}.metadata.name"), F.lit("")), c("uid"))
    name = F.when(c("kind").isin("Node", "Namespace") | (c("space") == ""), plain).otherwise(F.concat(c("space"), F.lit("/"), plain))
    none = F.create_map().cast("map<string,string>")
    attributes = {
        "Node": F.struct(plain.alias("node_name")),
        "Namespace": F.struct(F.lit(None).cast("string").alias("none")),
        "Deployment": F.struct(c("space").alias("namespace"), F.lit("Deployment").alias("kind"), F.coalesce(F.from_json(F.get_json_object(c("w.object.spec.selector"), "$.matchLabels"), "map<string,string>"), none).alias("selector")),
        "Service": F.struct(c("space").alias("namespace"), F.coalesce(F.from_json(c("w.object.spec.selector"), "map<string,string>"), none).alias("selector")),
        "Pod": F.struct(c("space").alias("namespace"), c("node").alias("node_name"), c("w.object.status.phase").alias("phase"), F.coalesce(c(f"{o}.metadata.labels"), none).alias("labels")),
    }
    told = F.concat(c("w.type"), F.lit(" "), c("kind"), F.lit(" (uid="), c("uid"), F.lit(")"))
    evidence = F.array(F.struct(F.lit("k8s-events").alias("source"), c("made").alias("observed_at"), told.alias("detail")))
    live, gone = ok.where("w.type <> 'DELETED'"), ok.where("w.type = 'DELETED'")

    def links(df: DataFrame, step: int) -> list[DataFrame]:
        more = {"source": F.lit("declared"), "confidence": F.lit(1.0), "evidence": evidence} if step == events.UPSERT_EDGE else {}
        held = df.where("kind in ('Deployment', 'Service') and space <> ''")
        ran = df.where("kind = 'Pod' and node is not null")
        return [
            events.rows(held, step, *own, type=F.lit("CONTAINS"), from_type=F.lit("k8s_namespace"), from_ext=c("space"), to_type=c("t"), to_ext=c("uid"), edge_key=F.lit(""), **more),
            events.rows(ran, step, *own, type=F.lit("RUNS_ON"), from_type=F.lit("k8s_pod"), from_ext=c("uid"), to_type=F.lit("k8s_node"), to_ext=c("node"), edge_key=F.lit(""), **more),
        ]

    log = common.union(
        *(events.rows(live.where(c("kind") == k), events.UPSERT_CI, *own, type=c("t"), external_id=c("uid"), name=name, attributes=canonical_json(F.to_json(a)), alias_keys=F.array().cast("array<string>"), confidence=F.lit(1.0)) for k, a in attributes.items()),
        *links(live, events.UPSERT_EDGE),
        events.rows(gone, events.REMOVE_CI, *own, type=c("t"), external_id=c("uid")),
        *links(gone, events.REMOVE_EDGE),
    )
    return log, read.where("reason is not null").select("value", "reason")


def watch(records: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The log's parts without their order: `cis`, `edges`, `removed_cis`, `removed_edges`, and `rejected`."""
    log, rejected = watch_log(records, now)
    return events.parts(log) | {"rejected": rejected}
