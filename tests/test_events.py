"""Ordered events: any split into batches gives the state of one-by-one application; replays, raw facts, runs, conflicts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import events
from orrery.operators.commits import Conflict, Store
from orrery.sources import aws, kubernetes
from orrery.streaming import intake

DAY = dt.datetime(2024, 3, 1)


def at(k):
    return DAY + dt.timedelta(minutes=k)


def random_log(seed, n=90):
    """Upserts and removals of three items and of edges between them; some minutes hold several events."""
    draw, rows, live = random.Random(seed), [], set()
    for k in range(n):
        when, x, y = at(k // 2), *draw.sample(["a", "b", "c"], 2)
        base = dict.fromkeys("type external_id name attributes alias_keys from_type from_ext to_type to_ext edge_key source confidence evidence".split())
        head = {"event_id": f"e{k:03d}", "at": when, "seq": k}
        if draw.random() < 0.45 or k < 3:
            x = "abc"[k] if k < 3 else x
            live.add(x)
            rows.append(base | head | {"step": 0, "op": "upsert", "type": "vpc", "external_id": x, "name": draw.choice(["one", "two"]), "attributes": "{}"})
        elif draw.random() < 0.25:
            live.discard(x)
            rows.append(base | head | {"step": 2, "op": "remove", "type": "vpc", "external_id": x})
        else:
            ends = {"type": "CONNECTS_TO", "from_type": "vpc", "from_ext": x, "to_type": "vpc", "to_ext": y, "edge_key": ""}
            if draw.random() < 0.35:
                rows.append(base | head | ends | {"step": 3, "op": "remove"})
            elif {x, y} <= live:
                told = [{"source": "s", "observed_at": DAY, "detail": draw.choice(["p", "q"])}]
                rows.append(base | head | ends | {"step": 1, "op": "upsert", "source": "declared", "confidence": 1.0, "evidence": told})
    return rows


def one_by_one(rows):
    """Versions of items and edges, one event after another."""
    items, edges, open_items, open_edges, closed = [], [], {}, {}, 0
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
        if r["step"] in (0, 2):
            v = open_items.get(r["external_id"])
            if r["op"] == "remove":
                if v:
                    v["to"] = r["at"]
                    del open_items[r["external_id"]]
                continue
            if v and v["name"] == r["name"]:
                v["seen"] = r["at"]
                continue
            if v:
                v["to"] = r["at"]
            new = {"ext": r["external_id"], "life": v["life"] if v else (r["external_id"], r["at"]), "name": r["name"], "first": v["first"] if v else r["at"], "seen": r["at"], "from": r["at"], "to": None}
            items.append(new)
            open_items[r["external_id"]] = new
        else:
            # An item that closed at this very time still counts as open.
            ends = [max((i for i in items if i["ext"] == r[f"{e}_ext"] and (i["to"] is None or i["to"] >= r["at"])), key=lambda i: i["from"], default=None) for e in ("from", "to")]
            if None in ends:
                assert r["op"] == "remove"
                continue
            key = (ends[0]["life"], ends[1]["life"])
            v = open_edges.get(key)
            if r["op"] == "remove":
                if v:
                    v["to"], closed = r["at"], closed + 1
                    del open_edges[key]
                continue
            told = r["evidence"][0]["detail"]
            if v and v["told"] == told:
                continue
            if v:
                v["to"] = r["at"]
            open_edges[key] = {"key": key, "told": told, "from": r["at"], "to": None}
            edges.append(open_edges[key])
    return items, edges, closed


def empty_state(spark):
    from orrery.operators.commits import EMPTY

    return {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}


def found(state):
    """Versions with lives in place of ids."""
    cis = state["cis"].collect()
    life = {}
    for r in cis:
        life[r.id] = min(life.get(r.id, (r.external_id, r.first_seen)), (r.external_id, r.first_seen))
    items = sorted((r.external_id, str(life[r.id]), r.name, r.first_seen, r.last_seen, r.valid_from, str(r.valid_to)) for r in cis)
    edges = sorted((str((life[r.from_id], life[r.to_id])), r.evidence[0].detail, r.valid_from, str(r.valid_to)) for r in state["edges"].collect())
    return items, edges


@pytest.mark.parametrize("seed", [3])
def test_any_split_gives_one_state(spark, seed):
    rows = random_log(seed)
    items, edges, closed = one_by_one(rows)
    want = (
        sorted((i["ext"], str(i["life"]), i["name"], i["first"], i["seen"], i["from"], str(i["to"])) for i in items),
        sorted((str(e["key"]), e["told"], e["from"], str(e["to"])) for e in edges),
    )
    for cuts in ([0, len(rows)], [0, 21, 60, len(rows)]):
        state, total = empty_state(spark), {}
        for a, b in zip(cuts, cuts[1:]):
            log = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in events.LOG.split(", ")) for r in rows[a:b]], events.LOG)
            state = events.apply_log(state, log, "acme", "s")
            for k, v in state.pop("counts").first().asDict().items():
                total[k] = total.get(k, 0) + v
        assert found(state) == want
        assert total["cis_created"] + total["cis_updated"] == len(items) and total["edges_closed"] == closed


def trail(name, k, event, request=None, response=None):
    return json.dumps({"eventName": name, "eventID": event, "eventTime": at(k).isoformat() + "Z", "requestParameters": request, "responseElements": response})


def rule(peer):
    return {"groupId": "sg-1", "ipPermissions": {"items": [{"ipProtocol": "tcp", "groups": {"items": [{"groupId": peer}]}}]}}


def group(k, g, event):
    return trail("CreateSecurityGroup", k, event, {"groupName": g.upper(), "groupDescription": "d"}, {"groupId": g})


def test_a_rule_revoked_and_authorized_in_one_batch_is_open(spark):
    values = [group(0, "sg-1", "1"), group(0, "sg-2", "2"), trail("AuthorizeSecurityGroupIngress", 1, "3", rule("sg-2")), trail("RevokeSecurityGroupIngress", 2, "4", rule("sg-2")), trail("AuthorizeSecurityGroupIngress", 3, "5", rule("sg-2")), "no json", trail("StopInstances", 4, "6")]
    log, rejected = aws.cloudtrail_log(spark.createDataFrame([(v,) for v in values], "value string"))
    assert {r.reason for r in rejected.collect()} == {"unreadable", "unsupported event"}
    out = events.apply_log(empty_state(spark), log, "acme", "aws-events")
    got = sorted((r.valid_from, r.valid_to, r.evidence[0].detail) for r in out["edges"].collect())
    assert got == [(at(1), at(2), "AuthorizeSecurityGroupIngress (eventID=3)"), (at(3), None, "AuthorizeSecurityGroupIngress (eventID=5)")]
    assert out["counts"].first().asDict() == {"cis_created": 2, "cis_updated": 0, "cis_unchanged": 0, "cis_closed": 0, "cis_stale": 0, "edges_written": 2, "edges_closed": 1, "edges_stale": 0}
    lost, _ = aws.cloudtrail_log(spark.createDataFrame([(trail("AuthorizeSecurityGroupIngress", 1, "3", rule("sg-2")),)], "value string"))
    with pytest.raises(Exception, match="unresolved end of edge"):
        events.apply_log(empty_state(spark), lost, "acme", "aws-events")


def test_run_and_terminate_instances(spark):
    i = {"instanceId": "i-1", "instanceType": "t", "subnetId": "s-1", "vpcId": "v", "currentState": {"name": "pending"}, "groupSet": {"items": [{"groupId": "sg-1"}]}}
    values = [trail("RunInstances", 0, "1", None, {"instancesSet": {"items": [i]}}), trail("TerminateInstances", 5, "2", {"instancesSet": {"items": [{"instanceId": "i-1"}]}}), trail("CreateSecurityGroup", 1, "3", {"groupName": "g", "vpcId": "v"}, {"groupId": "sg-9"}), trail("CreateSecurityGroup", 1, "4")]
    out = aws.cloudtrail(spark.createDataFrame([(v,) for v in values], "value string"))
    assert {(r.type, r.external_id): json.loads(r.attributes) for r in out["cis"].collect()} == {("ec2_instance", "i-1"): {"instance_type": "t", "state": "pending", "subnet": "s-1", "vpc": "v"}, ("security_group", "sg-9"): {"vpc": "v"}}
    assert {(r.type, r.from_type, r.from_ext, r.to_ext) for r in out["edges"].collect()} == {("CONTAINS", "subnet", "s-1", "i-1"), ("MEMBER_OF", "ec2_instance", "i-1", "sg-1"), ("CONTAINS", "vpc", "v", "sg-9")}
    assert [r.external_id for r in out["removed_cis"].collect()] == ["i-1"] and [r.reason for r in out["rejected"].collect()] == ["no groupId"]


def watched(type_, kind, uid, version, **more):
    meta = {"uid": uid, "name": more.pop("name", uid.upper()), "namespace": more.pop("namespace", None), "resourceVersion": str(version), "labels": more.pop("labels", None)}
    return json.dumps({"type": type_, "object": {"kind": kind, "metadata": {k: v for k, v in meta.items() if v is not None}, **more}})


def test_watch_events(spark):
    values = [
        watched("ADDED", "Node", "n1", 1), watched("ADDED", "Namespace", "ns", 2, name="shop"),
        watched("ADDED", "Deployment", "d1", 3, namespace="shop", spec={"selector": {"matchLabels": {"app": "x"}}}),
        watched("ADDED", "Service", "s1", 4, namespace="shop", spec={"selector": {"app": "x"}}),
        watched("ADDED", "Pod", "p1", 5, name="", namespace="shop", labels={"app": "x"}, spec={"nodeName": "n1"}, status={"phase": "Running"}),
        watched("DELETED", "Pod", "p2", 6, namespace="shop", spec={"nodeName": "n1"}), watched("ADDED", "Secret", "x", 7), watched("BOOKMARK", "Pod", "x", 8), "{}",
    ]
    out = kubernetes.watch(spark.createDataFrame([(v,) for v in values], "value string"), F.lit("2024-03-01").cast("timestamp"))
    got = {r.external_id: (r.type, r.name, json.loads(r.attributes)) for r in out["cis"].collect()}
    assert got == {
        "n1": ("k8s_node", "N1", {"node_name": "N1"}), "ns": ("k8s_namespace", "shop", {}),
        "d1": ("k8s_workload", "shop/D1", {"namespace": "shop", "kind": "Deployment", "selector": {"app": "x"}}),
        "s1": ("k8s_service", "shop/S1", {"namespace": "shop", "selector": {"app": "x"}}),
        "p1": ("k8s_pod", "shop/p1", {"namespace": "shop", "node_name": "n1", "phase": "Running", "labels": {"app": "x"}}),
    }
    edges = {(r.type, r.from_ext, r.to_ext, r.evidence[0].detail) for r in out["edges"].collect()}
    assert edges == {("CONTAINS", "shop", "d1", "ADDED Deployment (uid=d1)"), ("CONTAINS", "shop", "s1", "ADDED Service (uid=s1)"), ("RUNS_ON", "p1", "n1", "ADDED Pod (uid=p1)")}
    assert [r.external_id for r in out["removed_cis"].collect()] == ["p2"] and [(r.from_ext, r.to_ext) for r in out["removed_edges"].collect()] == [("p2", "n1")]
    assert sorted(r.reason for r in out["rejected"].collect()) == ["unreadable", "unsupported event", "unsupported kind"]


def test_intake_counts_a_batch_once_and_one_writer_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    log, _ = aws.cloudtrail_log(spark.createDataFrame([(group(0, "sg-1", "1"),), (group(1, "sg-2", "2"),)], "value string"))
    first = intake.intake(store, log, "acme", "aws-events", 0)
    assert (first["cis_created"], first["raw_facts"]) == (2, 2)
    assert intake.intake(store, log, "acme", "aws-events", 0) is None and store.version() == 1 and store.facts().count() == 2
    # The same events in a later batch are left out of the state; an empty batch is a run without facts.
    again = intake.intake(store, log, "acme", "aws-events", 1)
    assert (again["cis_created"], again["cis_unchanged"], again["raw_facts"]) == (0, 0, 2)
    assert intake.intake(store, log.limit(0), "acme", "aws-events", 2)["raw_facts"] == 0
    assert sorted((r.run_id, r.status) for r in store.runs().collect()) == [("aws-events-0", "ok"), ("aws-events-1", "ok"), ("aws-events-2", "ok")]
    m, state = store.read()
    assert state["cis"].count() == 2 and store.append_facts(store.facts().drop("batch_id").limit(1), 9, "aws-events") == 1
    mine, theirs = Store(spark, store.root), Store(spark, store.root)
    base, _ = mine.read()
    theirs.commit(theirs.read()[0], {"cis": state["cis"].limit(1)})
    with pytest.raises(Conflict):
        mine.commit(base, {"cis": state["cis"].limit(0)})
    assert store.read()[1]["cis"].count() == 1
    store.vacuum(1)
    assert store.read()[1]["cis"].count() == 1 and store.version() == base["version"] + 1


def test_a_stream_runs_into_a_store(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "s"))
    folder.mkdir()
    (folder / "1.json").write_text(group(0, "sg-1", "1") + "\n" + group(0, "sg-2", "2") + "\n")
    run = lambda: intake.run(aws.cloudtrail_log(spark.readStream.text(str(folder)))[0], store, "acme", "aws-events", str(tmp_path / "c")).awaitTermination()
    run()
    (folder / "2.json").write_text(trail("AuthorizeSecurityGroupIngress", 1, "3", rule("sg-2")) + "\n")
    run()
    m, state = store.read()
    assert m["batches"] == {"aws-events": 1} and state["cis"].count() == 2 and state["edges"].where("valid_to is null").count() == 1


def test_a_trail_is_parsed_once(spark):
    log, rejected = aws.cloudtrail_log(spark.createDataFrame([("{}",), ("no json",)], "value string"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (log, rejected)]
    assert all(p.count("from_json") + p.count("jsontostructs") == 0 for p in plans)
    assert log.count() == 0 and rejected.count() == 2
