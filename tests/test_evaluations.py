"""Anomalies by window, deliveries that are made once, prefix and label indexes."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery import schema
from orrery.operators import rules
from orrery.sources import aws, kubernetes
from test_graph import items, links

FEED = "entity string, kind string, at timestamp, id string, type string, name string, from_id string, to_id string"


def day(d, hour=0):
    return dt.datetime(2024, 1, d, hour)


def test_anomalies_by_window(spark):
    cis = items(spark, ("net", "internet"), ("l", "elb"), ("db", "rds"), ("pg", "db_instance"), ("hidden", "rds"), ("sg", "security_group"), ("other", "security_group"))
    edges = links(spark, ("CONNECTS_TO", "net", "l"), ("ROUTES_TO", "l", "db"), ("ROUTES_TO", "l", "pg"))
    rows = [
        ("edge", "created", day(1, 5), "e2", "ROUTES_TO", None, "l", "db"),
        ("edge", "created", day(1, 5), "e1", "EXPOSES", None, "l", "db"),
        ("ci", "updated", day(1, 1), "db", "rds", "DB", None, None),
        ("edge", "created", day(1), "e3", "OWNS", None, "l", "pg"),  # of a type that exposes nothing
        ("edge", "removed", day(1), "e4", "ROUTES_TO", None, "l", "pg"),
        ("ci", "created", day(1), "hidden", "rds", None, None, None),  # not reached
        ("edge", "created", day(2), "e5", "CONNECTS_TO", None, "net", "sg"),
        ("edge", "created", day(2), "e6", "CONNECTS_TO", None, "l", "other"),  # not from the internet
        ("ci", "created", day(3), "pg", "db_instance", None, None, None),
        ("ci", "updated", day(3), "db", "rds", "DB", None, None),
    ]
    feed = spark.createDataFrame(rows, FEED)
    risk = ("r1", "t", "internet_reachable_database", "critical", "db", "x", "x", "{}", "open", day(1), day(1), None)
    findings = spark.createDataFrame([risk], schema.FINDING)

    def evaluate(findings, a, b):
        after, counts = rules.evaluate_anomalies(findings, cis, edges, feed, "t", day(a), day(b), F.lit(day(b)).cast("timestamp"))
        open_ = {(r.rule_id, r.subject_ci_id): r for r in after.where("status = 'open'").collect()}
        return after, tuple(counts.first()), open_

    public, world = rules.PUBLIC_DATABASE[0], rules.OPEN_GROUP[0]
    first, counts, open_ = evaluate(findings, 1, 3)
    assert counts == (16, 2, 0, 2) and set(open_) == {(public, "db"), (world, "sg"), ("internet_reachable_database", "db")}
    told = json.loads(open_[public, "db"].evidence)
    assert [e["id"] for e in told["triggering_events"]] == ["db", "e1", "e2"] and told["reaching_source"] == {"id": "net", "distance": 2} and told["window"]["until"] == "2024-01-03T00:00:00"
    again, counts, same = evaluate(first, 1, 3)
    assert counts == (16, 0, 0, 2) and {r.id for r in same.values()} == {r.id for r in open_.values()}
    # In the next window pg is new, db stays as it was and the group is resolved; the risk finding isn't touched.
    _, counts, later = evaluate(again, 3, 4)
    assert counts == (4, 1, 1, 2) and later[public, "db"].id == open_[public, "db"].id and set(later) == {(public, "db"), (public, "pg"), ("internet_reachable_database", "db")}
    assert evaluate(findings, 10, 11)[1] == (0, 0, 0, 0)
    for a, b in ((3, 3), (4, 3)):
        with pytest.raises(ValueError, match="since"):
            evaluate(findings, a, b)


def test_a_delivery_is_made_once(spark, tmp_path):
    log = str(tmp_path / "sent")

    def send(payload):
        with open(log, "a") as file:
            file.write(payload + "\n")
        return payload != "bad"

    out = rules.dispatch(spark.createDataFrame([("1", "good"), ("2", "bad")], "id string, payload string").coalesce(1), send, 2, lambda s: None)
    assert [sorted((r.id, r.attempt, r.status) for r in out.collect()) for _ in range(2)] == [[("1", 1, "delivered"), ("2", 1, "failed"), ("2", 2, "failed"), ("2", 3, "dead_letter")]] * 2
    assert sorted(open(log).read().split()) == ["bad", "bad", "good"]


def test_bucket_grants_by_prefix(spark):
    draw = random.Random(3)
    names = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(3, 6))) for _ in range(30)})
    wanted = {}
    rows = []
    for k in range(25):
        resources = ["*", "arn:aws:s3:::*", "arn:aws:sqs:::aa*", "arn:aws-cn:s3:::a*"] if k == 0 else [f"arn:aws:s3:::{draw.choice(names)[: draw.randint(1, 6)]}{draw.choice(['', '*', '/key', '*/key'])}" for _ in range(2)]
        rows.append(("iam_role", f"r{k}", "inline:p", json.dumps({"Statement": [{"Effect": "Allow", "Action": ["s3:GetObject"], "Resource": resources}, {"Effect": "Deny", "Action": "s3:*", "Resource": "*"}]})))
        for r in resources:
            part = "*" if r == "*" else r.removeprefix("arn:aws:s3:::").split("/")[0] if r.startswith("arn:aws:s3:::") else None
            if part is not None:
                wanted.setdefault(f"r{k}", set()).update(n for n in names if (n.startswith(part[:-1]) if part.endswith("*") else n == part))
    found = aws.bucket_grants(spark.createDataFrame(rows, aws.GRANTS), spark.createDataFrame([(n,) for n in names], "Name string"), F.lit(day(1)).cast("timestamp"))
    got = {}
    for r in found.collect():
        got.setdefault(r.from_ext, set()).add(r.to_ext)
        assert [e.detail for e in r.evidence] == ["inline:p grants s3:GetObject"]
    assert got == {k: v for k, v in wanted.items() if v}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_selectors_by_their_rarest_label(spark):
    draw = random.Random(8)
    pods = [(f"p{k}", {"app": "web", "tier": draw.choice("xyz"), "track": draw.choice("mn")}) for k in range(40)] + [("bare", {})]
    services = [("all", {"app": "web"}), ("one", {"app": "web", "tier": "x", "track": "m"}), ("none", {"app": "web", "tier": "absent"}), ("empty", {}), ("null", None)]
    p = spark.createDataFrame([({"uid": u, "labels": x},) for u, x in pods], "metadata struct<uid:string,labels:map<string,string>>")
    s = spark.createDataFrame([({"uid": u}, {"selector": x}) for u, x in services], "metadata struct<uid:string>, spec struct<selector:map<string,string>>")
    got = {(r.owner, r.pod) for r in kubernetes.selected(s, "spec.selector", p).collect()}
    assert got == {(o, q) for o, x in services if x for q, y in pods if x.items() <= y.items()}


def test_nested_patterns_bring_one_edge_without_gathering_pairs(spark):
    """Patterns of one principal that begin with each other: the longest brings the edge, with the actions of all."""
    policy = lambda *grants: json.dumps({"Statement": [{"Effect": "Allow", "Action": [f"s3:{a}"], "Resource": f"arn:aws:s3:::{r}"} for a, r in grants]})
    rows = [("iam_role", "r", "p", policy(("A", "a*"), ("B", "ab*"), ("C", "abc"), ("D", "abc*"), ("E", "*"), ("F", "x"))), ("iam_role", "r", "q", policy(("B", "ab*/k"))), ("iam_user", "r", "p", policy(("Z", "ab")))]
    names = ["a", "ab", "abc", "abcd", "b", "abc"]
    found = aws.bucket_grants(spark.createDataFrame(rows, aws.GRANTS), spark.createDataFrame([(n,) for n in names], "Name string"), F.lit(day(1)).cast("timestamp"))
    got = {(r.from_type, r.to_ext): "".join(e.detail[0] + e.detail[-1] for e in r.evidence) for r in found.collect()}
    assert got == {("iam_role", "b"): "pE", ("iam_role", "a"): "pApE", ("iam_role", "ab"): "pApBpEqB", ("iam_role", "abcd"): "pApBpDpEqB", ("iam_role", "abc"): "pApBpCpDpEqB", ("iam_user", "ab"): "pZ"}
    assert found.count() == len(got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is gathered of pairs


def test_selectors_of_many_owners_are_looked_up_once(spark):
    pods = [(f"p{k}", {"app": "web", "tier": "xyz"[k % 3]}) for k in range(30)]
    services = [(f"s{k}", {"app": "web", "tier": "xyz"[k % 3]} if k % 2 else {"tier": "xyz"[k % 3], "app": "web"}) for k in range(50)] + [("s0", {"app": "web"})]
    p = spark.createDataFrame([({"uid": u, "labels": x},) for u, x in pods], "metadata struct<uid:string,labels:map<string,string>>")
    s = spark.createDataFrame([({"uid": u}, {"selector": x}) for u, x in services], "metadata struct<uid:string>, spec struct<selector:map<string,string>>")
    out = kubernetes.selected(s, "spec.selector", p)
    assert sorted((r.owner, r.pod) for r in out.collect()) == sorted((o, q) for o, x in services for q, y in pods if x.items() <= y.items())
    top = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "forall" not in top  # labels are compared once for each different selector, below the join with its owners


def test_names_are_not_shuffled_for_each_prefix(spark, monkeypatch):
    from bench import shuffled

    monkeypatch.setattr(aws, "CHUNK", 100)
    draw = random.Random(5)
    names = sorted({f"{draw.getrandbits(200):x}" for _ in range(3000)})
    wide, exact = ["", *(n[: draw.randint(1, 4)] for n in draw.sample(names, 40))], draw.sample(names, 10)
    policy = lambda r: json.dumps({"Statement": [{"Effect": "Allow", "Action": "s3:A", "Resource": f"arn:aws:s3:::{r}"}]})
    rows = [("iam_role", f"r{k}", "p", policy(r)) for k, r in enumerate([*(f"{p}*" for p in wide), *exact, "none", "zz*"])]
    after, _ = shuffled(spark, 0)
    found = aws.bucket_grants(spark.createDataFrame(rows, aws.GRANTS), spark.createDataFrame([(n,) for n in [*names, names[0], None]], "Name string"), F.lit(day(1)).cast("timestamp"))
    got = sorted((r.from_ext, r.to_ext) for r in found.collect())
    assert got == sorted([(f"r{k}", n) for k, p in enumerate(wide) for n in names if n.startswith(p)] + [(f"r{len(wide) + k}", n) for k, n in enumerate(exact)])
    assert shuffled(spark, after)[1] < 1.0  # the names are 150 KB, all their prefixes 4 MB
    none = aws.bucket_grants(spark.createDataFrame(rows, aws.GRANTS), spark.createDataFrame([], "Name string"), F.lit(day(1)).cast("timestamp"))
    assert none.count() == 0
