"""Inventories of the sources: items, edges with their evidence, and a search over what AWS gives."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import traversal, versions
from orrery.operators.commits import EMPTY
from orrery.sources import aws, clouds

NOW = dt.datetime(2024, 6, 1)


@pytest.fixture
def now():
    return F.lit(NOW).cast("timestamp")


@pytest.fixture
def frame(spark):
    return lambda schema, *rows: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows] or ["{}"]) if rows else spark.sparkContext.parallelize([], 1))


def things(items):
    return {(r.type, r.external_id): (r.name, json.loads(r.attributes)) for r in items.collect()}


def ways(edges):
    return {(r.type, r.from_ext, r.to_ext, r.edge_key): [e.detail for e in r.evidence] for r in edges.collect()}


def test_aws_from_the_internet_to_an_instance(spark, frame, now):
    vpcs = frame(aws.VPCS, {"VpcId": "v", "CidrBlock": "10.0.0.0/16", "IsDefault": True, "Tags": [{"Key": "Name", "Value": "main"}]})
    subnets = frame(aws.SUBNETS, {"SubnetId": "s", "VpcId": "v"})
    instances = frame(aws.INSTANCES, *({"InstanceId": i, "SubnetId": "s", "VpcId": "v", "State": {"Name": "running"}, "SecurityGroups": [{"GroupId": "sg"}]} for i in ("i-1", "i-2")))
    databases = frame(aws.DATABASES, {"DBInstanceArn": "arn:db", "DBInstanceIdentifier": "db", "Engine": "pg", "DBInstanceStatus": "available", "DBSubnetGroup": {"VpcId": "v"}})
    buckets = frame(aws.BUCKETS, {"Name": "b"}, {"Name": "c", "LocationConstraint": "eu"})
    items, edges = aws.network(vpcs, subnets, instances, databases, buckets, "123", "us-east-1", now)
    t, w = things(items), ways(edges)
    assert t["vpc", "v"] == ("main", {"cidr": "10.0.0.0/16", "is_default": True, "region": "us-east-1"})
    assert t["rds", "arn:db"] == ("db", {"engine": "pg", "status": "available", "vpc": "v"}) and t["s3_bucket", "b"][1] == {"region": "us-east-1"}
    assert w["CONTAINS", "v", "arn:db", ""] == ["aws:rds:describe_db_instances"] and w["CONTAINS", "123", "us-east-1", ""] == ["aws:account:region"] and ("CONTAINS", "s", "i-1", "") in w
    groups = frame(aws.GROUPS, {"GroupId": "sg", "GroupName": "g", "Description": "d", "VpcId": "v", "IpPermissions": [
        {"IpProtocol": "tcp", "FromPort": 443, "ToPort": 443, "IpRanges": [{"CidrIp": "0.0.0.0/0"}, {"CidrIp": "10.0.0.0/8"}], "Ipv6Ranges": [{"CidrIpv6": "::/0"}]},
        {"IpProtocol": "-1", "UserIdGroupPairs": [{"GroupId": "peer"}]},
    ]})
    group_items, group_edges = aws.group_rules(groups, now)
    assert things(group_items) == {("security_group", "sg"): ("g", {"description": "d", "vpc": "v"}), ("internet", "internet"): ("Internet (0.0.0.0/0, ::/0)", {})}
    assert ways(group_edges) == {("CONTAINS", "v", "sg", ""): ["aws:ec2:describe_security_groups"], ("CONNECTS_TO", "internet", "sg", ""): ["sg sg allows tcp/443 from 0.0.0.0/0", "sg sg allows tcp/443 from ::/0"], ("CONNECTS_TO", "peer", "sg", "all traffic"): ["sg sg allows all traffic from group peer"]}
    lbs = frame(aws.BALANCERS, {"LoadBalancerArn": "lb", "LoadBalancerName": "web", "Type": "application", "Scheme": "internet-facing", "DNSName": "web.example", "VpcId": "v"}, {"LoadBalancerArn": "lone"})
    health = frame(aws.TARGET_HEALTH, {"TargetGroupArn": "tg", "Target": {"Id": "i-1"}}, {"TargetGroupArn": "tg", "Target": {"Id": "10.0.0.1"}}, {"TargetGroupArn": "unused", "Target": {"Id": "i-2"}})
    lb_items, lb_edges = aws.balancers(lbs, frame(aws.TARGET_GROUPS, {"TargetGroupArn": "tg", "LoadBalancerArns": ["lb"]}, {"TargetGroupArn": "unused", "LoadBalancerArns": []}), health, now)
    assert things(lb_items)["elb", "lb"] == ("web", {"type": "application", "scheme": "internet-facing", "dns_name": "web.example", "vpc": "v"}) and ("dns_name", "web.example") in things(lb_items)
    assert set(ways(lb_edges)) == {("CONTAINS", "v", "lb", ""), ("RESOLVES_TO", "web.example", "lb", ""), ("ROUTES_TO", "lb", "i-1", ""), ("EXPOSES", "lb", "i-1", "")}
    # All ends resolve, and the balancer is found in front of the instance.
    discovered, found = items.unionByName(group_items).unionByName(lb_items), edges.unionByName(group_edges.where("from_ext <> 'peer'")).unionByName(lb_edges)
    state = versions.reconcile({n: spark.createDataFrame([], EMPTY[n]) for n in ("cis", "edges", "source_keys", "alias_keys")}, discovered, found, "t", "aws", [], [], now)
    live, open_edges = state["cis"].where("valid_to is null"), state["edges"].where("valid_to is null")
    assert open_edges.count() == found.count()
    target = live.where("external_id = 'i-1'").select("id")
    assert [r.name for r in traversal.reachability(live, open_edges, target).collect()] == ["web"]


def test_aws_principals_and_clusters(frame, now):
    items, edges = aws.principals(frame(aws.ROLES, {"Arn": "r", "RoleName": "role", "RoleId": "1"}), frame(aws.USERS, {"Arn": "u", "UserName": "user", "UserId": "2"}), "123", now)
    assert things(items) == {("iam_role", "r"): ("role", {"role_id": "1"}), ("iam_user", "u"): ("user", {"user_id": "2"})} and set(ways(edges)) == {("OWNS", "123", "r", ""), ("OWNS", "123", "u", "")}
    items, edges = aws.clusters(frame(aws.CLUSTERS, {"name": "k", "arn": "a", "status": "ACTIVE", "resourcesVpcConfig": {"vpcId": "v"}}, {"name": "bare"}), now)
    assert set(things(items)) == {("eks_cluster", "a"), ("eks_cluster", "bare")} and set(ways(edges)) == {("CONTAINS", "v", "a", "")}


def test_azure(frame, now):
    rg = "/subscriptions/x/resourceGroups/main"
    rule = lambda n, access="Allow", **p: {"name": n, "properties": {"access": access, "direction": "Inbound", **p}}
    nic = lambda *s: {"properties": {"ipConfigurations": [{"properties": {"subnet": {"id": x}}} for x in s]}}
    items, edges = clouds.azure(
        "x", frame(clouds.AZURE_GROUPS, {"id": rg, "name": "main", "location": "eu"}),
        frame(clouds.AZURE_VNETS, {"id": f"{rg}/v", "name": "v", "location": "eu", "properties": {"addressSpace": {"addressPrefixes": ["10.0.0.0/8"]}, "subnets": [{"id": "s1", "name": "one", "properties": {"addressPrefix": "10.1.0.0/16"}}, {"id": "s2"}]}}),
        frame(clouds.AZURE_NSGS, {"id": f"{rg}/n", "properties": {"subnets": [{"id": "s1"}, {"id": "gone"}], "securityRules": [rule("b", protocol="Tcp", destinationPortRange="22", sourceAddressPrefix="*"), rule("a"), rule("c", "Deny")]}}),
        frame(clouds.AZURE_VMS, {"id": f"{rg}/m", "name": "m", "location": "eu", "properties": {"hardwareProfile": {"vmSize": "big"}, "networkProfile": {"networkInterfaces": [nic(), nic("s2", "s1")]}}}, {"id": "lost", "properties": {"networkProfile": {"networkInterfaces": [nic("gone")]}}}),
        now,
    )
    t = things(items)
    assert t["azure_vm", f"{rg}/m"] == ("m", {"location": "eu", "vm_size": "big", "resource_group": "main"}) and t["azure_subnet", "s2"] == ("s2", {"vnet": f"{rg}/v"})
    assert ways(edges) == {
        ("CONTAINS", "x", rg, ""): ["azure:subscription:resource_group"], ("CONTAINS", rg, f"{rg}/v", ""): ["azure:resource_group:vnet"], ("CONTAINS", rg, f"{rg}/m", ""): ["azure:resource_group:vm"],
        ("CONTAINS", f"{rg}/v", "s1", ""): ["azure:vnet:subnet"], ("CONTAINS", f"{rg}/v", "s2", ""): ["azure:vnet:subnet"], ("RUNS_ON", f"{rg}/m", "s2", ""): ["azure:vm:nic:subnet"],
        ("CONNECTS_TO", f"{rg}/n", "s1", ""): ["azure:nsg:rule:a allows all/all from *", "azure:nsg:rule:b allows Tcp/22 from *"],
    }


def test_gcp(frame, now):
    firewall = lambda n, **more: {"selfLink": n, "name": n, "network": "net", "direction": "INGRESS", "allowed": [{"IPProtocol": "tcp", "ports": ["80", "443"]}], **more}
    items, edges = clouds.gcp(
        "p", frame(clouds.GCP_NETWORKS, {"selfLink": "net", "name": "n", "routingConfig": {"routingMode": "GLOBAL"}}),
        frame(clouds.GCP_SUBNETS, {"selfLink": "a", "network": "net", "region": "x/eu"}, {"selfLink": "b", "network": "net"}, {"selfLink": "empty", "network": "net"}, {"selfLink": "far", "network": "other"}),
        frame(clouds.GCP_FIREWALLS, firewall("all", sourceRanges=["9.0.0.0/8", "1.0.0.0/8"]), firewall("web", targetTags=["web"], sourceTags=["t"]), firewall("none", allowed=[]), firewall("off", disabled=True), firewall("out", direction="EGRESS"), firewall("any", network=None, allowed=[{"IPProtocol": "icmp"}])),
        frame(clouds.GCP_INSTANCES, {"selfLink": "i", "machineType": "m/small", "zone": "z/eu-1", "tags": {"items": ["web"]}, "networkInterfaces": [{"subnetwork": "unknown"}, {"subnetwork": "a"}]}, {"selfLink": "j", "networkInterfaces": [{"subnetwork": "b"}]}, {"selfLink": "k", "networkInterfaces": [{"subnetwork": "far"}]}),
        now,
    )
    assert things(items)["gcp_instance", "i"] == ("i", {"machine_type": "small", "zone": "eu-1", "tags": ["web"]})
    w = ways(edges)
    assert {k[1:3]: v for k, v in w.items() if k[0] == "RUNS_ON"} == {("i", "a"): ["gcp:instance:nic:subnetwork"], ("j", "b"): ["gcp:instance:nic:subnetwork"], ("k", "far"): ["gcp:instance:nic:subnetwork"]}
    rule = lambda n, what: [f"gcp:firewall:rule:{n} allows {what}"]
    assert {k[1:3]: v for k, v in w.items() if k[0] == "CONNECTS_TO"} == {("all", "a"): rule("all", "tcp/80,443 from 1.0.0.0/8,9.0.0.0/8"), ("all", "b"): rule("all", "tcp/80,443 from 1.0.0.0/8,9.0.0.0/8"), ("web", "a"): rule("web", "tcp/80,443 from tag:t"), **{("any", s): rule("any", "icmp from *") for s in ("a", "b", "far")}}
    assert {k[1:3] for k in w if k[0] == "CONTAINS"} == {("p", "net"), ("net", "a"), ("net", "b"), ("net", "empty"), ("p", "i"), ("p", "j"), ("p", "k")}


def test_catalog_and_saas(frame, now):
    key = lambda **k: {"constraint_name": "fk", "database": "d", "from_schema": "s", "from_table": "t", "from_columns": ["x", "y"], "to_schema": "s", "to_table": "u", "to_columns": ["z"]} | k
    items, edges = clouds.catalog("h", 5432, frame(clouds.DATABASES, {"name": "d", "owner": "o", "encoding": "UTF8"}), frame(clouds.SCHEMAS, {"database": "d", "name": "s"}, {"database": "gone", "name": "s"}), frame(clouds.TABLES, {"database": "d", "schema": "s", "name": "t", "relkind": "r", "estimated_rows": 5}, {"database": "d", "schema": "s", "name": "u"}), frame(clouds.KEYS, key(), key(to_table="gone")), now)
    assert things(items)["db_table", "h:5432/d/s/t"] == ("t", {"database": "d", "schema": "s", "table": "t", "kind": "r", "estimated_rows": 5}) and things(items)["db_instance", "h:5432"][1] == {"host": "h", "port": 5432, "engine": "postgresql"}
    w = ways(edges)
    assert w["DEPENDS_ON", "h:5432/d/s/t", "h:5432/d/s/u", "fk"] == ["db:fk:fk (s.t(x,y) -> s.u(z))"] and len(w) == 5
    items, edges = clouds.saas("acme", frame(clouds.APPS, {"id": "crm", "name": "CRM"}), frame(clouds.ACCOUNTS, {"id": "ann", "email": "A@x", "app_id": "crm"}, {"id": "bob", "app_id": "gone"}), frame(clouds.RESOURCES, {"id": "r", "app_id": "crm", "external_handle": "acme/crm/q"}, {"id": "q", "app_id": "crm"}), frame(clouds.ACCESS, {"id": "g", "account_id": "ann", "resource_id": "r", "scope": "read"}, {"account_id": "ann", "resource_id": "q"}, {"id": "h", "account_id": "none", "resource_id": "q"}), now)
    assert set(things(items)) == {("saas_app", "acme/crm"), ("saas_account", "acme/ann"), ("saas_account", "acme/bob"), ("saas_resource", "acme/crm/r"), ("saas_resource", "acme/crm/q")}
    assert ways(edges) == {
        ("CONTAINS", "acme/crm", "acme/ann", ""): ["saas:app:account"], ("CONTAINS", "acme/crm", "acme/crm/r", ""): ["saas:app:resource"], ("CONTAINS", "acme/crm", "acme/crm/q", ""): ["saas:app:resource"],
        ("DEPENDS_ON", "acme/crm/r", "acme/crm/q", "acme/crm/q"): ["saas:resource:depends_on:acme/crm/q"], ("HAS_ACCESS_TO", "acme/ann", "acme/crm/r", "g"): ["saas:grant:g (scope=read)"], ("HAS_ACCESS_TO", "acme/ann", "acme/crm/q", ""): ["saas:grant:<unnamed> (scope=None)"],
    }
