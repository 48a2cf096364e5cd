"""Webhook deltas and fixed names."""

import json

from orrery import schema
from orrery.functions import names
from orrery.operators import resolution
from orrery.sources import aws, kubernetes
from pyspark.sql import functions as F

NOW = "2024-05-01 12:00:00"


def test_webhook_deltas(spark):
    good = {
        "source": " cmdb ",
        "upserts": [{"type": "vpc", "external_id": "v1", "name": "one"}],
        "edges": [{"type": "CONTAINS", "from_type": "vpc", "from_external_id": "v1", "to_type": "subnet", "to_external_id": "s1"}],
        "removed": [{"type": "subnet", "external_id": "s9"}],
        "removed_edges": [{"type": "CONTAINS", "from_type": "vpc", "from_external_id": "v1", "to_type": "subnet", "to_external_id": "s9"}],
    }
    values = [json.dumps(good), json.dumps({"source": "AWS-events", "upserts": []}), json.dumps({"source": "  "}), "no json"]
    out = aws.webhook(spark.createDataFrame([(v,) for v in values], "value string"), F.lit(NOW).cast("timestamp"))
    assert [(r.source, r.type, r.external_id, r.name) for r in out["cis"].collect()] == [("cmdb", "vpc", "v1", "one")]
    assert [(r.from_ext, r.to_ext) for r in out["edges"].collect()] == [("v1", "s1")]
    assert [r.external_id for r in out["removed_cis"].collect()] == ["s9"]
    assert [(r.from_ext, r.to_ext) for r in out["removed_edges"].collect()] == [("v1", "s9")]
    reasons = {r.value: r.reason for r in out["rejected"].collect()}
    assert reasons[values[1]] == "reserved source" and reasons[values[2]] == "no source" and set(reasons) == set(values[1:])
    assert all(aws.webhook(spark.createDataFrame([], "value string"), F.lit(NOW).cast("timestamp"))[k].count() == 0 for k in out)


def test_types_of_watched_kinds_are_known():
    assert set(kubernetes.KINDS.values()) <= set(schema.CI_TYPES) and kubernetes.KINDS["Deployment"] == "k8s_workload"


def test_normalised_names(spark):
    rows = [("a\u00a0b", "a b"), ("A\u3000 B!", "a b"), ("cafe\u0301 x", "cafe x"), ("d-e_f", "de_f"), (None, None)]
    got = spark.createDataFrame(rows, "x string, y string").select(names.normalized(F.col("x")).alias("n"), "y").collect()
    assert all(r.n == r.y for r in got)


def test_candidates_meet_by_each_signal(spark):
    """Names, hosts, addresses and aliases each bring a pair together; a brute-force join of all pairs finds no others."""
    rows = [
        ("01", "web server one", {}, [], ["a"]),
        ("02", "web server two", {}, [], ["b"]),
        ("03", "alpha", {"dns_name": "db.example.org"}, [], ["a"]),
        ("04", "beta", {"hostname": "db.example.org"}, [], ["b"]),
        ("05", "gamma", {"private_ip": "10.0.0.1"}, [], ["a"]),
        ("06", "delta", {"ip": "10.0.0.1"}, [], ["b"]),
        ("07", "x", {}, ["red blue"], ["a"]),
        ("08", "y", {}, ["blue red green"], ["b"]),
        ("09", None, {}, [], ["b"]),
        ("10", "web server one", {}, ["same"], ["a"]),
        ("11", "web server one", {}, ["same"], ["b"]),
    ]
    items = spark.createDataFrame([(i, "t", n, json.dumps(a), al, s) for i, n, a, al, s in rows], "id string, type string, name string, attributes string, aliases array<string>, sources array<string>")
    got = {(r.ci_id_a, r.ci_id_b): round(r.score, 3) for r in resolution.scored_pairs(items).collect()}
    assert got == {("01", "02"): 0.5, ("01", "11"): 1.0, ("02", "10"): 0.5, ("03", "04"): 1.0, ("05", "06"): 0.9, ("07", "08"): 0.667}
