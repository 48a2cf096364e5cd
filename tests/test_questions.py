"""Questions: a planner against fixed cases, checks of arguments, sentences, and what is declined."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orrery import schema
from orrery.plans import templates

# Questions with the template and the arguments that answer them; None where arguments aren't graded.
GOLDEN = [
    ("what EC2 instances do I have", "inventory", {"type": "ec2_instance"}),
    ("list my VPCs", "inventory", {"type": "vpc"}),
    ("show me all my S3 buckets", "inventory", {"type": "s3_bucket"}),
    ("what infrastructure resources are currently running?", "inventory", None),
    ("how many of each resource do I have", "count_by_type", {}),
    ("give me an inventory summary", "count_by_type", {}),
    ("how many resources are in my account broken down by type", "count_by_type", None),
    ("what breaks if vpc-123 goes down", "blast_radius", {"external_id": "vpc-123"}),
    ("what depends on i-0abc", "blast_radius", {"external_id": "i-0abc"}),
    ("if my RDS instance rds-prod failed, which services would be affected", "blast_radius", {"external_id": "rds-prod"}),
    ("what changed this week", "recent_changes", {"days": 7}),
    ("show changes in the last 14 days", "recent_changes", {"days": 14}),
    ("show me infrastructure changes from the past month", "recent_changes", {"days": 30}),
    ("can the internet reach i-1", "reachability", {"external_id": "i-1"}),
    ("is sg-123 publicly accessible", "reachability", {"external_id": "sg-123"}),
    ("what can reach my load balancer elb-prod", "reachability", {"external_id": "elb-prod"}),
    ("what's the weather in San Francisco", "unsupported", None),
    ("write me a poem about clouds", "unsupported", None),
    ("delete my VPC", "unsupported", None),
    ("what is the CEO's salary", "unsupported", None),
    ("translate 'hello world' to French", "unsupported", None),
]


@pytest.fixture(scope="module")
def state(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    ci = lambda i, t, until=None: (i, "t", t, f"{t}-{i}", i.upper(), "{}", 1.0, day(1), day(1), day(1), until)
    ev = [("s", day(1), "x")]
    edge = lambda t, a, b: (f"{a}>{b}", "t", t, a, b, "", "declared", 1.0, ev, day(2), None)
    cis = spark.createDataFrame([ci("net", "internet"), ci("l", "elb"), ci("db", "rds"), ci("v", "vpc"), ci("old", "vpc", day(3))], schema.CI)
    edges = spark.createDataFrame([edge("CONNECTS_TO", "net", "l"), edge("ROUTES_TO", "l", "db"), edge("CONTAINS", "v", "l")], schema.EDGE)
    return templates.state_of(cis, edges, F.lit("2024-01-04").cast("timestamp"))


def test_rules_answer_the_fixed_cases():
    assert templates.score(templates.by_rules, GOLDEN) == {"template": 1.0, "arguments": 1.0, "unsupported": 1.0, "overall": 1.0}


def test_score_counts_each_kind_of_fault():
    wrong = {"list my VPCs": ("inventory", {"type": "no_such"}), "what changed this week": ("recent_changes", {"days": 8}), "delete my VPC": ("inventory", {})}
    got = templates.score(lambda q: wrong.get(q) or templates.by_rules(q), GOLDEN)
    assert got == {"template": 20 / 21, "arguments": 12 / 14, "unsupported": 4 / 5, "overall": 18 / 21}
    assert templates.score(lambda q: None, GOLDEN)["unsupported"] == 1.0 and templates.score(templates.by_rules, []) == {"template": 1.0, "arguments": 1.0, "unsupported": 1.0, "overall": 1.0}


@pytest.mark.parametrize("name,args", [("recent_changes", {"days": 0}), ("recent_changes", {"days": 31}), ("blast_radius", {}), ("blast_radius", {"external_id": "x", "max_depth": 11}), ("inventory", {"type": "teapot"}), ("reachability", {"external_id": "x", "internet_only": "yes"}), ("recent_changes", {"days": "soon"}), ("recent_changes", {"days": True})])
def test_bad_arguments_are_declined(state, name, args):
    got = templates.ask("?", lambda q: (name, args), state)
    assert not got["answered"] and got["template"] == name and got["summary"] == templates.DECLINE and got["data"] is None


def test_unknown_templates_are_declined(state):
    for planned in (None, ("unsupported", {}), ("drop_tables", {})):
        got = templates.ask("?", lambda q: planned, state)
        assert not got["answered"] and got["template"] is None


def test_sentences_and_rows(state):
    told = lambda name, **args: templates.ask("?", lambda q: (name, args), state)
    assert told("inventory", type="vpc")["summary"] == "Found 1 configuration item of type vpc."
    assert told("inventory")["summary"] == "Found 4 configuration items."
    assert told("inventory", type="iam_user")["summary"] == "Found 0 configuration items of type iam_user."
    assert told("count_by_type", more="ignored")["summary"] == "4 configuration items across 4 type(s)."
    got = told("blast_radius", external_id="vpc-v", max_depth="1")
    assert got["summary"] == "1 resource would be impacted if 'vpc-v' failed." and [r.id for r in got["data"].collect()] == ["l"] and got["params"]["max_depth"] == 1
    assert told("recent_changes", days=2)["summary"] == "4 changes in the last 2 days."
    assert told("reachability", external_id="rds-db")["summary"] == "2 sources can reach 'rds-db'."
    assert told("reachability", external_id="rds-db", internet_only=True)["summary"] == "The internet can reach 'rds-db'."
    assert told("reachability", external_id="vpc-v", internet_only=True)["summary"] == "The internet cannot reach 'vpc-v'."
    for name in ("blast_radius", "reachability"):
        assert told(name, external_id="vpc-old")["summary"] == "No configuration item found with id 'vpc-old'."
    assert templates.ask("is rds-db publicly accessible", templates.by_rules, state)["summary"] == "2 sources can reach 'rds-db'."
