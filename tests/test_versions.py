"""Versioned writes, entity resolution, findings and freshness."""

import datetime as dt

import pytest
from orrery import schema
from orrery.functions import confidence as conf
from orrery.functions import names
from orrery.operators import resolution, rules, temporal, versions
from pyspark.sql import functions as F


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n - 1)


def now(n):
    return F.lit(day(n)).cast("timestamp")


def ev(*entries):
    return [(s, day(d), x) for s, d, x in entries]


def ci(i, ext=None, name="n", attrs="{}", type_="vpc", valid_to=None):
    return (i, "t", type_, ext or i, name, attrs, 1.0, day(1), day(1), day(1), valid_to)


def edge(a, b, source, confidence, evidence, valid_from=1, key=""):
    return (f"{a}>{b}", "t", "CONNECTS_TO", a, b, key, source, confidence, evidence, day(valid_from), None)


BATCH = f"type string, from_id string, to_id string, edge_key string, source string, confidence double, evidence {schema.EVIDENCE}"


def test_curves(spark):
    got = [r[0] for r in spark.range(1, 6).select(conf.for_observations(F.col("id"))).collect()]
    assert [round(x, 12) for x in got] == [0.6, 0.8, 0.9, 0.95, 0.975]
    d = spark.createDataFrame([(7.0,), (8.0,), (30.0,), (None,)], "d double").select(conf.decayed(F.lit(0.6), F.col("d"))).collect()
    assert d[0][0] == 0.6 and abs(d[1][0] - 0.55) < 1e-9 and d[2][0] == 0.2 and d[3][0] is None
    assert spark.range(1).select(conf.for_observations(F.lit(None).cast("int"))).first()[0] is None
    for refused in (conf.for_observations(F.col("id")), conf.decayed(F.lit(0.6), F.col("id") - 0.5)):
        with pytest.raises(Exception, match="must"):
            spark.range(1).select(refused).collect()
    assert spark.range(1).select(conf.timedelta_text(F.lit(93784))).first()[0] == "1 day, 2:03:04"


def test_ci_upsert_versions(spark):
    state = spark.createDataFrame([ci("a"), ci("b"), ci("c", valid_to=day(2))], schema.CI)
    batch = spark.createDataFrame([("vpc", "a", "n", "{}", 1.0), ("vpc", "b", "new", "{}", 1.0), ("vpc", "c", "n", "{}", 1.0)], "type string, external_id string, name string, attributes string, confidence double")
    out = {(r.id, r.name, r.valid_from.day, r.valid_to and r.valid_to.day, r.first_seen.day, r.last_seen.day) for r in versions.upsert_cis(state, batch, "t", now(5)).collect()}
    opened = [r for r in out if r[0] not in ("a", "b", "c")]
    assert ("a", "n", 1, None, 1, 5) in out and ("b", "n", 1, 5, 1, 1) in out and ("b", "new", 5, None, 1, 5) in out and ("c", "n", 1, 2, 1, 1) in out
    assert len(opened) == 1 and opened[0][2:] == (5, None, 5, 5)


def test_edges_accumulate_age_and_are_marked(spark):
    state = spark.createDataFrame([], schema.EDGE)
    for n in range(1, 24):
        batch = spark.createDataFrame([("CONNECTS_TO", "a", "b", "", "inferred", 0.6, ev(("aws-flowlogs", n, f"x{n}")))], BATCH)
        if n in (1, 2, 23):
            state = versions.upsert_edges(state, batch, "t", now(n))
        elif n == 3:
            evidence = ev(("aws-flowlogs-count", 22, "22"), *(("aws-flowlogs", d, f"x{d}") for d in range(1, 23)))
            state = spark.createDataFrame([edge("a", "b", "inferred", 0.9, evidence, 22)], schema.EDGE)
    r = [x for x in state.collect() if x.valid_to is None][0]
    assert r.evidence[0].detail == "23" and len(r.evidence) == 21 and r.evidence[1].detail == "x4" and r.evidence[-1].detail == "x23"
    assert abs(r.confidence - (1 - 0.4 * 0.5**22)) < 1e-12
    rows = [edge("f", "x", "inferred", 0.6, ev(("aws-flowlogs-count", 24, "1"))), edge("s", "x", "inferred", 0.6, ev(("aws-flowlogs-count", 22, "1"))), edge("o", "x", "inferred", 0.6, ev(("aws-flowlogs-count", 1, "1"))), edge("m", "x", "inferred", 0.6, ev(("other", 1, "1"))), edge("l", "x", "inferred", 0.2, ev(("aws-flowlogs-count", 15, "1")))]
    table = spark.createDataFrame(rows, schema.EDGE)
    assert {r.from_id: r.action for r in versions.aging_actions(table, now(31)).collect()} == {"f": "untouched", "s": "decay", "o": "decay", "m": "untouched", "l": "untouched"}
    assert {r.from_id: r.action for r in versions.aging_actions(table, now(32)).collect()}["o"] == "close"
    swept = versions.aging_sweep(table, now(31))
    again = versions.aging_sweep(swept, now(31))
    assert swept.count() == again.count() == 7
    note = [r for r in swept.collect() if r.from_id == "s" and r.valid_to is None][0]
    assert note.evidence[-1].detail == "decayed 0.6000->0.5000 age_days=9" and abs(note.confidence - 0.5) < 1e-9


def test_decays_are_written_or_refused(spark):
    state = spark.createDataFrame([edge("a", "x", "inferred", 0.6, ev(("aws-flowlogs-count", 22, "1"))), edge("b", "x", "declared", 0.6, ev(("s", 1, "1"))), edge("c", "x", "inferred", 0.6, ev(("s", 1, "1")))], schema.EDGE)
    change = lambda i, c: spark.createDataFrame([(i, c, ("aging", day(31), "decayed"))], "id string, new_confidence double, decay_evidence struct<source:string,observed_at:timestamp,detail:string>")
    rows = versions.write_decayed(state, change("a>x", 0.5), now(31)).collect()
    old, new = sorted((r for r in rows if r.id == "a>x"), key=lambda r: r.valid_from)
    assert len(rows) == 4 and old.valid_to == new.valid_from and new.valid_to is None and old.confidence == 0.6 and new.confidence == 0.5
    assert [e.source for e in new.evidence] == ["aws-flowlogs-count", "aging"] and new.evidence[0] == old.evidence[0]
    for i, c, told in (("b>x", 0.5, "only inferred"), ("a>x", 0.6, "must lower"), ("a>x", 0.7, "must lower"), ("a>x", None, "must lower"), ("gone", 0.1, "no open edge")):
        with pytest.raises(Exception, match=told):
            versions.write_decayed(state, change(i, c), now(31)).collect()


def test_declared_edges_and_empty_evidence(spark):
    state = spark.createDataFrame([edge("a", "b", "declared", 1.0, ev(("s", 1, None)))], schema.EDGE)
    same = spark.createDataFrame([("CONNECTS_TO", "a", "b", "", "declared", 1.0, ev(("s", 1, None)))], BATCH)
    assert versions.upsert_edges(state, same, "t", now(3)).count() == 1
    seen = spark.createDataFrame([("CONNECTS_TO", "a", "b", "", "inferred", 0.6, ev(("f", 2, None)))], BATCH)
    assert versions.upsert_edges(state, seen, "t", now(3)).count() == 2
    assert versions.upsert_edges(state, seen, "t", now(3), protect_declared=True).count() == 1
    with pytest.raises(Exception, match="evidence"):
        versions.upsert_edges(state, spark.createDataFrame([("CONNECTS_TO", "c", "b", "", "declared", 1.0, [])], BATCH), "t", now(3)).collect()


def world(spark, cis, edges=(), keys=(), aliases=()):
    return {"cis": spark.createDataFrame(list(cis), schema.CI), "edges": spark.createDataFrame(list(edges), schema.EDGE), "source_keys": spark.createDataFrame(list(keys), schema.SOURCE_KEYS), "alias_keys": spark.createDataFrame(list(aliases), schema.ALIAS_KEYS)}


def discovered(spark, *rows):
    return spark.createDataFrame([(t, e, n, "{}", 1.0, a) for t, e, n, a in rows], schema.DISCOVERED_CI)


def found_edges(spark, *rows):
    return spark.createDataFrame([(t, ft, f, tt, x, "declared", 1.0, ev(("s", 1, None)), "") for t, ft, f, tt, x in rows], schema.DISCOVERED_EDGE)


def test_reconcile_renames_and_closes_what_is_absent(spark):
    first = versions.reconcile(world(spark, []), discovered(spark, ("vpc", "vpc-1", "v", []), ("subnet", "sub-1", "s", [])), found_edges(spark, ("CONTAINS", "vpc", "vpc-1", "subnet", "sub-1")), "t", "aws", ["vpc", "subnet"], ["CONTAINS"], now(1))
    assert {r.action: r["count"] for r in first["counts"].collect()} == {"create": 2, "closed": 0, "edges_written": 1, "edges_closed": 0}
    second = versions.reconcile(first, discovered(spark, ("subnet", "sub-1", "renamed", [])), found_edges(spark), "t", "aws", ["vpc", "subnet"], ["CONTAINS"], now(2))
    assert {r.action: r["count"] for r in second["counts"].collect()} == {"update": 1, "closed": 1, "edges_written": 0, "edges_closed": 1}
    other = versions.reconcile(first, discovered(spark), found_edges(spark), "t", "gcp", ["vpc"], [], now(2))
    assert other["cis"].where("valid_to is null").count() == 2


def test_reconcile_merges_by_alias(spark):
    a = versions.reconcile(world(spark, []), discovered(spark, ("s3_bucket", "a-ext-1", "a", ["alias:shared-1"])), found_edges(spark), "t", "srcA", ["s3_bucket"], [], now(1))
    b = versions.reconcile(a, discovered(spark, ("s3_bucket", "b-ext-1", "b", ["alias:shared-1"])), found_edges(spark), "t", "srcB", ["s3_bucket"], [], now(2))
    live = b["cis"].where("valid_to is null").collect()
    assert [(r.external_id, r.name) for r in live] == [("a-ext-1", "b")] and b["merges"].first().matched_key == "alias:shared-1"
    assert {(r.source, r.native_id) for r in b["source_keys"].collect()} == {("srcA", "a-ext-1"), ("srcB", "b-ext-1")}


def test_delta_closes_only_what_it_names(spark):
    state = world(spark, [ci("1", "a"), ci("2", "b"), ci("3", "c")], [edge("1", "2", "declared", 1.0, ev(("s", 1, None)))])
    none = spark.createDataFrame([], "type string, external_id string")
    no_edges = spark.createDataFrame([], "type string, from_type string, from_ext string, to_type string, to_ext string")
    gone = spark.createDataFrame([("vpc", "c")], "type string, external_id string")
    cut = spark.createDataFrame([("CONNECTS_TO", "vpc", "a", "vpc", "b")], no_edges.schema)
    out = versions.apply_delta(state, discovered(spark, ("vpc", "d", "d", [])), found_edges(spark, ("CONTAINS", "vpc", "d", "vpc", "a")), gone, cut, "t", "hook", now(2))
    assert {r.external_id for r in out["cis"].where("valid_to is null").collect()} == {"a", "b", "d"}
    assert [r.type for r in out["edges"].where("valid_to is null").collect()] == ["CONTAINS"]
    with pytest.raises(Exception, match="unresolved end"):
        versions.apply_delta(state, discovered(spark), found_edges(spark, ("CONTAINS", "vpc", "nope", "vpc", "a")), none, no_edges, "t", "hook", now(2))["edges"].collect()


def test_retention_keeps_the_latest_closed_version(spark):
    rows = [("a", "x", day(1), day(2)), ("a", "x", day(2), day(4)), ("a", "x", day(4), day(6)), ("a", "x", day(6), None), ("b", "x", day(1), day(2))]
    v = spark.createDataFrame(rows, "id string, type string, valid_from timestamp, valid_to timestamp")
    kept, gone = versions.retention_sweep(v, now(4))
    assert kept.count() == 4 and [tuple(r)[:2] for r in gone.collect()] == [("a", 1)]
    assert versions.retention_sweep(v, now(20), enabled=False)[0].count() == 5


def test_names_and_candidates(spark):
    got = spark.createDataFrame([("Café-Ünit_1!",), ("  A  b ",)], "n string").select(names.normalized(F.col("n"))).collect()
    assert [r[0] for r in got] == ["caféünit_1", "a b"]
    rows = [("1", "vpc", "web server one", '{"private_ip":"10.0.0.1"}', ["k1"], ["s1"]), ("2", "vpc", "web server two", "{}", [], ["s2"]), ("3", "vpc", "other", '{"ip":"10.0.0.1"}', [], ["s2"]), ("4", "vpc", "web server one", "{}", ["k1"], ["s2"]), ("5", "subnet", "web server one", "{}", [], ["s2"]), ("6", "vpc", "web server one", "{}", [], ["s1"])]
    items = spark.createDataFrame(rows, "id string, type string, name string, attributes string, aliases array<string>, sources array<string>")
    found = resolution.scored_pairs(items)
    got = {(r.ci_id_a, r.ci_id_b): r.score for r in found.collect()}
    assert got == {("1", "2"): 0.5, ("1", "3"): 0.9, ("2", "6"): 0.5, ("4", "6"): 1.0}
    empty = spark.createDataFrame([], "ci_id_a string, ci_id_b string, type string, score double, evidence string, status string, generated_at timestamp")
    table = resolution.decide(resolution.upsert_candidates(empty, found, now(1)), "1", "2", "dismissed")
    again = resolution.upsert_candidates(table, found, now(2))
    assert {(r.ci_id_a, r.ci_id_b, r.status, r.generated_at.day) for r in again.collect()} == {("1", "2", "dismissed", 1), ("1", "3", "pending", 2), ("2", "6", "pending", 2), ("4", "6", "pending", 2)}


def test_accept_and_unmerge(spark):
    keys = [("t", "s1", "b", "1", day(1)), ("t", "s2", "a", "2", day(1))]
    state = world(spark, [ci("1", "b"), ci("2", "a"), ci("3", "c")], [edge("1", "3", "declared", 1.0, ev(("s1", 1, None))), edge("1", "2", "declared", 1.0, ev(("s1", 1, None))), edge("3", "1", "inferred", 0.6, ev(("f", 1, None)))], keys)
    out = resolution.accept(state, spark.createDataFrame([("1", "2")], "ci_id_a string, ci_id_b string"), now(2))
    assert {r.id for r in out["cis"].where("valid_to is null").collect()} == {"2", "3"}
    assert {(r.from_id, r.to_id) for r in out["edges"].where("valid_to is null").collect()} == {("2", "3"), ("1", "2"), ("3", "1")}
    assert {r.ci_id for r in out["source_keys"].collect()} == {"2"}
    back = resolution.unmerge(out, "2", "s1", "b", "t", now(3))
    born = [r for r in back["cis"].where("valid_to is null").collect() if r.external_id == "b"][0]
    assert born.name is None and {(r.source, r.ci_id) for r in back["source_keys"].collect()} == {("s1", born.id), ("s2", "2")}
    assert (born.id, "3") in {(r.from_id, r.to_id) for r in back["edges"].where("valid_to is null").collect()}


def test_findings_open_keep_resolve(spark):
    empty = spark.createDataFrame([], schema.FINDING)
    want = lambda *ids: spark.createDataFrame([(i, "{}") for i in ids], "subject_ci_id string, evidence string")
    one = rules.apply_findings(empty, want("a", "b"), rules.BROAD_ACCESS, "t", now(1))
    two = rules.apply_findings(one, want("b", "c"), rules.BROAD_ACCESS, "t", now(2))
    three = rules.apply_findings(two, want("a", "b", "c"), rules.BROAD_ACCESS, "t", now(3))
    assert {(r.subject_ci_id, r.status) for r in two.collect()} == {("a", "resolved"), ("b", "open"), ("c", "open")}
    assert three.count() == 4 and three.select("id").distinct().count() == 4
    assert '"text":"[HIGH]' in rules.payloads(one, "slack").first().payload
    sent = rules.dispatch(rules.payloads(one, "webhook"), lambda p: '"a"' in p).collect()
    assert sorted((r.attempt, r.status) for r in sent) == [(1, "delivered"), (1, "failed"), (2, "failed"), (3, "failed"), (4, "dead_letter")]


def test_evaluation_counts_what_it_opens_and_resolves(spark):
    cis = spark.createDataFrame([("net", "internet", "net"), ("db", "rds", "db"), ("far", "rds", "far"), ("role", "iam_role", "role")], "id string, type string, name string")
    access = [("HAS_ACCESS_TO", "role", f"r{k}") for k in range(10)]
    row = "type string, from_id string, to_id string"
    made = lambda rows: spark.createDataFrame(rows, row).selectExpr("type", "from_id", "to_id", "'' edge_key", "'declared' source", "1.0D confidence", f"cast(array() as {schema.EVIDENCE}) evidence")
    nothing = spark.createDataFrame([], schema.FINDING)
    one, first = rules.evaluate_findings(nothing, cis, made([("CONNECTS_TO", "net", "db"), *access]), "t", now(1))
    assert first.first().asDict() == {"evaluated": 3, "opened": 2, "resolved": 0, "open_count": 2}
    two, second = rules.evaluate_findings(one, cis, made([("CONNECTS_TO", "net", "far"), *access]), "t", now(2))
    assert second.first().asDict() == {"evaluated": 3, "opened": 1, "resolved": 1, "open_count": 2}
    of = lambda i: [r.subject_ci_id for r in temporal.finding_for_subject(two, rules.INTERNET_DATABASE[0], i).collect()]
    assert of("far") == ["far"] and of("db") == [] and of("role") == []


def test_freshness(spark):
    runs = spark.createDataFrame([(1, "ok", "ok", day(1), day(1)), (2, "late", "ok", day(1), day(1)), (3, "bad", "error", day(9), day(9)), (4, "going", "partial", day(9), None)], "run_id long, source string, status string, started_at timestamp, finished_at timestamp")
    slos = spark.createDataFrame([("ok", 10**6), ("late", 60), ("bad", 10**6), ("going", 10**6), ("never", 60)], "source string, expected_interval_seconds int")
    assert {r.source: r.fresh for r in rules.freshness(slos, runs, now(10)).collect()} == {"ok": True, "late": False, "bad": False, "going": False, "never": False}
