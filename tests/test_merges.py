"""Accepting, chaining, dismissing and undoing merges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import events, merges
from orrery.operators.commits import EMPTY, Conflict, Store
from orrery.schema import CANDIDATE, CI, EDGE, SOURCE_KEYS

T = dt.datetime(2024, 5, 1)


def now(k):
    return F.lit(T + dt.timedelta(hours=k)).cast("timestamp")


def a_state(spark, pairs):
    """Items a to e, an edge from each to x, and candidates of some pairs; item `e` has no key of a source."""
    state = {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}
    items = [(f"id-{x}", "t", "vpc", f"ext-{x}", x, "{}", 1.0, T, T, T, None) for x in "abcdex"]
    told = lambda x: [{"source": f"src-{x}", "observed_at": T, "detail": None}]
    edges = [(f"e-{x}", "t", "CONNECTS_TO", f"id-{x}", "id-x", "", "declared", 0.5 + "abcde".index(x) / 10, told(x), T, None) for x in "abcde"]
    edges += [("e-ab", "t", "CONTAINS", "id-a", "id-b", "", "declared", 1.0, told("a"), T, None), ("e-i", "t", "CONNECTS_TO", "id-x", "id-c", "", "inferred", 0.6, told("x"), T, None)]
    state["cis"] = spark.createDataFrame(items, CI)
    state["edges"] = spark.createDataFrame(edges, EDGE)
    state["source_keys"] = spark.createDataFrame([("t", f"src-{x}", f"ext-{x}", f"id-{x}", T) for x in "abcdx"], SOURCE_KEYS)
    state["candidates"] = spark.createDataFrame([(f"c-{x}{y}", "t", f"id-{x}", f"id-{y}", "vpc", 0.9, "why", "pending", None, T, None) for x, y in pairs], CANDIDATE)
    return state


def facts(state):
    """What is open, without ids of versions and times."""
    edges = sorted((r.type, r.from_id, r.to_id, r.source, round(r.confidence, 6), tuple(sorted({e.source for e in r.evidence}))) for r in state["edges"].where("valid_to is null").collect())
    keys = sorted((r.source, r.native_id, r.ci_id) for r in state["source_keys"].collect())
    return sorted(r.id for r in state["cis"].where("valid_to is null").collect()), edges, keys


def test_a_chain_in_one_call_is_that_of_three(spark):
    pairs = ["bc", "ab", "cd"]
    one = merges.accept(a_state(spark, pairs), ["c-bc", "c-ab", "c-cd"], "t", now(1))
    open_, edges, keys = facts(one)
    assert open_ == ["id-a", "id-e", "id-x"]
    assert edges == [("CONNECTS_TO", "id-a", "id-x", "declared", 0.8, ("merge-candidate", "src-a", "src-b", "src-c", "src-d")), ("CONNECTS_TO", "id-e", "id-x", "declared", 0.9, ("src-e",)), ("CONNECTS_TO", "id-x", "id-c", "inferred", 0.6, ("src-x",)), ("CONTAINS", "id-a", "id-b", "declared", 1.0, ("src-a",))]
    assert keys == sorted((f"src-{x}", f"ext-{x}", "id-a" if x in "abcd" else "id-x") for x in "abcdx")
    ledger = {r.merged_ci_id: (r.canonical_ci_id, r.merged_source, r.merged_external_id) for r in one["merges"].collect()}
    assert ledger == {f"id-{x}": ("id-a", f"src-{x}", f"ext-{x}") for x in "bcd"}
    ids = {r.merge_id for r in one["merges"].collect()}
    assert {(r.candidate_id, r.status, r.resolved_merge_id in ids) for r in one["candidates"].collect()} == {(f"c-{p}", "accepted", True) for p in pairs}
    three = a_state(spark, pairs)
    for k, p in enumerate(pairs):
        three = merges.accept(three, [f"c-{p}"], "t", now(k + 1))
    assert facts(three) == facts(one) and three["merges"].count() == 3


def test_wrong_candidates_are_refused(spark):
    state = merges.dismiss(a_state(spark, ["ab", "cd"]), ["c-ab"], now(1))
    assert [r.status for r in state["candidates"].orderBy("candidate_id").collect()] == ["dismissed", "pending"]
    for change in (lambda i: merges.accept(state, [i], "t", now(2)), lambda i: merges.dismiss(state, [i], now(2))):
        with pytest.raises(merges.AlreadyResolved):
            change("c-ab")
        with pytest.raises(merges.NotFound):
            change("c-zz")
    closed = state | {"cis": state["cis"].where("id <> 'id-d'")}
    with pytest.raises(merges.NotFound, match="id-d"):
        merges.accept(closed, ["c-cd"], "t", now(2))


def test_undoing_a_merge(spark):
    state = merges.accept(a_state(spark, ["ab", "ae"]), ["c-ab", "c-ae"], "t", now(1))
    rows = {r.merged_ci_id: r for r in state["merges"].collect()}
    assert (rows["id-e"].merged_source, rows["id-e"].merged_external_id) == (merges.FUZZY, "ext-e")
    back = merges.unmerge(state, rows["id-b"].merge_id, "t", now(2))
    record = back["unmerges"].first()
    assert (record.original_merge_id, record.canonical_ci_id, record.restored_source, record.restored_external_id) == (rows["id-b"].merge_id, "id-a", "src-b", "ext-b")
    born = back["cis"].where(F.col("id") == record.restored_ci_id).first()
    assert (born.type, born.external_id, born.name, born.attributes) == ("vpc", "ext-b", None, "{}") and born.valid_to is None
    keys = {r.native_id: r.ci_id for r in back["source_keys"].collect()}
    assert keys["ext-b"] == record.restored_ci_id and keys["ext-a"] == "id-a" and back["merges"].count() == 2
    open_ = {(r.from_id, r.to_id): r.evidence[-1].source for r in back["edges"].where("valid_to is null and source = 'declared' and to_id = 'id-x'").collect() if r.from_id == record.restored_ci_id}
    assert open_ == {(record.restored_ci_id, "id-x"): "unmerge"}
    with pytest.raises(merges.AlreadyResolved):
        merges.unmerge(back, rows["id-b"].merge_id, "t", now(3))
    with pytest.raises(merges.NotFound):
        merges.unmerge(back, "none", "t", now(3))
    gone = state | {"cis": state["cis"].where("id <> 'id-a'")}
    with pytest.raises(merges.NotFound, match="no longer open"):
        merges.unmerge(gone, rows["id-b"].merge_id, "t", now(3))
    assert [r.merged_ci_id for r in merges.listed(state["merges"], "merged_at", "merge_id", "id-e").collect()] == ["id-e"]


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(store.read()[0], a_state(spark, ["ab"]))
    base, state = store.read()
    mine = merges.accept(state, ["c-ab"], "t", now(1))
    merges.commit(store, merges.dismiss, ["c-ab"], now(1))
    with pytest.raises(Conflict):
        store.commit(base, {n: mine[n] for n in ("cis", "edges", "candidates", "merges")})
    with pytest.raises(merges.AlreadyResolved):
        merges.commit(store, merges.accept, ["c-ab"], "t", now(2))
    assert store.read()[1]["cis"].where("valid_to is null").count() == 6


def test_an_alias_merge_is_in_the_ledger_once_and_can_be_undone(spark):
    def log(*rows):
        shape = {c.split(" ")[0]: None for c in events.LOG.split(", ")}
        return spark.createDataFrame([tuple((shape | {"event_id": e, "at": T + dt.timedelta(minutes=k), "seq": k, "step": 0, "op": "upsert", "type": "s3_bucket", "external_id": x, "name": x, "alias_keys": ["shared"]}).values()) for k, (e, x) in enumerate(rows, k0)], events.LOG)

    k0 = 0
    state = events.apply_log({n: spark.createDataFrame([], s) for n, s in EMPTY.items()}, log(("1", "a-1")), "t", "srcA")
    k0 = 5
    state = {n: spark.createDataFrame([], s) for n, s in EMPTY.items()} | state
    state = events.apply_log(state, log(("2", "b-1")), "t", "srcB") | {"unmerges": state["unmerges"], "candidates": state["candidates"]}
    k0 = 9
    again = events.apply_log(state, log(("3", "b-1")), "t", "srcB") | {"unmerges": state["unmerges"], "candidates": state["candidates"]}
    row = again["merges"].collect()
    assert [(r.merged_source, r.merged_external_id, r.matched_alias_key) for r in row] == [("srcB", "b-1", "shared")]
    assert [r.external_id for r in again["cis"].where("valid_to is null").collect()] == ["a-1"]
    back = merges.unmerge(again, row[0].merge_id, "t", now(3))
    assert sorted(r.external_id for r in back["cis"].where("valid_to is null").collect()) == ["a-1", "b-1"]
    assert json.loads(json.dumps({r.native_id: r.source for r in back["source_keys"].collect()})) == {"a-1": "srcA", "b-1": "srcB"}


def test_long_chains_are_few_passes(spark, monkeypatch):
    """A chain whose least item is at its end, one of items that lead through an unknown one, and an item paired with itself."""
    from pathlib import Path

    from orrery.operators import components as stars

    tables = []
    for module in (merges, stars):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: tables.append(name) or f(df, name))
    n = 300
    pairs = [(f"c{k:03}", f"c{k - 1:03}") for k in range(1, n)] + [("x1", "gone"), ("gone", "x2"), ("y", "y"), (None, "x1")]
    order = [(f"c{k:03}", (k * 77) % n) for k in range(n)] + [("x1", 1), ("x2", 0), ("y", 5)]
    got = merges.components(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(order, "id string, rank int"))
    assert {r.id: r.root for r in got.collect()} == {f"c{k:03}": "c000" for k in range(n)} | {"x1": "x1", "x2": "x2", "y": "y"}
    assert len(tables) < 20 and Path(got.inputFiles()[0].removeprefix("file://")).exists()
