"""Candidates of a merge against all pairs, on names, host names, addresses and aliases of random words."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from orrery.functions import names
from orrery.operators import resolution

SCHEMA = "id string, type string, name string, attributes string, aliases array<string>, sources array<string>"


def norm(text):
    bare = "".join(c for c in text.lower() if c.isspace() or c == "_" or unicodedata.category(c)[0] in "LN")
    return re.sub(r"\s+", " ", bare).strip()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, threshold):
    """{(a, b): score} of all pairs, one after another."""
    out = {}
    for a in rows:
        for b in rows:
            if not a["id"] < b["id"] or a["type"] != b["type"] or not set(a["sources"]) - set(b["sources"]) or not set(b["sources"]) - set(a["sources"]) or set(a["aliases"] or []) & set(b["aliases"] or []):
                continue
            x, y = norm(a["name"] or ""), norm(b["name"] or "")
            scores = [0.0 if not x or not y else 1.0 if x == y else jaccard(set(x.split()), set(y.split()))]
            u, v = (json.loads(r["attributes"] or "{}") for r in (a, b))
            hosts = [[h[k] for k in resolution.DNS_KEYS if k in h] for h in (u, v)]
            words = [{w for h in s for w in norm(h).split()} for s in hosts]
            scores.append(0.0 if not hosts[0] or not hosts[1] else 1.0 if set(hosts[0]) & set(hosts[1]) else jaccard(*words))
            ips = [{h[k] for k in resolution.IP_KEYS if k in h} for h in (u, v)]
            scores.append(0.9 if ips[0] & ips[1] else 0.0)
            said = [{w for s in r["aliases"] or [] for w in s.split()} for r in (a, b)]
            scores.append(min(0.8, jaccard(*said)) if a["aliases"] and b["aliases"] else 0.0)
            if max(scores) >= threshold:
                out[a["id"], b["id"]] = max(scores)
    return out


def some_rows(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Zürich", "ét", "x_y", "A-b.c"]
    text = lambda most: " ".join(pick.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=pick.randint(0, most)))
    rows = []
    for i in range(n):
        attributes = {k: text(4) for k in resolution.DNS_KEYS if pick.random() < 0.2} | {k: f"10.0.0.{pick.randint(0, 60)}" for k in resolution.IP_KEYS if pick.random() < 0.1}
        name = pick.choice([None, "", text(12), text(12), text(60), "  ".join(text(6).split()) + "!"])
        if rows and pick.random() < 0.3:
            name = " ".join(w for w in (pick.choice(rows)["name"] or "").split() if pick.random() < 0.8)
        rows.append({"id": f"{i:04d}", "type": pick.choice("pq"), "name": name, "attributes": pick.choice([json.dumps(attributes), json.dumps(attributes), None]), "aliases": pick.choice([None, [], [text(5)], [text(3), text(3)]]), "sources": pick.choice([["a"], ["b"], ["a", "b"], ["c"]])})
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 0.5), (2, 0.7), (3, 0.3)])
def test_candidates_are_all_pairs_of_the_score(spark, seed, threshold):
    rows = some_rows(seed, 220)
    got = resolution.scored_pairs(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), threshold).collect()
    want = brute(rows, threshold)
    assert len(got) == len(want) > 50
    assert {(r.ci_id_a, r.ci_id_b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert all(r.evidence.startswith("probable match: ") for r in got)


@pytest.mark.parametrize("few", [0, 6, 10**6])
def test_candidates_of_few_and_many_tokens(spark, monkeypatch, few):
    monkeypatch.setattr(resolution, "FEW_TOKENS", few)
    rows = some_rows(4, 160)
    got = resolution.scored_pairs(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), 0.5).collect()
    want = brute(rows, 0.5)
    assert len(got) == len(want) > 30
    assert {(r.ci_id_a, r.ci_id_b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_pairs_of_few_tokens_are_not_shuffled(spark):
    own = resolution._tokenized(spark.createDataFrame([tuple(r.values()) for r in some_rows(5, 20)], SCHEMA))
    plan = resolution._bare_pairs(resolution._keys(own, 0.5), own)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]  # what is done with the pairs
    assert "Aggregate" not in above and "Window" not in above and "array_intersect" in plan.splitlines()[1] + plan.splitlines()[0]


def test_long_names_and_no_items(spark):
    words = [f"t{i}" for i in range(4000)]
    rows = [("a", "p", " ".join(words), "{}", [], ["x"]), ("b", "p", " ".join(words[:3000]), "{}", [], ["y"]), ("c", "p", " ".join(words[:1900]), "{}", [], ["z"])]
    found = resolution.scored_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.ci_id_a, r.ci_id_b): r.score for r in found} == {("a", "b"): 0.75, ("b", "c"): 1900 / 3000}
    assert resolution.scored_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_lose_marks_and_blanks_of_any_kind(spark):
    texts = ["Café  du　Lac", "a b c\x85d", "_x_ !?", "ZÜRICH", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(names.normalized(F.col("t"))).collect()]
    assert got == ["cafe du lac", "a b c d", "_x_", "zürich", None]


def test_bitmaps_leave_all_similar_sets_and_few_others(spark, monkeypatch):
    from orrery.operators import overlap

    monkeypatch.setattr(overlap, "LEAST", 40)
    pick, rows, sets = random.Random(7), [], {}
    for i in range(240):
        words = {f"w{pick.randint(0, 3000)}" for _ in range(pick.choice([1, 3, 70, 200, 400]))}
        if rows and pick.random() < 0.5:
            old = sorted(pick.choice(list(sets.values())))
            words = set(pick.sample(old, max(1, int(len(old) * pick.uniform(0.5, 1)))))
        sets[f"{i:03d}"] = words
        rows.append((i % 2, f"{i:03d}", i % 3, i % 5 > 0, sorted(words)))
    got = overlap.likely_pairs(spark.createDataFrame(rows, "key long, id string, kind long, wide boolean, tokens array<string>"), 0.5).collect()
    meet = lambda x, y: x[0] == y[0] and x[2] != y[2] and (x[3] or y[3])
    met = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and meet(x, y)}
    want = {(a, b) for a, b in met if jaccard(sets[a], sets[b]) >= 0.5}
    assert len(want) > 50 and want <= {tuple(r) for r in got} <= met
    assert len(got) == len({tuple(r) for r in got}) < len(want) + len(met) / 100


def hosts(seed, n):
    """Items of which most have nothing but host names, or but addresses."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        attributes = {k: f"H-{pick.randint(0, 8) ** 2}" for k in resolution.DNS_KEYS[:2]} if pick.random() < 0.6 else {"ip": f"10.0.0.{pick.randint(0, 9)}"}
        if pick.random() < 0.4:
            attributes["private_ip"] = f"10.0.0.{pick.randint(0, 9)}"
        rows.append({"id": f"{i:04d}", "type": pick.choice("pq"), "name": pick.choice([None] * 9 + ["web one", "web two"]), "attributes": json.dumps(attributes), "aliases": pick.choice([None, None, [], [], ["x y"], ["y z"]]), "sources": pick.choice([["a"], ["b"], ["b", "b"], ["a", "b"], ["b", "c"]])})
    return rows


@pytest.mark.parametrize("part", [2048, 7])
@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_lone_items_are_told_once_each(spark, monkeypatch, part, threshold):
    monkeypatch.setattr(resolution, "KEY_PART", part)
    items = spark.createDataFrame([tuple(r.values()) for r in hosts(6, 260)], SCHEMA)
    got = resolution.scored_pairs(items, threshold).collect()
    want = brute(hosts(6, 260), threshold)
    assert len(got) == len(want) > 500
    assert {(r.ci_id_a, r.ci_id_b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    # Pairs of items that only a host name or an address tells apart carry neither tokens nor attributes, and their evidence isn't put together pair by pair.
    plan = resolution._lone_pairs(resolution._keys(resolution._tokenized(items), threshold), threshold)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "format_string" not in above and "tokens" not in above and "Aggregate" not in above and "Window" not in above
    told = {r.evidence for r in got}
    assert "probable match: dns 1.00" in told and ("probable match: ip 0.90" in told) == (threshold < 0.9) and "probable match: dns 1.00; ip 0.90" in told


@pytest.mark.parametrize("part", [512, 16])
def test_an_item_of_many_pairs_is_not_shuffled_for_each(spark, monkeypatch, part):
    monkeypatch.setattr(resolution, "GROUP_PART", part)
    pick, words = random.Random(8), [f"{random.Random(i).getrandbits(48):x}" for i in range(400)]
    rows = [{"id": f"{i:04d}", "type": "p", "name": " ".join(pick.sample(words, 320)), "attributes": "{}", "aliases": [], "sources": [f"s{i % 7}"]} for i in range(150)]
    got = resolution.scored_pairs(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).collect()
    want = brute(rows, 0.5)
    assert len(got) == len(want) > 9000
    assert {(r.ci_id_a, r.ci_id_b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    units = resolution._grouped(spark.createDataFrame(sorted(want), "a_id string, b_id string"), len(want)).collect()
    assert sorted((r.a_id, r.b_id) for r in units) == sorted(want)
    held = {(i, r.unit) for r in units for i in (r.a_id, r.b_id)}
    # One group: the item that is least, and the few that aren't pairs with it for their sources, begin their own.
    assert len(held) < 150 * (4 if part == 512 else 24) < len(want)


def test_values_in_common():
    import numpy as np
    from orrery.operators import overlap

    pick = random.Random(9)
    sets = [set(pick.sample(range(-50, 50), pick.choice([0, 1, 9, 60]))) for _ in range(40)]
    i, j = (np.array([pick.randrange(40) for _ in range(2000)]) for _ in "ij")
    edges, values = np.cumsum([0, *(len(s) for s in sets)]), np.array([v for s in sets for v in s])
    assert overlap.common(i, j, edges, values).tolist() == [len(sets[a] & sets[b]) for a, b in zip(i, j)]
    assert overlap.common(i, j, np.zeros(41, int), values[:0]).tolist() == [0] * 2000
