"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from orrery.llm import common, queries, search


def brute(docs, items, k=10):
    split = [(i, re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    split = [(i, Counter(w)) for i, w in split if w]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = {}
    for item, text in items:
        own = set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for i, c in split:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out[item] = [(r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return {i: rows for i, rows in out.items() if rows}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return {i: sorted(rows) for i, rows in out.items()}


def test_query_against_brute_force(spark, data):
    docs, items = (pd.read_parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(list(zip(docs.doc_id, docs.text)), list(zip(items.item_id, items.text)))
    assert found(queries.op13_ranked_search(spark, data)) == want


@pytest.mark.parametrize("shard_bytes,block", [(40, 3), (400, 100), (10**9, 1)])
def test_shards_and_blocks_don_t_matter(spark, shard_bytes, block):
    draw = random.Random(shard_bytes)
    word = lambda: draw.choice("a b c d e f g hh Ii é 12 日本".split())
    docs = [(k // 2 * 7 % 60, " ".join(word() for _ in range(draw.randint(0, 12)))) for k in range(120)] + [(None, "a b c"), (3, None), (4, "…!?")]
    items = [(f"i{k}", ", ".join(word() for _ in range(draw.randint(0, 5)))) for k in range(7)] + [("none", None), ("unknown", "zzz")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = common.written(search.build(d, *search.statistics(d), shard_bytes), "index")
    got = found(search.search(index, spark.createDataFrame(items, "item_id string, text string"), search.statistics(d)[0], 10, block))
    assert got == brute(docs, items)


def test_tree_gives_ranges_by_impact():
    """At each node a term's range holds its documents of that half, by falling impact."""
    draw = random.Random(4)
    split = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(1, 9))] for _ in range(37)]
    row = search._packed(list(range(37)), split, 37, sum(map(len, split)))
    shard = search.Shard(row, {b"a": 0, b"b": 1, b"c": 2})
    sizes = np.array([len(w) for w in split])
    for term, number in ((b"a", 0), (b"b", 1), (b"c", 2)):
        tf = np.array([w.count(term) for w in split])
        strength = search.impact(tf, sizes, 37, int(sizes.sum()))
        want = sorted((d for d in range(37) if tf[d]), key=lambda d: (-strength[d], d))
        nodes = [(0, 0, *shard.ranges[number])]
        while nodes:
            level, start, a, b = nodes.pop()
            width = 1 << (shard.depth - level)
            assert shard.impacts[level][a:b].tolist() == [strength[d] for d in want if start <= d < start + width]
            if level < shard.depth:
                ones = shard.ones[level]
                nodes += [(level + 1, start, a - ones[a], b - ones[b]), (level + 1, start + width // 2, ones[a] + shard.zeros[level], ones[b] + shard.zeros[level])]


def test_odd_documents(spark, odd, empty):
    items = spark.createDataFrame([(1, "The lazy DOG"), (2, "word"), (3, None), (4, "x"), (4, "x")], "item_id long, text string").selectExpr("*", "text as score", "1 as doc_id")
    clash = odd.selectExpr("*", "text as terms", "doc_id as number")
    got = search.ranked(clash, items).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(docs, [(1, "The lazy DOG"), (2, "word"), (4, "x")])
    assert found(search.ranked(clash, items.where("item_id < 3"))) == {i: want[i] for i in (1, 2)}
    assert sum(r.item_id == 4 for r in got) == 2 * len(want[4])
    assert search.ranked(empty, items).count() == 0
    assert search.ranked(clash, items.limit(0)).count() == 0
