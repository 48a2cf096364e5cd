"""Runs of words against every stretch of every period."""

import hashlib
import random
import re
import zlib
from itertools import count

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import periodic, queries


def brute(w, exponent, least):
    """Each maximal stretch with period q, of the smallest q."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        a = 0
        while a + q < len(w):
            e = a
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - a >= max(least, exponent * q):
                best.setdefault((a, e + q), q)
            a = e + 1
    return sorted(((a, e, q) for (a, e), q in best.items()), key=lambda r: (r[0], r[2]))


def symbols(texts):
    number = count()
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    return np.concatenate([np.fromiter(map({}.setdefault, w, number), np.int64, len(w)) for w in texts]), first


def test_suffixes_and_previous_factors():
    draw = random.Random(2)
    for _ in range(300):
        texts = [[draw.randrange(2) for _ in range(draw.randint(0, 25))] for _ in range(3)]
        symbol, first = symbols(texts)
        s = periodic.Suffixes(symbol, first)
        ends = s.end.tolist()
        suffix = lambda i: symbol[i : ends[i]].tolist()
        for a, b in zip(s.array.tolist(), s.array[1:].tolist()):
            assert (s.begin[a], suffix(a)) < (s.begin[b], suffix(b)) or s.begin[a] != s.begin[b]
        length, source = periodic.longest_previous(s)
        for i in range(s.n):
            shared = lambda j: next((k for k in range(ends[i] - i) if symbol[j + k] != symbol[i + k]), ends[i] - i)
            assert length[i] == max((shared(j) for j in range(s.begin[i], i)), default=0)
            assert length[i] == 0 or source[i] < i and shared(source[i]) == length[i]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7), st.sampled_from([(2, 2), (2, 3), (3, 3), (4, 6)]))
def test_all_runs_are_found(texts, period, times, limits):
    texts = [w + period * times + w[:7] + period * times for w in texts]
    got = periodic.runs_of(*symbols(texts), *limits)
    assert got == {k: found for k, w in enumerate(texts) if (found := brute(w, *limits))}


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = brute(w, 4, 6)
    dropped = {i for a, e, q in runs for i in range(a + q, e)}
    best = min(((a - e, a, q) for a, e, q in runs), default=None)
    told = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *told, digest("".join(f"{a},{e - a},{q}\n" for a, e, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_against_brute_force(spark, data):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, data).collect()}
    docs = pd.read_parquet(f"{data}/documents.parquet")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        if len(text or "") < 6000:  # brute force takes the square
            assert got[doc_id] == expected(doc_id, text), doc_id
    assert sum(x[0] > 0 for x in got.values()) > 10


def test_odd_documents(spark, odd, empty):
    clash = odd.selectExpr("*", "text as runs", "doc_id as collapsed", "1 as h", "2 as w")
    got = periodic.report(periodic.find_runs(clash)).collect()
    want = {}
    for r in odd.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        runs = [(0, len(w), 1)] if len(w) > 10_000 else brute(w, 4, 6)
        want.setdefault(r.doc_id, len(runs))
    assert len(got) == odd.count() and all(want[r.doc_id] == r.n_runs for r in got)
    long = [r for r in got if r.doc_id == 6][0]
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 30_000, 1, 30_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert periodic.report(periodic.find_runs(empty)).count() == 0
    assert periodic.with_planted_runs(clash).count() == odd.count() and periodic.with_planted_runs(empty).count() == 0


def test_planting(spark):
    rows = [(i, " \n".join(f"w{k}" for k in range(i % 23)) + "\t") for i in range(400)] + [(None, "a b"), (7, None), (5, "")]
    got = periodic.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, text), r in zip(rows, got):
        assert (r.text or "").split() == (planted(i, (text or "").split()) if i is not None else text.split())


def test_text_of_more_than_a_slice(spark):
    """One text of 3 MB, in which a long block holds copies of runs."""
    piece = [f"w{k}" for k in range(50)] + ["x", "y"] * 5 + ["z"] * 7
    w = piece * 3000 + ["end"] + ["q"] * 300_000
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    runs = periodic.find_runs(df).first().runs
    assert [tuple(r) for r in runs if r.length > 10] == [(0, 3000 * 67, 67), (3000 * 67 + 1, 300_000, 1)]
    assert len(runs) == 6002
