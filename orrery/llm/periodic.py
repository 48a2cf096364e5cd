"""Runs (maximal periodic stretches) of the words of whole texts, and texts without their repeats.

Texts are looked at in slices of bounded size inside Spark tasks: a suffix array with the ranks of each doubling step, common prefixes of
neighbours in it, the longest previous factor of each word, and blocks of a Lempel-Ziv factorization. Each new run touches
the edge of a block and is found by extending equality to both sides of it; a run strictly inside a block is a copy of one before it.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

MIN_EXPONENT, MIN_LENGTH = 4, 6
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """Suffix array of the words of several texts at once. No suffix reaches beyond its text.

    `first` has the index of each text's first word, and the number of words last; symbol[i] is the index of the first occurrence of word i
    in its text. ranks[k][i] orders the stretches of 2**k words from i on: equal ranks are equal stretches."""

    def __init__(self, symbol: np.ndarray, first: np.ndarray):
        n = len(symbol)
        self.first, self.n = first, n
        sizes = np.diff(first)
        self.begin, self.end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
        counts = np.bincount(symbol, minlength=n)
        rank = (np.cumsum(counts) - counts)[symbol] if n else np.zeros(0, np.int64)
        self.ranks = [rank.astype(np.int32)]
        active = np.flatnonzero(counts[symbol] > 1) if n else np.zeros(0, np.int64)
        width = 1
        while len(active):  # only suffixes that are equal so far are sorted again
            further = active + width
            inside = further < self.end[active]
            key = rank[active] * (n + 1) + np.where(inside, rank[np.where(inside, further, 0)] + 1, 0)
            order = np.argsort(key)
            key, moved = key[order], active[order]
            old = rank[moved]
            place = np.arange(len(moved))
            heads = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
            own = np.maximum.accumulate(np.where(heads, place, 0))
            rank = rank.copy()
            rank[moved] = old + own - group
            self.ranks.append(rank.astype(np.int32))
            size = np.diff(np.append(np.flatnonzero(heads), len(moved)))
            active = np.sort(moved[np.repeat(size, size) > 1])
            width *= 2
        self.array = np.empty(n, np.int64)
        self.array[rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal, for each pair of different places of one text, or ends of it."""
        return self._common(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to a and up to b, these included, are equal."""
        return self._common(a, b, -1)

    def _common(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        if way > 0:
            live = high < self.n
            edge = self.end[np.where(low < self.n, low, 0)] if self.n else low
        else:
            live = low >= 0
            edge = self.begin[np.where(high >= 0, high, 0)] if self.n else low
        for k in range(len(self.ranks) - 1, -1, -1):
            step, rank = 1 << k, self.ranks[k]
            x, y = (a, b) if way > 0 else (a - step + 1, b - step + 1)
            fits = live & (np.maximum(x, y) + step <= edge if way > 0 else np.minimum(x, y) >= edge)
            at = np.flatnonzero(fits)
            at = at[rank[x[at]] == rank[y[at]]]
            a[at] += way * step
            b[at] += way * step
            out[at] += step
        return out


def longest_previous(s: Suffixes) -> tuple[list[int], list[int]]:
    """For each word, the length of the longest stretch from it on that also starts at an earlier word (they may overlap), and such an
    earlier word: in the suffix array that is one of the nearest neighbours with an earlier place."""
    n = s.n
    lcp = np.zeros(n + 1, np.int64)
    if n > 1:
        pairs = np.flatnonzero(s.ranks[0][s.array[1:]] == s.ranks[0][s.array[:-1]]) + 1
        lcp[pairs] = s.forward(s.array[pairs - 1], s.array[pairs])
    length, source = [0] * n, [-1] * n
    some = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))  # a suffix that shares nothing with its neighbours has no previous factor
    places, common = [], []
    for at, shared in zip([*s.array[some].tolist(), -1], [*lcp[some].tolist(), 0]):
        while places and at < places[-1]:
            done, before = places.pop(), common.pop()
            if before >= shared:
                length[done], source[done] = before, places[-1] if before else -1
            else:
                length[done], source[done] = shared, at
            shared = min(shared, before)
        places.append(at)
        common.append(shared)
    return length, source


def blocks_of(length: list[int], start: int, end: int) -> list[int]:
    """Starts of the Lempel-Ziv blocks of a text, and its end: each is the longest that occurs before, or a single new word."""
    out, at = [], start
    while at < end:
        out.append(at)
        at += length[at] or 1
    out.append(end)
    return out


def edges_of(blocks: list[list[int]]) -> np.ndarray:
    """(start of the block before, edge, end of the block after) for each end of a block; after the last block comes an empty one."""
    flat = np.fromiter(chain.from_iterable(blocks), np.int64)
    sizes = np.array([len(b) for b in blocks], np.int64)
    last = np.cumsum(sizes) - 1
    after = np.append(flat[1:], 0)
    after[last] = flat[last]
    inner = np.ones(len(flat), bool)
    inner[last - sizes + 1] = False
    return np.stack([np.append(0, flat[:-1]), flat, after], 1)[inner]


def touching(s: Suffixes, edges: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of runs with an exponent of at least `least` (2 or more) that touch an edge; edges are
    the rows (block before it, edge, block after it, as starts and end).

    Words q apart are equal on a stretch of (least - 1) * q or more in a run. If the run ends in the block after the edge and starts before it,
    its second period can't start before the block in front of the edge, or that block would be longer. So q is bounded by both blocks."""
    before, edge, after = edges.T
    most = np.maximum(after - before, 0) // (least - 1)
    at = np.repeat(edge, most)
    low, high = s.begin[np.repeat(before, most)], s.end[np.repeat(before, most)]
    q = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    symbol = s.ranks[0]
    equal = lambda i, j: (i >= low) & (j < high) & (symbol[np.clip(i, 0, s.n - 1)] == symbol[np.clip(j, 0, s.n - 1)])
    found = []
    for i in (at, at - q):  # the stretch of equal words reaches the edge from the right, or does so a period before it
        near = np.flatnonzero(equal(i, i + q) | equal(i - 1, i - 1 + q))
        left, p = i[near], q[near]
        ahead = np.zeros(len(near), np.int64)
        go = np.flatnonzero(equal(i, i + q)[near])
        ahead[go] = s.forward(left[go], left[go] + p[go])
        back = np.zeros(len(near), np.int64)
        go = np.flatnonzero(equal(i - 1, i - 1 + q)[near])
        back[go] = s.backward(left[go] - 1, left[go] - 1 + p[go])
        keep = ahead + back >= (least - 1) * p
        found.append(np.stack([left - back, left + p + ahead, p], 1)[keep])
    return np.concatenate(found)


def runs_of(symbol: np.ndarray, first: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> dict[int, list[tuple[int, int, int]]]:
    """(start, end, period) of all runs of texts of words, by the index of the text, sorted by start and period.

    Runs have a smallest period q, a length of at least max(min_length, min_exponent * q) and min_exponent of 2 or more."""
    if not len(symbol):
        return {}
    s = Suffixes(symbol, first)
    length, source = longest_previous(s)
    blocks = [blocks_of(length, a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    found = touching(s, edges_of(blocks), min_exponent)
    found = found[np.lexsort(found.T[::-1])]
    same = np.zeros(len(found), bool)  # a multiple of the smallest period gives the same stretch
    same[1:] = (found[1:, :2] == found[:-1, :2]).all(1)
    found = found[~same]
    size = found[:, 1] - found[:, 0]
    found = found[size >= np.maximum(min_length, min_exponent * found[:, 2])]
    text_of = np.searchsorted(first, found[:, 0], "right") - 1
    out = {}
    for text in np.unique(text_of).tolist():
        begin = int(first[text])
        at_start = defaultdict(list)  # buckets of runs by start
        for a, b, q in found[text_of == text].tolist():
            at_start[a].append((b, q))
        for a, b in zip(blocks[text], blocks[text][1:]):
            if b - a < min_length + 2:
                continue
            back = a - source[a]
            for at in range(a + 1, b):  # a run strictly inside a block is a copy: its bucket is that of the same place before
                for e, q in at_start.get(at - back, ()):
                    if e + back < b:
                        at_start[at].append((e + back, q))
        out[text] = sorted((a - begin, q, e - begin) for a, held in at_start.items() for e, q in set(held))
        out[text] = [(a, e, q) for a, q, e in out[text]]
    return out


def find_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of the words of each whole text, as structs (start, length, period) by start and period,
    words numbered from 0; and the words that are left, joined by blanks, when each run keeps its first period only.

    Words are what stands between the ASCII blanks. A null, empty or blank text has no runs and collapses to the empty text. Null doc_ids and repeated
    rows stay rows of their own, other columns are left out, an empty table gives an empty one. Memory of a task grows with one slice of
    2 MB of text, or a single longer text, by some 20 numbers a word; no step is quadratic in a text."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have an exponent and a length of 2 or more")

    def found(batches):
        for batch in batches:
            ids, texts = batch.column(0), words.encoded(batch.column(1))
            for i, j in words.slices(texts):
                split = [x.split() for x in texts[i:j]]
                first = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
                number = count()
                symbol = np.concatenate([np.fromiter(map({}.setdefault, w, number), np.int64, len(w)) for w in split])
                runs = runs_of(symbol, first, min_exponent, min_length)
                for k, held in runs.items():
                    kept = np.ones(len(split[k]), bool)
                    for a, e, q in held:
                        kept[a + q : e] = False
                    split[k] = [split[k][x] for x in np.flatnonzero(kept).tolist()]
                told = [[{"start": a, "length": e - a, "period": q} for a, e, q in runs.get(k, ())] for k in range(j - i)]
                left = pa.array([b" ".join(w) for w in split], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(told, pa.list_(_RUN)), left], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, f"doc_id long, runs array<{RUN}>, collapsed string")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten texts, chosen by a hash h of doc_id, the words from number a on repeat those of a period p: a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), where n counts the words and g = floor(h / 10). Null doc_ids are never chosen."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    chosen = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, w))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int")
    chosen = chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of find_runs(): the longest run (ties: smallest
    start, then period) and digests of all runs and of the collapsed text."""
    best: Column = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.withColumn("best", best)
    size, period = -F.col("best.back"), F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), size.alias("length"), period.alias("period"),
        F.expr("(1000 * -best.back) div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
