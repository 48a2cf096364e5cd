"""Pairs of token sets that may be similar, told by bitmaps: no similar pair is lost, and few others are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import tasks, written

#: Parts that the sets of a key are dealt to, for parallel work, each of LEAST sets or so; of more than PARTS * PART sets the number of parts grows.
PARTS, LEAST, PART = 16, 256, 1 << 15
#: Most 64-bit words of a bitmap. It has at least four bits a token up to there; sets of more tokens are told apart less well.
WORDS = 512
#: Rows by columns that are compared at once, and pairs of them by whole bitmaps.
TILE, FULL = (128, 256), 1 << 12


def bitmaps(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set of 64-bit hashes the parities of its tokens by their low bits. In a bit in which two bitmaps differ, the sets have a token
    that is in one of them only, also after the longer bitmap is folded to the length of the shorter."""
    out = []
    for h in hashes:
        words = min(WORDS, 1 << max(0, (4 * len(h) - 1).bit_length() - 6))
        odd = np.bincount(h & (64 * words - 1), minlength=64 * words) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps in `words` words, a power of two."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _by_width(rows: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{words: (rows by size, their bitmaps)}"""
    widths = np.array([len(bits[i]) for i in rows])
    out = {}
    for words in np.unique(widths).tolist():
        some = rows[widths == words]
        some = some[np.argsort(sizes[some], kind="stable")]
        out[words] = some, np.stack([bits[i] for i in some])
    return out


def near(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of left and right, or of left with itself if right is it, whose sets may have a Jaccard similarity of threshold or more:
    their sizes are near enough, and their bitmaps differ in no more bits than so similar sets have tokens apart."""
    own = right is left
    ours = _by_width(left, sizes, bits)
    theirs = ours if own else _by_width(right, sizes, bits)
    apart = (1 - threshold) / (1 + threshold)
    for w, (x, x_bits) in ours.items():
        for v, (y, y_bits) in theirs.items():
            if own and v < w:
                continue
            words = min(w, v)
            a, b, short = folded(x_bits, words), folded(y_bits, words), max(1, words // 2)
            a_short, b_short = folded(a, short), np.ascontiguousarray(folded(b, short).T)
            n, m = sizes[x], sizes[y]
            for at in range(0, len(x), TILE[0]):
                some = slice(at, min(at + TILE[0], len(x)))
                least, most = n[some.start], n[some.stop - 1]
                low, high = np.searchsorted(m, least * threshold - 1e-6), np.searchsorted(m, most / threshold + 1e-6, "right")
                if own and v == w:
                    low = max(low, at)
                for k in range(low, high, TILE[1]):
                    part = slice(k, min(k + TILE[1], high))
                    # Folded bitmaps never differ in more bits, and rows of a tile are of about one size, so most pairs are told apart by half of the words and one bound.
                    i, j = np.nonzero(_differ(a_short[some], b_short[:, part]) <= np.uint16((int(most) + int(m[part.stop - 1])) * apart + 1e-6))
                    i, j = i + some.start, j + part.start
                    keep = np.minimum(n[i], m[j]) >= threshold * np.maximum(n[i], m[j]) - 1e-6
                    if own and v == w:
                        keep &= i < j
                    i, j = i[keep], j[keep]
                    if len(i):
                        near_ = np.concatenate([_count(a[i[q : q + FULL]] ^ b[j[q : q + FULL]]) for q in range(0, len(i), FULL)]) <= (n[i] + m[j]) * apart + 1e-6
                        yield x[i[near_]], y[j[near_]]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each row of a differs from each column of b."""
    shape = len(a), b.shape[1]
    out, odd, some, count = np.zeros(shape, np.uint16), np.empty(shape, np.uint64), np.zeros(shape, np.uint8), np.empty(shape, np.uint8)
    for q in range(len(b)):
        np.bitwise_xor(a[:, q, None], b[None, q], out=odd)
        np.bitwise_count(odd, out=count)
        some += count
        if q % 3 == 2 or q == len(b) - 1:  # three words differ in 192 bits at most
            out += some
            some[:] = 0
    return out


def _count(odd: np.ndarray) -> np.ndarray:
    return np.bitwise_count(odd).sum(axis=1, dtype=np.int32)


def common(i: np.ndarray, j: np.ndarray, edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many values the sets i[k] and j[k] share, of sets whose distinct values lie from edges[s] to edges[s + 1]."""
    out = np.zeros(len(i), np.int64)
    if not len(values):
        return out
    found, codes = np.unique(values, return_inverse=True)
    has = np.zeros(len(found), bool)
    order = np.argsort(i, kind="stable")
    starts = np.flatnonzero(np.diff(i[order], prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], len(order))):
        own = codes[edges[i[order[start]]] : edges[i[order[start]] + 1]]
        has[own] = True
        for k in range(start, end, 512):
            some = order[k : min(k + 512, end)]
            first, sizes = edges[j[some]], edges[j[some] + 1] - edges[j[some]]
            past = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(first - past[:-1], sizes) + np.arange(past[-1])
            hits = np.concatenate([[0], np.cumsum(has[codes[at]])])
            out[some] = hits[past[1:]] - hits[past[:-1]]
        has[own] = False
    return out


def likely_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a_id, b_id), a_id < b_id: of the sets (key long, id, kind long, wide boolean, tokens) all pairs of one key and different kinds, one of
    them wide or both, with a Jaccard similarity of `threshold` or more, and some others; of ids with several sets, pairs may come more than once.

    A key's sets are dealt to parts, and each two parts meet in one task, as bitmaps: no pair leaves it but those that
    are likely. What is shuffled is each set's bitmap once for each part, some PARTS * n bytes for n tokens."""

    def mapped(batches):
        for batch in batches:
            at = batch.schema.get_field_index("hashes")
            hashes = batch.column(at)
            edges, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            bits = bitmaps([values[i:j] for i, j in zip(edges, edges[1:])])
            sizes = pa.array(np.diff(edges).astype(np.int32), pa.int32())
            columns = [batch.column(c) for c in ("key", "id", "kind", "wide")]
            yield pa.RecordBatch.from_arrays([*columns, sizes, pa.array([b.tobytes() for b in bits], pa.binary())], names=["key", "id", "kind", "wide", "n", "bits"])

    def compare(table: pa.Table) -> pa.Table:
        sizes, kind, part = (table.column(c).to_numpy() for c in ("n", "kind", "part"))
        wide = table.column("wide").to_numpy(zero_copy_only=False).astype(bool)
        bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("bits").combine_chunks()]
        first = np.flatnonzero(part == part.min())
        second = np.flatnonzero(part != part.min())
        # A block of two parts, or of one with itself, of which the number of the block tells.
        alone = bool(table.column("alone")[0].as_py())
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in near(first, first if alone else second, sizes, bits, threshold) if alone or len(second) else ():
            keep = (kind[i] != kind[j]) & (wide[i] | wide[j])
            found.append((i[keep], j[keep]))
        i, j = (np.concatenate(c) for c in zip(*found))
        ids = table.column("id").combine_chunks()
        return pa.Table.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["x", "y"])

    hashed = sets.select("key", F.col("id").cast("string").alias("id"), "kind", "wide", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    maps = written(hashed.where(F.size("hashes") > 0).mapInArrow(mapped, "key long, id string, kind long, wide boolean, n int, bits binary"), "bitmaps")
    parts = F.greatest(F.lit(1), F.least(F.lit(PARTS), F.ceil(F.col("count") / LEAST)), F.ceil(F.col("count") / PART)).cast("int")
    dealt = maps.join(maps.groupBy("key").count().select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.least("part", "other") * F.col("parts").cast("long") + F.greatest("part", "other")
    blocks = each.select("key", block.alias("block"), "part", (F.col("part") == F.col("other")).alias("alone"), "id", "kind", "wide", "n", "bits")
    # The number of partitions is given, as small blocks make much work: by their bytes they would be brought together into few tasks.
    pairs = blocks.repartition(tasks(sets), "key", "block").groupBy("key", "block").applyInArrow(compare, "x string, y string")
    return pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).where("a_id < b_id")
