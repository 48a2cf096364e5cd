"""Ranked search over a lexical index: dual-sorted wavelet trees, one for each shard of documents.

A shard holds the postings of all its terms as one sequence of local document numbers: term after term, and for a term by falling impact.
The wavelet tree over it (levels in matrix layout) halves the documents at each level and keeps the order within a half, so a node
has a term's documents of its half as one range whose first element has the greatest impact. The sum of these over the terms bounds all scores
below the node; taking the node of the best bound first yields the best documents without looking at most of the postings.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

#: Bytes of text in a shard (a longer text is one of its own), and items that are searched in one pass over the index.
SHARD_BYTES, ITEM_BLOCK = 2_000_000, 4096
#: Lower-cases A-Z, and makes a blank of all ASCII that is neither digit nor letter.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "doc_ids array<bigint>, terms binary, counts binary, bits binary, impacts binary"


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal stretches of digits, letters and all that isn't ASCII, A-Z in lower case."""
    return ((text.encode() if isinstance(text, str) else text) or b"").translate(TERMS).split() if text else []


def statistics(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all their terms with repeats."""

    def counted(batches):
        for batch in batches:
            sizes = [len(x.translate(TERMS).split()) for x in words.encoded(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 for n in sizes if n)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["n", "total"])

    row = docs.select("text").mapInArrow(counted, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    return row.n, row.total


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to its score for a weight of 1, in 64-bit integers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * documents // max(total, 1)))


def _packed(doc_ids: list[int | None], split: list[list[bytes]], documents: int, total: int) -> dict:
    """One row of the index from the terms of some documents."""
    order = sorted(range(len(split)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0))
    split, doc_ids = [split[k] for k in order], [doc_ids[k] for k in order]
    sizes = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    using = count()
    term = np.concatenate([np.fromiter(map(number.setdefault, w, using), np.int64, len(w)) for w in split])
    d = len(split)
    key, tf = np.unique(term * d + np.repeat(np.arange(d), sizes), return_counts=True)
    doc = key % d
    own, at = np.unique(key // d, return_inverse=True)  # numbers of terms are places of their first occurrence
    strength = impact(tf, sizes[doc], documents, total)
    order = np.lexsort((doc, -strength, at))
    sequence, strength = doc[order], strength[order].astype(np.int32)
    bits = []
    for level in range(max(d - 1, 0).bit_length() - 1, -1, -1):
        bit = sequence >> level & 1
        bits.append(np.packbits(bit.astype(np.uint8)).tobytes())
        sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
    return {"doc_ids": doc_ids, "terms": b" ".join(number), "counts": np.bincount(at, minlength=len(own)).astype("<i4").tobytes(), "bits": b"".join(bits), "impacts": strength.astype("<i4").tobytes()}


_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("impacts", pa.binary())])


def build(docs: DataFrame, documents: int, total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index, a row for each shard: doc_ids by local number (ascending), terms (joined by blanks), counts of documents of each term,
    bits of the levels of the wavelet tree, and impacts of the postings. documents and total are statistics().

    Shards are consecutive rows of a partition, so nothing is shuffled, and a shard is bounded by shard_bytes or a single text. Rows without a
    term are in no shard. Null doc_ids and repeated rows are documents of their own; an empty table gives an empty index."""

    def shards(batches) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), words.encoded(batch.column(1))):
                found = text.translate(TERMS).split()
                if not found:
                    continue
                if held and size + len(text) > shard_bytes:
                    yield pa.RecordBatch.from_pylist([_packed(ids, held, documents, total)], _INDEX)
                    ids, held, size = [], [], 0
                ids.append(doc_id.as_py())
                held.append(found)
                size += len(text)
        if held:
            yield pa.RecordBatch.from_pylist([_packed(ids, held, documents, total)], _INDEX)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, INDEX)


class Shard:
    """The wavelet tree of a shard, with the impacts of the postings at each level and the ranges of wanted terms."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.doc_ids = row["doc_ids"]
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        ends = np.cumsum(counts)
        size = int(ends[-1]) if len(ends) else 0
        self.depth = max(len(self.doc_ids) - 1, 0).bit_length()
        level = np.frombuffer(row["impacts"], "<i4")
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.depth, -(-size // 8))
        self.ones, self.zeros, self.impacts = [], [], [level]
        for k in range(self.depth):
            bit = np.unpackbits(packed[k], count=size)
            ones = np.zeros(size + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(size - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
            self.impacts.append(level)
        self.ranges = {wanted[t]: (int(ends[k] - counts[k]), int(ends[k])) for k, t in enumerate(row["terms"].split(b" ")) if t in wanted} if size else {}

    def best(self, weights: list[tuple[int, int]], k: int, least: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, local number) of the terms (number, weight), best first, ties by number. A score under that of `least`
        (score, doc_id) isn't looked for."""
        own = [(*self.ranges[t], w) for t, w in weights if t in self.ranges and w > 0]
        if not own:
            return []
        low, high, weight = np.array(own, np.int64).T
        bound = int((weight * self.impacts[0][low]).sum())
        heap = [(-bound, 0, 0, low, high, weight)]
        out: list[tuple[int, int]] = []
        while heap and len(out) < k:
            bound, start, level, low, high, weight = heapq.heappop(heap)
            if least is not None and -bound < least[0]:
                break
            if level == self.depth:
                out.append((-bound, start))
                continue
            ones, strength = self.ones[level], self.impacts[level + 1]
            one_low, one_high = ones[low], ones[high]
            half = 1 << (self.depth - level - 1)
            for begin, a, b in ((start, low - one_low, high - one_high), (start + half, one_low + self.zeros[level], one_high + self.zeros[level])):
                some = b > a
                if some.any():
                    a, b, w = a[some], b[some], weight[some]
                    heapq.heappush(heap, (-int((w * strength[a]).sum()), begin, level + 1, a, b, w))
        return out


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def _document_counts(index: DataFrame, wanted) -> dict[int, int]:
    """How many documents hold each wanted term, from the dictionaries of the shards alone."""

    def found(batches):
        number = wanted.value
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1)):
                counts = np.frombuffer(c.as_py(), "<i4")
                rows = [(number[x], int(counts[k])) for k, x in enumerate(t.as_py().split(b" ")) if x in number]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "df"])

    rows = index.select("terms", "counts").mapInArrow(found, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.toLocalIterator()}  # as many rows as the block has terms at most


def search(index: DataFrame, items: DataFrame, documents: int, k: int = 10, block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item (item_id, text), rank from 1, equal
    scores by ascending doc_id (nulls last).

    Items are a stated set of queries: they pass over the index in blocks of at most `block`, whose terms and weights are broadcast; each block
    reads the whole index. A task keeps the k best of each item over its shards, which also bound the search in the next
    one; these meet in a ranking by item. Null text has no term and such items no row; repeated item_ids are items of their own each with its rows,
    extra columns are left out."""
    spark = index.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    results = []

    def run(batch: list[tuple]) -> None:
        number: dict[bytes, int] = {}
        using = [sorted({number.setdefault(t, len(number)) for t in terms(text)}) for _, text in batch]
        shared = spark.sparkContext.broadcast(number)
        df = _document_counts(index, shared)
        known = {t: weight(n, documents) for t, n in df.items()}
        asked = spark.sparkContext.broadcast([(i, [(t, known[t]) for t in own if t in known]) for (i, _), own in zip(batch, using)])

        def searched(batches):
            top: list[list] = [[] for _ in asked.value]  # (score, order of doc_id, doc_id), worst first
            for part in batches:
                for k_row in range(part.num_rows):
                    row = {c: part.column(c)[k_row].as_py() for c in part.schema.names}
                    shard = Shard(row, shared.value)
                    for held, (_, own) in zip(top, asked.value):
                        for score, at in shard.best(own, k, held[0][:2] if len(held) == k else None):
                            if score > 0:
                                doc_id = shard.doc_ids[at]
                                entry = (score, _Later(_order(doc_id)), doc_id)
                                if len(held) < k:
                                    heapq.heappush(held, entry)
                                else:
                                    heapq.heappushpop(held, entry)
            rows = [(n, e[2], e[0]) for n, held in enumerate(top) for e in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["number", "doc_id", "score"])

        best = index.mapInArrow(searched, "number long, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(batch)], f"number long, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(best.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))

    held: list[tuple] = []
    for r in items.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == block:
            run(held)
            held = []
    if held:
        run(held)
    if not results:
        return spark.createDataFrame([], schema.replace("doc_id", "rank int, doc_id"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


class _Later(tuple):
    """Compares the other way round: the greatest doc_id of equal scores is the worst."""

    __slots__ = ()

    def __lt__(self, other):
        return tuple.__gt__(self, other)

    def __gt__(self, other):
        return tuple.__lt__(self, other)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() of items in an index of all docs, which is written once."""
    documents, total = statistics(docs)
    return search(common.written(build(docs, documents, total), "index"), items, documents, k)
