"""Language-model scores from a hierarchical Pitman-Yor model of words.

Each word, and the begin of a text, is a context with a restaurant of its own; all share one parent, the restaurant of
words without a context, over a uniform distribution of the V words learned and one for any other. The customers of
the parent are the tables of its children. Seating is sampled by blocked Gibbs sweeps, in which each dish of a restaurant draws its
number of tables given its customers and the parent's prediction; predictive probabilities are averaged over sweeps.

The model is two tables: cells, of a context, a word and its customers and tables there, and the vocabulary. A sweep joins a
context's weight and a word's prediction to the cells, draws, and sums tables by context and by word. A dish of one customer has
one table in every sweep, so only cells of two customers or more are kept; the others are numbers in the vocabulary, and
are met again among the pairs of the texts that are scored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import NOT_SPACE, Words, encoded, mix, slices

#: Discount and strength of the root and of the restaurants of contexts.
DISCOUNT, STRENGTH = (0.6, 0.75), (20.0, 2.0)
#: Sweeps that are not averaged, and those that are.
BURN_IN, SAMPLES = 2, 3
#: Most words and most pairs of words that are broadcast for scoring: those of a share of the training tokens of 1 / FREQUENT and
#: 1 / FREQUENT_PAIRS or more, of which there can't be more. Others are joined.
FREQUENT, FREQUENT_PAIRS = 1 << 18, 1 << 20
#: Customers of a dish up to which its tables are drawn from their exact distribution; beyond, from a normal one.
EXACT = 256
#: Different keys that a task holds before it passes their counts on.
HELD = 1_000_000

#: The begin of a text as a context and the end as a token. No hash of a word is known to equal it; it is one value of 2**64.
END = np.uint64(0x456E64206F662074)


class Tokens:
    """The tokens of texts, words and ends, in order: `hash`, `context` (that of the token before) and `doc` of each."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, NOT_SPACE)
        self.hash = np.insert(w.hash, w.first[1:], END)
        self.context = np.concatenate([[END], self.hash[:-1]]) if len(texts) else self.hash
        self.doc = np.repeat(np.arange(len(texts)), np.diff(w.first) + 1)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A negative number for each pair; pairs of frequent words have their places in the list of these as keys, which are positive."""
    return mix(mix(context.view(np.uint64)) + word.view(np.uint64)).view(np.int64) | np.int64(-(2**63))


def _summed(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Sorted different keys (by the last one first) and the sums of their values."""
    order = np.lexsort(keys)
    keys, values = [k[order] for k in keys], [v[order] for v in values]
    if not len(order):
        return (*keys, *values)
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return (*(k[new] for k in keys), *(np.add.reduceat(v, new) for v in values))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


#: Rows of columns are shuffled as blocks: `data` holds up to BLOCK of them, column by column, each of eight bytes, compressed, of
#: one bucket and kind. Of a bucket the kinds come in this order: a table to look things up in, pairs of texts to learn from (PLAIN ones
#: of frequent words alone), pairs of the other texts, sums of documents.
BLOCKS, BLOCK = "bucket long, kind int, data binary", 256
TABLE, PLAIN_LEARNED, LEARNED, PLAIN, OTHER, SUMS = range(6)
#: Tokens that a bucket holds on average, at most.
BUCKET_TOKENS = 4_000_000


def _buckets(docs: DataFrame, tokens: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(buckets)).view(np.int64)


def _real(column: np.ndarray) -> np.ndarray:
    return column.view(np.float64)


def _state(inverse: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Customers of restaurants, and tables in each sample, of which inverse and weights were made: whole numbers compress well."""
    customers = 1 / inverse
    return [np.rint(v).astype(np.int64) for v in (customers - STRENGTH[1], *((weights * customers[:, None] - STRENGTH[1]) / DISCOUNT[1]).T)]


def _blocks(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch of BLOCKS of rows of 64-bit columns, which keep their order within a bucket; none of no rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, table = bucket[order], np.stack([c[order].view(np.int64) for c in columns])
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    place = np.arange(len(bucket))
    edges = np.flatnonzero((place - np.maximum.accumulate(np.where(first, place, 0))) % BLOCK == 0)
    ends = [*edges[1:].tolist(), len(bucket)]
    packed = zstandard.ZstdCompressor(level=1).compress
    data = pa.array([packed(table[:, a:b].tobytes()) for a, b in zip(edges.tolist(), ends)], pa.binary())
    yield _batch(bucket=bucket[edges], kind=np.full(len(edges), kind, np.int32), data=data)


def _met(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.unionAll(table).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _runs(batches, widths: dict[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, kind, columns) of sorted BLOCKS; a bucket's kind may come in several runs."""
    unpacked = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data = batch.column(2)
        edges = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                parts = [np.frombuffer(unpacked(d.as_buffer()), np.int64).reshape(widths[int(kind[a])], -1) for d in data[a:b]]
                yield int(bucket[a]), int(kind[a]), np.concatenate(parts, axis=1)


def _beside_table(batches, widths: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, table, columns) of the runs of sorted BLOCKS that are no TABLE, where table is that of their bucket, sorted by its
    first column."""
    now, held, table = None, [], None
    for bucket, kind, rows in _runs(batches, widths):
        if bucket != now:
            now, held, table = bucket, [], None
        if kind == TABLE:
            held.append(rows)
            continue
        if table is None:
            table = np.concatenate([np.zeros((widths[TABLE], 0), np.int64), *held], axis=1)
            table, held = table[:, np.argsort(table[0])], []
        yield kind, table, rows


def pairs(docs: DataFrame) -> DataFrame:
    """Of the texts to learn from (text): (context, word, n) for each pair that occurs n times, twice or more; and
    with a null context, (word, n, x, y) that add up to the number n of its occurrences, and how many pairs that
    occur once have it as word (x) and as context (y)."""

    def count(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            texts = encoded(batch.column(0))
            for a, b in slices(texts):
                t = Tokens(texts[a:b])
                held.append(_summed((t.context.view(np.int64), t.hash.view(np.int64)), (np.ones(len(t.hash), np.int64),)))
                size += len(held[-1][0])
                if size > HELD:
                    c, w, n = map(np.concatenate, zip(*held))
                    yield _batch(**dict(zip(("context", "word", "n"), _summed((c, w), (n,)))))
                    held, size = [], 0
        if held:
            c, w, n = map(np.concatenate, zip(*held))
            yield _batch(**dict(zip(("context", "word", "n"), _summed((c, w), (n,)))))

    def split(batches):
        held: list[tuple] = []
        size = 0

        def words():
            word, n, x, y = _summed((np.concatenate([h[0] for h in held]),), tuple(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))
            return _batch(context=pa.nulls(len(word), pa.int64()), word=word, n=n, x=x, y=y)

        for batch in batches:
            c, w, n = (batch.column(k).to_numpy() for k in range(3))
            more, zero = n > 1, np.zeros(len(n), np.int64)
            yield _batch(context=c[more], word=w[more], n=n[more], x=zero[more], y=zero[more])
            once = (~more).astype(np.int64)
            held.append(_summed((np.concatenate([w, c[~more]]),), (np.concatenate([n, zero[~more]]), np.concatenate([once, zero[~more]]), np.concatenate([zero, once[~more]]))))
            size += len(held[-1][0])
            if size > HELD:
                yield words()
                held, size = [], 0
        if held:
            yield words()

    counted = docs.select("text").mapInArrow(count, "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(split, "context long, word long, n long, x long, y long")


@functools.cache
def _log_stirling(discount: float) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S(n, t), t from 1 to n, for n up to EXACT."""
    rows = [np.zeros(0), np.zeros(1)]
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        grown = np.full(n + 1, -np.inf)
        grown[:n] = rows[n] + np.log(n - discount * t)
        rows.append(np.logaddexp(grown, np.concatenate([[-np.inf], rows[n]])))
    return rows


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the salt alone, so that a lost task draws the same ones again."""
    bits = mix(mix(keys.view(np.uint64)) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def typical_tables(c: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    """The number of tables t about which S(c, t) a**t peaks. It is that of the Pitman-Yor process whose strength s makes
    the weight of its next table a too: s + discount * t = s (1 + c / s)**discount = a."""
    low, high = np.full(len(c), -80.0), np.log(a)
    for _ in range(60):
        s = (low + high) / 2
        above = s + discount * np.logaddexp(0, np.log(c) - s) > np.log(a)
        low, high = np.where(above, low, s), np.where(above, s, high)
    return np.clip((a - np.exp(low)) / discount + 0.5, 1, c)


def drawn_tables(c: np.ndarray, a: np.ndarray, keys: np.ndarray, salt: int, discount: float) -> np.ndarray:
    """Numbers of tables of dishes with c customers, where a is the weight of a new table: t has a probability in
    proportion to S(c, t) a**t. Over EXACT customers it is drawn from a normal distribution about typical_tables()."""
    t = np.minimum(c, 1)
    u = uniform(keys, salt)
    stirling, log_a = _log_stirling(discount), np.log(np.maximum(a, 1e-300))
    first = np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    edges = np.searchsorted(first[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        for k in range(edges[n], edges[n + 1], 20_000):
            some = order[k : min(k + 20_000, edges[n + 1])]
            weight = stirling[n] + np.arange(1, n + 1) * log_a[some, None]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            t[some] = 1 + np.minimum((weight < u[some, None] * weight[:, -1:]).sum(1), n - 1)
    some = np.flatnonzero(c > EXACT)
    if len(some):
        most = typical_tables(c[some], a[some], discount)
        normal = np.sqrt(-2 * np.log(u[some])) * np.cos(2 * np.pi * uniform(keys[some], salt + 104729))
        t[some] = np.clip(np.rint(most + np.sqrt(most * (1 - most / c[some])) * normal), 1, c[some])
    return t


CELLS = "context long, word long, n long, t long, sum long, rare boolean"
WORDS = "word long, n long, x long, y long, t long"


class Model(NamedTuple):
    """words: (word, n, inverse, weights, predictions) of each learned token: its occurrences; as a context, 1 / (strength +
    customers), and of each sample the weight of a new table times that; its probability in the root of each sample.
    cells: (context, word, n, r) of each pair that occurs twice or more: its customers less the discounts of its tables, averaged.
    unknown: of each sample, the root's probability of a word that wasn't learned. total: training tokens; distinct: different ones."""

    words: DataFrame
    cells: DataFrame
    unknown: list[float]
    total: int
    distinct: int


def _frequent(words: DataFrame, total: int, frequent: int, *columns: str) -> pa.Table:
    """The columns of words of a share of the training tokens of 1 / frequent or more: `frequent` rows at most, sorted by word."""
    return words.where(F.col("n") >= max(1, -(-total // frequent))).select("word", *columns).orderBy("word").toArrow().combine_chunks()


def _drawn(cells: DataFrame, words: DataFrame, root: tuple[float, float], total: int, salt: int, sampled: bool) -> DataFrame:
    """cells with tables drawn anew, given the words' state; root is what a word's customers are divided by, and what every word gets.
    Cells of two frequent words find weight and prediction in a broadcast table, the others (`rare`) by joins."""
    words = words.select("word", "n", (F.lit(STRENGTH[1]) + DISCOUNT[1] * F.col("y")).alias("a"), ((F.col("x") - DISCOUNT[0] * F.col("t") + F.lit(root[1])) / root[0]).alias("p"))
    table = _frequent(words, total, FREQUENT, "a", "p")
    shared = cells.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("word", "a", "p")))

    def batch_of(c, w, n, s, a, rare):
        t = drawn_tables(n, a, pair_key(c, w), salt, DISCOUNT[1])
        return _batch(context=c, word=w, n=n, t=t, sum=s + t if sampled else s, rare=np.full(len(n), rare))

    def look_up(batches):
        keys, a, p = shared.value
        for batch in batches:
            c, w, n, s = (batch.column(k).to_numpy() for k in range(4))
            yield batch_of(c, w, n, s, a[_place(keys, c)[0]] * p[_place(keys, w)[0]] if len(n) else np.zeros(0), False)

    def draw(batches):
        for batch in batches:
            yield batch_of(*(batch.column(k).to_numpy() for k in range(5)), True)

    own = ["context", "word", "n", "sum"]
    joined = cells.where("rare").select(*own).join(words.select(F.col("word").alias("context"), "a"), "context").join(words.select("word", "p"), "word")
    easy = cells.where("not rare").select(*own).mapInArrow(look_up, CELLS)
    return common.written(easy.unionAll(joined.select(*own, (F.col("a") * F.col("p")).alias("a")).mapInArrow(draw, CELLS)), "cells")


def _seated(single: DataFrame, cells: DataFrame, weight: float, salt: int) -> tuple[DataFrame, int, int]:
    """WORDS: x customers of each word in the root, drawn to t tables there, and y tables in its own restaurant; and the
    sums of x and t. `weight` is that of a new table of the root for each word."""

    def draw(batches):
        for batch in batches:
            w, n, x, y = (batch.column(k).to_numpy() for k in range(4))
            yield _batch(word=w, n=n, x=x, y=y, t=drawn_tables(x, np.full(len(x), weight), w, salt, DISCOUNT[0]))

    zero = F.lit(0).cast("long")
    dishes = cells.select("word", zero.alias("n"), F.col("t").alias("x"), zero.alias("y"))
    restaurants = cells.select(F.col("context").alias("word"), zero.alias("n"), zero.alias("x"), F.col("t").alias("y"))
    summed = single.unionAll(dishes).unionAll(restaurants).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y")))
    words = common.written(summed.mapInArrow(draw, WORDS), "words")
    x, t = words.agg(F.sum("x"), F.sum("t")).first()
    return words, x or 0, t or 0


def fit(docs: DataFrame) -> Model:
    """The model of documents (text, learn)."""
    counted = common.written(pairs(docs.where("learn")), "pairs")
    single = common.written(counted.where("context is null").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y"))), "single")
    total, distinct = single.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    listed = docs.sparkSession.sparkContext.broadcast(_frequent(single, total, FREQUENT).column("word").to_numpy())

    def first(batches):
        for batch in batches:
            c, w, n = (batch.column(k).to_numpy() for k in range(3))
            rare = ~(_place(listed.value, c)[1] & _place(listed.value, w)[1])
            yield _batch(context=c, word=w, n=n, t=np.ones(len(n), np.int64), sum=np.zeros(len(n), np.int64), rare=rare)

    cells = common.written(counted.where("context is not null").select("context", "word", "n").mapInArrow(first, CELLS), "cells")
    common.discard(counted)
    base = 1 / (distinct + 1)
    words, x, t = _seated(single, cells, STRENGTH[0] * base, 0)
    samples = []
    for s in range(1, BURN_IN + SAMPLES + 1):
        root = (STRENGTH[0] + x, (STRENGTH[0] + DISCOUNT[0] * t) * base)
        now = _drawn(cells, words, root, total, 2 * s, s > BURN_IN)
        after, x, t = _seated(single, now, root[1], 2 * s + 1)
        common.discard(cells)
        if s <= BURN_IN + 1:
            common.discard(words)
        cells, words = now, after
        if s > BURN_IN:
            samples.append((words, STRENGTH[0] + x, (STRENGTH[0] + DISCOUNT[0] * t) * base))
    inverse = 1 / (F.lit(STRENGTH[1]) + F.col("n"))  # each occurrence of a word is a customer of its restaurant
    each = [w.select("word", "n", F.lit(k).alias("k"), ((F.lit(STRENGTH[1]) + DISCOUNT[1] * F.col("y")) * inverse).alias("g"), ((F.col("x") - DISCOUNT[0] * F.col("t") + F.lit(r)) / F.lit(c)).alias("p")) for k, (w, c, r) in enumerate(samples)]
    of = lambda c: F.array(*(F.sum(F.when(F.col("k") == k, F.col(c))) for k in range(SAMPLES)))
    gathered = functools.reduce(DataFrame.unionAll, each).groupBy("word").agg(F.max("n").alias("n"), of("g").alias("weights"), of("p").alias("predictions"))
    vocabulary = common.written(gathered.select("word", "n", inverse.alias("inverse"), "weights", "predictions"), "vocabulary")

    found = common.written(cells.select("context", "word", "n", (F.col("n") - F.col("sum") * (DISCOUNT[1] / SAMPLES)).alias("r")), "found")
    common.discard(single, cells, *(w for w, _, _ in samples))
    return Model(vocabulary, found, [r / c for _, c, r in samples], total, distinct)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold the wanted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def score(docs: DataFrame, model: Model, frequent: int = FREQUENT, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """(_doc, n_tokens, n_known, base_score, score) for each different document key _doc of (text, learn, _doc).

    Frequent words and pairs are looked up in broadcast tables. Other pairs go as blocks to where the cells are; those with a rare
    word go by the rows of their context and of their word in the vocabulary first. In all three places the table of a bucket comes before
    the pairs, which pass by it: what a task holds is a bucket's table and its pairs of one occurrence, whatever a pair's frequency.
    """
    floor = 0.1 * (model.distinct + 1) + model.total
    least_pair = max(2, -(-model.total // frequent_pairs))
    some = _frequent(model.words, model.total, frequent, "n", "inverse", "weights", "predictions")
    listed = lambda c: some.column(c).combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
    based = np.log10((some.column("n").to_numpy() + 0.1) / floor)
    words = some.column("word").to_numpy()
    buckets = _buckets(docs, model.total)

    def keys_of(words: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        (at, hit), (by, held) = _place(words, word), _place(words, context)
        return np.where(hit & held, by * max(1, len(words)) + at, pair_key(context, word))

    top = model.cells.where(F.col("n") >= least_pair).select("context", "word", "r").toArrow()  # `frequent_pairs` at most
    keys = keys_of(words, top.column("context").to_numpy(), top.column("word").to_numpy())
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((words, some.column("inverse").to_numpy(), listed("weights"), listed("predictions"), based, keys[order], top.column("r").to_numpy()[order]))
    unknown = np.array(model.unknown)
    texts = docs.select("text", "learn", "_doc")

    def texts_of(batches):
        for batch in batches:
            texts, learn, own = encoded(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2).to_numpy()
            for a, b in slices(texts):
                t = Tokens(texts[a:b])
                yield t, t.context.view(np.int64), t.hash.view(np.int64), learn[a:b], own[a:b]

    def two_kinds(key, learn, columns, kinds):
        for kind, which in zip(kinds, (learn, ~learn)):
            yield from _blocks(_bucket(key[which], buckets), kind, *(c[which] for c in columns))

    def common_pairs(batches):
        words, inverse, weights, predictions, based, cells, rest = shared.value
        for t, context, word, learn, own in texts_of(batches):
            n = len(own)
            (at, hit), (by, held) = _place(words, word), _place(words, context)
            ok = hit & held
            at_ok, by_ok, doc = at[ok], by[ok], t.doc[ok]
            key = by_ok * max(1, len(words)) + at_ok
            place, known = _place(cells, key)
            p = rest[place[known]] * inverse[by_ok[known]] + (weights[by_ok[known]] * predictions[at_ok[known]]).mean(1)
            summed = lambda d, v: np.bincount(d, v, n).astype(np.float64)
            tokens, of_known = np.bincount(t.doc, minlength=n), np.bincount(t.doc[hit], minlength=n)
            yield from _blocks(_bucket(own, buckets), SUMS, own, np.ones(n, np.int64), tokens, of_known, summed(t.doc[hit], based[at[hit]]), summed(doc[known], np.log10(p)))
            key, doc, times = _summed((key[~known], doc[~known]), (np.ones((~known).sum(), np.int64),))
            yield from two_kinds(key, learn[doc], (key, own[doc], times), (PLAIN_LEARNED, PLAIN))

    def rare_pairs(rare_context: bool, rare_word: bool):
        """Pairs of just these two; those of a frequent context with what to_words adds."""

        def pairs_of(batches):
            words, inverse, weights, *_ = shared.value
            for t, context, word, learn, own in texts_of(batches):
                (at, hit), (by, held) = _place(words, word), _place(words, context)
                some = (hit != rare_word) & (held != rare_context)
                rows = word[some], context[some], t.doc[some]
                if not rare_context:
                    c, w, at, doc, n = _summed((rows[1], rows[0], by[some], rows[2]), (np.ones(len(rows[0]), np.int64),))
                    yield from two_kinds(w, learn[doc], (w, c, own[doc], n, *_state(inverse[at], weights[at])), (LEARNED, OTHER))
                else:
                    w, c, doc, n = _summed(rows, (np.ones(len(rows[0]), np.int64),))
                    yield from two_kinds(c, learn[doc], (w, c, own[doc], n), (LEARNED, OTHER))

        return texts.mapInArrow(pairs_of, BLOCKS)

    def as_contexts(batches):
        for batch in batches:
            word, inverse = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield from _blocks(_bucket(word, buckets), TABLE, word, *_state(inverse, batch.column(2).flatten().to_numpy().reshape(-1, SAMPLES)))

    def as_words(batches):
        for batch in batches:
            word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield from _blocks(_bucket(word, buckets), TABLE, word, n, *batch.column(2).flatten().to_numpy().reshape(-1, SAMPLES).T)

    def with_context(batches):
        """Kind, word, context, document, number, and the context's customers and tables: none of one that wasn't learned."""
        for kind, table, rows in _beside_table(batches, {TABLE: 2 + SAMPLES, LEARNED: 4, OTHER: 4}):
            at, hit = _place(table[0], rows[1])
            yield kind, *rows, *(np.where(hit, v[at], 0) if len(v) else np.zeros(len(hit), np.int64) for v in table[1:])

    def ended(kind, w, c, doc, n, customers, tables, p):
        key, weights = pair_key(c, w), (STRENGTH[1] + DISCOUNT[1] * np.stack(tables, axis=1)) / (STRENGTH[1] + customers[:, None])
        yield from _blocks(_bucket(key, buckets), kind, key, doc, n, customers, (weights * p).mean(1))

    def to_words(batches):
        for kind, w, *others in with_context(batches):
            yield from _blocks(_bucket(w, buckets), kind, w, *others)

    def of_frequent(batches):
        words, predictions = shared.value[0], shared.value[3]
        for kind, w, c, doc, n, customers, *tables in with_context(batches):
            yield from ended(kind, w, c, doc, n, customers, tables, predictions[_place(words, w)[0]])

    def to_pairs(batches):
        for kind, table, rows in _beside_table(batches, {TABLE: 2 + SAMPLES, LEARNED: 5 + SAMPLES, OTHER: 5 + SAMPLES}):
            w, c, doc, n, customers, *tables = rows
            at, hit = _place(table[0], w)
            p, occurs = np.tile(unknown, (len(w), 1)), np.zeros(len(w), np.int64)
            p[hit] = np.stack([_real(v)[at[hit]] for v in table[2:]], axis=1)
            occurs[hit] = table[1][at[hit]]
            yield from ended(kind, w, c, doc, n, customers, tables, p)
            doc, known, base = _summed((doc,), (n * (occurs > 0), n * np.log10((occurs + 0.1) / floor)))
            zero = np.zeros(len(doc), np.int64)
            yield from _blocks(_bucket(doc, buckets), SUMS, doc, zero, zero, known, base, np.zeros(len(doc)))

    def of_cells(batches):
        words = shared.value[0]
        for batch in batches:
            c, w, r = (batch.column(k).to_numpy() for k in range(3))
            key = keys_of(words, c, w)
            yield from _blocks(_bucket(key, buckets), TABLE, key, r)

    def sums(batches):
        words, inverses, weights, predictions, *_ = shared.value
        once: list[np.ndarray] = []
        seen, listed_once = None, np.zeros(0, np.int64)
        widths = {TABLE: 2, PLAIN_LEARNED: 3, LEARNED: 5, PLAIN: 3, OTHER: 5, SUMS: 6}
        for kind, table, rows in _beside_table(batches, widths):
            if kind == SUMS:
                doc, *values = _summed((rows[0],), (*rows[1:4], *map(_real, rows[4:])))
            else:
                if table is not seen:
                    seen, once, listed_once = table, [], np.zeros(0, np.int64)
                key, doc, n = rows[:3]
                at, hit = _place(table[0], key)
                seated = np.where(hit, _real(table[1])[at], 0.0) if len(table[0]) else np.zeros(len(key))
                # A pair that isn't among the cells occurs once if a text to learn from has it, else never.
                if kind in (PLAIN_LEARNED, LEARNED):
                    once.append(key[~hit])
                    seated[~hit] = 1 - DISCOUNT[1]
                else:
                    if once:
                        listed_once, once = np.sort(np.concatenate([listed_once, *once])), []
                    seated[~hit & _place(listed_once, key)[1]] = 1 - DISCOUNT[1]
                if kind in (PLAIN_LEARNED, PLAIN):
                    by, at = key // max(1, len(words)), key % max(1, len(words))
                    p = seated * inverses[by] + (weights[by] * predictions[at]).mean(1)
                else:
                    p = seated / (STRENGTH[1] + rows[3]) + _real(rows[4])
                doc, score = _summed((doc,), (n * np.log10(p),))
                zero = np.zeros(len(doc), np.int64)
                values = [zero, zero, zero, np.zeros(len(doc)), score]
            yield _batch(**dict(zip(("_doc", "rows", "tokens", "known", "based", "scored"), (doc, *values))))

    of_context = model.words.select("word", "inverse", "weights").mapInArrow(as_contexts, BLOCKS)
    of_word = model.words.select("word", "n", "predictions").mapInArrow(as_words, BLOCKS)
    rare_words = _met(rare_pairs(True, True), of_context).mapInArrow(to_words, BLOCKS).unionAll(rare_pairs(False, True))
    rare = _met(rare_words, of_word).mapInArrow(to_pairs, BLOCKS).unionAll(_met(rare_pairs(True, False), of_context).mapInArrow(of_frequent, BLOCKS))
    cells = model.cells.select("context", "word", "r").mapInArrow(of_cells, BLOCKS)
    each = _met(texts.mapInArrow(common_pairs, BLOCKS).unionAll(rare), cells).mapInArrow(sums, "_doc long, rows long, tokens long, known long, based double, scored double")
    # Equal rows of the input add up; each is the sum divided by their number.
    summed = each.groupBy("_doc").agg(*(F.sum(c).alias(c) for c in ("rows", "tokens", "known", "based", "scored")))
    mean = lambda c: F.col(c) / F.col("rows")
    return summed.select("_doc", mean("tokens").cast("long").alias("n_tokens"), mean("known").cast("long").alias("n_known"), mean("based").alias("base_score"), mean("scored").alias("score"))


def scored(docs: DataFrame, learn, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learning from the rows for which
    the column `learn` is true. score is the model's base-10 logarithm of the probability of the text's words (A-Z in lower
    case) and its end, where any word that wasn't learned is the same unknown one; base_score is that of additively
    smoothed word frequencies.

    Null and empty texts are an end alone; with nothing to learn from, every token is the unknown word, of probability 1;
    rows of equal doc_id and text have equal scores; a null doc_id is kept; other columns are left out.
    """
    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.xxhash64("doc_id", text).alias("_doc"))
    model = fit(rows)
    found = score(rows, model, frequent)
    return rows.select("doc_id", "learn", "_doc").join(found, "_doc").select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) per token over the rows of scored()."""
    ppl = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(ppl("score").alias("perplexity"), ppl("base_score").alias("base_perplexity"))
