"""Near-duplicate vectors by spherical-cap filters of a structured random product code."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.93
#: Parts of the product code; a filter direction is one short code vector for each part.
PARTS = 4
#: Filters that two vectors of just COSINE share on average, and the least that a vector gets.
SHARED, LEAST = 48, 64
#: Least cap height in standard deviations of a random direction, and the random vectors a cap may hold: the height
#: and with it the code grow with the number of vectors.
HEIGHT, LOAD = 4.0, 16
#: Vectors of fewer dimensions are all compared: caps are of use in many dimensions only.
LEAST_DIMENSIONS = 16
#: Most members of a bucket that are compared in one step, and of one whose sketches are compared together with those of other buckets.
BLOCK, SMALL = 1024, 32


class Code:
    """Random unit directions (c1, ..., c4) / 2 after a random rotation; each part has `size` code vectors."""

    def __init__(self, dimensions: int, size: int, height: float):
        rng = np.random.default_rng(dimensions)
        wide = -(-dimensions // PARTS) * PARTS
        self.turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dimensions]
        c = rng.standard_normal((PARTS, size, wide // PARTS))
        self.codes = c / np.linalg.norm(c, axis=2, keepdims=True) / math.sqrt(PARTS)
        self.size, self.alpha = size, height / math.sqrt(wide)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters with a product of alpha or more; both halves of the code
        are cut to what can still reach alpha before they are combined. A vector of fewer than LEAST filters
        gets them at a lower alpha."""
        n = len(unit)
        parts = np.split(unit @ self.turn, PARTS, axis=1)
        score = [p @ c.T for p, c in zip(parts, self.codes)]
        left = (score[0][:, :, None] + score[1][:, None, :]).reshape(n, -1)
        right = (score[2][:, :, None] + score[3][:, None, :]).reshape(n, -1)
        top_left, top_right = left.max(1), right.max(1)
        out = []
        for a, b, x, y in zip(left, right, top_left, top_right):
            alpha = min(self.alpha, x + y)
            while True:
                i, j = np.flatnonzero(a >= alpha - y), np.flatnonzero(b >= alpha - x)
                p, q = np.nonzero(a[i][:, None] + b[j] >= alpha)
                if len(p) >= LEAST or alpha < 0:
                    break
                alpha -= 0.03 * self.alpha
            out.append(i[p] * self.size**2 + j[q])
        return out


@functools.cache
def code(dimensions: int, vectors: int) -> Code:
    """A code fit for `vectors` of one label: the cap's height leaves LOAD random vectors in a cap at most, and there are
    as many directions as two vectors of cosine COSINE need to share SHARED filters on average."""
    normal = NormalDist()
    height = max(HEIGHT, normal.inv_cdf(1 - LOAD / max(vectors, 2 * LOAD + 1)))
    beyond = normal.cdf(-height)
    x = height + 1 / height  # the mean of a product that exceeds the height
    both = normal.cdf((COSINE * x - height) / math.sqrt(1 - COSINE**2))
    return Code(dimensions, math.ceil((SHARED / both / beyond) ** (1 / PARTS)), height)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sketch(unit: np.ndarray) -> np.ndarray:
    """Each unit vector in eight bits a component, then the step between two of them and the norm of what rounding took, four bytes each."""
    step = np.abs(unit).max(1, keepdims=True) / 127
    near = np.rint(unit / step).astype(np.int8)
    lost = np.linalg.norm(unit - near * step, axis=1, keepdims=True)
    return np.hstack([near.view(np.uint8), np.hstack([step, lost]).astype("<f4").view(np.uint8)])


def filtered(classes: DataFrame, vectors: int) -> DataFrame:
    """classes (cid, rep, label, copies, embedding) with the filters and the sketch of each vector, those of one length in a batch."""
    schema = "cid long, rep long, label string, copies long, embedding array<double>, filters array<long>, sketch binary"

    def decode(batches):
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                same = batch.filter(pa.array(sizes == d))
                for k in range(0, same.num_rows, 256):
                    part = same.slice(k, 256)
                    unit = _unit(part.column(4))
                    found = code(d, vectors).decode(unit) if d >= LEAST_DIMENSIONS else [[-1]] * part.num_rows
                    added = [pa.array([np.sort(f) for f in found], pa.list_(pa.int64())), pa.array([r.tobytes() for r in _sketch(unit)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "filters", "sketch"])

    return classes.mapInArrow(decode, schema)


def _likely(batches, cosine: float):
    """The rows (cid, filter, i, j, chunk) of a partition sorted by (size, bucket) whose sketch leaves a cosine of `cosine` or more to
    another one of their bucket open: no row that has such a link goes. Small buckets are compared all at once, by places, others one by one."""
    names = ["cid", "filter", "i", "j", "chunk"]
    for batch, edges in common.whole_groups(batches, ("size", "bucket")):
        size = batch.column("size").to_numpy()
        ends, sizes = np.repeat(edges[1:], np.diff(edges)), np.repeat(np.diff(edges), np.diff(edges))
        hit = np.zeros(batch.num_rows, bool)
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)  # of a sorted partition, so without a gap
            a = int(rows[0])
            raw = np.frombuffer(b"".join(batch.column("sketch").slice(a, len(rows)).to_pylist()), np.uint8).reshape(len(rows), d + 8)
            told = np.ascontiguousarray(raw[:, d:]).view("<f4").astype(np.float64)
            x = raw[:, :d].view(np.int8) * told[:, :1].astype(np.float32)
            lost, end, small = told[:, 1], ends[rows] - a, sizes[rows] <= SMALL
            # x.y is at most the product of the sketches, |e| for what x lost, and (1 + |e|) times what y lost; and some rounding
            least = cosine - lost - 1e-4
            for k in range(1, SMALL):
                p = np.flatnonzero(small & (np.arange(len(rows)) + k < end))
                if not len(p):
                    break
                q = p + k
                near = np.einsum("ij,ij->i", x[p], x[q]) + (1 + lost[p]) * lost[q] >= least[p]
                hit[a + p[near]] = hit[a + q[near]] = True
            for u, v in zip(edges[:-1], edges[1:]):
                if v - u > SMALL and a <= u < a + len(rows):
                    y, e = x[u - a : v - a], lost[u - a : v - a]
                    near = y @ y.T + (1 + e)[:, None] * e >= least[u - a : v - a, None]
                    np.fill_diagonal(near, False)
                    hit[u:v] = near.any(0) | near.any(1)
        if hit.any():
            yield batch.select(names).filter(pa.array(hit))


def _blocks(batches):
    """Whole groups of the rows of a partition that is sorted by (bucket, i, j), as tables."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if held and _key(held[-1], -1) != _key(t, 0):
            yield from _split(pa.concat_tables(held))
            held = []
        held.append(t)
        if _key(t, 0) != _key(t, -1):
            *done, last = _split(pa.concat_tables(held))
            yield from done
            held = [last]
    if held:
        yield from _split(pa.concat_tables(held))


def _key(t: pa.Table, at: int):
    at %= t.num_rows
    return tuple(t.column(c)[at].as_py() for c in ("label", "size", "filter", "i", "j"))


def _split(t: pa.Table):
    change = np.zeros(t.num_rows, bool)
    for c in ("label", "size", "filter", "i", "j"):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    edges = [0, *np.flatnonzero(change).tolist(), t.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield t.slice(a, b - a)


def _links(batches, cosine: float):
    """(cid, links, rep, component) for the members of each block that have a link in it. A pair counts in the
    smallest filter that its vectors share; the component is the smallest rep reachable within the block."""
    out: list[tuple] = []
    for t in _blocks(batches):
        if t.num_rows < 2:
            continue
        own = t.column("filter")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x = _unit(t.column("embedding").combine_chunks())
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:  # pairs within a chunk are those of another block
            chunk = t.column("chunk").to_numpy()
            near &= chunk[:, None] != chunk[None, :]
        some = np.flatnonzero(near.any(1))
        if not len(some):
            continue
        t, near = t.take(pa.array(some)), near[np.ix_(some, some)]
        filters = t.column("filters").to_pylist()
        lower = {f: k for k, f in enumerate(sorted({f for fs in filters for f in fs if f < own}))}
        has = np.zeros((len(some), len(lower) + 1), np.float32)
        for k, fs in enumerate(filters):
            has[k, [lower[f] for f in fs if f < own]] = 1
        counted = near & (has @ has.T == 0)
        links = counted.astype(np.float64) @ t.column("copies").to_numpy().astype(np.float64)
        rep = t.column("rep").to_numpy()
        least = rep.copy()
        while True:
            new = np.minimum(least, np.where(near, least[None, :], np.iinfo(np.int64).max).min(1))
            if (new == least).all():
                break
            least = new
        out += zip(t.column("cid").to_pylist(), links.astype(np.int64).tolist(), rep.tolist(), least.tolist())
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 4)], names=["cid", "links", "rep", "component"])


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label): vectors of equal label are linked
    at a cosine of `cosine` or more, in double precision.

    Equal vectors of a label are one class that counts as often as it has rows. Each class goes to the buckets of
    its filters, first with a sketch alone, which leaves out what can't have a link in its bucket; a bucket is compared in blocks of BLOCK members at most (two chunks at a time), in
    which only counts and local components leave the block, never its pairs. Null labels and vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; a null vec_id links with nothing,
    has a null component_id and is kept; vectors of different length never link. Other columns are left out.
    """
    embedding = F.col("embedding").cast("array<double>")
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate(embedding, F.lit(0.0), lambda a, v: a + v * v)
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~bad & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = common.written(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(fit, F.col("label").cast("string")).alias("label"),
            F.when(fit, F.xxhash64("label", embedding)).alias("cid"),
            F.when(fit, embedding).alias("embedding"),
        ),
        "vectors",
    )
    classes = common.written(rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    known = common.written(filtered(classes.select("cid", "rep", "label", "copies", "embedding").repartition(F.col("cid")), 2 ** max(most, 1).bit_length()), "filters")
    # The table of classes joins the buckets by their hash and by a sketch; embeddings and filters go to those rows alone that are likely to have a link.
    thin = known.select("cid", F.size("embedding").alias("size"), "label", F.explode("filters").alias("filter")).withColumn("bucket", F.xxhash64("label", "size", "filter")).drop("label")
    full = thin.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    dealt = (
        thin.join(full, "bucket")
        .withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cid", F.col("size").cast("long").alias("size"), "bucket", "filter", "chunk", F.least("chunk", "_x").alias("i"), F.greatest("chunk", "_x").alias("j"))
        .withColumn("bucket", F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("bucket")).otherwise(F.xxhash64("bucket", "i", "j")))
    )
    met = dealt.join(known.select("cid", "sketch"), "cid").repartition("size", "bucket").sortWithinPartitions("size", "bucket")
    likely = met.mapInArrow(lambda b: _likely(b, cosine), "cid long, filter long, i int, j int, chunk int")
    key = ["label", "size", "filter"]
    members = likely.join(known.drop("sketch"), "cid").withColumn("size", F.size("embedding")).select(*key, "i", "j", "chunk", "cid", "rep", "copies", "embedding", "filters")
    sorted_ = members.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    links = common.written(sorted_.mapInArrow(lambda b: _links(b, cosine), "cid long, links long, rep long, component long"), "links")
    components = common.connected_components(links.where("rep <> component"), "rep", "component")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    named = (
        classes.select("cid", "rep", "copies")
        .join(counts, "cid", "left")
        .join(components, F.col("rep") == F.col("id"), "left")
        .select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
