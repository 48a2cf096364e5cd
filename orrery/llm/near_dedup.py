"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted
from . import common
from .linking import joined, linked_components, sized, with_component
from .words import NOT_SPACE, Words, encoded, mix, slices, window_hashes

#: Bands of rows: a pair of similarity 0.8 shares no band once in ten million times.
BANDS, ROWS = 40, 5
#: Low bits kept of each minimum. Signatures whose corrected estimate is below the threshold by more than SLACK
#: (over five standard deviations of it) are not compared in full.
BITS, SLACK = 2, 0.19
#: Members of a bucket that are compared in one block, and so the sets that a task holds at once.
BLOCK = 1024
#: Most ids that are broadcast to pick out their texts; of more, all texts are shuffled once.
BROADCAST_IDS = 1 << 20

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_XOR = (_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
LONGS = -(-BANDS * ROWS // 64)

SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature array<long>"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; fewer words than `width` are one shingle."""
    out = []
    for a, b in slices(texts):
        w = Words(texts[a:b], NOT_SPACE)
        whole = window_hashes(w.hash, width)
        for i in range(b - a):
            first, last = int(w.first[i]), int(w.first[i + 1])
            if last - first >= width:
                out.append(np.unique(whole[first : last - width + 1]))
            else:
                out.append(window_hashes(w.hash[first:last], last - first) if last > first else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed signatures of non-empty sets, as signed longs."""
    n = len(sets)
    minima = np.empty((BANDS * ROWS, n), np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for k in range(BANDS * ROWS):
        minima[k] = np.minimum.reduceat((values ^ _XOR[k]) * _TIMES[k], starts)
    wide = mix(minima.T.astype(np.uint64) + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)))
    bands = wide.reshape(n, BANDS, ROWS)
    keys = bands[:, :, 0].copy()
    for r in range(1, ROWS):
        keys = mix(keys * np.uint64(3) + bands[:, :, r])
    bits = np.zeros((n, BITS, LONGS * 64), np.uint8)
    for k in range(BITS):
        bits[:, k, : BANDS * ROWS] = wide >> np.uint64(k) & np.uint64(1)
    return keys.view(np.int64), np.packbits(bits.reshape(n, -1), axis=1).view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """SKETCH rows: set_key is a digest of the whole set, null (as bands and signature) for one that is empty."""

    def sketch(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, signatures = sketches([sets[i] for i in full]) if full else (np.zeros((0, BANDS), np.int64),) * 2
                at = dict(zip(full, range(len(full))))
                pick = lambda of: pa.array([of[at[i]] if i in at else None for i in range(b - a)], pa.list_(pa.int64()))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()), pick(bands), pick(signatures)],
                    names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(sketch, SKETCH)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many minima packed signatures differ, as far as BITS bits show."""
    x = (a ^ b).view(np.uint64)  # the bits of a negative number would be those of its amount
    apart = x[..., :LONGS]
    for k in range(1, BITS):
        apart = apart | x[..., k * LONGS : (k + 1) * LONGS]
    return np.bitwise_count(apart).sum(-1, dtype=np.int64)


def estimate(differ: np.ndarray) -> np.ndarray:
    """Similarity from differing minima: the share of equal ones, corrected for low bits that are equal by chance."""
    chance = 1 / 2**BITS
    return ((1 - differ / (BANDS * ROWS)) - chance) / (1 - chance)


def likely(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return estimate(differing(a, b)) >= percent / 100 - SLACK


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("signature").flatten().to_numpy().reshape(batch.num_rows, -1)


def forest(signatures: np.ndarray, component: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows: a spanning forest of the graph of likely pairs, along the greatest estimates (Prim), whose rows of one
    component are joined already."""
    n = len(signatures)
    far = np.iinfo(np.int64).max
    best, parent, rest, out = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        near = np.where(rest, best, far)
        i = int(near.argmin())
        if near[i] == far or estimate(near[i]) < percent / 100 - SLACK:
            i = int(rest.argmax())
        elif component[i] != component[parent[i]]:
            out.append((parent[i], i))
        rest[i] = False
        now = np.where(component == component[i], -1, differing(signatures, signatures[i]))
        closer = now < best
        best[closer], parent[closer] = now[closer], i
    return np.array(out, np.int64).reshape(-1, 2)


def _blocks_of(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("key", "block", *columns).repartition("key", "block").sortWithinPartitions("key", "block")


def _mixed(component: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which groups of rows hold several components."""
    return np.minimum.reduceat(component, edges[:-1]) != np.maximum.reduceat(component, edges[:-1])


def likely_forest(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the likely pairs of each block of (key, block, id, component, signature), but for the pairs of
    one component."""

    def compare(batches):
        for batch, edges in common.whole_groups(batches, ("key", "block")):
            ids, component, sig = batch.column("id").to_numpy(), batch.column("component").to_numpy(), _signatures(batch)
            mixed, sizes = _mixed(component, edges), np.diff(edges)
            two = edges[:-1][mixed & (sizes == 2)]
            two = two[likely(sig[two], sig[two + 1], percent)]
            found = [np.stack([two, two + 1], 1)]
            for k in np.flatnonzero(mixed & (sizes > 2)):
                a, b = edges[k], edges[k + 1]
                found.append(forest(sig[a:b], component[a:b], percent) + a)
            pairs = ids[np.concatenate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], names=["a", "b"])

    return _blocks_of(blocks, "id", "component", "signature").mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def undecided(blocks: DataFrame, percent: int) -> DataFrame:
    """(key, block, id, component) of the members of blocks (and signature) that are likely to be like one of another component."""

    def pick(batches):
        for batch, edges in common.whole_groups(batches, ("key", "block")):
            sig, component = _signatures(batch), batch.column("component").to_numpy()
            hit = np.zeros(batch.num_rows, bool)
            for k in np.flatnonzero(_mixed(component, edges)):
                a, b = edges[k], edges[k + 1]
                for i in range(a, b):
                    other = np.flatnonzero(component[a:b] != component[i])
                    hit[i] = likely(sig[a:b][other], sig[i], percent).any()
            yield batch.filter(pa.array(hit)).select(["key", "block", "id", "component"])

    return _blocks_of(blocks, "id", "component", "signature").mapInArrow(pick, "key long, block long, id long, component long")


def exact_links(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links by full shingle sets between the components of each block of (key, block, id, component, text)."""

    def compare(batches):
        for batch, edges in common.whole_groups(batches, ("key", "block"), BLOCK):
            ids, component = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            texts = encoded(batch.column("text"))
            known = dict.fromkeys(texts)
            known = dict(zip(known, shingle_sets(list(known), width)))
            out = [np.zeros((0, 2), np.int64)]
            for a, b in zip(edges, edges[1:]):
                out.append(ids[a:b][links_between([known[x] for x in texts[a:b]], component[a:b], percent)])
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], names=["a", "b"])

    return _blocks_of(blocks, "id", "component", "text").mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def links_between(sets: list[np.ndarray], component: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows that are linked, one for each two components that a row joins; rows of a common component are one already.
    Shared shingles are counted through an index of all sets, row by row, but for those of the largest component."""
    sizes, component = np.array(list(map(len, sets))), component.copy()
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    names, n = np.unique(component, return_counts=True)
    out = []
    for i in np.flatnonzero(component != names[n.argmax()]).tolist():
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        shared = np.bincount(of[at], minlength=len(sets))
        linked = np.flatnonzero((100 * shared >= percent * (sizes + sizes[i] - shared)) & (component != component[i]))
        for c, k in zip(*np.unique(component[linked], return_index=True)):
            out.append((i, linked[k]))
            component[component == c] = component[i]
    return np.array(out, np.int64).reshape(-1, 2)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: (id, text)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def confirm(batches):
        for batch in batches:
            x, y = encoded(batch.column(2)), encoded(batch.column(3))
            known = dict.fromkeys([*x, *y])
            known = dict(zip(known, shingle_sets(list(known), width)))
            keep = []
            for p, q in zip(x, y):
                s, t = known[p], known[q]
                common_ = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(common_ > 0 and 100 * common_ >= percent * (len(s) + len(t) - common_))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct()


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The different (id, text) of these ids, as a written table: texts of other ids are read and not shuffled."""
    wanted, n = counted(ids.distinct(), "wanted")
    some = texts.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "id", "left_semi")
    out = common.written(some.distinct(), "texts")
    common.discard(wanted)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents whose sets of `width`-word shingles have a similarity of
    percent / 100 or more are linked; component_id is the smallest doc_id reachable, kept where it is its own.

    Equal sets are one class, and only its smallest doc_id goes into band buckets, whose members are compared in blocks
    (see linked_components): packed b-bit signatures give a forest of likely pairs, which full sets confirm; what is
    likely and still apart after that is decided by the full sets inside the block. Buckets of many times BLOCK that hold several
    groups are first dealt to pairs of bands, and what is then still mixed is compared part by part. Null, empty and wordless
    texts, and rows with a null doc_id, link with nothing; a null doc_id has a null component_id and is kept. Rows of
    one doc_id are one document that has the links of all its texts. Other columns are left out; no rows give none.
    The result is a written table; the tables on the way to it, texts among them, are deleted as soon as nothing reads them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    sketch = common.written(sketched(docs, width), "sketch")
    classes = common.written(sketch.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    first = common.written(sketch.join(classes, "set_key").where("doc_id = rep").select(F.col("doc_id").alias("id"), "bands", "signature"), "first")
    members = common.written(sized(first.select(F.explode("bands").alias("key"), "id")), "members")

    def compare(blocks: DataFrame, components: DataFrame | None) -> DataFrame:
        rows = blocks.select("key", "block", "id").join(first.select("id", "signature"), "id")
        rows = rows.withColumn("component", F.col("id")) if components is None else with_component(rows, components)
        signed = common.written(rows, "signed")
        pairs = common.written(likely_forest(signed, percent), "likely")
        paired = texts_of(texts, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")))
        links = common.written(confirmed(pairs, paired, width, percent), "links")
        known = common.written(common.connected_components(links, "a", "b"), "known") if components is None else joined(components, links)
        left = common.written(undecided(with_component(signed.drop("component"), known), percent), "undecided")
        apart = texts_of(texts, left.select("id"))
        more = common.written(exact_links(left.join(apart, "id"), width, percent), "more")
        out = common.written(links.unionByName(more), "links")
        common.discard(signed, pairs, paired, links, left, apart, more, *([known] if known is not components else []))
        return out

    def split(large: DataFrame) -> DataFrame:
        # Similar sets that share a band nearly always share a second one; those that don't meet when the bucket is compared part by part.
        pairs = large.select("key", "id").join(first.select("id", F.explode("bands").alias("other")), "id").where("key <> other")
        return pairs.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "id").distinct()

    components = linked_components(members, compare, BLOCK, split)
    common.discard(members, first)
    # Rows of one doc_id with several texts tie the classes of these together.
    ties = sketch.where("set_key is not null").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    named = classes.join(components, classes.rep == components.id, "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    repeated = ties.groupBy("a").agg(F.countDistinct("b").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        more = ties.join(repeated, "a", "left_semi").unionByName(components.select(F.col("id").alias("a"), F.col("component").alias("b")))
        components, before = common.written(common.connected_components(more, "a", "b"), "components"), components
        common.discard(before)
        named = classes.join(components, classes.rep == components.id, "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    result = common.written(result, "near-duplicates")
    common.discard(sketch, classes, components)
    return result


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group of near-duplicates.

    All columns stay. Rows that repeat the kept doc_id all stay, as do those of a null doc_id and those of null, empty and
    wordless texts; no rows give none."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
