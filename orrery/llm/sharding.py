"""Sharding of documents: indivisible groups of equal texts into shards of near equal bytes."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Sizes keep this many leading bits (exact below 2**BITS bytes), rounded up: shards differ by 2**-BITS at most
#: from what the plan says, and there are a few thousand size classes whatever the corpus.
BITS = 10


def size_class(size: int) -> int:
    """size rounded up to BITS leading bits."""
    low = max(0, size.bit_length() - BITS)
    return (size + (1 << low) - 1) >> low << low


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, shards: int | None = None):
    """Places groups, given as (size, count) with sizes falling, into bins of `capacity`: each into the open bin
    with the least room that holds it, found in a sorted (balanced) list of rooms; a new bin opens where none does.

    Equal sizes go in at once: the tightest bin stays the tightest until it can't hold another. Rows (size,
    from rank, to rank, bin), and the number of bins; None in place of the rows once more than `shards` are needed.
    """
    rooms: list[tuple[int, int]] = []
    rows, bins = [], 0
    for size, count in classes:
        done = 0
        while done < count:
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                room, b = max(capacity, size), bins
                bins += 1
                if shards is not None and bins > shards:
                    return None, bins
            k = min(count - done, room // size)
            rows.append((size, done, done + k, b))
            done += k
            insort(rooms, (room - k * size, b))
    return rows, bins


def balanced(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing with the least capacity for which it needs `shards` bins at most. Groups that alone
    are more than an equal part get a bin each first, so that the others still fill theirs evenly."""
    rows, used, ranks = [], 0, {}
    rest = sorted(((s, n) for s, n in classes if n), reverse=True)
    total = sum(s * n for s, n in rest)
    while rest and shards - used > 1 and rest[0][0] * (shards - used) >= total:
        size, n = rest[0]
        at = ranks.get(size, 0)
        rows.append((size, at, at + 1, used))
        ranks[size], used, total = at + 1, used + 1, total - size
        rest = ([(size, n - 1)] if n > 1 else []) + rest[1:]
    low, high, best = -(-total // max(1, shards - used)), max(1, total), None
    while rest and low <= high:
        middle = (low + high) // 2 if best else min(high, low + low // 1000)
        found, _ = best_fit_decreasing(rest, middle, shards - used)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle - 1
    for size, a, b, k in best or ():
        base = ranks.get(size, 0)
        rows.append((size, a + base, b + base, k + used))
    return rows


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of `shards` shards. Law `bytes`: rows of equal
    texts stay together, and otherwise the shards' sizes are as near to equal as best-fit-decreasing gets.

    size is the text's UTF-8 bytes (null: none, and equal to empty) plus 16; slot numbers the rows of a shard
    from 0. Only counts by size class reach the driver. Groups are ranked within their class and rows within
    their shard over all executors, so neither a class, a group nor a shard has to fit one task. Repeated rows
    are rows of the same group; a null doc_id is kept; other columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    rows = common.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(common.text_or_empty()) + 16).cast("long").alias("size"),
            F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(common.text_or_empty().cast("binary"))).alias("_text"),
        ),
        "sizes",
    )
    low = F.greatest(F.lit(0), F.length(F.bin("total")) - BITS).cast("int")
    groups = (
        rows.groupBy("_text").agg(F.sum("size").cast("long").alias("total"))
        .withColumn("_low", low)
        .select("_text", F.expr("shiftleft(shiftright(total + shiftleft(1L, _low) - 1, _low), _low)").alias("_class"))
    )
    groups = common.written(groups, "groups")
    counts = [(r[0], r[1]) for r in groups.groupBy("_class").agg(F.count(F.lit(1))).collect()]  # a few thousand classes
    table = np.array(sorted(balanced(counts, shards)), np.int64).reshape(-1, 4)
    where = spark.createDataFrame([tuple(map(int, r)) for r in table], "_class long, _from long, _to long, shard int")
    ranks = common.ranked(groups, ["_class"], ["_text"], sum(n for _, n in counts), "_rank")
    # At most shards rows of the plan for each class (a few thousand classes), whatever the corpus.
    placed = ranks.join(F.broadcast(where), (ranks._class == where._class) & (ranks._rank >= where._from) & (ranks._rank < where._to)).select("_text", "shard")
    n = rows.count()
    return common.ranked(rows.join(placed, "_text").drop("_text"), ["shard"], ["doc_id", "size", "text_crc32"], n, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
