"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components  # noqa: F401
from ..session import written  # noqa: F401

#: Rows that one bucket of a distributed ranking should hold, and the most buckets a key is dealt to.
RANK_BUCKET_ROWS, RANK_BUCKETS = 512, 4096


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def whole_groups(batches, keys: tuple[str, ...], rows: int = 20_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of a partition that is sorted by some columns of longs, with the edges of the groups in each.
    A batch has some `rows` rows, or one group if that has more."""

    def edges_of(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for c in keys:
            v = t.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        edges = edges_of(t)
        if len(edges) > 2:
            yield t.slice(0, edges[-2]).combine_chunks().to_batches()[0], edges[:-1]
            t = t.slice(edges[-2])
        held, size = t.to_batches(), 0
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield t.to_batches()[0], edges_of(t)


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, out: str = "rank") -> DataFrame:
    """Adds a number from 0, gapless within each key, without one task per key.

    Rows of a key are dealt to buckets by a hash of `order`, numbered within their bucket, and moved up by
    the sizes of the key's earlier buckets. Keys must not be null.
    """
    rows = df.count() if rows is None else rows
    buckets = max(1, min(RANK_BUCKETS, -(-rows // RANK_BUCKET_ROWS)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        dealt.withColumn("_place", place)
        .join(bases, [*keys, "_bucket"])
        .withColumn(out, (F.col("_base") + F.col("_place")).cast("long"))
        .drop("_bucket", "_base", "_place")
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
