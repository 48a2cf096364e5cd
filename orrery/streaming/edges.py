"""Edges inferred from a stream of flow records: one state transition for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import versions
from ..schema import EDGE


def accumulate_batch(state: DataFrame, batch: DataFrame, tenant_id: str) -> DataFrame:
    """The table of edges after one micro-batch of inferred edges (versions.EDGE_KEY, source, confidence, evidence): a pair
    counts once a batch, however many records it has, at the time of the batch's last evidence."""
    one = versions.deduplicated(batch.withColumn("_at", F.element_at("evidence", 1)["observed_at"]), versions.EDGE_KEY, "_at").drop("_at")
    now = batch.agg(F.max(F.element_at("evidence", -1)["observed_at"])).first()[0]
    return versions.upsert_edges(state, one, tenant_id, F.lit(now))


def run(flow_edges: DataFrame, root: str, tenant_id: str, checkpoint: str) -> StreamingQuery:
    """Runs a streaming frame of inferred edges into versioned tables root/0, root/1, ...: batch n reads what batch n - 1
    wrote and overwrites its own folder, so a batch that is run again after a failure counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            current(spark, root, batch_id).write.mode("overwrite").parquet(f"{root}/{batch_id}")
            return
        accumulate_batch(current(spark, root, batch_id), batch, tenant_id).write.mode("overwrite").parquet(f"{root}/{batch_id}")

    return flow_edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The table before a batch."""
    return spark.read.schema(EDGE).parquet(f"{root}/{batch_id - 1}") if batch_id > 0 else spark.createDataFrame([], EDGE)


def deltas(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON records, one text line each in `value`, for the event sources."""
    return spark.readStream.text(folder)
