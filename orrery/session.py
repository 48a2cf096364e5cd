"""Tables of one tenant, and tables that cut a lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class TenantSession:
    """The only way to a table: every read is filtered to the tenant, and without a tenant nothing is seen.

    Tables lie as Parquet in `root`, partitioned by tenant_id where they are large, so the filter prunes files."""

    def __init__(self, spark: SparkSession, tenant_id: str | None, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tenant_id, self.root, self.tables = spark, tenant_id, root, tables or {}

    def table(self, name: str) -> DataFrame:
        df = self.tables[name] if name in self.tables else self.spark.read.parquet(f"{self.root}/{name}")
        return df.where(F.col("tenant_id") == self.tenant_id) if self.tenant_id is not None else df.where(F.lit(False))

    def open(self, name: str) -> DataFrame:
        return self.table(name).where("valid_to is null")


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="orrery-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in local mode, if unset, an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """Partitions of a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(), and the number of its rows, counted on the way."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def bucketed(df: DataFrame, name: str, by: str, buckets: int, partition: str | None = None, dealt: bool = False) -> str:
    """The name of a table with the rows of df, in the shared folder, bucketed and sorted by a column: joins and groups on it need no
    shuffle. With partition, a column of that name holds the bucket, so that single buckets can be overwritten. `dealt` says that
    the rows come from a repartition by that column to as many parts, so they aren't dealt out again."""
    table = f"{name}_{uuid.uuid4().hex}"
    # Rows are dealt out by the hash that numbers the buckets, so each has one file.
    rows = df if dealt else df.repartition(buckets, by)
    writer = (rows.withColumn(partition, F.pmod(F.hash(by), F.lit(buckets))) if partition else rows).write
    if partition:
        writer = writer.partitionBy(partition)
    writer.bucketBy(buckets, by).sortBy(by).option("path", f"{shared_folder(df.sparkSession)}/{table}").saveAsTable(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
