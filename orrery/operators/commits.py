"""Versioned state on shared storage: tables, raw facts and runs, with a manifest for each version that only one writer can commit."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALIAS_KEYS, CANDIDATE, CI, EDGE, MERGE, SOURCE_KEYS, UNMERGE

EMPTY = {"cis": CI, "edges": EDGE, "source_keys": SOURCE_KEYS, "alias_keys": ALIAS_KEYS, "candidates": CANDIDATE, "merges": MERGE, "unmerges": UNMERGE}
FACTS = "tenant_id string, source string, observed_at timestamp, event_id string, payload string, batch_id bigint"
RUN = "run_id string, tenant_id string, source string, status string, started_at timestamp, finished_at timestamp, batch_id bigint, counts string"


class Conflict(Exception):
    """Another writer has committed since the state was read."""


class Store:
    """A state under root: manifests/n.json names the folder of each table of version n, and the last batch of each source in it.

    A reader sees one version whole. A writer commits against the version that it read, as a conditional update does: the manifest is renamed into
    place without overwriting, so of two writers one gets the version and the other a Conflict. (That rename is atomic on HDFS; a store without one needs its
    own conditional put.)"""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def version(self) -> int:
        """The last version; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> tuple[dict, dict[str, DataFrame]]:
        """The manifest and the tables of a version, by default the last; tables that it hasn't are empty."""
        m = self.manifest(version)
        tables = {n: self.spark.createDataFrame([], s) for n, s in EMPTY.items()}
        for name, at in m["tables"].items():
            tables[name] = self.spark.read.schema(self.spark.createDataFrame([], at["schema"]).schema).parquet(at["path"])
        return m, tables

    def commit(self, base: dict, tables: dict[str, DataFrame], batches: dict[str, int] | None = None) -> dict:
        """Writes tables and makes them the version after base, a manifest from read(); other tables stay as they are in base. Conflict if
        that version exists by then; what was written for it is deleted."""
        number = base["version"] + 1
        held = dict(base["tables"])
        made = []
        for name, df in tables.items():
            path = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            made.append(path)
            held[name] = {"path": path, "schema": df.schema.simpleString().removeprefix("struct<").removesuffix(">")}
        m = {"version": number, "tables": held, "batches": {**base["batches"], **(batches or {})}}
        part = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(m).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(part, self._path(f"{self.root}/manifests/{number}.json"), options)
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self._fs.delete(part, False)
            for path in made:
                self._fs.delete(self._path(path), True)
            raise Conflict(f"version {number} of {self.root} has been committed by another writer") from None
        return m

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last versions, with tables that none of the others names."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {t["path"].rpartition("/")[2] for m in kept for t in m["tables"].values()}
        folder = self._path(f"{self.root}/tables")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)

    def facts(self) -> DataFrame:
        """Raw facts: what came in, as it came."""
        path = f"{self.root}/facts"
        return self.spark.read.schema(FACTS).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], FACTS)

    def append_facts(self, facts: DataFrame, batch_id: int, source: str) -> int:
        """Appends the raw facts (tenant_id, source, observed_at, event_id, payload) of a batch of a source and returns how many there are. A batch that comes again
        takes its own place, so nothing is added twice; an empty one adds nothing and is 0. Earlier facts are never changed."""
        path = f"{self.root}/facts"
        folder = self._path(f"{path}/source={source}/batch_id={batch_id}")
        self._fs.delete(folder, True)
        facts.drop("source").write.parquet(folder.toString())
        return self.spark.read.parquet(folder.toString()).count()

    def runs(self) -> DataFrame:
        """One row for each batch: who ran when, how it ended, and what it counted."""
        path = f"{self.root}/runs"
        return self.spark.read.schema(RUN).option("recursiveFileLookup", True).json(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], RUN)

    def record_run(self, tenant_id: str, source: str, batch_id: int, status: str, started_at, counts: dict) -> None:
        """Writes the run of a batch in its own folder: `partial` at its start, `ok` at its end in place of that."""
        row = self.spark.range(1).select(
            F.lit(f"{source}-{batch_id}").alias("run_id"), F.lit(tenant_id).alias("tenant_id"), F.lit(source).alias("source"), F.lit(status).alias("status"), F.lit(started_at).cast("timestamp").alias("started_at"),
            (F.current_timestamp() if status == "ok" else F.lit(None).cast("timestamp")).alias("finished_at"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(json.dumps(counts)).alias("counts"),
        )
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/runs/{source}-{batch_id}")
