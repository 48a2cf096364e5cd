"""Inferred edges as keyed state of a stream: observations add to an edge's state, timers of event time let it decay and close.

State is kept by (tenant_id, type, from_id, to_id, edge_key), so a micro-batch works on the keys that it hits, and on those whose timers
are due, alone. What comes out is a log of changes, from which versions_of() makes the table of edges.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.confidence import canonical_id
from ..operators.versions import EDGE_KEY
from ..schema import BASELINE_CONFIDENCE, CONFIDENCE_CEILING, CONFIDENCE_FLOOR, CONFIDENCE_RATIO, DECAY_PER_DAY, EVIDENCE, EVIDENCE_KEPT, FRESH_DAYS, INFERRED, TTL_DAYS

KEY = ["tenant_id", *EDGE_KEY]
ENTRY = "source string, observed_at timestamp, detail string"
OBSERVATION = f"tenant_id string, type string, from_id string, to_id string, edge_key string, {ENTRY}"
CHANGE = f"tenant_id string, type string, from_id string, to_id string, edge_key string, seq bigint, action string, at timestamp, observations int, confidence double, evidence {EVIDENCE}"
DAY = dt.timedelta(days=1)


def observed_confidence(n: int) -> float:
    return min(1.0 - (1.0 - BASELINE_CONFIDENCE) * CONFIDENCE_RATIO ** (n - 1), CONFIDENCE_CEILING)


def decayed_confidence(confidence: float, days: int) -> float:
    return max(CONFIDENCE_FLOOR, min(confidence, confidence - DECAY_PER_DAY * (days - FRESH_DAYS)))


def _millis(time: dt.datetime) -> int:
    return int(time.timestamp() * 1000)


class EdgeProcessor(StatefulProcessor):
    """One edge: seq numbers its changes, base is its confidence when it was last observed, days its age up to which it has decayed.

    An edge ages by the time of its observations, and of the watermark where none comes, so what comes out doesn't depend on the batches."""

    def init(self, handle) -> None:
        self.handle = handle
        self.edge = handle.getValueState("edge", "seq bigint, observations int, base double, observed_at timestamp, days int")
        self.evidence = handle.getListState("evidence", ENTRY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.edge.get()) if self.edge.exists() else None
        kept = [tuple(e) for e in self.evidence.get()] if state else []
        out = []
        for r in sorted(rows, key=lambda r: (r.observed_at, r.source, r.detail or "")):
            state, kept = self._aged(key, state, kept, _millis(r.observed_at), out)
            seq, n = (state[0] + 1, state[1] + 1) if state else (0, 1)
            kept = [*kept, (r.source, r.observed_at, r.detail)][-EVIDENCE_KEPT:]
            state = (seq, n, observed_confidence(n), r.observed_at, FRESH_DAYS)
            out.append(self._change(key, seq, "accumulate" if n > 1 else "create", r.observed_at, n, state[2], kept))
        self._keep(state, kept)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.edge.exists():
            out = []
            self._keep(*self._aged(key, tuple(self.edge.get()), [tuple(e) for e in self.evidence.get()], timerValues.getCurrentWatermarkInMs(), out))
            yield from out

    def _aged(self, key, state, kept, until: int, out: list[Row]):
        """State and evidence at a time: a decay for each whole day over the fresh window, and the close when the time to live is over."""
        while state:
            seq, n, base, observed, days = state
            if days == TTL_DAYS:
                if _millis(observed + TTL_DAYS * DAY) >= until:
                    break
                out.append(self._change(key, seq + 1, "close", observed + TTL_DAYS * DAY, n, decayed_confidence(base, days), kept))
                return None, []
            if _millis(observed + (days + 1) * DAY) > until:
                break
            days += 1
            confidence = decayed_confidence(base, days)
            if confidence < decayed_confidence(base, days - 1):
                seq += 1
                out.append(self._change(key, seq, "decay", observed + days * DAY, n, confidence, kept))
            state = (seq, n, base, observed, days)
        return state, kept

    def _keep(self, state, kept) -> None:
        """Stores the state, with the one timer at which it changes next if nothing is observed."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.edge.clear()
            self.evidence.clear()
            return
        self.edge.update(state)
        self.evidence.put(kept)
        _, _, _, observed, days = state
        self.handle.registerTimer(_millis(observed + (days + 1) * DAY) if days < TTL_DAYS else _millis(observed + TTL_DAYS * DAY) + 1)

    def _change(self, key, seq, action, at, n, confidence, kept) -> Row:
        told = [Row(source=s, observed_at=t, detail=d) for s, t, d in kept]
        return Row(**dict(zip(KEY, key)), seq=seq, action=action, at=at, observations=n, confidence=confidence, evidence=told)


def changes(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of changes (CHANGE) of a stream of observations (OBSERVATION) of inferred edges.

    An observation counts one; its confidence follows from the count, and 20 entries of evidence stay. An edge decays each day from the eighth
    after its last observation on and closes after thirty, in event time: the watermark stays `late` behind the latest observation of any edge,
    and observations from before it are left out. An edge that is observed after it closed is a new one."""
    timed = observations.withColumn("edge_key", F.coalesce("edge_key", F.lit(""))).withWatermark("observed_at", late)
    return timed.groupBy(*KEY).transformWithState(EdgeProcessor(), CHANGE, "Append", "EventTime")


def versions_of(log: DataFrame) -> DataFrame:
    """The table of edges (schema.EDGE) of a log of changes: each change but a close is a version, until the next change of its edge."""
    by_key = Window.partitionBy(*KEY).orderBy("at", "seq")
    life = F.sum(F.when(F.col("action") == "create", 1).otherwise(0)).over(by_key)
    born = F.first("at").over(Window.partitionBy(*KEY, "_life").orderBy("at", "seq"))
    out = log.withColumn("_life", life).withColumn("valid_to", F.lead("at").over(by_key)).withColumn("_born", born).where("action <> 'close'")
    return out.select(canonical_id(*KEY, F.col("_born").cast("string")).alias("id"), *KEY, F.lit(INFERRED).alias("source"), "confidence", "evidence", F.col("at").alias("valid_from"), "valid_to")


def run(observations: DataFrame, root: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Runs a stream into root, a log with a folder for each batch: a batch that is run again overwrites its own, so it counts once."""
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return changes(observations, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(root)
