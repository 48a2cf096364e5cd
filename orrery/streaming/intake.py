"""Events into a store, batch by batch: raw facts, a run and a version each, once however often a batch is run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events
from ..operators.commits import Store


def intake(store: Store, log: DataFrame, tenant_id: str, source: str, batch_id: int) -> dict | None:
    """Applies a batch of an event log (events.LOG) and returns its counters; None for a batch that is in the state already.

    Raw facts are appended first, and the run is `partial` until the version is committed; a batch that failed in between is run again and takes
    the same places. An event whose facts another batch brought before is left out, so a sender may repeat itself."""
    m, state = store.read()
    if m["batches"].get(source, -1) >= batch_id:
        return None
    started = dt.datetime.now(dt.timezone.utc)
    store.record_run(tenant_id, source, batch_id, "partial", started, {})
    body = F.to_json(F.struct(*(c for c in log.columns if c not in ("event_id", "seq"))))
    facts = store.append_facts(log.select(F.lit(tenant_id).alias("tenant_id"), F.lit(source).alias("source"), F.col("at").alias("observed_at"), "event_id", body.alias("payload")), batch_id, source)
    before = store.facts().where((F.col("source") == source) & (F.col("batch_id") < batch_id)).select("event_id").distinct()
    after = events.apply_log(state, log.join(before, "event_id", "left_anti"), tenant_id, source)
    counts = {**after.pop("counts").first().asDict(), "raw_facts": facts}
    store.commit(m, after, {source: batch_id})
    store.record_run(tenant_id, source, batch_id, "ok", started, counts)
    return counts


def run(log: DataFrame, store: Store, tenant_id: str, source: str, checkpoint: str) -> StreamingQuery:
    """Runs a streaming log into a store."""
    return log.writeStream.foreachBatch(lambda batch, batch_id: intake(store, batch, tenant_id, source, batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
