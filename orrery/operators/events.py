"""Ordered intake of events: a log of changes folded by key and event time into versions, whatever the batches it comes in.

An event carries upserts and removals of items and edges. Here each is a row of a log (LOG) with the event's time, a number `seq` that orders
events of one time (a stream's offset), and its step within the event: items, edges, removed items, removed edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import canonical_id
from ..schema import CONFIDENCE_EPSILON, DECLARED, EVIDENCE
from ..session import written
from . import resolution
from .versions import CI_KEY, EDGE_KEY, latest_keys

LOG = (
    "event_id string, at timestamp, seq bigint, step int, op string, type string, external_id string, name string, attributes string, alias_keys array<string>, "
    f"from_type string, from_ext string, to_type string, to_ext string, edge_key string, source string, confidence double, evidence {EVIDENCE}"
)
UPSERT_CI, UPSERT_EDGE, REMOVE_CI, REMOVE_EDGE = range(4)
_ORDER = ["at", "seq", "event_id", "step"]


def rows(df: DataFrame, step: int, event_id: Column, at: Column, seq: Column, **columns: Column) -> DataFrame:
    """Rows of a log for one step; columns that aren't named are null."""
    given = {"event_id": event_id, "at": at, "seq": seq, "step": F.lit(step), "op": F.lit("upsert" if step < REMOVE_CI else "remove"), **columns}
    types = dict(c.split(" ", 1) for c in LOG.split(", "))
    return df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def parts(log: DataFrame) -> dict[str, DataFrame]:
    """The upserts and removals of a log without their order, as a delta that holds each key once."""
    of = lambda step: log.where(F.col("step") == step)
    key = ["type", "from_type", "from_ext", "to_type", "to_ext", "edge_key"]
    last = of(UPSERT_CI).groupBy("type", "external_id").agg(F.max_by(F.struct("name", "attributes", "confidence", "alias_keys"), F.struct(*_ORDER)).alias("r")).select("type", "external_id", "r.*")
    edges = of(UPSERT_EDGE).groupBy(*key).agg(F.max("source").alias("source"), F.max("confidence").alias("confidence"), F.array_sort(F.flatten(F.collect_set("evidence"))).alias("evidence"))
    return {
        "cis": last,
        "edges": edges.select(*key[:5], "source", "confidence", "evidence", "edge_key"),
        "removed_cis": of(REMOVE_CI).select("type", "external_id").distinct(),
        "removed_edges": of(REMOVE_EDGE).select(*key[:5]).distinct(),
    }


def folded(state: DataFrame, changes: DataFrame, key: list[str], content: list[str], new_id: Column, first: str | None = None, seen: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table after some changes, the action of each change).

    changes have key, content, op and the order columns. By key, in order, the state's latest version first: an upsert creates where nothing
    is open, updates where content differs from what is open, and else touches; a removal closes what is open, and else does nothing. Each creation or
    update is a version from its time to the next one's or to the closing. Changes from before the latest known time of their key are `stale` and do
    nothing. So the result depends on the changes and their order alone, not on how they were dealt into batches. One shuffle by key; a key's
    changes are looked at in passing and never gathered. first and seen name columns for the time of creation and of the last upsert."""
    names = state.columns
    keys = changes.select(*key).distinct()
    known = state.join(keys, key, "left_semi")
    time = F.coalesce(F.col("valid_to"), F.greatest("valid_from", seen) if seen else F.col("valid_from"))
    latest = known.groupBy(*key).agg(F.max_by(F.struct(*(c for c in names if c not in key)), F.struct(F.col("valid_to").isNull(), "valid_from")).alias("_old"), F.max(time).alias("_time"))
    open_ = F.col("_old.valid_to").isNull()
    none = F.lit(None)
    start = latest.select(
        *key, *(F.when(open_, F.col(f"_old.{c}")).alias(c) for c in content), F.when(open_, "upsert").otherwise("remove").alias("op"), F.coalesce("_old.valid_to", "_old.valid_from").alias("at"),
        F.lit(-1).cast("long").alias("seq"), F.lit("").alias("event_id"), F.lit(-1).alias("step"), "_old",
    )
    timed = changes.select(*key, *content, "op", *_ORDER).join(latest.select(*key, "_time"), key, "left").withColumn("_stale", F.coalesce(F.col("at") < F.col("_time"), F.lit(False)))
    fresh = timed.where(~F.col("_stale")).drop("_time", "_stale").withColumn("_old", none.cast(start.schema["_old"].dataType))
    by_key = Window.partitionBy(*key).orderBy(*_ORDER)
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for c in content:
        before = F.lag(c).over(by_key)
        same = same & (F.abs(F.col(c) - before) <= CONFIDENCE_EPSILON if c == "confidence" else F.col(c).eqNullSafe(before))
    alive = F.coalesce(F.lag("op").over(by_key) == "upsert", F.lit(False))
    upsert = F.col("op") == "upsert"
    action = (
        F.when(F.col("_old").isNotNull(), F.when(upsert, "open").otherwise("none"))
        .when(upsert, F.when(alive & same, "touch").when(alive, "update").otherwise("create"))
        .otherwise(F.when(alive, "close").otherwise("none"))
    )
    acted = start.unionByName(fresh).withColumn("action", action)
    begins = F.col("action").isin("open", "create", "update")
    acted = acted.withColumn("_id", F.last(F.when(F.col("action") == "create", new_id).when(F.col("action") == "open", F.col("_old.id")), True).over(so_far))
    if first:
        acted = acted.withColumn("_first", F.last(F.when(F.col("action") == "create", F.col("at")).when(F.col("action") == "open", F.col(f"_old.{first}")), True).over(so_far))
    acted = acted.withColumn("_v", F.sum(F.when(begins, 1).otherwise(0)).over(so_far))
    if seen:
        acted = acted.withColumn("_seen", F.max(F.when(F.col("action") == "open", F.col(f"_old.{seen}")).when(upsert, F.col("at"))).over(Window.partitionBy(*key, "_v")))
    marks = acted.where(begins | (F.col("action") == "close")).withColumn("valid_to", F.lead("at").over(by_key))
    made = {"id": F.col("_id"), "valid_from": F.col("at"), "valid_to": F.col("valid_to"), **({first: F.col("_first")} if first else {}), **({seen: F.col("_seen")} if seen else {})}
    plain = [c for c in names if c not in made and c not in key and c not in content]
    versions = marks.where(begins).select(*(made[c].alias(c) if c in made else F.col(f"_old.{c}").alias(c) if c in plain else F.col(c) for c in names))
    untouched = state.where("valid_to is not null").unionByName(state.where("valid_to is null").join(keys, key, "left_anti"))
    after = untouched.select(*names).unionByName(versions)
    did = acted.where("_old is null").select(*key, *_ORDER, "action").unionByName(timed.where("_stale").select(*key, *_ORDER, F.lit("stale").alias("action")))
    return after, did


def _ends(changes: DataFrame, cis: DataFrame, created: DataFrame, source_keys: DataFrame) -> DataFrame:
    """changes of edges with from_id and to_id: the item of that key that was open at the time of the change, else the one that a source knows by
    that native id; null if there is none. created (type, external_id, at, seq) says where among the events of its time an item was made."""
    lives = cis.groupBy("type", "external_id", "id").agg(F.min("valid_from").alias("_from"), F.max(F.coalesce("valid_to", F.lit("9999-01-01").cast("timestamp"))).alias("_to"))
    made = created.groupBy("type", "external_id", F.col("at").alias("_from")).agg(F.min("seq").alias("_seq"))
    lives = lives.join(made, ["type", "external_id", "_from"], "left").withColumn("_seq", F.coalesce("_seq", F.lit(-1)))
    native = source_keys.groupBy("native_id").agg(F.min_by("ci_id", "source").alias("id")).join(lives.drop("external_id"), "id")
    out = changes
    for end in ("from", "to"):
        points = changes.select(F.col(f"{end}_type").alias("_t"), F.col(f"{end}_ext").alias("_x"), "at", "seq").distinct()
        within = (F.struct("at", "seq") >= F.struct(F.col("_from").alias("at"), F.col("_seq").alias("seq"))) & (F.col("at") <= F.col("_to"))
        key = ["_t", "_x", "at", "seq"]
        own = points.join(lives, (F.col("_t") == F.col("type")) & (F.col("_x") == F.col("external_id")) & within).groupBy(*key).agg(F.max_by("id", "_from").alias("_a"))
        other = points.join(native, (F.col("_x") == F.col("native_id")) & within).groupBy(*key).agg(F.max_by("id", "_from").alias("_b"))
        found = points.join(own, key, "left").join(other, key, "left").select(F.col("_t").alias(f"{end}_type"), F.col("_x").alias(f"{end}_ext"), "at", "seq", F.coalesce("_a", "_b").alias(f"{end}_id"))
        out = out.join(found, [f"{end}_type", f"{end}_ext", "at", "seq"], "left")
    return out


def apply_log(state: dict[str, DataFrame], log: DataFrame, tenant_id: str, source: str) -> dict[str, DataFrame]:
    """The state (cis, edges, source_keys, alias_keys, merges) after the events of one source, and `counts`, one row of counters.

    log has the columns of LOG. A new item that shares an alias with exactly one open item of another source is an upsert of that item
    from then on, and `merges` says so.
    An upserted edge whose end isn't open at its time is an error, and so is an inferred one; a removed edge without such an end is none. An empty log
    changes nothing. What is read more than once is written."""
    upserts = log.where(F.col("step") == UPSERT_CI)
    live = state["cis"].where("valid_to is null")
    fresh = upserts.select("type", "external_id", "alias_keys").join(live, CI_KEY, "left_anti")
    fresh = fresh.groupBy(*CI_KEY).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("alias_keys", F.array())))).alias("alias_keys"))
    # An identity that the source has been merged by before stays with its item; else an alias may lead it to one.
    own = state["source_keys"].where(F.col("source") == source).select(F.col("native_id").alias("external_id"), "ci_id").join(live.select(F.col("id").alias("ci_id"), "type", F.col("external_id").alias("_canonical")), "ci_id")
    known = written(fresh.join(own, CI_KEY).groupBy(*CI_KEY).agg(F.min("_canonical").alias("_canonical")), "known")
    merged = written(resolution.deterministic(fresh.join(known, CI_KEY, "left_anti"), state["alias_keys"], live, source), "merges")
    rename = known.unionByName(merged.select("type", "external_id", F.col("canonical_external_id").alias("_canonical")))
    items = log.where(F.col("step").isin(UPSERT_CI, REMOVE_CI)).join(rename, CI_KEY, "left").withColumn("_native", F.col("external_id"))
    items = items.withColumn("external_id", F.when(F.col("op") == "upsert", F.coalesce("_canonical", "external_id")).otherwise(F.col("external_id"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    items = written(items.withColumn("attributes", F.coalesce("attributes", F.lit("{}"))), "items")
    new_id = canonical_id(F.lit(tenant_id), F.col("type"), F.col("external_id"), F.col("at").cast("string"))
    cis, ci_acts = folded(state["cis"], items, CI_KEY, ["name", "attributes", "confidence"], new_id, "first_seen", "last_seen")
    cis = written(cis.withColumn("tenant_id", F.lit(tenant_id)), "cis")

    # What an upsert names is bound to the item that it made or met at that time.
    named = items.where("op = 'upsert'").select(*CI_KEY, "_native", "at", "alias_keys")
    met = cis.select(*CI_KEY, F.col("id").alias("ci_id"), "valid_from", "valid_to")
    bound = named.join(met, CI_KEY).where("at >= valid_from and (valid_to is null or at <= valid_to)").groupBy("type", "_native").agg(F.max_by(F.struct("ci_id", "at", "alias_keys"), F.struct("at", "valid_from")).alias("b")).select("type", "_native", "b.*")
    bound = written(bound, "bound")
    keyed = bound.groupBy(F.col("_native").alias("native_id")).agg(F.max_by("ci_id", F.struct("at", "ci_id")).alias("ci_id"), F.max("at").alias("observed_at")).select(F.lit(tenant_id).alias("tenant_id"), F.lit(source).alias("source"), "native_id", "ci_id", "observed_at")
    source_keys = written(latest_keys(state["source_keys"], keyed, ["tenant_id", "source", "native_id"], "observed_at"), "source-keys")
    told = bound.select(F.explode("alias_keys").alias("alias_key"), "ci_id", "type", "at").groupBy("alias_key").agg(F.max_by(F.struct("ci_id", "type", "at"), F.struct("at", "ci_id")).alias("a"))
    told = told.select(F.lit(tenant_id).alias("tenant_id"), "alias_key", "a.ci_id", F.col("a.type").alias("ci_type"), F.lit(source).alias("source"), F.col("a.at").alias("observed_at"))
    alias_keys = written(latest_keys(state["alias_keys"], told, ["tenant_id", "alias_key"], "observed_at"), "alias-keys")

    links = _ends(log.where(F.col("step").isin(UPSERT_EDGE, REMOVE_EDGE)).drop("external_id"), cis, ci_acts.where("action = 'create'").select(*CI_KEY, "at", "seq"), source_keys)
    missing = F.raise_error(F.concat(F.lit("unresolved end of edge "), "type", F.lit(" "), "from_ext", F.lit(" "), "to_ext"))
    inferred = F.raise_error(F.lit("edges of events are declared"))
    is_upsert = F.col("op") == "upsert"
    known_ends = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    # In one condition, so that the row that fails isn't left out first.
    links = links.where(F.when(is_upsert & (F.coalesce("source", F.lit(DECLARED)) != DECLARED), inferred.cast("boolean")).when(is_upsert & ~known_ends, missing.cast("boolean")).otherwise(known_ends))
    links = links.withColumns({"edge_key": F.coalesce("edge_key", F.lit("")), "source": F.when(is_upsert, DECLARED), "confidence": F.when(is_upsert, F.coalesce("confidence", F.lit(1.0)))})
    links = written(links, "links")
    new_id = canonical_id(F.lit(tenant_id), F.col("type"), F.col("from_id"), F.col("to_id"), F.col("edge_key"), F.col("at").cast("string"))
    edges, edge_acts = folded(state["edges"], links, EDGE_KEY, ["source", "confidence", "evidence"], new_id)
    edges = written(edges.withColumn("tenant_id", F.lit(tenant_id)), "edges")

    count = lambda *a: F.coalesce(F.sum(F.when(F.col("action").isin(*a), 1)), F.lit(0)).cast("long")
    of_items = ci_acts.agg(count("create").alias("cis_created"), count("update").alias("cis_updated"), count("touch").alias("cis_unchanged"), count("close").alias("cis_closed"), count("stale").alias("cis_stale"))
    of_edges = edge_acts.agg(count("create", "update", "touch").alias("edges_written"), count("close").alias("edges_closed"), count("stale").alias("edges_stale"))
    when = upserts.groupBy(*CI_KEY).agg(F.min("at").alias("merged_at"))
    appended = merged.join(when, CI_KEY).select(
        canonical_id(F.lit(tenant_id), F.lit("merge"), "ci_id", F.lit(source), "external_id").alias("merge_id"), F.lit(tenant_id).alias("tenant_id"), F.col("ci_id").alias("canonical_ci_id"), F.lit(None).cast("string").alias("merged_ci_id"),
        F.lit(source).alias("merged_source"), F.col("external_id").alias("merged_external_id"), F.col("matched_key").alias("matched_alias_key"),
        F.concat(F.lit(f"merged {source}:"), "external_id", F.lit(" into canonical "), "ci_id", F.lit(" via alias_key="), "matched_key").alias("evidence"), "merged_at",
    )
    # A merged identity that comes again is no new merge.
    merges = state["merges"].unionByName(written(appended.join(state["merges"], "merge_id", "left_anti"), "ledger"))
    return {"cis": cis, "edges": edges, "source_keys": source_keys, "alias_keys": alias_keys, "merges": merges, "counts": of_items.crossJoin(F.broadcast(of_edges))}
