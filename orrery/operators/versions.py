"""Versioned writes as functions from (state, batch, run time) to a new state: nothing is updated in place.

State tables have the columns of schema.CI and schema.EDGE. A batch has one row for each key; the last wins before it gets
here (deduplicated()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..schema import CONFIDENCE_EPSILON, COUNT_MARKER, DECLARED, EVIDENCE, EVIDENCE_KEPT, FRESH_DAYS, INFERRED, TTL_DAYS
from ..session import written

CI_KEY, EDGE_KEY = ["type", "external_id"], ["type", "from_id", "to_id", "edge_key"]


def deduplicated(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the greatest `order` for each key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return batch.withColumn("_n", last).where("_n = 1").drop("_n")


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _moved(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) > CONFIDENCE_EPSILON


def ci_actions(open_cis: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (type, external_id, name, attributes, confidence) with the open row's id and times, and an action: `create`
    where none is open, `update` where name, attributes or confidence differ, else `touch`."""
    old = open_cis.select(*CI_KEY, F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("attributes").alias("_attributes"), F.col("confidence").alias("_confidence"), F.col("first_seen").alias("_first"), F.col("valid_from").alias("_from"))
    joined = batch.join(old, CI_KEY, "left")
    changed = _differs("name", "_name") | _differs("attributes", "_attributes") | _moved("confidence", "_confidence")
    return joined.withColumn("action", F.when(F.col("_id").isNull(), "create").when(changed, "update").otherwise("touch"))


def upsert_cis(state: DataFrame, batch: DataFrame, tenant_id: str, now: Column) -> DataFrame:
    """The table of items after a batch: unchanged items are touched (last_seen), changed ones closed and opened anew under
    the same id with first_seen carried on, new ones opened."""
    names = state.columns
    acted = ci_actions(state.where("valid_to is null"), batch)
    new_id = conf.canonical_id(F.lit(tenant_id), F.col("type"), F.col("external_id"), now.cast("string"))
    opened = acted.where("action <> 'touch'").select(
        F.coalesce("_id", new_id).alias("id"), F.lit(tenant_id).alias("tenant_id"), "type", "external_id", "name", "attributes", "confidence",
        F.coalesce("_first", now).alias("first_seen"), now.alias("last_seen"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    did = acted.where("_id is not null").select(F.col("_id").alias("id"), F.col("_from").alias("valid_from"), "action")
    kept = state.join(did, ["id", "valid_from"], "left")
    kept = kept.withColumn("last_seen", F.when(F.col("action") == "touch", now).otherwise(F.col("last_seen"))).withColumn("valid_to", F.when(F.col("action") == "update", now).otherwise(F.col("valid_to")))
    return kept.select(*names).unionByName(opened.select(*names))


def closed(state: DataFrame, keys: DataFrame, key: list[str], now: Column) -> DataFrame:
    """state with the open rows of some keys closed."""
    hit = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    out = state.join(hit, key, "left")
    return out.withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).select(*state.columns)


def _marker(detail: Column, at: Column) -> Column:
    return F.struct(F.lit(COUNT_MARKER).alias("source"), at.cast("timestamp").alias("observed_at"), detail.cast("string").alias("detail"))


def marked(evidence: Column) -> Column:
    """Evidence of an edge inferred for the first time: a count of 1 in front, of the latest observation."""
    latest = F.array_max(F.transform(evidence, lambda e: e["observed_at"]))
    return F.concat(F.array(_marker(F.lit("1"), latest)), evidence)


def observation_count(evidence: Column) -> Column:
    """What the count marker says; 1 without one that can be read."""
    marker = F.try_element_at(F.filter(evidence, lambda e: e["source"] == COUNT_MARKER), F.lit(1))
    return F.coalesce(marker["detail"].try_cast("int"), F.lit(1))


def last_observed(evidence: Column) -> Column:
    return F.try_element_at(F.filter(evidence, lambda e: e["source"] == COUNT_MARKER), F.lit(1))["observed_at"]


def accumulated(prior: Column, incoming: Column) -> Column:
    """Evidence after one more batch: the count plus one, and the last EVIDENCE_KEPT of prior and incoming entries. The
    marker takes the time of the last entry, even if it is older."""
    rest = F.concat(F.filter(prior, lambda e: e["source"] != COUNT_MARKER), incoming)
    kept = F.slice(rest, F.greatest(F.size(rest) - EVIDENCE_KEPT, F.lit(0)) + 1, EVIDENCE_KEPT)
    return F.concat(F.array(_marker(observation_count(prior) + 1, F.element_at(rest, -1)["observed_at"])), kept)


def edge_actions(open_edges: DataFrame, batch: DataFrame, protect_declared: bool = False) -> DataFrame:
    """batch (type, from_id, to_id, edge_key, source, confidence, evidence) with the evidence and confidence to write and an
    action: `create`, `accumulate` (inferred again: always a new version), `update` (differs), or `keep`."""
    old = open_edges.select(*EDGE_KEY, F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("confidence").alias("_confidence"), F.col("evidence").alias("_evidence"), F.col("valid_from").alias("_from"))
    joined = batch.join(old, EDGE_KEY, "left")
    inferred = F.col("source") == INFERRED
    changed = _differs("source", "_source") | _moved("confidence", "_confidence") | _differs("evidence", "_evidence")
    guarded = F.lit(protect_declared) & inferred & (F.col("_source") == DECLARED)
    action = F.when(F.col("_id").isNull(), "create").when(inferred & (F.col("_source") == INFERRED), "accumulate").when(changed & ~guarded, "update").otherwise("keep")
    more = accumulated(F.col("_evidence"), F.col("evidence"))
    return (
        joined.withColumn("action", action)
        .withColumn("new_evidence", F.when((F.col("action") == "create") & inferred, marked(F.col("evidence"))).when(F.col("action") == "accumulate", more).otherwise(F.col("evidence")))
        .withColumn("new_confidence", F.when(F.col("action") == "accumulate", conf.for_observations(observation_count(F.col("_evidence")) + 1)).otherwise(F.col("confidence")))
    )


def upsert_edges(state: DataFrame, batch: DataFrame, tenant_id: str, now: Column, protect_declared: bool = False) -> DataFrame:
    """The table of edges after a batch. Evidence must not be empty."""
    names = state.columns
    acted = edge_actions(state.where("valid_to is null"), batch, protect_declared)
    evidence = F.when(F.size("new_evidence") > 0, F.col("new_evidence")).otherwise(F.raise_error(F.lit("an edge needs evidence")).cast(EVIDENCE))
    new_id = conf.canonical_id(F.lit(tenant_id), F.col("type"), F.col("from_id"), F.col("to_id"), F.col("edge_key"), now.cast("string"))
    opened = acted.where("action <> 'keep'").select(
        F.coalesce("_id", new_id).alias("id"), F.lit(tenant_id).alias("tenant_id"), *EDGE_KEY, "source", F.col("new_confidence").alias("confidence"), evidence.alias("evidence"),
        now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    over = acted.where("_id is not null and action <> 'keep'").select(F.col("_id").alias("id"), F.col("_from").alias("valid_from"), F.lit(True).alias("_over"))
    kept = state.join(over, ["id", "valid_from"], "left").withColumn("valid_to", F.when(F.col("_over"), now).otherwise(F.col("valid_to")))
    return kept.select(*names).unionByName(opened.select(*names))


def latest_keys(state: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """A keyed table after an upsert, the batch winning over the state and later rows over earlier ones."""
    both = state.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def first_keys(state: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """A keyed table after registrations: what is there stays unchanged."""
    return state.unionByName(batch.dropDuplicates(key).join(state, key, "left_anti"))


def aging_actions(edges: DataFrame, now: Column) -> DataFrame:
    """Open inferred edges with days since their last observation, an action (`close` over the time to live, `decay` over the
    fresh window if that lowers the confidence, else `untouched`) and new_confidence. Without a marker, with a time in
    the future, or with a version of this very time, nothing is done."""
    aged = edges.where((F.col("valid_to").isNull()) & (F.col("source") == INFERRED)).withColumn("days", conf.age_days(last_observed(F.col("evidence")), now))
    lower = F.when(F.col("days") >= 0, conf.decayed(F.col("confidence"), F.col("days")))
    action = (
        F.when(F.col("days").isNull() | (F.col("days") < 0), "untouched")
        .when(F.col("days") > TTL_DAYS, "close")
        .when((F.col("days") > FRESH_DAYS) & (lower < F.col("confidence")) & (F.col("valid_from") < now), "decay")
        .otherwise("untouched")
    )
    return aged.withColumn("action", action).withColumn("new_confidence", F.when(F.col("action") == "decay", lower))


def aging_sweep(state: DataFrame, now: Column) -> DataFrame:
    """The table of edges after decay and closing; a decayed edge is a new version with a note among its evidence."""
    acted = aging_actions(state, now)
    note = F.struct(F.lit("aging").alias("source"), now.alias("observed_at"), F.format_string("decayed %.4f->%.4f age_days=%d", "confidence", "new_confidence", F.floor("days")).alias("detail"))
    # The note tells the confidence before the decay, so it's made first.
    opened = acted.where("action = 'decay'").withColumn("evidence", F.concat("evidence", F.array(note))).withColumn("confidence", F.col("new_confidence")).withColumn("valid_from", now)
    did = acted.where("action <> 'untouched'").select("id", "valid_from", F.lit(True).alias("_over"))
    kept = state.join(did, ["id", "valid_from"], "left").withColumn("valid_to", F.when(F.col("_over"), now).otherwise(F.col("valid_to")))
    return kept.select(*state.columns).unionByName(opened.select(*state.columns))


def write_decayed(state: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The table of edges after decays (id, new_confidence, decay_evidence), one an id: the open version is closed and one of the same id opened, with the
    entry behind its evidence, whose marker stays. A declared edge, a confidence that isn't lower and an id without an open edge are errors."""
    cut = changes.select("id", "new_confidence", "decay_evidence")
    hit = cut.join(state.where("valid_to is null"), "id", "left")
    fault = (
        F.when(F.col("source").isNull(), F.lit("no open edge "))
        .when(F.col("source") != INFERRED, F.lit("only inferred edges decay, not "))
        .when(~F.coalesce(F.col("new_confidence") < F.col("confidence"), F.lit(False)), F.lit("a decay must lower the confidence of "))
    )
    checked = hit.where(F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(fault, "id")).cast("boolean")))
    opened = checked.withColumns({"confidence": F.col("new_confidence"), "evidence": F.concat("evidence", F.array("decay_evidence")).cast(EVIDENCE), "valid_from": now})
    return closed(state, cut, ["id"], now).unionByName(opened.select(*state.columns))


def retention_split(versions: DataFrame, horizon: Column) -> DataFrame:
    """versions with `removed`: closed before the horizon and not the latest closed version of its id."""
    latest = F.row_number().over(Window.partitionBy("id", F.col("valid_to").isNull()).orderBy(F.desc("valid_from")))
    return versions.withColumn("_n", latest).withColumn("removed", F.coalesce(F.col("valid_to") < horizon, F.lit(False)) & (F.col("_n") > 1)).drop("_n")


def retention_sweep(versions: DataFrame, horizon: Column, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept versions, aggregates): removed versions become one row (id, version_count, first_from, last_to, types) each id."""
    split = retention_split(versions, horizon)
    removed = F.col("removed") & F.lit(enabled)
    gone = split.where(removed).groupBy("id").agg(
        F.count(F.lit(1)).alias("version_count"), F.min("valid_from").alias("first_from"), F.max("valid_to").alias("last_to"), F.array_sort(F.collect_set("type")).alias("types")
    )
    return split.where(~removed).drop("removed"), gone


def resolved_endpoints(edges: DataFrame, open_cis: DataFrame, source_keys: DataFrame) -> DataFrame:
    """Discovered edges with from_id and to_id: by (type, external_id) among open items, else by native id among source keys
    of any source whose item is open; null where neither is found."""
    ids = open_cis.select("type", "external_id", "id")
    live = source_keys.join(open_cis.select(F.col("id").alias("ci_id")), "ci_id", "left_semi")
    native = live.groupBy("native_id").agg(F.min(F.struct("source", "ci_id")).alias("k")).select("native_id", F.col("k.ci_id").alias("ci_id"))
    out = edges
    for end in ("from", "to"):
        a = ids.select(F.col("type").alias(f"{end}_type"), F.col("external_id").alias(f"{end}_ext"), F.col("id").alias("_a"))
        b = native.select(F.col("native_id").alias(f"{end}_ext"), F.col("ci_id").alias("_b"))
        out = out.join(a, [f"{end}_type", f"{end}_ext"], "left").join(b, f"{end}_ext", "left").withColumn(f"{end}_id", F.coalesce("_a", "_b")).drop("_a", "_b")
    return out


def reconcile(state: dict[str, DataFrame], cis: DataFrame, edges: DataFrame, tenant_id: str, source: str, ci_types: list[str], edge_types: list[str], now: Column, scope_edges_by_source: bool = False) -> dict[str, DataFrame]:
    """The state (cis, edges, source_keys, alias_keys) after an authoritative discovery of one source, and `counts`.

    Items are matched by key, then by alias (resolution.deterministic); absent ones of the declared types that this source
    owns are closed. Edges resolve their ends against the new items; unresolved ones are skipped; open edges of the declared
    types that weren't seen are closed, whatever their source, unless scope_edges_by_source. What later steps and the next
    discovery read again is written, so that plans don't grow from one to the next.
    """
    from . import resolution

    open_cis = state["cis"].where("valid_to is null")
    merged = written(resolution.deterministic(cis.join(open_cis, CI_KEY, "left_anti"), state["alias_keys"], open_cis, source), "merges")
    renamed = cis.join(merged.select("type", "external_id", F.col("canonical_external_id").alias("_ext")), CI_KEY, "left")
    batch = written(deduplicated(renamed.withColumn("_native", F.col("external_id")).withColumn("external_id", F.coalesce("_ext", "external_id")), CI_KEY, "_native"), "batch")
    actions = ci_actions(open_cis, batch)
    after = upsert_cis(state["cis"], batch.select(*CI_KEY, "name", "attributes", "confidence"), tenant_id, now)
    seen = batch.select(*CI_KEY)
    owned = state["source_keys"].where(F.col("source") == source).select(F.col("ci_id").alias("id")).distinct()
    absent = open_cis.where(F.col("type").isin(*ci_types)).join(owned, "id", "left_semi").join(seen, CI_KEY, "left_anti")
    after = written(closed(after, absent, CI_KEY, now), "cis")
    live = after.where("valid_to is null")
    native = renamed.select("type", F.coalesce("_ext", "external_id").alias("_key"), F.col("external_id").alias("native_id"))
    bound = native.join(live.select("type", F.col("external_id").alias("_key"), F.col("id").alias("ci_id")), ["type", "_key"]).select(F.lit(tenant_id).alias("tenant_id"), F.lit(source).alias("source"), "native_id", "ci_id", now.alias("observed_at"))
    source_keys = written(latest_keys(state["source_keys"], bound.dropDuplicates(["tenant_id", "source", "native_id"]), ["tenant_id", "source", "native_id"], "observed_at"), "source-keys")
    aliases = renamed.select("type", F.coalesce("_ext", "external_id").alias("_key"), F.explode("alias_keys").alias("alias_key")).join(live.select("type", F.col("external_id").alias("_key"), F.col("id").alias("ci_id")), ["type", "_key"])
    aliases = aliases.select(F.lit(tenant_id).alias("tenant_id"), "alias_key", "ci_id", F.col("type").alias("ci_type"), F.lit(source).alias("source"), now.alias("observed_at")).dropDuplicates(["alias_key"])
    alias_keys = written(latest_keys(state["alias_keys"], aliases, ["tenant_id", "alias_key"], "observed_at"), "alias-keys")
    linked = resolved_endpoints(edges, live, source_keys).where("from_id is not null and to_id is not null")
    links = written(deduplicated(linked.withColumn("_o", F.to_json("evidence")), EDGE_KEY, "_o").select(*EDGE_KEY, "source", "confidence", "evidence"), "links")
    open_edges = state["edges"].where("valid_to is null")
    edge_acts = edge_actions(open_edges, links)
    gone = open_edges.where(F.col("type").isin(*edge_types)).join(links.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    if scope_edges_by_source:
        gone = gone.where(F.exists("evidence", lambda e: e["source"] == source))
    new_edges = written(closed(upsert_edges(state["edges"], links, tenant_id, now), gone, EDGE_KEY, now), "edges")
    counts = (
        actions.groupBy("action").count()
        .unionByName(absent.groupBy().count().select(F.lit("closed").alias("action"), "count"))
        .unionByName(edge_acts.where("action <> 'keep'").groupBy().count().select(F.lit("edges_written").alias("action"), "count"))
        .unionByName(gone.groupBy().count().select(F.lit("edges_closed").alias("action"), "count"))
    )
    return {"cis": after, "edges": new_edges, "source_keys": source_keys, "alias_keys": alias_keys, "merges": merged, "counts": counts}


def apply_delta(state: dict[str, DataFrame], cis: DataFrame, edges: DataFrame, removed_cis: DataFrame, removed_edges: DataFrame, tenant_id: str, source: str, now: Column) -> dict[str, DataFrame]:
    """The state after explicit upserts and removals; absence closes nothing. An edge whose end can't be resolved is an error.
    Removed edges are those of the given edge_key, by default the empty one."""
    after = upsert_cis(state["cis"], deduplicated(cis, CI_KEY, "attributes").select(*CI_KEY, "name", "attributes", "confidence"), tenant_id, now)
    live = after.where("valid_to is null")
    bound = cis.select("type", "external_id").distinct().join(live.select("type", "external_id", F.col("id").alias("ci_id")), CI_KEY)
    bound = bound.select(F.lit(tenant_id).alias("tenant_id"), F.lit(source).alias("source"), F.col("external_id").alias("native_id"), "ci_id", now.alias("observed_at")).dropDuplicates(["native_id"])
    source_keys = latest_keys(state["source_keys"], bound, ["tenant_id", "source", "native_id"], "observed_at")
    linked = resolved_endpoints(edges, live, source_keys)
    fail = F.raise_error(F.concat(F.lit("unresolved end of edge "), "type", F.lit(" "), "from_ext", F.lit(" "), "to_ext")).cast("string")
    linked = linked.withColumn("from_id", F.coalesce("from_id", fail)).withColumn("to_id", F.coalesce("to_id", fail))
    links = deduplicated(linked.withColumn("_o", F.to_json("evidence")), EDGE_KEY, "_o").select(*EDGE_KEY, "source", "confidence", "evidence")
    gone = resolved_endpoints(removed_edges, live, source_keys).withColumn("edge_key", F.coalesce("edge_key", F.lit("")) if "edge_key" in removed_edges.columns else F.lit(""))
    new_edges = closed(upsert_edges(state["edges"], links, tenant_id, now), gone, EDGE_KEY, now)
    return {"cis": closed(after, removed_cis, CI_KEY, now), "edges": new_edges, "source_keys": source_keys, "alias_keys": state["alias_keys"]}
