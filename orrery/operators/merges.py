"""Merging items and undoing it: accepted candidates with their chains, an append-only ledger, and reversal by merge id.

States are those of versions.reconcile() and events.apply_log() with tables `candidates`, `merges` and `unmerges` (schema.CANDIDATE, MERGE,
UNMERGE). Nothing is deleted: keys point elsewhere, edges and items are closed and opened anew. Of two writers who resolve
candidates of one store at a time, commits.Store lets one through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import canonical_id
from ..schema import DECLARED
from ..session import discard, written
from .commits import Store
from .components import connected_components
from .versions import EDGE_KEY

FUZZY = "fuzzy-candidate"


class NotFound(ValueError):
    """There is no such candidate or merge, or an item of it isn't open."""


class AlreadyResolved(ValueError):
    """The candidate isn't pending, or the merge has been reversed."""


def components(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(id, root): of each item in pairs (a, b), the least item that pairs lead to, by order (id, rank, any comparable column). Items that order
    doesn't have lead nowhere and have no row.

    Groups are found by their ids alone, in a number of passes that grows with the logarithm of the longest chain; ranks are compared once, at the end."""
    met = written(pairs.select("a", "b"), "pairs")
    rank = order.select("id", F.struct("rank", "id").alias("root"))
    nodes = written(met.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(rank, "id"), "nodes")
    known = lambda c: nodes.select(F.col("id").alias(c))
    groups = connected_components(met.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"), "a", "b")
    named = nodes.join(groups, "id", "left").select("id", "root", F.coalesce("component", "id").alias("group"))
    least = named.groupBy("group").agg(F.min("root").alias("least"))
    out = written(named.select("id", "group").join(least, "group").select("id", F.col("least.id").alias("root")), "roots")
    discard(met, nodes, groups)
    return out


def fused(state: dict[str, DataFrame], merged: DataFrame, now: Column, note: Column) -> dict[str, DataFrame]:
    """The state after items (merged_ci_id, canonical_ci_id) went into others: their keys and declared open edges go along and they are closed.

    Edges between items that became one stay as they are. Edges that fall together are one, with all their evidence and the greatest confidence, and a
    moved edge has a note (of old and new ends) among its evidence."""
    to = lambda c: merged.select(F.col("merged_ci_id").alias(c), F.col("canonical_ci_id").alias(f"_{c}"))
    moved_keys = lambda t: t.join(to("ci_id"), "ci_id", "left").withColumns({"observed_at": F.when(F.col("_ci_id").isNotNull(), now).otherwise(F.col("observed_at")), "ci_id": F.coalesce("_ci_id", "ci_id")}).select(*t.columns)
    edges = state["edges"]
    f, t = F.coalesce("_from_id", "from_id"), F.coalesce("_to_id", "to_id")
    hit = F.col("valid_to").isNull() & (F.col("source") == DECLARED) & (F.col("_from_id").isNotNull() | F.col("_to_id").isNotNull())
    seen = edges.join(to("from_id"), "from_id", "left").join(to("to_id"), "to_id", "left").withColumn("_hit", hit).withColumns({"_f": f, "_t": t})
    seen = written(seen, "moves")
    moves = seen.where(F.col("_hit") & (F.col("_f") != F.col("_t")))
    told = F.struct(F.lit("merge-candidate").alias("source"), now.alias("observed_at"), note.alias("detail"))
    arrived = moves.select("tenant_id", "type", F.col("_f").alias("from_id"), F.col("_t").alias("to_id"), "edge_key", "confidence", F.concat("evidence", F.array(told)).alias("evidence"), F.lit(True).alias("_new"))
    there = edges.where(F.col("valid_to").isNull()).join(arrived.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_semi").join(moves.select("id", "valid_from"), ["id", "valid_from"], "left_anti")
    both = arrived.unionByName(there.select("tenant_id", *EDGE_KEY, "confidence", "evidence", F.lit(False).alias("_new")))
    ordered = F.array_sort(F.collect_list(F.struct("_new", "evidence")))  # those of the edge that was there come first
    joined = both.groupBy("tenant_id", *EDGE_KEY).agg(F.max("confidence").alias("confidence"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["evidence"]))).alias("evidence"))
    opened = joined.withColumns({"id": canonical_id(F.col("tenant_id"), *EDGE_KEY, now.cast("string")), "source": F.lit(DECLARED), "valid_from": now, "valid_to": F.lit(None).cast("timestamp")}).select(*edges.columns)
    # The versions that end: what moved, and what others fell upon.
    ended = moves.select("id", "valid_from").unionByName(there.select("id", "valid_from")).distinct().withColumn("_ended", F.lit(True))
    closed = edges.join(ended, ["id", "valid_from"], "left").withColumn("valid_to", F.when(F.col("_ended") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).select(*edges.columns)
    gone = merged.select(F.col("merged_ci_id").alias("id"), F.lit(True).alias("_gone"))
    cis = state["cis"].join(gone, "id", "left").withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).select(*state["cis"].columns)
    return state | {"cis": written(cis, "cis"), "edges": written(closed.unionByName(opened), "edges"), "source_keys": written(moved_keys(state["source_keys"]), "source-keys"), "alias_keys": written(moved_keys(state["alias_keys"]), "alias-keys")}


def _pending(state: dict[str, DataFrame], candidate_ids: list[str]) -> DataFrame:
    asked = state["candidates"].where(F.col("candidate_id").isin(candidate_ids))
    found = {r.candidate_id: r.status for r in asked.select("candidate_id", "status").collect()}  # as many as were asked for
    for i in candidate_ids:
        if i not in found:
            raise NotFound(f"candidate {i} not found")
        if found[i] != "pending":
            raise AlreadyResolved(f"candidate {i} is already {found[i]}")
    return asked


def dismiss(state: dict[str, DataFrame], candidate_ids: list[str], now: Column) -> dict[str, DataFrame]:
    """The state with pending candidates dismissed; an unknown or resolved one is an error."""
    _pending(state, candidate_ids)
    hit = F.col("candidate_id").isin(candidate_ids)
    return state | {"candidates": state["candidates"].withColumns({"status": F.when(hit, "dismissed").otherwise(F.col("status")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at"))})}


def accept(state: dict[str, DataFrame], candidate_ids: list[str], tenant_id: str, now: Column) -> dict[str, DataFrame]:
    """The state with pending candidates accepted: of all items that they join, directly or in a chain, the one of the least (external_id, id)
    stays and the others go into it, as they would candidate by candidate in any order.

    A candidate's item that went into another one since it was generated stands for that one. The ledger gets a row for each merged item, under
    its first key (source, native id), by which it can be undone. Errors: a candidate that is unknown or resolved, and an item that is neither open nor merged."""
    asked = written(_pending(state, candidate_ids), "asked")
    open_cis = state["cis"].where("valid_to is null").select("id", "external_id")
    # Where items went before, through all merges that weren't undone.
    undone = state["unmerges"].select(F.col("original_merge_id").alias("merge_id"))
    went = state["merges"].where("merged_ci_id is not null").join(undone, "merge_id", "left_anti").select(F.col("merged_ci_id").alias("id"), F.col("canonical_ci_id").alias("_to"))
    ends = written(asked.select("candidate_id", F.explode(F.array("ci_id_a", "ci_id_b")).alias("named")).withColumn("id", F.col("named")), "ends")
    while ends.join(open_cis, "id", "left_anti").join(went, "id", "left_semi").limit(1).count():
        ends = written(ends.join(open_cis.withColumn("_open", F.lit(True)).select("id", "_open"), "id", "left").join(went, "id", "left").select("candidate_id", "named", F.when(F.col("_open").isNull(), F.coalesce("_to", "id")).otherwise(F.col("id")).alias("id")), "ends")
    lost = ends.join(open_cis, "id", "left_anti").first()
    if lost:
        raise NotFound(f"item {lost.named} of candidate {lost.candidate_id} is no longer open")
    pairs = ends.groupBy("candidate_id").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    roots = components(pairs, open_cis.select("id", F.col("external_id").alias("rank")))
    first_key = state["source_keys"].groupBy(F.col("ci_id").alias("merged_ci_id")).agg(F.min(F.struct("source", "native_id")).alias("k"))
    why = ends.groupBy(F.col("id").alias("merged_ci_id")).agg(F.min("candidate_id").alias("candidate_id")).join(asked.select("candidate_id", "score", F.col("evidence").alias("_why")), "candidate_id")
    merged = roots.where("id <> root").select(F.col("id").alias("merged_ci_id"), F.col("root").alias("canonical_ci_id"))
    merged = merged.join(open_cis.select(F.col("id").alias("merged_ci_id"), "external_id"), "merged_ci_id").join(first_key, "merged_ci_id", "left").join(why, "merged_ci_id")
    source, native = F.coalesce("k.source", F.lit(FUZZY)), F.coalesce("k.native_id", "external_id")
    ledger = merged.select(
        canonical_id(F.lit(tenant_id), F.lit("merge"), "merged_ci_id", "canonical_ci_id", now.cast("string")).alias("merge_id"), F.lit(tenant_id).alias("tenant_id"), "canonical_ci_id", "merged_ci_id",
        source.alias("merged_source"), native.alias("merged_external_id"), F.concat(F.lit(f"{FUZZY}:"), "candidate_id").alias("matched_alias_key"),
        F.concat(F.lit("accepted fuzzy candidate "), "candidate_id", F.lit(" (confidence="), F.col("score").cast("string"), F.lit("): "), "_why").alias("evidence"), now.alias("merged_at"),
    )
    ledger = written(ledger, "ledger")
    unnamed = ledger.where(F.col("merged_source") == FUZZY).select("tenant_id", F.col("merged_source").alias("source"), F.col("merged_external_id").alias("native_id"), F.col("merged_ci_id").alias("ci_id"), now.alias("observed_at"))
    keyed = state | {"source_keys": state["source_keys"].unionByName(unnamed.join(state["source_keys"], ["tenant_id", "source", "native_id"], "left_anti"))}
    note = F.concat(F.lit("re-pointed from "), "from_id", F.lit(">"), "to_id", F.lit(" to "), "_f", F.lit(">"), "_t", F.lit(" by accepted candidates"))
    out = fused(keyed, ledger.select("merged_ci_id", "canonical_ci_id"), now, note)
    # Both ends of a candidate may have come together by others: then it names the merge of the same group.
    group = ledger.groupBy(F.col("canonical_ci_id").alias("root")).agg(F.min("merge_id").alias("_any"))
    of = pairs.join(roots.withColumnRenamed("id", "a"), "a").join(ledger.select(F.col("merged_ci_id").alias("b"), F.col("merge_id").alias("_b")), "b", "left").join(group, "root", "left").select("candidate_id", F.coalesce("_b", "_any").alias("_merge"))
    candidates = state["candidates"].join(of.withColumn("_hit", F.lit(True)), "candidate_id", "left")
    candidates = candidates.withColumns({"status": F.when(F.col("_hit"), "accepted").otherwise(F.col("status")), "resolved_merge_id": F.coalesce("resolved_merge_id", "_merge"), "resolved_at": F.when(F.col("_hit"), now).otherwise(F.col("resolved_at"))})
    return out | {"merges": state["merges"].unionByName(ledger), "candidates": written(candidates.select(*state["candidates"].columns), "candidates")}


def unmerge(state: dict[str, DataFrame], merge_id: str, tenant_id: str, now: Column) -> dict[str, DataFrame]:
    """The state with a merge undone: a new item of the merged external id, without name and attributes, takes that source's key and aliases, and the
    declared open edges whose evidence is of the source or tells the external id. The merge stays in the ledger, and `unmerges` gets a row.

    Errors: an unknown merge, one that was undone before, and one whose item isn't open any more (undo the later merge first)."""
    row = state["merges"].where(F.col("merge_id") == merge_id).first()
    if row is None:
        raise NotFound(f"merge {merge_id} not found")
    if state["unmerges"].where(F.col("original_merge_id") == merge_id).limit(1).count():
        raise AlreadyResolved(f"merge {merge_id} has already been reversed")
    base = state["cis"].where((F.col("id") == row.canonical_ci_id) & F.col("valid_to").isNull()).first()
    if base is None:
        raise NotFound(f"canonical item {row.canonical_ci_id} is no longer open")
    cis, edges, old_id = state["cis"], state["edges"], row.canonical_ci_id
    source, external_id = row.merged_source, row.merged_external_id
    if external_id == base.external_id:
        raise ValueError(f"{external_id} is the canonical item's own external id")
    spark = cis.sparkSession
    held = cis.where((F.col("type") == base.type) & (F.col("external_id") == external_id) & F.col("valid_to").isNull()).first()
    if held is not None:
        new_id, born = held.id, spark.createDataFrame([], cis.schema)
    else:
        born = spark.range(1).select(canonical_id(F.lit(tenant_id), F.lit(base.type), F.lit(external_id), now.cast("string")).alias("id"), F.lit(tenant_id).alias("tenant_id"), F.lit(base.type).alias("type"), F.lit(external_id).alias("external_id"), F.lit(None).cast("string").alias("name"), F.lit("{}").alias("attributes"), F.lit(1.0).alias("confidence"), now.alias("first_seen"), now.alias("last_seen"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
        new_id = born.first().id
    key = (F.col("source") == source) & (F.col("native_id") == external_id)
    own = (F.col("source") == source) & (F.col("ci_id") == old_id)
    repoint = lambda t, hit: t.withColumns({"observed_at": F.when(hit, now).otherwise(F.col("observed_at")), "ci_id": F.when(hit, F.lit(new_id)).otherwise(F.col("ci_id"))})
    told = F.exists("evidence", lambda e: (e["source"] == source) | F.coalesce(F.contains(e["detail"], F.lit(external_id)), F.lit(False)))
    hit = F.col("valid_to").isNull() & (F.col("source") == DECLARED) & ((F.col("from_id") == old_id) | (F.col("to_id") == old_id)) & told
    swap = lambda c: F.when(F.col(c) == old_id, F.lit(new_id)).otherwise(F.col(c))
    note = F.struct(F.lit("unmerge").alias("source"), now.alias("observed_at"), F.lit(f"re-pointed from {old_id} to {new_id} via unmerge of {merge_id}").alias("detail"))
    moved = edges.where(hit).withColumns({"from_id": swap("from_id"), "to_id": swap("to_id"), "valid_from": now, "evidence": F.concat("evidence", F.array(note))})
    moved = moved.withColumn("id", canonical_id(F.col("tenant_id"), *EDGE_KEY, now.cast("string"))).select(*edges.columns)
    record = spark.range(1).select(
        canonical_id(F.lit(tenant_id), F.lit("unmerge"), F.lit(merge_id)).alias("unmerge_id"), F.lit(tenant_id).alias("tenant_id"), F.lit(merge_id).alias("original_merge_id"), F.lit(old_id).alias("canonical_ci_id"), F.lit(new_id).alias("restored_ci_id"),
        F.lit(source).alias("restored_source"), F.lit(external_id).alias("restored_external_id"), F.lit(f"un-merged {source}:{external_id} out of canonical {old_id} into {new_id} (reverses merge {merge_id})").alias("evidence"), now.alias("unmerged_at"),
    )
    return state | {
        "cis": cis.unionByName(born.select(*cis.columns)),
        "edges": edges.withColumn("valid_to", F.when(hit, now).otherwise(F.col("valid_to"))).unionByName(moved),
        "source_keys": repoint(state["source_keys"], key),
        "alias_keys": repoint(state["alias_keys"], own),
        "unmerges": state["unmerges"].unionByName(record),
    }


def listed(ledger: DataFrame, at: str, tie: str, ci_id: str | None = None, columns: tuple[str, ...] = ("canonical_ci_id", "merged_ci_id")) -> DataFrame:
    """Rows of the ledger, newest first; with ci_id those that name it."""
    if ci_id is not None:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c) == ci_id, F.lit(False))
        ledger = ledger.where(hit)
    return ledger.orderBy(F.desc(at), F.desc(tie))


def commit(store: Store, change, *args) -> dict:
    """Applies accept, dismiss or unmerge to a store's last version and commits what it changed; commits.Conflict if another writer was faster."""
    m, state = store.read()
    after = change(state, *args)
    return store.commit(m, {n: t for n, t in after.items() if t is not state[n]})
