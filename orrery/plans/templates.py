"""Questions answered by templates: a planner picks one and its arguments, these are checked, the operator runs, and its rows are told in a sentence.

A planner is a function question -> (template, arguments), as a language model with tools would be; `by_rules` is one of ordered patterns. No planner
writes a query. A sentence is one aggregated row, so an answer of any size passes no rows through the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import temporal, traversal
from ..schema import CI_TYPES

DECLINE = "I can't answer that with the available queries."
UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class Template:
    """rows: (state, arguments) -> the rows of an answer; told: (arguments) -> its sentence, an aggregate over the rows. An
    argument without a default (external_id) must be given."""

    rows: Callable[[dict, dict], DataFrame]
    told: Callable[[dict], Column]
    defaults: dict
    limits: dict[str, tuple[int, int]]

    def checked(self, args: dict) -> dict:
        """All arguments with defaults filled in; unknown ones are left out, ValueError for missing or impossible ones."""
        out = self.defaults | {k: v for k, v in args.items() if k in self.defaults}
        for name, value in out.items():
            if name in self.limits:
                low, high = self.limits[name]
                if isinstance(value, bool) or not re.fullmatch(r"[+-]?\d+", str(value)) or not low <= int(value) <= high:
                    raise ValueError(f"{name} must be from {low} to {high}, not {value!r}")
                out[name] = int(value)
            elif name == "external_id" and not isinstance(value, str):
                raise ValueError("external_id must be given")
            elif name == "type" and value is not None and value not in CI_TYPES:
                raise ValueError(f"no type {value!r}")
            elif name == "internet_only" and not isinstance(value, bool):
                raise ValueError("internet_only must be true or false")
        return out


def item(cis: DataFrame, external_id: str) -> DataFrame:
    """The id of the open item of an external id; where several types have it, the one of the least type and id."""
    named = F.when(F.col("external_id") == external_id, F.struct("type", "id"))
    return cis.where(F.col("external_id") == external_id).agg(F.min(named).alias("k")).where("k is not null").select("k.id")


def _count(one: str, more: str) -> Column:
    n = F.count(F.lit(1))
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more))


def _inventory(state: dict, args: dict) -> DataFrame:
    cis = state["open"] if args["type"] is None else state["open"].where(F.col("type") == args["type"])
    return cis.select("id", "type", "external_id", "name")


def _reachability(state: dict, args: dict) -> DataFrame:
    found = traversal.reachability(state["open"], state["open_edges"], item(state["open"], args["external_id"]), args["max_depth"], kept=state.get("kept"))
    return found.where("is_internet") if args["internet_only"] else found


def _reached(args: dict) -> Column:
    target = f"reach '{args['external_id']}'."
    if args["internet_only"]:
        return F.when(F.count(F.lit(1)) > 0, f"The internet can {target}").otherwise(f"The internet cannot {target}")
    return F.concat(_count("source", "sources"), F.lit(f" can {target}"))


TEMPLATES = {
    "inventory": Template(
        _inventory,
        lambda args: F.concat(F.lit("Found "), _count("configuration item", "configuration items"), F.lit(f" of type {args['type']}." if args["type"] else ".")),
        {"type": None}, {},
    ),
    "count_by_type": Template(
        lambda state, args: temporal.count_by_type(state["cis"]),
        lambda args: F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" configuration items across "), F.count(F.lit(1)).cast("string"), F.lit(" type(s).")),
        {}, {},
    ),
    "blast_radius": Template(
        lambda state, args: traversal.blast_radius(state["open"], state["open_edges"], item(state["open"], args["external_id"]), args["max_depth"], kept=state.get("kept")),
        lambda args: F.concat(_count("resource", "resources"), F.lit(f" would be impacted if '{args['external_id']}' failed.")),
        {"external_id": None, "max_depth": 4}, {"max_depth": (1, 10)},
    ),
    "recent_changes": Template(
        lambda state, args: temporal.change_feed(state["cis"], state["edges"], state["now"], args["days"]),
        lambda args: F.concat(_count("change", "changes"), F.lit(f" in the last {args['days']} days.")),
        {"days": 7}, {"days": (1, 30)},
    ),
    "reachability": Template(_reachability, _reached, {"external_id": None, "max_depth": 6, "internet_only": False}, {"max_depth": (1, 10)}),
}


def state_of(cis: DataFrame, edges: DataFrame, now: Column, kept=None) -> dict:
    """What templates read: versions of items and edges, the open ones among them, and with kept a projection of the graph to search."""
    return {"cis": cis, "edges": edges, "open": cis.where("valid_to is null"), "open_edges": edges.where("valid_to is null"), "now": now, "kept": kept}


def answer(state: dict, name: str, args: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, sentence) of a template with checked arguments; the sentence is one row (summary). An item that isn't there has no
    rows and a sentence that says so."""
    template = TEMPLATES[name]
    rows = template.rows(state, args)
    told = rows.agg(template.told(args).alias("summary"))
    if "external_id" in args:
        there = item(state["open"], args["external_id"]).agg((F.count(F.lit(1)) > 0).alias("there"))  # one row
        none = f"No configuration item found with id '{args['external_id']}'."
        told = told.crossJoin(F.broadcast(there)).select(F.when(F.col("there"), F.col("summary")).otherwise(none).alias("summary"))
    return rows, told


def ask(question: str, planner, state: dict) -> dict:
    """{question, answered, template, params, data, summary}: data are the rows of the answer, not yet computed, summary is its sentence. A question that no
    template answers, or whose arguments fail their checks, is declined."""
    name, args = planner(question) or (UNSUPPORTED, {})
    declined = {"question": question, "answered": False, "template": name if name in TEMPLATES else None, "params": {}, "data": None, "summary": DECLINE}
    if name not in TEMPLATES:
        return declined
    try:
        params = TEMPLATES[name].checked(args)
    except ValueError:
        return declined
    rows, told = answer(state, name, params)
    return declined | {"answered": True, "params": params, "data": rows, "summary": told.first().summary}


#: A name with a hyphen, or an ARN: what a question can mean by one resource.
NAMED = re.compile(r"\barn:\S+|\b[a-z0-9]+(?:-[a-z0-9]+)+\b", re.I)
PERIODS = {"day": 1, "week": 7, "fortnight": 14, "month": 30}


def _type_in(q: str) -> str | None:
    """The type whose words stand in a question, the longest name first."""
    for t in sorted(CI_TYPES, key=len, reverse=True):
        if re.search(rf"\b{t.replace('_', '[ _-]')}(s|es)?\b", q):
            return t
    return None


def _days_in(q: str) -> dict:
    if m := re.search(r"(\d+)\s+(day|week|month)s?\b", q):
        return {"days": int(m[1]) * PERIODS[m[2]]}
    return next(({"days": n} for word, n in PERIODS.items() if re.search(rf"\b{word}\b", q)), {})


def by_rules(question: str) -> tuple[str, dict]:
    """A planner of ordered patterns; what asks for a deed, or for nothing that a template has, is unsupported."""
    q = question.lower()
    says = lambda pattern: re.search(rf"\b(?:{pattern})", q) is not None
    named = NAMED.search(question)
    one = {"external_id": named[0]} if named else None
    if re.match(r"\s*(please )?(delete|remove|create|stop|start|terminate|restart|write|translate|update|scale)\b", q):
        return UNSUPPORTED, {}
    if one and says("reach|publicly|public|accessible|exposed"):
        return "reachability", one
    if one and says("break|depend|fail|affected|impact|blast|goes? down|lose"):
        return "blast_radius", one
    if says("chang|happened|new since"):
        return "recent_changes", _days_in(q)
    kind = _type_in(q)
    if says("how many|count|summary|by type|breakdown") and kind is None:
        return ("count_by_type", {}) if says("resource|inventory|item|type|infrastructure") else (UNSUPPORTED, {})
    if says("list|show|what|which|find|how many|count|inventory") and (kind or says("resources?|infrastructure|inventory|configuration items?")):
        return "inventory", {"type": kind} if kind else {}
    return UNSUPPORTED, {}


def score(planner, golden: list[tuple[str, str, dict | None]]) -> dict[str, float]:
    """Shares of (question, template, arguments or None) cases that a planner gets right: template, arguments (after checks, where they are
    given and the template is right), unsupported, overall."""
    seen = []
    for question, template, wanted in golden:
        name, args = planner(question) or (UNSUPPORTED, {})
        name = name if name in TEMPLATES else UNSUPPORTED
        graded = name == template and wanted is not None and name in TEMPLATES
        same = True
        if graded:
            try:
                same = TEMPLATES[name].checked(args) == TEMPLATES[name].checked(wanted)
            except ValueError:
                same = False
        seen.append((template, name == template, graded, same))
    share = lambda right: sum(right) / len(right) if right else 1.0
    return {
        "template": share([t for _, t, _, _ in seen]), "arguments": share([s for _, _, g, s in seen if g]),
        "unsupported": share([t for w, t, _, _ in seen if w == UNSUPPORTED]), "overall": share([t and s for _, t, _, s in seen]),
    }
