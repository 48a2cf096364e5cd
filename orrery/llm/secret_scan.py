"""Secret scans: formatted secrets, and credentials whose parts stand apart, linked by an interval join."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points within which parts of one credential are looked for.
SCOPE = 300

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]+", re.A)
ASSIGN_VALUE, ACCESS_ALL, HEX_ALL = 6, 20, 24

#: Weak parts: an identifier, a secret and an endpoint, none of which says enough alone.
WEAK = {
    "identifier": re.compile(r"""(?ai:\b(?:user(?:name)?|login|client_?id|account(?:_?name)?|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.A),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.A),
    "endpoint": re.compile(r"(?ai:(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp)://[A-Za-z0-9._:@/-]+)", re.A),
}
#: What makes a weak part worth a report, if within SCOPE code points of it.
COMPLEMENTS = {"identifier": ("secret", "assign", "hex"), "secret": ("identifier", "access", "endpoint"), "endpoint": ("secret", "assign")}

PARTS = "doc_id long, text_key long, parts array<struct<kind:string,start:long,stop:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the formatted secrets, leftmost and not overlapping within each kind; what is too
    short has used its characters up and is dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_ALL]
    # The longest runs of hexadecimal digits: those of fewer than HEX_ALL needn't be made to be dropped.
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return out


_LONG_HEX = re.compile(rf"[0-9a-f]{{{HEX_ALL},}}", re.A)


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """base_spans() and the weak parts of a text."""
    found = base_spans(text)
    for kind, pattern in WEAK.items():
        found += [(f"weak_{kind}", m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans): for each document all spans (kind, start, stop) in code points by start, then kind.

    Kinds assign, access and hex are always reported. A weak identifier, secret or endpoint is reported, as
    weak_*, only when a complementary part stands within `scope` code points in the same document: parts are dealt
    to blocks of `scope` code points and joined with the parts of the same and the neighbouring blocks, so a document
    of many parts is many keys. Null text is empty; repeated rows give equal rows; a null doc_id is kept; other
    columns are left out.
    """

    def parts(batches):
        for batch in batches:
            found = [parts_of(x or "") for x in batch.column(1).to_pylist()]
            rows = [[{"kind": k, "start": a, "stop": b} for k, a, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "text_key", "parts"])

    from . import common

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    found = common.written(keyed.mapInArrow(parts, PARTS), "parts")
    weak_kind = lambda p: p["kind"].startswith("weak_")
    key = [F.coalesce("doc_id", F.lit(-1)).alias("_doc"), F.col("text_key").alias("_text")]
    each = found.where(F.exists("parts", weak_kind)).dropDuplicates(["doc_id", "text_key"]).select(*key, F.explode("parts").alias("p")).select("_doc", "_text", "p.*")
    pairs = found.sparkSession.createDataFrame([(f"weak_{a}", k) for a, others in COMPLEMENTS.items() for b in others for k in ((b,) if b in ("assign", "access", "hex") else (f"weak_{b}",))], "kind string, other string")
    weak = (
        each.where(F.col("kind").startswith("weak_"))
        .join(F.broadcast(pairs), "kind")  # a fixed table of a few rows
        .select("*", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("stop") / scope) + 1)).alias("block"))
    )
    other = each.select(F.col("_doc"), F.col("_text"), F.col("kind").alias("other"), F.col("start").alias("_start"), F.col("stop").alias("_stop")).withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / scope), F.floor(F.col("_stop") / scope))))
    near = (F.col("_start") <= F.col("stop") + scope) & (F.col("start") <= F.col("_stop") + scope)
    linked = (
        weak.alias("w")
        .join(other.alias("o"), (F.col("w._doc") == F.col("o._doc")) & (F.col("w._text") == F.col("o._text")) & (F.col("w.other") == F.col("o.other")) & (F.col("w.block") == F.col("o.block")) & near, "left_semi")
        .groupBy("_doc", "_text")
        .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("linked"))
    )
    out = found.withColumn("_doc", F.coalesce("doc_id", F.lit(-1))).join(linked.withColumnRenamed("_text", "text_key"), ["_doc", "text_key"], "left")
    strong = F.filter("parts", lambda p: ~weak_kind(p))
    spans = F.concat(strong, F.coalesce("linked", F.filter(strong, lambda p: F.lit(False))))
    return out.select("doc_id", F.transform(F.array_sort(F.transform(spans, _ordered)), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop"))).alias("spans"))


def _ordered(p):
    rank = F.when(p["kind"] == "assign", 0).when(p["kind"] == "access", 1).when(p["kind"] == "hex", 2).otherwise(3)
    return F.struct(p["start"].alias("start"), rank.alias("rank"), p["kind"].alias("kind"), p["stop"].alias("stop"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of scan()."""
    told = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["stop"])), ",")
    base = F.filter("spans", lambda p: ~p["kind"].startswith("weak_"))
    count = lambda kind: F.size(F.filter("spans", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
