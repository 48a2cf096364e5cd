"""Benchmark decontamination: word windows of benchmark items found in documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .words import LETTER_DIGIT, Words, encoded, slices, window_hashes

WINDOW = 10
#: Most benchmark windows (some 60 bytes each) that are sent to every executor at once. A larger benchmark is
#: sent and scanned for in as many blocks.
BLOCK_WINDOWS = 1_000_000

HITS = "doc_id long, n_words long, hits array<struct<start:long,stop:long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class WindowIndex:
    """The windows of benchmark items, by hash; equal words are checked after equal hashes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        found: dict[int, dict[bytes, set[str]]] = {}
        self.widths: dict[int, np.ndarray] = {}
        by_width: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            w = Words([text], LETTER_DIGIT)
            width = min(window, len(w.hash))
            if not width:
                continue
            hashes = window_hashes(w.hash, width)
            by_width.setdefault(width, []).append(hashes)
            for i, h in enumerate(hashes.tolist()):
                words = b" ".join(w.text(j) for j in range(i, i + width))
                found.setdefault(h, {}).setdefault(words, set()).add(item_id)
        self.widths = {k: np.unique(np.concatenate(v)) for k, v in by_width.items()}
        self.found = found

    def scan(self, texts: list[bytes]):
        """For each text: its number of words, hit word ranges (start, stop) and item ids."""
        for a, b in slices(texts):
            w = Words(texts[a:b], LETTER_DIGIT)
            out = [([], set()) for _ in range(b - a)]
            for width, known in self.widths.items():
                hashes = window_hashes(w.hash, width)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                maybe = np.flatnonzero(known[at] == hashes)
                for i in maybe[w.doc[maybe] == w.doc[maybe + width - 1]].tolist():
                    items = self.found[int(hashes[i])].get(b" ".join(w.text(j) for j in range(i, i + width)))
                    if items:
                        d = w.doc[i]
                        out[d][0].append((i - int(w.first[d]), i - int(w.first[d]) + width))
                        out[d][1].update(items)
            yield from zip(np.diff(w.first).tolist(), out)


def _spans(hits: list[tuple[int, int]]) -> list[dict]:
    spans: list[list[int]] = []
    for a, b in sorted(hits):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [{"start": a, "stop": b} for a, b in spans]


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> list:
    """Broadcasts of (item_id, text) rows, each of about `block_windows` windows at most; none if there is no item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), common.text_or_empty().alias("text"))
    # A window starts at a word and a word takes two bytes with its end, so half the bytes bound the windows.
    size = items.select(F.sum((F.octet_length("text") / 2 + 1).cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_windows))
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(items.sparkSession.sparkContext.broadcast(([(r.item_id, r.text.encode()) for r in part.collect()], window)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, hits, items): for each document, the ranges of words that any benchmark window covers,
    and the item ids, sorted as strings, whose windows occur.

    The benchmark's windows, `block_windows` at most, are broadcast and the documents scanned in place; of a larger
    benchmark block after block is scanned for, without a shuffle of the documents. Null or wordless documents have
    no hits; null or wordless items have no windows; a null item_id is the empty string; repeated rows are
    scanned each by itself; columns besides doc_id, text, item_id are left out.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    blocks = _blocks(benchmark, window, block_windows)
    for k, index in enumerate(blocks):
        last = k == len(blocks) - 1
        out = out.mapInArrow(_scanner(index, k > 0, last), HITS if last else "doc_id long, text string, " + HITS[len("doc_id long, ") :])
    return out


def _scanner(index, seen: bool, last: bool):
    def scan(batches):
        rows, window = index.value
        known = WindowIndex(rows, window)
        for batch in batches:
            found = list(known.scan(encoded(batch.column("text"))))
            hits, items = [h for _, (h, _) in found], [i for _, (_, i) in found]
            if seen:
                hits = [h + [(s["start"], s["stop"]) for s in o] for h, o in zip(hits, batch.column("hits").to_pylist())]
                items = [i | set(o) for i, o in zip(items, batch.column("items").to_pylist())]
            columns = {"doc_id": batch.column("doc_id")} | ({} if last else {"text": batch.column("text")})
            columns |= {"n_words": pa.array([n for n, _ in found], pa.int64()), "hits": pa.array(list(map(_spans, hits)), SPANS)}
            columns |= {"items": pa.array(list(map(sorted, items)), pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with benchmark passages cut out, in the columns of docs. A document of whose words hit
    passages cover `drop_share` or more goes as a whole; of others the hit words go, with what stands
    between them. The uncut text is scanned for all blocks of the benchmark first, each handing its spans to the next; the
    last one decides and cuts."""
    schema, at = docs.schema, docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    carried = "_hits"
    while carried in docs.columns:
        carried += "_"
    wide = StructType([*schema.fields, *StructType.fromDDL(f"`{carried}` array<struct<start:long,stop:long>>").fields])

    def cleaner(index, seen, last):
        def cut(batches):
            rows, width = index.value
            known = WindowIndex(rows, width)
            for batch in batches:
                texts = encoded(batch.column(at))
                found = [(n, hits) for n, (hits, _) in known.scan(texts)]
                if seen:
                    found = [(n, h + [(s["start"], s["stop"]) for s in o]) for (n, h), o in zip(found, batch.column(batch.num_columns - 1).to_pylist())]
                    batch = batch.select(range(batch.num_columns - 1))
                if not last:
                    columns = [*batch.columns, pa.array([_spans(h) for _, h in found], SPANS)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, carried])
                    continue
                keep, new = [], []
                for i, (x, (n, hits)) in enumerate(zip(texts, found)):
                    spans = _spans(hits)
                    if spans and sum(s["stop"] - s["start"] for s in spans) >= drop_share * n:
                        continue
                    keep.append(i)
                    new.append(_without(x, spans) if spans else batch.column(at)[i].as_py())
                kept = batch.take(pa.array(keep, pa.int64()))
                columns = list(kept.columns)
                columns[at] = pa.array(new, kept.schema.field(at).type)
                if count is not None:
                    columns[count] = pa.array([None if c is None else len(x or "") if x != o else c for c, x, o in zip(kept.column(count).to_pylist(), new, kept.column(at).to_pylist())], kept.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=kept.schema)

        return cut

    blocks = _blocks(benchmark, window, block_windows)
    for k, index in enumerate(blocks):
        last = k == len(blocks) - 1
        docs = docs.mapInArrow(cleaner(index, k > 0, last), schema if last else wide)
    return docs


def _without(text: bytes, spans: list[dict]) -> str:
    w = Words([text], LETTER_DIGIT)
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : w.starts[s["start"]]])
        at = w.ends[s["stop"] - 1]
    return b"".join([*parts, text[at:]]).decode()


def sha256_of(items: list[str]) -> str:
    """What report() gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
