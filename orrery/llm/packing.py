"""Best-fit packing of tokenised documents into sequences of fixed length (minimum bin slack)."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

CAPACITY = 4096
#: Chunks between blanks whose ids a Python worker remembers.
CACHE = 400_000

# The letters and digits of Latin-1 and the splitting rule of the tokenizer file, for which
# test_packing holds the short way against the tokenizer itself.
_L, _N = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")


class _Chunks(dict):
    """Ids, as bytes, of a chunk between blanks. Tokens never span white space, so a text's ids are those of
    its chunks. Chunks of printable Latin-1 are split here and go to the tokenizer's model word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model.tokenize
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self.shown = {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(others)}}

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids = [t.id for w in _PIECES.findall(chunk.lower()) for t in self.model(w.encode().decode("latin-1").translate(self.shown))]
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        if len(self) >= CACHE:
            self.clear()
        found = np.array(ids, "<u4").tobytes()
        if len(chunk) < 100:
            self[chunk] = found
        return found


@functools.cache
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of each text and `end_id`, cut only where they are
    more than `capacity`; ids are little-endian unsigned 32-bit. Null text counts as empty; empty text is the
    end alone; a null doc_id and repeated rows stay as rows of their own; other columns are left out."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def pieces(batches):
        chunks = _chunks(tokenizer_path)
        get = chunks.__getitem__
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(get, (text.as_py() or "").replace("\n", " ").split(" "))) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    rows.append((doc_id, k, at // 4, min(step, len(ids) - at) // 4, ids[at : at + step]))
                held += len(ids)
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids"])


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """(length, count) pairs of the fullest combination within `room`. Bit s of the bitset says that sum s is
    reachable; lengths join in falling order, in powers of two of their count, until `room` itself is."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for x in lengths:
        if x > room:
            continue
        most, k = min(left[x], room // x), 1
        while most:
            k = min(k, most)
            grown = (reach | reach << (x * k)) & mask
            if grown != reach:
                steps.append((x, k, reach))
                reach = grown
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            used[x] = used.get(x, 0) + k
            at -= x * k
    return list(used.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over the counts of each length (at most `capacity` of them, whatever the corpus):
    the longest piece left opens a bin, the fullest combination fills it, and the bin repeats as long as its
    pieces last. Rows (length, from rank, to rank, per bin, first bin, offset): pieces of that length with
    such ranks lie in bins from `first bin`, `per bin` of them one after another from `offset`."""
    left = {x: n for x, n in counts.items() if n}
    lengths = sorted(left, reverse=True)
    taken = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while lengths:
        x = lengths[0]
        left[x] -= 1
        rest = fullest(capacity - x, lengths, left)
        left[x] += 1
        used = dict(rest)
        used[x] = used.get(x, 0) + 1
        times = min(left[y] // k for y, k in used.items())
        offset = 0
        for y, k in sorted(used.items(), reverse=True):
            rows.append((y, taken[y], taken[y] + k * times, k, bins, offset))
            taken[y] += k * times
            left[y] -= k * times
            offset += y * k
        bins += times
        lengths = [y for y in lengths if left[y]]
    return rows


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to capacity).

    The plan is made from a histogram of at most `capacity` rows; pieces are ranked within their length over
    all executors and look their place up in the plan.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted(plan(counts, capacity))
    n = sum(counts.values())
    far = 1 << 40
    table = np.array(rows, np.int64).reshape(-1, 6)
    key = table[:, 0] * far + table[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((key, table))
    numbered = common.ranked(pieces, ["length"], ["doc_id", "piece", "start"], n, "_rank")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = pieces.columns

    def look_up(batches):
        key, table = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            t = table[np.searchsorted(key, length * far + rank, "right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            k = rank - t[:, 1]
            own = [pa.array(t[:, 4] + k // np.maximum(t[:, 3], 1)), pa.array(t[:, 5] + k % np.maximum(t[:, 3], 1) * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=[*names, "sequence_id", "offset"])

    return numbered.select(*names, "_rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every document packed into sequences."""
    return placed(common.written(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, at most `capacity` tokens each."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return held.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
