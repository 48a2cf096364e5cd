"""SentencePiece encoding and decoding of whole texts with a BPE model: exact merges by backtracking."""

from __future__ import annotations

import codecs
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Chunks, and pairs of adjacent tokens, that a Python worker remembers.
CHUNKS, PAIRS = 400_000, 1_000_000
BLANK, REPLACEMENT, UNKNOWN = "▁", "�", " ⁇ "

codecs.register_error("orrery.each_byte", lambda e: (REPLACEMENT * (e.end - e.start), e.end))


class Model:
    """The vocabulary of a model file: scores of the pieces that merges make, an automaton that finds them, and their ids.

    Tokens are numbers of pieces here. A character that occurs inside pieces without being one is a token of its own that
    is written as bytes; any other character outside the vocabulary is never part of a merge and parts a text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, kinds = proto.normalizer_spec, schema.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != schema.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be of the merge type and write unknown characters as bytes")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("the model must take texts as they are, with blanks escaped")
        if any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in proto.pieces):
            raise ValueError("models with unused or user-defined pieces aren't supported")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (proto.trainer_spec.bos_id, proto.trainer_spec.eos_id))
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.score = {p.piece: p.score for _, p in normal}
        self.byte_ids = [np.array([byte_ids[b]], "<u4").tobytes() for b in range(256)]
        only_inside = sorted(set("".join(self.score)) - self.score.keys())
        self.text = [p.piece for _, p in normal] + only_inside
        self.written = [np.array([i], "<u4").tobytes() for i, _ in normal] + [self.as_bytes(c) for c in only_inside]
        number = {t: k for k, t in enumerate(self.text)}
        self.length = [len(t) for t in self.text]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

        # Merges stay between two places of a text where no piece reaches across: before blanks, unless pieces hold blanks inside, and at
        # ASCII characters that are in no piece.
        apart = "".join(re.escape(chr(b)) for b in range(128) if chr(b) not in number and chr(b) != " ")
        inner = any(BLANK in t.lstrip(BLANK) for t in self.text)
        word = f"[^{apart}]+" if apart else "(?s:.)+"
        if not inner:
            word = f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+"
        self.chunks = re.compile(f"{word}|[{apart}]+" if apart else word).findall

        # What a decoder writes for each id; the first piece loses the blank that stands for the start of the text.
        special = {kinds.CONTROL: b"", kinds.UNKNOWN: UNKNOWN.encode()}
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else special.get(p.type, p.piece.replace(BLANK, " ").encode()) for p in proto.pieces]
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.opening = {i for i, p in normal if self.prefix and p.piece.startswith(BLANK)}

    def as_bytes(self, text: str) -> bytes:
        return b"".join(self.byte_ids[b] for b in text.encode())

    def merged(self, text: str) -> list[str]:
        """The merges themselves, one by one: the pair of the best score, the leftmost of equal ones. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the texts of two tokens again gives these two; left -1: whether right alone gives itself.

        Merges inside a stretch that no merge crosses don't depend on what is around it. So tokens are those of the merges
        exactly if each two neighbours are compatible."""
        key = left * len(self.text) + right
        known = self.pairs.get(key)
        if known is None:
            both = self.text[left : left + 1] if left >= 0 else []
            both = [*both, self.text[right]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged("".join(both)) == both
        return known

    def tokens(self, text: str, longest: list[int]) -> list[int]:
        """Tokens of a text without characters outside the vocabulary; longest[i] is the longest piece that starts at i.

        The longest piece comes first, then its prefixes. A place from which nothing fits is marked as failed and not
        entered again, so the steps are linear in the text."""
        size, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        failed = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0 and (failed[at + length[token]] or not compatible(last, token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == size:
                    return out
                token = longest[at]
            else:
                failed[at] = 1
                token = out.pop()
                at -= length[token]

    def encode(self, chunk: str) -> bytes:
        """Ids of a chunk, little-endian unsigned 32-bit."""
        length = self.length
        longest = [-1] * len(chunk)
        for last, token in self.automaton.iter(chunk):  # a longer piece of the same start ends, and comes, later
            longest[last + 1 - length[token]] = token
        if -1 not in longest:
            return b"".join([self.written[t] for t in self.tokens(chunk, longest)])
        out, at = [], 0
        while at < len(chunk):
            known = longest[at] >= 0
            to = at
            while to < len(chunk) and (longest[to] >= 0) == known:
                to += 1
            out.append(b"".join([self.written[t] for t in self.tokens(chunk[at:to], longest[at:to])]) if known else self.as_bytes(chunk[at:to]))
            at = to
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), None)
        cuts = [0, *(k for k in range(1, len(ids) - 1) if ids[k] in self.control), len(ids)]  # bytes on both sides form no character
        parts = [b"".join([self.surface[i] for i in ids[a:b]]).decode("utf-8", "orrery.each_byte") for a, b in zip(cuts, cuts[1:])]
        out = "".join(parts)
        return out[1:] if first in self.opening else out


class _Encoder(dict):
    """Ids of chunks met before."""

    def __init__(self, path: str):
        self.model = Model(path)

    def __missing__(self, chunk: str) -> bytes:
        found = self.model.encode(chunk)
        if len(self) >= CHUNKS:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        m = self.model
        chunks = m.chunks(m.prefix + text.replace(" ", BLANK)) if text else []
        return b"".join((m.begin, *map(self.__getitem__, chunks), m.end))


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text with begin and end, as little-endian unsigned 32-bit binary.

    A null text counts as empty; an empty text is begin and end. Null doc_ids and repeated rows stay rows of their own, other
    columns are left out, an empty table gives an empty one."""

    def encoded(batches):
        encoder = _encoder(model_path)
        for batch in batches:
            names, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                names.append(doc_id.as_py())
                held.append(encoder.ids(text.as_py() or ""))
                size += len(held[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "ids"])
                    names, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replaces the column of ids by the text that they stand for; other columns stay.

    Begin and end write nothing, unknown ids a mark, bytes that form no character a replacement each. Null ids give the empty
    text; ids outside the vocabulary and binaries of a length that is no multiple of four are an error."""
    others = [c for c in encoded.columns if c != ids]
    schema = StructType([*(encoded.schema[c] for c in others), StructField(out, StringType())])

    def decoded(batches):
        model = _encoder(model_path).model
        for batch in batches:
            texts = [model.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(texts, pa.string())], names=[*others, out])

    return encoded.select(*others, ids).mapInArrow(decoded, schema)


def report(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()."""
    told = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    out = decode(told, model_path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
