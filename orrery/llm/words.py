"""Word boundaries and 64-bit word hashes of many texts at once, with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are looked at together; bounds the memory of a task besides one text of its own.
SLICE_BYTES = 2_000_000


def _mix_scalar(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


#: A fixed random odd value for each byte, and the lower-casing of A-Z.
BYTE_VALUES = np.array([_mix_scalar(i) | 1 for i in range(256)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = _mix_scalar(1 << 20) | 1

#: Bytes of words: all but white space, and all but ASCII that is neither a digit nor a letter.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(BASE, len(_powers), 2**64))])
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > limit:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: `buf` (lower-cased bytes), `starts`, `ends`, `doc` (index of the text),
    `first` (index of each text's first word, and the number of words last) and `hash`."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.buf = buf = LOWER[np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = np.concatenate([[0], np.cumsum(lengths)])
        inside = is_word[buf]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.first = np.searchsorted(self.starts, edges)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if len(self.starts):
            size = self.ends - self.starts
            at = np.flatnonzero(inside)
            offset = np.cumsum(size) - size
            place = np.arange(len(at)) - np.repeat(offset, size)
            value = BYTE_VALUES[buf[at]] * powers(int(size.max()))[place]
            self.hash = mix(np.add.reduceat(value, offset) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values: a hash for every start, len - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n]
    return mix(out)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty. Lone surrogates can't occur in Arrow."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
