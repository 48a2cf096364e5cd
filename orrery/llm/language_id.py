"""Language identification: scripts narrow the candidates, and Viterbi with a switching penalty labels the words."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import encoded, slices

#: Hashed letter trigrams, most languages, what a change of language costs (natural logarithms) and the share of a
#: language's letters that makes a script one of its own.
BUCKETS, LANGUAGES, PENALTY, SCRIPT_SHARE = 1 << 16, 500, 12.0, 0.01
#: Score of a word for a language that doesn't write its script.
FOREIGN = -100.0
#: Cells (words times documents times languages) that one step of the full search holds at most, but for one document.
CELLS = 8_000_000

# The Unicode ranges of scripts, as first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

COUNTS = "lang string, feature int, n long"
SPANS = "array<struct<lang:string,start:long,stop:long>>"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and its script from 1 (others last) if it is a letter or a mark, else 0."""
    lower = np.arange(0x110000, dtype=np.uint32)
    script = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            script[i] = len(SCRIPTS) + 1
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = script[a : b + 1]
            part[part > 0] = k + 1
    return lower, script


@functools.cache
def _marks() -> np.ndarray:
    """Of each code point, whether it is a mark."""
    return np.array([unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)])


class Letters:
    """Words (runs of letters of one script) of some texts: `starts` and `sizes` of words among the letters, `at` (code
    point offset in its text) and `feature` of each letter, `script` and `doc` of each word, `first` word of each text."""

    def __init__(self, texts: list[bytes]):
        lower, script = _tables()
        decoded = [x.decode() for x in texts]
        points = np.frombuffer(" ".join([*decoded, ""]).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in decoded], np.int64) + 1
        base = np.concatenate([[0], np.cumsum(lengths)])
        kind = script[points]
        # Marks go on with a word but don't begin one: those without a letter before them in their run are left out.
        place = np.arange(len(points))
        kind[_marks()[points] & (np.maximum.accumulate(np.where((kind > 0) & ~_marks()[points], place, -1)) <= np.maximum.accumulate(np.where(kind == 0, place, -1)))] = 0
        letter = kind > 0
        low = np.where(letter, lower[points], 0).astype(np.uint64)
        place = np.flatnonzero(letter)
        padded = np.concatenate([np.zeros(1, np.uint64), low, np.zeros(1, np.uint64)])
        before = padded[place]
        after = padded[place + 2]
        h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low[place] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
        self.feature = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
        k = kind[place]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | (k[1:] != k[:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.concatenate([self.starts, [len(place)]]))
        self.script = k[self.starts]
        self.first = np.searchsorted(place[self.starts], base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.at = place[self.starts] - base[self.doc]


def learned_counts(docs: DataFrame) -> DataFrame:
    """COUNTS over all rows of (text, lang): of each trigram bucket, and of letters by script as feature -script."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        wide = BUCKETS + len(SCRIPTS) + 2
        for batch in batches:
            texts, langs = encoded(batch.column(0)), batch.column(1).to_pylist()
            for a, b in slices(texts):
                w = Letters(texts[a:b])
                letters = np.repeat(w.doc, w.sizes)
                scripts = np.repeat(w.script, w.sizes).astype(np.int64)
                names = {x: k for k, x in enumerate(dict.fromkeys(langs[a:b]))}
                of = np.array([names[x] for x in langs[a:b]], np.int64)[letters]
                n = np.bincount(of * wide + w.feature, minlength=len(names) * wide) + np.bincount(of * wide + BUCKETS + scripts, minlength=len(names) * wide)
                for x, k in names.items():
                    total[x] = total.get(x, 0) + n[k * wide : (k + 1) * wide]
        for x, n in total.items():
            some = np.flatnonzero(n)
            feature = np.where(some < BUCKETS, some, BUCKETS - some)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(feature, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "feature", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, COUNTS)
    return rows.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of trigram buckets by language, and the languages that write each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        n = counts + 0.5
        self.logp = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.writes = share >= SCRIPT_SHARE
        self.common = int(scripts.sum(1).argmax()) if langs else 0

    def word_scores(self, w: Letters) -> np.ndarray:
        """Scores (words by languages): 0 for all where no language writes the word's script."""
        out = np.zeros((len(w.starts), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.logp[k][w.feature], w.starts)
        fits = self.writes[:, w.script].T
        out[~fits] = FOREIGN
        out[~fits.any(1)] = 0
        # a word that nobody can spell shouldn't outweigh the rest: what counts is the difference between languages
        return out - out.max(1, keepdims=True)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """For each document (words by languages) its labels of the highest sum of scores less penalties; documents of
    similar length go through the words together."""
    out: list[np.ndarray] = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    while order:
        n, languages = len(scores[order[-1]]), scores[order[-1]].shape[1]
        group = [order.pop()]
        while order and (len(group) + 1) * n * languages <= CELLS and len(scores[order[-1]]) * 2 >= n:
            group.append(order.pop())
        padded = np.zeros((n, len(group), languages))
        for g, i in enumerate(group):
            padded[: len(scores[i]), g] = scores[i]
        best, came = padded[0], np.zeros((n, len(group), languages), np.int16)
        stay = np.arange(languages, dtype=np.int16)[None, :]
        for t in range(1, n):
            top = best.argmax(1)
            switch = best[np.arange(len(group)), top][:, None] - penalty
            came[t] = np.where(best >= switch, stay, top[:, None])
            best = np.maximum(best, switch) + padded[t]
        label = best.argmax(1)
        path = np.empty((n, len(group)), np.int16)
        for t in range(n - 1, -1, -1):
            path[t] = label
            label = came[t][np.arange(len(group)), label]
        for g, i in enumerate(group):
            out[i] = path[: len(scores[i]), g]
    return out


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Viterbi labels of the words of texts. A text has its best language throughout if no other beats that by more than
    the penalty in any stretch of words, nor any two together in a beginning and an end: a path that comes to the best
    language pays a penalty for each stretch of another, and one that doesn't for each but one. Only
    the other texts take the search."""
    full = np.flatnonzero(np.diff(first) > 0)
    labels = np.zeros(len(scores), np.int16)
    if not len(full):
        return labels
    starts, stops = first[full], first[full + 1]
    best = np.add.reduceat(scores, starts, axis=0).argmax(1)
    labels[:] = np.repeat(best, stops - starts)
    own = scores[np.arange(len(scores)), labels]
    gain, head, tail = np.zeros((3, len(full)))
    for k in range(scores.shape[1]):
        d = scores[:, k] - own
        c = np.cumsum(d)
        c -= np.repeat(c[starts] - d[starts], stops - starts)
        far = 2 * np.abs(c).max() + 1
        down = np.repeat(np.arange(len(full)) * far, stops - starts)
        low = np.minimum.accumulate(np.minimum(c - d, c) - down) + down
        gain = np.maximum(gain, np.maximum.reduceat(c - low, starts))
        head = np.maximum(head, np.maximum.reduceat(c, starts))
        tail = np.maximum(tail, c[stops - 1] - np.minimum.reduceat(c - d, starts))
    hard = np.flatnonzero((gain > penalty) | (head + tail > penalty))
    for i, path in zip(hard, viterbi([scores[starts[i] : stops[i]] for i in hard], penalty)):
        labels[starts[i] : stops[i]] = path
    return labels


def fit(docs: DataFrame) -> Model:
    """A model of all rows of (text, lang). Its counts, BUCKETS and a few for each of LANGUAGES at most, are broadcast."""
    rows = learned_counts(docs)
    rows = common.written(rows, "counts")
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    at = {x: k for k, x in enumerate(langs)}
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPTS) + 2))
    for r in rows.toLocalIterator():
        if r.feature >= 0:
            counts[at[r.lang], r.feature] = r.n
        else:
            scripts[at[r.lang], -r.feature] = r.n
    return Model(langs, counts, scripts)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row: spans are stretches of words of one language, by code points;
    lang_pred is the language of most letters, `und` without a letter; score is its share of the letters
    and, if all words are of one language, times the probability that they give it over the next best one.

    Letters of scripts that no learned language writes count against the score. Null and empty texts are `und`
    with score 0, as all are if nothing was learned; repeated rows give equal rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                found = _predicted(m, Letters(texts[a:b]), b - a, penalty)
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found[:2], (pa.string(), pa.float64())), pa.array(found[2], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(predict, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def _predicted(m: Model, w: Letters, n: int, penalty: float) -> tuple[list, list, list]:
    names, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    if not m.langs or not len(w.starts):
        return names, score, spans
    scores = m.word_scores(w)
    labels = label_words(scores, w.first, penalty)
    known = m.writes[:, w.script].any(0)
    for i in range(n):
        a, b = w.first[i], w.first[i + 1]
        if a == b:
            continue
        letters = np.bincount(labels[a:b], w.sizes[a:b] * known[a:b], len(m.langs))
        k = int(letters.argmax()) if letters.any() else m.common
        total = scores[a:b].sum(0)
        rival = np.delete(total, k).max() if len(total) > 1 else -np.inf
        sure = 1 / (1 + np.exp(np.clip(rival - total[k], -500, 500)))
        share = letters[k] / w.sizes[a:b].sum()
        names[i], score[i] = m.langs[k], float(share * (sure if labels[a:b].min() == labels[a:b].max() else 1))
        turns = np.concatenate([[0], np.flatnonzero(np.diff(labels[a:b])) + 1, [b - a]])
        spans[i] = [{"lang": m.langs[labels[a + p]], "start": int(w.at[a + p]), "stop": int(w.at[a + q - 1] + w.sizes[a + q - 1])} for p, q in zip(turns, turns[1:])]
    return names, score, spans


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that the query doesn't learn from."""
    return common.crc_mod(doc_id, 4) == 2


def accepted(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows of docs (all columns) whose language is known: not `und`, and with a score of min_score or more.
    Learns from the rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        m = shared.value
        for batch in batches:
            texts = encoded(batch.column(at))
            ok = []
            for a, b in slices(texts):
                names, score, _ = _predicted(m, Letters(texts[a:b]), b - a, PENALTY)
                ok += [x != "und" and s >= min_score for x, s in zip(names, score)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
