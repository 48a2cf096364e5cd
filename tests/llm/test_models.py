"""Language identification, language-model scores and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from orrery.llm import language_id, lm_score, queries
from pyspark.sql import functions as F


def test_language_accuracy(spark, data):
    lang = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id").lang.to_dict()
    got = queries.op3_language_id(spark, data).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def brute_viterbi(scores, penalty):
    best, paths = scores[0].copy(), [[k] for k in range(scores.shape[1])]
    for row in scores[1:]:
        new, grown = best.copy(), []
        for k in range(len(row)):
            j = max(range(len(row)), key=lambda j: best[j] - penalty * (j != k))
            new[k] = best[j] - penalty * (j != k) + row[k]
            grown.append([*paths[j], k])
        best, paths = new, grown
    return best.max(), paths[int(best.argmax())]


def test_labels_are_those_of_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(0, 30, 6)
        scores = rng.standard_normal((int(sizes.sum()), 3)) * 4 + np.repeat(rng.standard_normal((6, 3)) * 3, sizes, axis=0)
        first = np.concatenate([[0], np.cumsum(sizes)])
        labels = language_id.label_words(scores, first, 5.0)
        for a, b in zip(first, first[1:]):
            if b > a:
                value = scores[np.arange(a, b), labels[a:b]].sum() - 5.0 * (np.diff(labels[a:b]) != 0).sum()
                assert math.isclose(value, brute_viterbi(scores[a:b], 5.0)[0], abs_tol=1e-9)


def test_labels_of_two_languages_beside_a_third():
    scores = np.array([[0, -30, -8], [-30, 0, -8]], float)
    assert language_id.label_words(scores, np.array([0, 2]), 12.0).tolist() == [0, 1]
    rng = np.random.default_rng(6)
    for _ in range(200):
        halves = [np.repeat([[0, -30, -8, -20], [-30, 0, -8, -20]], rng.integers(1, 4, 2), axis=0) for _ in range(5)]
        scores = np.concatenate(halves) / rng.choice([1, 2, 4]) + rng.standard_normal((sum(map(len, halves)), 4))
        first = np.concatenate([[0], np.cumsum([len(x) for x in halves])])
        labels = language_id.label_words(scores, first, 12.0)
        for a, b in zip(first, first[1:]):
            value = scores[np.arange(a, b), labels[a:b]].sum() - 12.0 * (np.diff(labels[a:b]) != 0).sum()
            assert math.isclose(value, brute_viterbi(scores[a:b], 12.0)[0], abs_tol=1e-9)


def test_language_spans_and_odd_rows(spark, data, odd, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {lang: docs.where(F.col("lang") == lang).where("n_chars > 800").first().text[:800] for lang in ("en", "fr")}
    russian = spark.createDataFrame([(-5, "мир и дом на горе " * 30, "ru", "x", 1)], docs.schema)
    model = language_id.fit(docs.unionByName(russian))
    mixed = texts["en"] + " 🙂 " + texts["fr"] + " мир и дом"
    rows = [(1, mixed), (2, "日本語"), (3, "12 + 34"), (4, None), (5, "мир"), (6, "\u0301\u0301 \u0301"), (7, "12\u0301")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    spans = [s for s in got[1].spans if s.stop - s.start > 60]
    assert [s.lang for s in spans] == ["en", "fr"] and got[1].spans[-1].lang == "ru"
    assert abs(spans[0].stop - 800) < 60 and 0.3 < got[1].score < 0.7 and mixed[got[1].spans[-1].start :] == "мир и дом"
    assert got[2].score == 0 and got[2].lang_pred != "und"
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[5].lang_pred == "ru"
    assert language_id.identify(odd, model).count() == odd.count()
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.accepted(empty).count() == 0 and language_id.accepted(odd).columns == odd.columns


def brute_base(rows, learn):
    words = {k: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""] for k, t in rows}
    c = Counter(w for k, ws in words.items() if learn(k) for w in ws)
    n = sum(c.values())
    floor = n + 0.1 * (len(c) + 1)
    return {k: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / floor) for w in ws)) for k, ws in words.items()}


def test_scores(spark, data):
    df = pd.read_parquet(f"{data}/documents.parquet")
    got = queries.op10_lm_scoring(spark, data)
    want = brute_base(list(zip(df.doc_id.tolist(), df.text)), lambda k: zlib.crc32(str(k).encode()) % 10 != 0)
    for r in got.collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) and r.score < 0
    ppl = {r.held_out: r for r in lm_score.perplexity(got).collect()}
    assert ppl[True].perplexity < ppl[True].base_perplexity


def test_scores_odd_rows(spark, odd, empty):
    got = lm_score.scored(odd, F.coalesce(F.col("doc_id"), F.lit(1)) != 5).collect()
    assert len(got) == odd.count() and all(r.score <= 1e-9 and r.score > -1e6 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    frequent = {(r.doc_id, round(r.score, 4)) for r in got}
    assert {(r.doc_id, round(r.score, 4)) for r in lm_score.scored(odd, F.coalesce(F.col("doc_id"), F.lit(1)) != 5, frequent=2).collect()} == frequent
    assert lm_score.scored(empty, F.lit(True)).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in lm_score.scored(odd, F.lit(False)).collect())


def test_predictions_of_a_restaurant_sum_to_one(spark):
    texts = [f"a b a c d{k} a b e f" for k in range(20)]
    model = lm_score.fit(spark.createDataFrame([(t, True) for t in texts] + [("a z b", False)], "text string, learn boolean"))
    words = {r.word: r for r in model.words.collect()}
    assert model.total == sum(r.n for r in words.values()) == 20 * 10 and model.distinct == len(words) == 26
    cells = {(r.context, r.word): r.r for r in model.cells.collect()}
    pairs = Counter()
    for t in texts:
        tokens = lm_score.Tokens([t.encode()])
        pairs.update(zip(tokens.context.view(np.int64).tolist(), tokens.hash.view(np.int64).tolist()))
    assert set(cells) == {p for p, n in pairs.items() if n > 1}
    mean = lambda g, p: sum(x * y for x, y in zip(g, p)) / len(g)
    for v, r in words.items():
        p = [cells.get((v, w), 0.25 if pairs[v, w] else 0) * r.inverse + mean(r.weights, words[w].predictions) for w in words]
        assert min(p) > 0 and math.isclose(sum(p) + mean(r.weights, model.unknown), 1)


def test_tables_follow_their_distribution():
    keys = np.arange(200_000, dtype=np.int64)
    c = np.full(len(keys), 5)
    t = lm_score.drawn_tables(c, np.full(len(keys), 0.7), keys, 1, 0.5)
    s = [0, 1]
    for n in range(1, 5):
        s = [0] + [(s[k - 1] if k <= n + 1 else 0) + ((n - 0.5 * k) * s[k] if k <= n else 0) for k in range(1, n + 2)]
    weight = np.array([s[k] * 0.7**k for k in range(1, 6)])
    assert np.abs(np.bincount(t, minlength=6)[1:] / len(keys) - weight / weight.sum()).max() < 0.006
    for a in (0.01, 0.7, 5.0, 60.0, 2000.0):  # the normal distribution takes over where the exact one ends
        exact = lm_score.drawn_tables(np.full(4000, lm_score.EXACT), np.full(4000, a), keys[:4000], 3, 0.5).mean()
        beyond = lm_score.drawn_tables(np.full(4000, lm_score.EXACT + 1), np.full(4000, a), keys[:4000], 3, 0.5).mean()
        assert abs(exact - beyond) < 0.08 * exact + 0.3


def test_pipeline(spark, data, tmp_path):
    df = pd.read_parquet(f"{data}/documents.parquet")
    extra = pd.DataFrame({"doc_id": [10**6, 10**6 + 1], "text": ["123 !!", None], "lang": ["en"] * 2, "source": ["s"] * 2, "n_chars": [6, None]})
    pd.concat([df, extra]).astype({"n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "benchmark.parquet").symlink_to(f"{data}/benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs.count(), spark.read.parquet(path)
        assert docs.columns == names and (docs.count() < before or name in ("line dedup", "benchmark decontamination"))
    last = {r.doc_id for r in docs.collect()}
    assert 10**6 not in last and len(last) == docs.count() > 100
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == last
