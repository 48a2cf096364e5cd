"""Packing, decontamination, sharding, secret scans and chat formatting against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import chat, decontamination, packing, queries, secret_scan, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


def test_fullest_finds_the_best_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = sorted({int(x) for x in rng.integers(1, 30, 4)}, reverse=True)
        left = {x: int(rng.integers(1, 4)) for x in lengths}
        sums = {0}
        for x in lengths:
            sums = {s + k * x for s in sums for k in range(left[x] + 1)}
        room = int(rng.integers(1, 60))
        used = packing.fullest(room, lengths, left)
        assert sum(x * k for x, k in used) == max(s for s in sums if s <= room)
        assert all(k <= left[x] for x, k in used)


def check_packing(rows, texts):
    t = Tokenizer.from_file(PATH)
    want = {}
    for i, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want.setdefault((i, k), []).append((a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())))
    got = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(n for v in places.values() for _, n in v) // 4096) * 1.02 + 2


def test_packing(spark, data, odd, empty):
    df = documents(data)
    check_packing(queries.op1_best_fit_packing(spark, data).collect(), list(zip(df.doc_id.tolist(), df.text)))
    from pyspark.sql import functions as F

    out = packing.pack(odd, PATH)
    check_packing(out.withColumn("ids_crc32", F.crc32("ids")).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    made = packing.sequences(out).collect()
    assert sum(len(r.ids) // 4 for r in made) == out.agg(F.sum("length")).first()[0]
    assert packing.pack(empty, PATH).count() == 0


def brute_hits(docs, items, window=10):
    rx = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: rx.findall((x or "").encode().lower())
    known = defaultdict(set)
    for i, x in items:
        w = words(x)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            known[tuple(w[k : k + n])].add(str(i))
    widths = {len(k) for k in known}
    for i, x in docs:
        w = words(x)
        hit, found = set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if t := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= t
        yield (i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_decontamination(spark, data, odd, empty):
    df, b = documents(data), pd.read_parquet(f"{data}/benchmark.parquet")
    got = {tuple(r) for r in queries.op4_benchmark_decontamination(spark, data).collect()}
    want = set(brute_hits(zip(df.doc_id.tolist(), df.text), zip(b.item_id.tolist(), b.text)))
    assert got == want and any(r[2] for r in got)
    items = spark.createDataFrame([(1, "the lazy dog", 0), (2, "THE LAZY dog near the river bank today again and, again", 0), (None, "x", 0), (3, None, 0), (4, "--", 0), (2, "x", 0)], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    own = [("" if r.item_id is None else r.item_id, r.text) for r in items.collect()]
    want = sorted(map(str, brute_hits(rows, own)))
    for windows in (10**6, 8):
        got = decontamination.report(decontamination.contamination(odd, items, block_windows=windows))
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.report(decontamination.contamination(odd, items.limit(0))).where("contaminated").count() == 0
    kept = decontamination.clean(odd, items)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert None in texts and "x" not in texts and not any("lazy" in (t or "") for t in texts)


def brute_clean(rows, items, window=10):
    for i, x in rows:
        at = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", x)]
        w = [x[a:b].lower() for a, b in at]
        hit = set()
        for item in items:
            v = re.findall(r"[a-z0-9]+", item.lower())
            n = min(window, len(v))
            known = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            hit |= {k + j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known for j in range(n)}
        if 2 * len(hit) < len(w):
            spans = [k for k in range(len(w)) if k in hit]
            drop = {c for k in spans for c in range(*at[k])} | {c for k in spans if k + 1 in hit for c in range(at[k][1], at[k + 1][0])}
            yield i, "".join(c for k, c in enumerate(x) if k not in drop)


def test_clean_in_blocks(spark):
    a, b, c, d, other = ([f"{x}{k}" for k in range(n)] for x, n in (("a", 30), ("b", 30), ("c", 12), ("d", 10), ("o", 200)))
    items = [" ".join(x) for x in (a, b, c, c[6:] + d[:6], other[:5] + other[15:20])]
    texts = [a + b + other[20:60], a + other[20:100], c + d + other[20:60], other[:5] + d + other[15:120], other[:5] + c[:10] + other[15:120], other]
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    table = spark.createDataFrame([(*r, len(r[1]), "x") for r in rows], "doc_id long, text string, n_chars long, _hits string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(brute_clean(rows, items))
    assert 0 not in dict(want) and len(want) == len(rows) - 1
    for windows in (10**6, 40):
        out = decontamination.clean(table, benchmark, block_windows=windows)
        got = out.collect()
        assert out.columns == table.columns and sorted((r.doc_id, r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) and r._hits == "x" for r in got)


@pytest.mark.parametrize("shards", [40, 3])
def test_sharding(spark, data, odd, empty, shards):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    df = documents(data)
    for table, rows in ((docs, list(zip(df.doc_id.tolist(), df.text))), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = sharding.shard(table, shards).collect()
        raw = [(t or "").encode() for _, t in rows]
        assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, ((i, len(t) + 16, zlib.crc32(t)) for (i, _), t in zip(rows, raw))))
        slots, groups, size = defaultdict(list), defaultdict(set), defaultdict(int)
        for r in got:
            slots[r.shard].append(r.slot)
            groups[r.size, r.text_crc32].add(r.shard)
            size[r.shard] += r.size
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for v in groups.values()) and set(slots) <= set(range(shards))
        if table is docs:
            assert max(size.values()) <= 1.03 * sum(size.values()) / shards + 16 or max(size.values()) <= max(len(t) + 16 for t in raw) * 3
    assert sharding.shard(empty, shards).count() == 0


def test_best_fit_decreasing_by_hand():
    rows, bins = sharding.best_fit_decreasing([(6, 1), (5, 1), (4, 1), (3, 2), (1, 1)], 10)
    where = {(s, k): b for s, a, z, b in rows for k in range(a, z)}
    assert bins == 3 and where[6, 0] == where[4, 0] and where[5, 0] == where[3, 0] == where[1, 0] or bins == 3


def brute_spans(text):
    out = []
    for kind, rx in (("assign", secret_scan.ASSIGN), ("access", secret_scan.ACCESS), ("hex", secret_scan.HEX)):
        for m in rx.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


SECRET = "aB3dE5gH7jK9lM1nO3pQ5rS7tU9vW1xY3zA5bC7d"


def test_secret_scan(spark, data, odd, empty):
    texts = documents(data).set_index("doc_id").text.to_dict()
    for r in queries.op7_secret_scans(spark, data).collect():
        base = brute_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("weak")] == base
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(20, f"user=alice then {SECRET} at https://x.example/a"), (21, f"{SECRET} alone"), (22, "user=alice alone"), (23, f"user=bob {'.' * 2000} {SECRET}")]
    rows += [(24, f"😀 AKIA{'A' * 16} {SECRET}"), (25, "secret=token:abcdefg paſsword=abcdefg"), (26, ("user=carol " + SECRET + " ") * 300)]
    got = {(r.doc_id, r.spans) for r in secret_scan.report(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    spans = {i: s for i, s in got}
    assert spans[20] == f"weak_identifier:0:10,weak_secret:16:56,weak_endpoint:60:{60 + 19}"
    assert spans[21] == spans[22] == spans[23] == "" and spans[25] == ""
    assert spans[24] == "access:2:22,weak_secret:23:63"
    assert spans[26].count("weak_identifier") == 300 == spans[26].count("weak_secret")
    assert secret_scan.scan(empty).count() == 0


def test_weak_secrets_of_any_length(spark):
    key = (SECRET * 3)[:86] + "=="
    short, url_safe = SECRET[:20], SECRET[:12] + "-_" + SECRET[12:24]
    rows = [(1, f"account: demo {key} at https://demo.example"), (2, f"AccountName=demo;AccountKey={key};x"), (3, f"user=alice {short}"), (4, f"user=alice {url_safe}"), (5, f"user=alice {SECRET * 30}")]
    rows += [(6, f"{key} alone"), (7, f"user=alice {SECRET[:19]}"), (8, f"user=alice {key}=")]
    got = {r.doc_id: r.spans for r in secret_scan.report(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for (i, text), secret in zip(rows, (key, key, short, url_safe, SECRET * 30)):
        assert f"weak_secret:{text.index(secret)}:{text.index(secret) + len(secret)}" in got[i].split(",")
    assert all("weak_secret" not in got[i] for i in (6, 7, 8))


def digest(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark, data):
    df = pd.read_parquet(f"{data}/conversations.parquet").sort_values(["conv_id", "turn"])
    want = {c: digest(list(zip(g.role, g.text.fillna("")))) for c, g in df.groupby("conv_id")}
    text = "<|im_end|><|im_start|>assistant ok"
    want[-1] = digest([("user", text), ("assistant", text)])
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op9_chat_formatting(spark, data).collect()}
    assert got == want


PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "assistant", "<\\|", "a", "é", "$1", "😀", ""]), max_size=6).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant"]) | PIECES, PIECES), min_size=1, max_size=4), min_size=1, max_size=30))
def test_chat_round_trip(spark, conversations):
    rows = [(c, k, r, t, 1) for c, turns in enumerate(conversations) for k, (r, t) in enumerate(turns)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int"))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.report(made).collect()}
    assert got == {c: digest(turns) for c, turns in enumerate(conversations)}


def test_chat_that_is_not_read_back_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "escaped", lambda text: text)
    rows = spark.createDataFrame([(1, 0, "user", "<|im_end|>"), (2, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="conversation 1"):
        chat.format_conversations(rows).collect()
    assert chat.format_conversations(rows.where("conv_id = 2")).first().formatted == "<|im_start|>user\nhello<|im_end|>\n"


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, None, "system", "s"), (None, 0, None, "x"), (1, 0, "user", None)]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.report(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: digest([("system", "s"), ("user", ""), ("user", "")]), None: digest([("", "x")])}
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
