"""Near-duplicates, fuzzy lines, vectors and connected components against brute force."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from orrery.llm import common, embedding_dedup, line_dedup, linking, near_dedup, queries
from pyspark.sql import functions as F


def groups(nodes, links):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(400 + k, 401 + k) for k in range(40)] + [(1000, k) for k in range(2000, 2100)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = groups({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i in {x for a, b in links if a != b for x in (a, b)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def compare_within(rule):
    """All pairs of a block that pass a rule, by a join: for small tables."""
    def compare(blocks, components):
        return blocks.select("key", "block", F.col("id").alias("a")).join(blocks.select("key", "block", F.col("id").alias("b")), ["key", "block"]).where("a > b").where(rule).select("a", "b").distinct()

    return compare


@pytest.mark.parametrize("limit", [100, 10])
def test_linked_components_decides_all_pairs_of_a_bucket(spark, limit):
    # One bucket in which only neighbours of equal remainder are linked, in one block, or part by part.
    n = 60
    members = spark.range(n).select(F.lit(7).alias("key"), F.col("id"), F.lit(n).cast("long").alias("n"))
    compare = compare_within("a % 6 = b % 6 and abs(a - b) = 6")
    written = lambda blocks, components: common.written(compare(blocks, components), "links")
    got = linking.linked_components(members, written, limit)
    want = groups(range(n), [(i, i + 6) for i in range(n - 6)])
    assert {r.id: r.component for r in got.collect()} == want


@pytest.mark.parametrize("limit", [100, 10, 3])
def test_a_split_that_parts_pairs_loses_no_link(spark, limit):
    # The same links whether the bucket is a block, compared part by part, or split first, by which no linked pair meets.
    n = 60
    members = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id"), F.lit(n).cast("long").alias("n"))
    compare = compare_within("a - b = 30")
    written = lambda blocks, components: common.written(compare(blocks, components), "links")
    split = lambda large: large.select((F.col("id") % 60).alias("key"), "id").unionByName(large.select((100 + F.floor(F.col("id") / 2)).alias("key"), "id"))
    got = linking.linked_components(members, written, limit, split)
    assert {r.id: r.component for r in got.collect()} == groups(range(n), [(i, i + 30) for i in range(n - 30)])


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter(p for v in holders.values() for p in combinations(v, 2))
    links = [(sets[a][0], sets[b][0]) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n)]
    links = [(a, b) for a, b in links if a is not None and b is not None]
    of = groups({i for i, _ in sets if i is not None}, links)
    return sorted(str((i, len(s), of.get(i), i is None or of[i] == i)) for i, s in sets)


def test_near_duplicates(spark, data, odd, empty):
    df = pd.read_parquet(f"{data}/documents.parquet")
    got = queries.op2_minhash_near_dedup(spark, data).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_near(list(zip(df.doc_id.tolist(), df.text)), 4)
    assert sum(not r.kept for r in got) > 5
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    words = [f"w{k}" for k in range(60)]
    rows += [(100 + k, " ".join(words[:k] + [f"other{k}"] + words[k + 1 :])) for k in range(40)] + [(3, "Another text of document three")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    for width in (4, 5):
        got = near_dedup.near_duplicates(table, width).collect()
        assert sorted(str(tuple(r)) for r in got) == brute_near(rows, width)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.deduplicated(table).columns == table.columns


def test_signature_estimate_is_close(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 2**63, 1000 - k).astype(np.uint64)])) for k in (1000, 900, 500, 0)]
    _, signature = near_dedup.sketches(sets)
    for k in range(4):
        true = len(np.intersect1d(sets[0], sets[k])) / len(np.union1d(sets[0], sets[k]))
        assert abs(near_dedup.estimate(near_dedup.differing(signature[0], signature[k])) - true) < 0.13


@pytest.mark.parametrize("block", [1024, 8])
def test_hot_near_duplicates(spark, monkeypatch, block):
    """Copies of one text with words replaced, some of them like few others only, and unlike texts that share a passage."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(linking, "SPLIT_FROM", 3)
    rng = np.random.default_rng(7)
    words, passage = [f"w{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    rows = []
    for k in range(90):
        own = list(words)
        for at in rng.choice(150, int(rng.integers(0, 8)), replace=False):
            own[at] = f"x{k}.{at}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(passage + [f"u{k}.{j}" for j in range(25)])) for k in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_near(rows, 4)


def test_links_between_components():
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rng.choice(base, 100 - k, replace=False), 1000 + 100 * np.uint64(k) + np.arange(k, dtype=np.uint64)])) for k in range(30)]
    component = np.array([k % 7 for k in range(30)])
    pairs = near_dedup.links_between(sets, component, 80)
    like = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    assert all(like(a, b) for a, b in pairs)
    same = [(a, b) for a in range(30) for b in range(a) if component[a] == component[b]]
    every = [(a, b) for a in range(30) for b in range(a) if like(a, b)]
    assert groups(range(30), same + [tuple(p) for p in pairs.tolist()]) == groups(range(30), same + every)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def norm(line):
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip(" ")


def simhash(text):
    words = text.split(" ")
    long = [w for w in words if len(w) >= line_dedup.LONG_WORD]
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (long if len(long) >= line_dedup.MIN_WORDS else words)]
    return sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in words) > len(words))


def brute_lines(rows):
    """Texts without repeated lines; rows must have different ids."""
    places = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if len(norm(line).split(" ")) >= line_dedup.MIN_WORDS:
                places[norm(line)].append((i, k))
    keys = sorted(places)
    sims = [simhash(x) for x in keys]
    longer = lambda a, b: max(len(keys[a]), len(keys[b]))
    links = [(a, b) for a, b in combinations(range(len(keys)), 2) if (sims[a] ^ sims[b]).bit_count() <= line_dedup.DISTANCE]
    links = [(a, b) for a, b in links if edit(keys[a], keys[b]) <= (1 - line_dedup.SIMILARITY) * longer(a, b) + 1e-9]
    of = groups(range(len(keys)), links)
    keep = {}
    for k, x in enumerate(keys):
        keep[of[k]] = min(keep.get(of[k], (2**63,)), min(places[x]))
    gone = {p for k, x in enumerate(keys) for p in places[x] if p != keep[of[k]]}
    return {i: t if not any(p[0] == i for p in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}, links


def test_lines(spark, data, empty):
    df = pd.read_parquet(f"{data}/documents.parquet").head(120)
    line = "the committee will meet on monday in the large hall to vote on the new budget of the city and its plan for {} years"
    rows = list(zip(df.doc_id.tolist(), df.text)) + [(10_001, line.format("ten")), (10_002, "x\n" + line.format("six") + "\n" + line.format("ten").upper() + "!\nshort line"), (10_003, None), (10_004, ""), (10_005, "short line\n\nshort line")]
    rows += [(10_006, line.format("tens")), (10_007, "one two three four\nOne, two; three - four\n" * 3)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars long, line string")
    out = line_dedup.without_repeated_lines(table)
    want, links = brute_lines(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == want and out.columns == table.columns and got[10_005] == rows[-3][1]
    assert len(links) >= 1
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_lines_without_blanks(spark):
    rng = np.random.default_rng(12)
    han = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3000, 400))
    thai = "".join(chr(0x0E01 + int(k)) for k in rng.integers(0, 40, 60))
    near = han[:300] + "新" + han[301:]
    rows = [(1, han), (2, "a first line\n" + han + "。"), (3, near), (4, thai), (5, thai + "\nlast"), (6, "東京都" * 2), (7, "東京都" * 2), (8, "東京都" * 3), (9, "東京都" * 3), (10, han[::-1])]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows) | {2: "a first line", 3: "", 5: "last", 9: ""}
    assert got == want


def test_lines_odd_rows(spark, odd):
    out = line_dedup.without_repeated_lines(odd).collect()
    assert len(out) == odd.count()
    texts = [r.text for r in out if r.doc_id in (3, 4)]
    assert sorted(texts)[:2] == ["", ""] and len(texts[0] + texts[1] + texts[2]) > 50


def test_blocks_share_a_key_up_to_the_distance(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        pairs.append((a, a ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 4)), replace=False))))
    table = spark.createDataFrame(pairs, "a long, b long")
    for n in (10, 10**8, 10**10):
        blocks = line_dedup.Blocks(n)
        shared = F.array_intersect(blocks.keys(F.col("a")), blocks.keys(F.col("b")))
        owners = F.size(F.filter(shared, lambda k: blocks.owned(k, F.col("a").bitwiseXOR(F.col("b")))))
        assert table.where(owners != 1).count() == 0


def test_alike_is_edit_similarity(spark):
    rng = np.random.default_rng(14)
    rows = []
    for _ in range(300):
        n = int(rng.integers(4, 60))
        a = ["".join(rng.choice(list("abcde"), int(rng.integers(1, 9)))) for _ in range(n)]
        b = list(a)
        for _ in range(int(rng.integers(1, 1 + n // 3 + 2))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = ["".join(rng.choice(list("abcdé"), 3))] * int(rng.integers(0, 3))
        if a != b:
            rows.append((" ".join(a), " ".join(b)))
    rows += [("a b c d", "a b c"), ("a a a a", "a a a a a"), ("x", "y"), ("abcdefghijklmnopqrst", "abcdefghijklmnopq"), ("abcdefghijklmnopqrst", "abcdefghijklmnop")]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.alike(F.col("x"), F.col("y")).alias("like")).collect()
    want = [edit(r.x, r.y) <= 0.15 * max(len(r.x), len(r.y)) + 1e-9 for r in got]
    assert [r.like for r in got] == want and 20 < sum(want) < len(want) - 20


@pytest.mark.parametrize("block", [512, 8])
def test_hot_lines(spark, monkeypatch, block):
    """Many lines of one template, of which some are alike only through others, long ones and one over 2048 letters too."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(400)]
    rows = []
    for k in range(40):
        own = words[:60]
        for at in rng.choice(60, int(rng.integers(0, 14)), replace=False):
            own[at] = own[at][:3] if rng.random() < 0.5 else f"{own[at]} of"
        rows.append((k, " ".join(own)))
    long = [" ".join(words), " ".join(words[:200] + ["another"] + words[201:]), " ".join(["from"] + words[:399])]
    rows += [(100 + k, "first of the lines here\n" + x) for k, x in enumerate(long)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, links = brute_lines(rows)
    assert got == want and len(links) > 50 and min(map(len, long)) > 2048


def brute_vectors(rows, cosine=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a, b in combinations(ok, 2) if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    n = Counter(x for p in links for x in p)
    of = groups({r[0] for r in rows if r[0] is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted(str((r[0], n[k], of.get(r[0]), r[0] is None or of[r[0]] == r[0])) for k, r in enumerate(rows))


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            centre = rng.standard_normal(32)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((len(rows), [float(x) for x in np.float32(centre + rng.standard_normal(32) * 0.22)], label))
    hot = [float(x) for x in rng.standard_normal(32)]
    rows += [(len(rows) + k, hot, 1) for k in range(30)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, hot[:-1] + [None], 1), (903, hot[:-1] + [float("nan")], 1), (904, hot, None), (None, hot, 1), (905, [], 1), (906, hot + [1.0], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, hot[:-1] + [float("inf")], 2)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, filters int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    got = embedding_dedup.near_duplicate_vectors(table)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_vectors(exact)
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    rows = [(k, [float(x) for x in centre + rng.standard_normal(64) * 0.2], 1) for k in range(120)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_vectors(rows)


def test_sketches_leave_out_what_has_no_link_and_lose_none():
    rng = np.random.default_rng(12)
    rows, want = [], set()
    for bucket, n in enumerate([1, 2, 3, 40, 7, 32, 33, 90] * 4):
        size = 64 if bucket % 2 else 24
        x = rng.standard_normal((n, size))
        near = rng.random(n) < 0.2
        x[near] = x[0] + rng.standard_normal((near.sum(), size)) * rng.uniform(0.2, 0.5)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = (x @ x.T >= 0.93) & ~np.eye(n, dtype=bool)
        for k, sketch in enumerate(embedding_dedup._sketch(x)):
            want |= {len(rows)} if linked[k].any() else set()
            rows.append((size, bucket, len(rows), 5, 0, 0, 0, sketch.tobytes()))
    rows.sort(key=lambda r: r[:2])
    table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], names=["size", "bucket", "cid", "filter", "i", "j", "chunk", "sketch"])
    got = [c for b in embedding_dedup._likely(table.to_batches(max_chunksize=50), 0.93) for c in b.column("cid").to_pylist()]
    assert want <= set(got) and len(got) == len(set(got)) and len(want) > 50
    assert len(got) < len(want) + 0.1 * len(rows) < len(rows)


def test_vectors_near_the_threshold_are_found():
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = embedding_dedup.code(64, 4096)
    found = [len(np.intersect1d(a, b)) > 0 for k in range(0, 300, 50) for a, b in zip(code.decode(x[k : k + 50]), code.decode(y[k : k + 50]))]
    assert np.mean(found) >= 0.98


def _shuffled_once(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_lines_of_buckets_are_shuffled_once(spark):
    from collections import defaultdict
    from random import Random

    from orrery.llm import line_dedup

    pick = Random(5)
    sims = [pick.getrandbits(63) for _ in range(100)]
    sims += [s ^ (1 << pick.randrange(63)) for s in sims[:60]] + [s ^ 3 for s in sims[:20]] + sims[:5]
    buckets = line_dedup.shared_buckets(spark.createDataFrame(list(enumerate(sims)), "lid long, sim long"), line_dedup.Blocks(len(sims)))
    pairs, held = set(), defaultdict(set)
    for r in buckets.collect():
        if r.n == 2:
            pairs.add((r.a, r.b))
        held[r.key].add(r.id)
    for ids in held.values():
        pairs |= {(x, y) for x in ids for y in ids if x > y}
    close = {(x, y) for x in range(len(sims)) for y in range(x) if (sims[x] ^ sims[y]).bit_count() <= line_dedup.DISTANCE}
    assert len(close) > 80 and close <= pairs
    _shuffled_once(buckets)


def test_members_of_buckets_are_shuffled_once(spark):
    from collections import Counter
    from random import Random

    from orrery.llm import linking

    pick = Random(5)
    rows = [(pick.randint(0, 300), i) for i in range(400)]
    sized = linking.sized(spark.createDataFrame(rows, "key long, id long"))
    sizes = Counter(k for k, _ in rows)
    assert sorted(map(tuple, sized.select("key", "id", "n").collect())) == sorted((k, i, sizes[k]) for k, i in rows if sizes[k] > 1)
    _shuffled_once(sized)


def test_near_dedup_shuffles_no_other_texts(spark):
    """Texts that are like no other are read and not shuffled, at any size."""
    import bench

    rng = np.random.default_rng(5)
    shared = " ".join(f"s{k}" for k in range(800))
    texts = [f"{shared} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 1200)) for _ in range(100)]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[0] + " and more")], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stage, _ = bench.shuffled(spark, 0)
        got = near_dedup.near_duplicates(common.written(docs, "docs"), width=4)
        moved = bench.shuffled(spark, stage)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: 0 if i == 100 else i for i in range(101)}
    assert moved < 0.3 * sum(map(len, texts)) / 1e6


def test_majorities_of_any_number_of_features(spark):
    """SimHashes of 1 to 600 features, on both sides of where the way of counting changes, against plain counts."""
    words = [f"word{k * k % 977}x{k % 13}" for k in range(600)]
    sizes = [4, 5, 6, 7, 15, 16, 63, 64, 126, 127, 128, 129, 300, 510, 511, 512, 600]
    lines = spark.createDataFrame([(n, " ".join(words[:n])) for n in sizes], "n int, norm string")
    got = {r.n: r.sim for r in line_dedup.simhashed(lines).collect()}

    def majority(hashes):
        return sum(1 << b for b in range(line_dedup.SIM_BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert got == {n: majority([xxhash.xxh64_intdigest(w, 42) for w in words[:n]]) for n in sizes}
