"""Fuzzy line deduplication in DataFrame functions alone: SimHash, pigeonhole blocks, edit similarity, groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .linking import linked_components, with_component

#: Lines of fewer words are never removed; of the scripts in UNSPACED, which are written without blanks, every WORD_LETTERS
#: letters count as a word, and lines that are mostly of them have the SimHash of their runs of GRAM letters. Lines are alike whose SimHashes differ in DISTANCE bits at most and whose
#: edit similarity, 1 - distance / longer length, is SIMILARITY or more.
MIN_WORDS, DISTANCE, SIMILARITY = 4, 3, 0.85
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
WORD_LETTERS, GRAM = 2, 3
LONG_WORD = 4
#: Bits of a SimHash. Those of up to FEW features are counted all at once; of more, in lanes of packed longs, of the first of LANES bits that hold
#: their number.
SIM_BITS, FEW, LANES = 63, 127, (9, 21)
#: Lines of a bucket that are compared in one block.
BLOCK = 512
#: Rounds in which a line is compared with PARTNERS others of its block.
ROUNDS, PARTNERS = 2, 4
#: Most bytes that are broadcast; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def letters_only(text: Column) -> Column:
    """Lower case, and each run of anything but letters, marks, digits and line ends as one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\n]+", " ")


def unspaced(norm: Column) -> Column:
    """The number of letters of UNSPACED scripts; lines without any, which are most, aren't rewritten to count them."""
    return F.when(norm.rlike(UNSPACED), F.length(norm) - F.length(F.regexp_replace(norm, UNSPACED, ""))).otherwise(0)


def own_id() -> Column:
    """doc_id, of which null comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, body, line, norm): the lines of documents that are long enough. id and body tell documents apart."""
    text = common.text_or_empty()
    lines = docs.select(own_id().alias("id"), F.xxhash64(text).alias("body"), F.posexplode(F.split(letters_only(text), "\n")).alias("line", "raw"))
    norm = lines.select("id", "body", "line", F.trim("raw").alias("norm"))
    blanks = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit("")))
    return norm.where((blanks >= MIN_WORDS - 1) | (unspaced(F.col("norm")) >= MIN_WORDS * WORD_LETTERS))


def _counts(hashes: Column, lane: int) -> Column:
    """A struct of longs that hold, in lanes of `lane` bits, how many hashes have each of their first SIM_BITS bits."""
    ones = F.lit(sum(1 << (lane * k) for k in range(SIM_BITS // lane)))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"s{k}") for k in range(lane)))
    return F.aggregate(hashes, zero, lambda a, h: F.struct(*((a[f"s{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(ones)).alias(f"s{k}") for k in range(lane))))


def _majority(counts: Column, n: Column, lane: int) -> Column:
    """The bits that more than half of n hashes have: a bias carries such a count into the top bit of its lane."""
    ones = F.lit(sum(1 << (lane * k) for k in range(SIM_BITS // lane)))
    bias = (F.lit(2 ** (lane - 1) - 1) - F.floor(n / 2)).cast("long") * ones
    bits = F.lit(0).cast("long")
    for k in range(lane):
        bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(counts[f"s{k}"] + bias, lane - 1).bitwiseAND(ones), k))
    return bits


def _with_majority(rows: DataFrame, hashes: str, n: str, out: str) -> DataFrame:
    """rows with the bits that more than half of n hashes have, of up to FEW. The hashes are added up bit by bit at once: three numbers
    of a weight are one of it and one of twice the weight, until there is one of each, the digits of the counts."""
    names = [f"_p{i}" for i in range(FEW)]
    kept = [c for c in rows.columns]
    rows = rows.select(*kept, *(F.coalesce(F.get(hashes, F.lit(i)), F.lit(0).cast("long")).alias(c) for i, c in enumerate(names)))
    weights, step = [names], 0
    while any(len(w) > 1 for w in weights):
        after: list[list] = [[] for _ in range(len(weights) + 1)]
        for k, w in enumerate(weights):
            for i in range(0, len(w) - len(w) % 3, 3):
                a, b, c = map(F.col, w[i : i + 3])
                after[k].append(a.bitwiseXOR(b).bitwiseXOR(c))
                after[k + 1].append(a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b))))
            rest = [*map(F.col, w[len(w) - len(w) % 3 :])]
            if len(rest) == 2 and len(w) == 2:
                after[k].append(rest[0].bitwiseXOR(rest[1]))
                after[k + 1].append(rest[0].bitwiseAND(rest[1]))
            else:
                after[k] += rest
        weights = [[f"_q{step}_{k}_{i}" for i in range(len(w))] for k, w in enumerate(after) if w]
        rows = rows.select(*kept, *(c.alias(name) for w, of in zip(weights, after) for name, c in zip(w, of)))
        step += 1
    # The counts are compared with n / 2 from their highest digit on.
    more, equal, half = F.lit(0).cast("long"), F.lit(-1).cast("long"), F.floor(F.col(n) / 2).cast("long")
    for k in reversed(range(len(weights))):
        digit, other = F.col(weights[k][0]), -F.shiftright(half, k).bitwiseAND(F.lit(1).cast("long"))
        more = more.bitwiseOR(equal.bitwiseAND(digit).bitwiseAND(F.bitwise_not(other)))
        equal = equal.bitwiseAND(F.bitwise_not(digit.bitwiseXOR(other)))
    return rows.select(*kept, more.bitwiseAND(F.lit(2**SIM_BITS - 1)).alias(out))


def simhashed(lines: DataFrame) -> DataFrame:
    """lines with `sim`, the SimHash of the words of norm of LONG_WORD letters or more, as shorter ones
    are much the same in all lines of a language; of all words where those are fewer than MIN_WORDS; of runs of GRAM letters
    where half the letters or more are of UNSPACED scripts. A line has 2**21 features at most."""
    every = F.split("norm", " ")
    some = F.filter(every, lambda w: F.length(w) >= LONG_WORD)
    letters = F.split(F.replace(F.col("norm"), F.lit(" "), F.lit("")), "")
    grams = F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - (GRAM - 1), F.lit(1))), lambda x, i: F.concat_ws("", x, *(F.get(letters, i + k) for k in range(1, GRAM))))
    out = lines.withColumn("_some", some)
    # Letters of UNSPACED scripts take three bytes, so lines of few such bytes needn't be searched for them.
    few_blanks = (F.octet_length("norm") >= 2 * F.length("norm")) & (2 * unspaced(F.col("norm")) >= F.length("norm"))
    features = F.when(few_blanks, grams).when(F.size("_some") >= MIN_WORDS, F.col("_some")).otherwise(every)
    out = out.withColumn("_h", F.transform(features, lambda w: F.xxhash64(w))).withColumn("_n", F.size("_h")).drop("_some")
    # Lines of more features than FEW, which are rare, have theirs counted one by one.
    wide, over = [], F.lit(FEW)
    for lane in LANES:
        wide.append((F.col("_n") > over) & (F.col("_n") < 2**lane))
        over = F.lit(2**lane - 1)
    for lane, which in zip(LANES, wide):
        out = out.withColumn(f"_c{lane}", F.when(which, _counts(F.col("_h"), lane)))
    out = out.withColumn("_long", F.coalesce(*(F.when(which, _majority(F.col(f"_c{lane}"), F.col("_n"), lane)) for lane, which in zip(LANES, wide))))
    out = _with_majority(out.drop(*(f"_c{lane}" for lane in LANES)), "_h", "_n", "_few")
    return out.withColumn("sim", F.coalesce("_long", "_few")).drop("_h", "_n", "_long", "_few")


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, body, line, k1, k2, chars, sim) of each line that is long enough. k1, k2 and chars stand for the normalised line: of a
    million million lines two different ones share them about once in 100,000 corpora."""
    rows = simhashed(lines_of(docs))
    return rows.select("id", "body", "line", F.xxhash64("norm").alias("k1"), F.hash("norm").alias("k2"), F.length("norm").alias("chars"), "sim")


LINE = ["k1", "k2", "chars"]


def different_lines(seen: DataFrame) -> DataFrame:
    """(lid, k1, k2, chars, first, copies, sim) of each different line of occurrences(): first is its least (id, body, line)."""
    each = seen.select(*LINE, F.struct("id", "body", "line").alias("at"), "sim")
    return each.groupBy(*LINE).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("sim").alias("sim")).withColumn("lid", F.monotonically_increasing_id())


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def alike(x: Column, y: Column) -> Column:
    """Whether the edit similarity of two different texts is SIMILARITY or more.

    Edits of words at equal places are an upper bound of the distance, which decides most; else the words that both begin or
    end with are left out, which doesn't change the distance, and the search over the rest is cut off beyond the bound."""
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    edits = lambda p, q: F.when(p == q, 0).otherwise(F.levenshtein(p, q))
    leading = lambda a, b: F.array_position(F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), False).cast("int") - 1

    def within(s: Column) -> Column:
        placed = F.aggregate(F.zip_with(s["a"], s["b"], edits), F.lit(0), lambda n, e: n + e)
        return F.when((F.size(s["a"]) == F.size(s["b"])) & (placed <= s["most"]), True).otherwise(_let(F.struct(s["a"].alias("a"), s["b"].alias("b"), s["most"].alias("most"), leading(s["a"], s["b"]).alias("k")), headless))

    def headless(s: Column) -> Column:
        rest = lambda v: F.reverse(F.slice(v, s["k"] + 1, F.size(v)))
        return _let(F.struct(rest(s["a"]).alias("a"), rest(s["b"]).alias("b"), s["most"].alias("most")), lambda r: _let(F.struct(r["a"].alias("a"), r["b"].alias("b"), r["most"].alias("most"), leading(r["a"], r["b"]).alias("k")), tailless))

    def tailless(s: Column) -> Column:
        rest = lambda v: F.array_join(F.reverse(F.slice(v, s["k"] + 1, F.size(v))), " ")
        return _let(F.struct(rest(s["a"]).alias("x"), rest(s["b"]).alias("y"), s["most"].alias("most")), lambda r: F.when(F.greatest(F.length(r["x"]), F.length(r["y"])) <= r["most"], True).otherwise(F.call_function("levenshtein", r["x"], r["y"], r["most"]) >= 0))

    # The greatest distance allowed; the small term takes back what the product of two fractions may be short of a whole number.
    most = F.floor((1 - SIMILARITY) * longer + 1e-9).cast("int")
    words = F.struct(F.split(x, " ").alias("a"), F.split(y, " ").alias("b"), most.alias("most"))
    return F.when(longer - shorter > most, False).otherwise(_let(words, within))


class Blocks:
    """Keys of which two SimHashes at DISTANCE or less share one at least: the bits fall into m blocks, of which m - DISTANCE
    are untouched, and each choice of so many blocks is a kind of key. m grows with the number of lines, so that a line meets
    less than one other by chance; the pairs found are the same."""

    def __init__(self, lines: int):
        for m in range(DISTANCE + 2, 2 * DISTANCE + 8):
            self.edges = [SIM_BITS * k // m for k in range(m + 1)]
            self.kinds = list(combinations(range(m), m - DISTANCE))
            if lines * len(self.kinds) < 2 ** (SIM_BITS * (m - DISTANCE) / m):
                break

    def _mask(self, b: int) -> int:
        return (1 << self.edges[b + 1]) - (1 << self.edges[b])

    def keys(self, sim: Column) -> Column:
        out = []
        for t, chosen in enumerate(self.kinds):
            bits = F.lit(0).cast("long")
            for b in chosen:
                width = self.edges[b + 1] - self.edges[b]
                bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned(sim, self.edges[b]).bitwiseAND(F.lit(2**width - 1)))
            out.append(bits * len(self.kinds) + t)
        return F.array(*out)

    def owned(self, key: Column, differ: Column) -> Column:
        """Whether two SimHashes with these differing bits are close, and the key is the first of those they share."""
        touched = [[self._mask(b) for b in range(chosen[-1]) if b not in chosen] for chosen in self.kinds]
        masks = F.array(*(F.array(*map(F.lit, t)).cast("array<bigint>") for t in touched))
        first = F.forall(F.get(masks, F.pmod(key, F.lit(len(self.kinds))).cast("int")), lambda k: differ.bitwiseAND(k) != 0)
        return (F.bit_count(differ) <= DISTANCE) & first


def shared_buckets(known: DataFrame, blocks: Blocks) -> DataFrame:
    """(key, id, sim, n, a, b) of the lines of different_lines() that share a key with n - 1 others; a bucket of two that are close is one row, of
    its greater id a and b, and one of two that aren't is none. Lines are shuffled once: those of a bucket are counted where they meet."""
    dealt_out = known.select(F.explode(blocks.keys(F.col("sim"))).alias("key"), F.col("lid").alias("id"), "sim")
    told = {"n": F.count(F.lit(1)), "b": F.min("id"), "a": F.max("id"), "low": F.min("sim"), "high": F.max("sim")}
    buckets = dealt_out.withColumns({k: v.over(Window.partitionBy("key")) for k, v in told.items()})
    # Where all SimHashes of a bucket are equal, the first kind of key has it already.
    equal = (F.col("low") == F.col("high")) & (F.pmod("key", F.lit(len(blocks.kinds))) > 0)
    decided = ~equal & ((F.col("n") > 2) | blocks.owned(F.col("key"), F.col("low").bitwiseXOR(F.col("high"))))
    return buckets.where((F.col("n") > 1) & decided).where("n > 2 or id = a").select("key", "id", "sim", "n", "a", "b")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if the bytes of its rows are few."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def texts_of(docs: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, norm) of these lines of different_lines(): only they are normalised again."""
    wanted = known.join(ids, known.lid == ids.id, "left_semi").select("first.*", "lid")
    by_doc = common.written(wanted.groupBy("id", "body").agg(F.collect_list(F.struct("line", "lid")).alias("wanted")).withColumnsRenamed({"id": "_id", "body": "_body"}), "wanted")
    keyed = docs.select(own_id().alias("_own_id"), F.xxhash64(common.text_or_empty()).alias("_own_body"), common.text_or_empty().alias("text"))
    some = keyed.join(_small(by_doc, F.lit(48) + 24 * F.size("wanted")), (F.col("_own_id") == F.col("_id")) & (F.col("_own_body") == F.col("_body")))
    each = some.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select(F.col("w.lid").alias("id"), F.trim(letters_only(F.get("lines", F.col("w.line")))).alias("norm"))
    out = common.written(each.groupBy("id").agg(F.min("norm").alias("norm")), "texts")
    common.discard(by_doc)
    return out


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(id, body, line): the occurrences of lines that go, all but the least (id, body, line) of each connected group."""
    seen = common.written(occurrences(docs), "lines")
    known = common.written(different_lines(seen), "lines")
    blocks = Blocks(known.count())
    buckets = common.written(shared_buckets(known, blocks), "buckets")
    members = common.written(buckets.where("n > 2").select("key", "id", "sim", "n"), "members")
    twos = buckets.where("n = 2").select("a", "b")

    def compare(of: DataFrame, components: DataFrame | None) -> DataFrame:
        rows = (with_component(of, components) if components is not None else of.withColumn("component", F.col("id"))).select("key", "block", F.struct("id", "sim", "component").alias("x"))
        met = lambda x, y: (x["component"] != y["component"]) & blocks.owned(F.col("key"), x["sim"].bitwiseXOR(y["sim"]))
        earlier = lambda x: F.aggregate("m", F.lit(None).cast("long"), lambda b, y: F.coalesce(b, F.when((y["id"] < x["id"]) & met(x, y), y["id"])))
        held = rows.groupBy("key", "block").agg(F.collect_list("x").alias("m")).where(F.size("m") > 1)
        with_b = lambda x: F.struct(x["id"].alias("id"), x["sim"].alias("sim"), earlier(x).alias("b"))
        close = F.transform(F.filter("m", lambda x: F.exists("m", lambda y: met(x, y))), with_b)
        near = common.written(held.select("key", "block", F.explode(close).alias("x")).select("key", "block", "x.*"), "near")
        pairs = near.where("b is not null").select(F.col("id").alias("a"), "b")
        pairs = (pairs.unionByName(twos) if components is None else pairs).distinct()
        ids = near.select("id").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
        texts = texts_of(docs, known, ids)

        def verified(pairs: DataFrame) -> DataFrame:
            both = pairs.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
            return both.where(alike(F.col("x"), F.col("y"))).select("a", "b")

        def mixed(columns: list[str], of: DataFrame) -> DataFrame:
            """The blocks of near lines that hold several components, each with its members in one array."""
            rest = with_component(of, now)
            keys = rest.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "block")
            return rest.join(keys, ["key", "block"], "left_semi").groupBy("key", "block").agg(F.collect_list(F.struct("id", "sim", "component", *columns)).alias("m"))

        links = common.written(verified(pairs), "links")
        now = common.written(common.connected_components(links.unionByName(_as_links(components)) if components is not None else links, "a", "b"), "now")
        # Rounds of the nearest partners of other components join most of what belongs together, before all pairs that are
        # then still close and apart are decided inside their block.
        near = near.select("key", "block", "id", "sim")
        apart = lambda x, y: F.struct(F.bit_count(x["sim"].bitwiseXOR(y["sim"])).alias("d"), F.xxhash64(x["id"], y["id"]).alias("h"), y["id"].alias("b"))
        nearest = lambda x: F.slice(F.sort_array(F.transform(F.filter("m", lambda y: met(x, y)), lambda y: apart(x, y))), 1, PARTNERS)
        for _ in range(ROUNDS):
            each = mixed([], near).select(F.explode(F.transform("m", lambda x: F.struct(x["id"].alias("a"), nearest(x)["b"].alias("b")))).alias("x")).select("x.a", F.explode("x.b").alias("b"))
            some = common.written(verified(each.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "some")
            if some.isEmpty():
                break
            both, before = common.written(links.unionByName(some), "links"), now
            now = common.written(common.connected_components(some.unionByName(_as_links(now)), "a", "b"), "now")
            common.discard(links, some, before)
            links = both
        like = lambda x: F.transform(F.filter("m", lambda y: (y["id"] < x["id"]) & met(x, y) & alike(x["norm"], y["norm"])), lambda y: y["component"])
        held = mixed(["norm"], near.join(texts, "id"))
        more = held.select(F.explode(F.transform("m", lambda x: F.struct(x["id"].alias("a"), F.array_distinct(like(x)).alias("b")))).alias("x")).select("x.a", F.explode("x.b").alias("b"))
        out = common.written(links.unionByName(more), "links")
        common.discard(near, texts, links, now)
        return out

    components = linked_components(members, compare, BLOCK)
    grouped = known.join(components, known.lid == components.id, "left").select(*LINE, "first", "copies", F.coalesce("component", "lid").alias("group"))
    # A line that occurs once and is like no other needs no look at all.
    more = grouped.where("copies > 1").select("group").unionByName(components.select(F.col("component").alias("group"))).distinct()
    some = grouped.join(more, "group", "left_semi")
    kept = some.groupBy("group").agg(F.min("first").alias("keep"))
    keys = common.written(some.join(kept, "group").select(*LINE, "keep"), "keys")
    at = F.struct("id", "body", "line")
    gone = common.written(seen.select("id", "body", "line", *LINE).join(keys, LINE).where(at != F.col("keep")).select("id", "body", "line"), "gone")
    common.discard(seen, known, buckets, members, components, keys)
    return gone


def _as_links(components: DataFrame) -> DataFrame:
    return components.select(F.col("id").alias("a"), F.col("component").alias("b"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out: of each group of equal or alike lines one occurrence stays in the whole
    table, that of the smallest (doc_id, hash of the text, line number).

    All columns stay, with n_chars, if there is one, counted anew; a document that loses all its lines stays with an
    empty text. Null and empty texts, and lines of fewer than MIN_WORDS words (see there), stay as they are. A null doc_id comes
    after all others. Rows of equal doc_id and text are one document and keep the same lines. No rows give none.
    """
    each = repeated_lines(docs)
    gone = each.groupBy("id", "body").agg(F.collect_set("line").alias("_gone"))
    gone = common.written(gone.select(F.col("id").alias("_id"), F.col("body").alias("_body"), "_gone"), "gone")
    common.discard(each)
    names = docs.columns
    keyed = docs.withColumn("_own_id", own_id()).withColumn("_own_body", F.xxhash64(common.text_or_empty()))
    joined = keyed.join(_small(gone, F.lit(48) + 8 * F.size("_gone")), (F.col("_own_id") == F.col("_id")) & (F.col("_own_body") == F.col("_body")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256): each document's lines, those taken out, and the text that is left.

    A row for each row of docs, null doc_ids and repeated rows too; a null text is one empty line; other columns, of whatever
    names, are left out; no rows give none."""
    out = without_repeated_lines(docs.select("doc_id", "text", F.size(F.split(common.text_or_empty(), "\n")).alias("_lines")))
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(common.text_or_empty(), "\n")))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), (F.col("_lines") - left).cast("long").alias("n_removed"), F.sha2(common.text_or_empty().cast("binary"), 256).alias("text_sha256"))
