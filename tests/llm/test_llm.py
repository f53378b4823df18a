"""The training-data operators against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from leafwork.llm import common, decontaminate, embedding_dedup, line_dedup, mixing, quality, queries, secrets, sharding, simhash, suffix_dedup, token_counts

DATA = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Extra columns that are called like what the operators use inside.
CLASHES = ["key", "k1", "k2", "pos", "n", "fp", "shard", "slot", "_row", "_source", "w1", "at", "term", "kept", "votes", "route", "starts", "_key", "lines", "next"]
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab c"), (5, "word " * 40_000), (6, "same text here. " * 40), (6, "same text here. " * 40), (7, "same text here. " * 40), (None, "no id é 😀"), (8, "a\nb\nc\nd"), (9, "x\na\nb\nc"), (10, "a\nb\nc\nd")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, "s" if i % 3 else None, None) for i, r in enumerate(ODD)], "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def components_of(ids, near):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# 1: benchmark decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(texts, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    found |= windows[tuple(w[i : i + size])]
                    hit |= set(range(i, i + size))
        out.append((len(w), len(hit), ",".join(sorted(found))))
    return out


def test_contamination(spark, docs, bench):
    rows = docs.collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    want = contaminated([r.text for r in rows], [(r.item_id, r.text) for r in bench.collect()])
    assert [got[r.doc_id] for r in rows] == want
    dirty = {r.doc_id for r, w in zip(rows, want, strict=True) if w[1]}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {r.doc_id for r in rows} - dirty


def test_contamination_by_short_and_odd_items(spark, odd, empty, bench):
    items = [(1, "ab C"), (2, ""), (3, None), (4, "word " * 12), (None, "é 😀"), (5, "here. same")]
    short = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(odd, short).collect())
    assert got == sorted(contaminated([t for _, t in ODD], [("" if i is None else i, t) for i, t in items]))
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(odd, bench.where("false")).collect()} == {False}
    assert decontaminate.clean(odd, short).columns == odd.columns


def test_proximity(spark):
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    near = "x " + " ".join(f"w{i}" if i not in (3, 7) else "other" for i in range(12))
    far = " ".join(f"w{i}" if i % 2 else "other" for i in range(12))
    df = spark.createDataFrame([(1, near), (2, far)], "doc_id long, text string")
    assert {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate.contamination(df, item).collect()} == {1: (0, 1), 2: (0, 0)}


def test_proximity_whichever_words_are_replaced(spark):
    """The replaced words occur in no text, so they are the rarest of all."""
    item = [f"w{i}" for i in range(10)]
    cases = [set(), *[{i} for i in range(10)], *[{i, j} for i in range(10) for j in range(i)], {0, 4, 9}, {1, 2, 3}]
    cases += [{*c, *range(1, 10, 2)} for c in ({0}, {2})]
    sizes = (10, 7, 3, 2)  # of 7 words six are in place, of 3 and of 2 all
    bench = spark.createDataFrame([(s, " ".join(f"{w}of{s}" for w in item[:s])) for s in sizes], "item_id long, text string")
    text = lambda s, n, c: "a " + " ".join(f"x{n}" if i in c else f"{w}of{s}" for i, w in enumerate(item[:s])) + " b"
    df = spark.createDataFrame([(100 * s + n, text(s, n, c)) for s in sizes for n, c in enumerate(cases)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_near_items for r in decontaminate.contamination(df, bench).collect()}
    assert got == {100 * s + n: int(s - len([i for i in c if i < s]) >= -(-s * 8 // 10)) for s in sizes for n, c in enumerate(cases)}



# 2: sharding


def test_shards(docs, odd, empty):
    for df, n in ((docs, 16), (odd, 5)):
        rows = sharding.shard(df, n).collect()
        sizes = collections.Counter(r.shard for r in rows)
        assert len(rows) == df.count() and max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        for r in rows:
            raw = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(empty).count() == 0


def test_walk_equals_one_key_at_a_time():
    """The plan over counts against serving single keys in the same order."""
    rng = random.Random(1)
    for _ in range(50):
        shards, arcs = rng.randrange(1, 6), rng.randrange(1, 20)
        owners = [*range(shards), *[rng.randrange(shards) for _ in range(arcs)]]
        counts = [rng.randrange(8) for _ in owners]
        total = sum(counts)
        room = [total // shards + (s < total % shards) for s in range(shards)]
        left, want, waiting = list(room), {}, [(a, k) for a, n in enumerate(counts) for k in range(n)]
        for r in range(len(owners)):
            still = []
            for a, k in waiting:
                s = owners[(a + r) % len(owners)]
                if left[s]:
                    left[s] -= 1
                    want[a, k] = s
                else:
                    still.append((a, k))
            waiting = still
        got = {(a, k): s for a, low, high, s, _ in sharding.walk(counts, owners, room) for k in range(low, high)}
        assert got == want and len(got) == total


def test_few_rows_move(docs):
    before = {r.doc_id: r.home for r in sharding.shard(docs, 16).collect()}
    after = {r.doc_id: r.home for r in sharding.shard(docs, 17).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.25 * len(before)


# 3: token counts


def test_token_counts(spark, docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = token_counts.loaded(path)[0]
    rng = random.Random(2)
    pool = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  \n\n x\t y z　\x1c\x85b", "'s I'LL don't", "\U0001fae8 new", "a \U0001fae8b c  \U0001fae8\n\U0001fae8 d e\U0001fae8", " \U0001fae8 <|endoftext|>\U0001fae8 x y", *["".join(rng.choice(pool if rng.random() < 0.5 else " ab1'\n") for _ in range(40)) for _ in range(300)]]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).union(odd.select("doc_id", "text"))
    rows = df.collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(e.ids), len(e.ids) > 512) for r, e in zip(rows, tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True))
    assert collections.Counter(tuple(r) for r in token_counts.token_counts(df, path).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_settled_code_points():
    """What the shortcut's pattern engine is trusted with, the library cuts alike."""
    tok, _, split, _ = token_counts.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    foreign = re.compile(f"[{token_counts.unsettled()}]")
    for i in range(0, 0x30000, 64):
        block = [chr(c) for c in range(i, i + 64) if not 0xD800 <= c < 0xE000 and not foreign.match(chr(c))]
        text = "".join(f"a{c}1{c}!" for c in block)
        assert [len(p) for p in split.findall(text)] == [b - a for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


# 4: quality classifier


def test_quality(spark, odd, empty):
    held = spark.read.parquet(f"{MORE}/labels.parquet").where("doc_id % 4 = 0")
    more = spark.read.parquet(f"{MORE}/documents.parquet")
    model = quality.fit(more, spark.read.parquet(f"{MORE}/labels.parquet").where("doc_id % 4 <> 0"))
    judged = quality.score(more, model).join(held, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality and not r.toxic) for r in judged]) >= 0.9  # held out; 300 labelled texts train here
    # two of 65 clean texts go, at 0.16 and 0.25; where 20,000 labelled texts train, none passes 0.025
    assert np.mean([r.kept for r in judged if r.quality and not r.toxic]) >= 0.95
    assert all(0 <= p["positive"]["+"] <= 1 for p in model.accuracies.values())
    assert quality.score(odd, model).columns == [*[c for c in odd.columns if c != "kept"], "p_quality", "p_toxic", "kept"]
    assert quality.classify(empty).count() == 0 and quality.classify(odd.limit(3), None).count() == 3


def test_em_finds_the_better_labeller():
    rng = random.Random(3)
    seen = collections.Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        seen["".join("+-"[(rng.random() < right) != truth] for right in (0.95, 0.7, 0.8)) + (("+" if truth else "-") if rng.random() < 0.3 else ".")] += 1
    patterns = sorted(seen)
    post, rate = quality.expectation_maximisation(patterns, np.array([seen[p] for p in patterns], float), 3)
    assert abs(rate[0, 0, 0] - 0.95) < 0.03 and abs(rate[0, 1, 0] - 0.7) < 0.05
    assert post[patterns.index("+++.")] > 0.95 > 0.05 > post[patterns.index("---.")]


def test_em_over_patterns_equals_em_over_texts():
    """Posteriors by text, in plain loops over all texts, against those over the counts of patterns."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("++-0") if rng.random() < 0.6 else "-" for _ in range(2)) + rng.choice("+-..") for _ in range(300)]
    trust, rounds = quality.TRUST, 25
    post = []
    for t in texts:
        lean = t.count("+") - t.count("-")
        post.append({"+": 0.95, "-": 0.05}.get(t[2], min(0.9, max(0.1, 0.5 + 0.2 * lean))))
    for _ in range(rounds):
        sides = []
        for weight in (post, [1 - p for p in post]):
            rate = []
            for j in range(2):
                seen = {v: 0.5 + sum(w for w, t in zip(weight, texts, strict=True) if t[j] == v) for v in "+-0"}
                rate.append({v: x / sum(seen.values()) for v, x in seen.items()} | {".": 1.0})
            sides.append((sum(weight) + 1, rate))
        new = []
        for t in texts:
            like = []
            for side, (prior, rate) in enumerate(sides):
                given = {"+": (trust, 1 - trust)[side], "-": (1 - trust, trust)[side]}.get(t[2], 1.0)
                like.append(prior * rate[0][t[0]] * rate[1][t[1]] * given)
            new.append(like[0] / sum(like))
        post = new
    patterns = sorted(set(texts))
    before, quality.EM_ROUNDS = quality.EM_ROUNDS, rounds
    try:
        got, _ = quality.expectation_maximisation(patterns, np.array([texts.count(p) for p in patterns], float), 2)
    finally:
        quality.EM_ROUNDS = before
    assert np.allclose([got[patterns.index(t)] for t in texts], post, atol=2e-4)


def test_repeats_of_a_labelled_row_train_once(spark, docs, labels):
    """Thousands of equal rows, labelled, do not change what is trained."""
    few = docs.limit(60).select("doc_id", "text").cache()
    many = few.unionByName(few.limit(1).crossJoin(spark.range(3000)).select("doc_id", "text"))
    given = few.select("doc_id").selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality", "0 AS toxic")
    assert len(quality.fit(many, given, sample=100).weights) == quality.BUCKETS
    assert quality.score(many, quality.fit(many, given, sample=100)).count() == 3060


# 5: SimHash


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, odd, empty):
    df = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, "text"))
    rows = {r.doc_id: fingerprint(r.text) for r in df.collect()}
    want = components_of(sorted(rows), lambda a, b: (rows[a] ^ rows[b]).bit_count() <= 3)
    for r in simhash.near_duplicates(df).collect():
        assert (r.fingerprint, r.component_id) == (f"{rows[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(odd).count() == len(ODD)


def similar_pairs(sets, least=simhash.SIMILAR):
    """All pairs of keys whose sets share that much, by an index of shingles."""
    at = collections.defaultdict(list)
    for i in sorted(sets):
        for x in sets[i]:
            at[x].append(i)
    met = collections.Counter((a, b) for ids in at.values() for k, b in enumerate(ids) for a in ids[:k])
    pairs = {p for p, n in met.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    none = [i for i in sorted(sets) if not sets[i]]
    return pairs | {(none[0], i) for i in none[1:]}


def kept_of(texts):
    """Brute force of distinct_documents() for keys that differ: texts by exact similarity of their shingles."""
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    pairs = similar_pairs({i: frozenset(simhash.hashes(texts[i], simhash.WORDS)) for i in first.values()})
    return set(components_of(sorted(first.values()), lambda a, b: (b, a) in pairs).values())


def test_candidates_reach_pairs_of_the_least_similarity(spark):
    """1,200 pairs that share 0.8 to 0.95 of their shingles: over nine in ten are found; a group of copies is one tree."""
    rng = random.Random(21)
    rows, pairs = [], []
    for k in range(1200):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        v = list(w)
        for i in rng.sample(range(300), rng.randrange(3, 8)):
            v[i] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append((2 * k, 2 * k + 1))
    sets = {i: frozenset(simhash.hashes(t, simhash.WORDS)) for i, t in rows}
    share = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    kept = {r.doc_id for r in simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 1)):
        some = [p for p in pairs if low <= share[p] < high]
        assert len(some) > 100 and sum(p[1] not in kept for p in some) > 0.9 * len(some)
    assert all(p[1] in kept for p in pairs if share[p] < 0.8) and all(p[0] in kept for p in pairs)


def test_nearest_tree():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, (60, 3)).astype(np.uint64)
    words[20:40] = words[0] ^ (np.uint64(1) << rng.integers(0, 60, (20, 3)).astype(np.uint64))
    a, b = simhash.nearest_tree(words, 6)
    d = np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    near = {(i, j) for i in range(60) for j in range(i) if d[i, j] <= 6}
    tree = {(max(i, j), min(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert tree <= near and components_of(range(60), lambda i, j: (i, j) in tree) == components_of(range(60), lambda i, j: (i, j) in near)


def test_distinct_documents(spark, docs, odd, empty):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(5)]
    near = []
    for t in base:
        for change in (1, 2, 3, 6, 12):
            w = t.split()
            for i in rng.sample(range(150), change):
                w[i] = "other"
            near.append(" ".join(w))
    rows = [(10**6 + i, t) for i, t in enumerate(base + near + base[:2] + [None, "", " \n", "one", "One", None])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = [r.doc_id for r in simhash.distinct_documents(df).collect()]
    # candidates may miss a pair that shares little more than 0.8; here one is
    assert len(got) == len(set(got)) and set(got) >= kept_of(texts) and len(got) <= len(kept_of(texts)) + 1
    # of equal rows, and of rows of one text, one stays; another text of the same key may stay too
    rows = [(7, "k k k", "a"), (7, "k k k", "a"), (1, "zz yy xx ww", "a"), (5, "zz yy xx ww", "b"), (5, "entirely other words here", "c"), (None, "k k k", "d"), (None, "own text", None)]
    got = sorted(map(repr, map(tuple, simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect())))
    assert got == sorted(map(repr, [rows[0], rows[2], rows[4], rows[6]]))
    assert simhash.distinct_documents(odd).columns == odd.columns and simhash.distinct_documents(empty).count() == 0


def test_masks_cover():
    rng = random.Random(4)
    found = simhash.masks(3)
    for _ in range(20_000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(not flips & m for m in found)


def test_blocks_lose_no_link(spark):
    rows = spark.createDataFrame([((1 << a) ^ (1 << b),) for a in range(30) for b in range(a)], "fp long").distinct()
    whole, cut = (sorted(map(tuple, common.components(simhash.near_links(rows, 3, n)).collect())) for n in (2048, 16))
    assert whole == cut and len(whole) == rows.count() - 1


def test_components_of_chains_and_stars(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1050).selectExpr("1000L AS a", "id AS b"))
    got = collections.Counter(r.root for r in common.components(edges).collect())
    assert got == {0: 300, 1000: 49}


# 6: line dedup


def test_lines(spark, docs, odd, empty, duck):
    from conftest import same

    same(queries.op6_line_dedup(spark, DATA), duck.execute(queries.ORACLE_SQL["op6_line_dedup"]))
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(odd).where("doc_id in (1, 2, 8, 9, 10)").collect()}
    assert got == {(1, None): (0, 0), (2, ""): (1, 0), (8, "a\nb\nc\nd"): (4, 0), (9, "x"): (4, 3), (10, ""): (4, 4)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_rows_that_share_a_key(spark):
    """Text that stands once stays, whatever other rows of its key lose; equal rows are one document."""
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "u\nv\nw"), (None, "a\nb\nc"), (None, "p\nq\nr"), (3, "k\nl\nm"), (3, "k\nl\nm")]
    got = sorted(map(repr, ((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(1, "", 3), (2, "", 3), (2, "u\nv\nw", 0), (None, "a\nb\nc", 0), (None, "p\nq\nr", 0), (3, "k\nl\nm", 0), (3, "k\nl\nm", 0)]))


# 7: mixing


def test_mixture(docs, odd, empty):
    weights = {f"src{i}": i + 1.0 for i in range(10)} | {"*": 5.0}
    rows = mixing.mix(docs, weights, block=2).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.slot].add(r.source)
    assert sorted(by) == list(range(len(by))) and all(len(s) == 1 for s in by.values()) and len({(r.slot, r.place) for r in rows}) == len(rows)
    found = {r.source for r in rows}
    other = collections.Counter(r.source for r in rows if r.source not in weights)
    parts = {s: weights[s] if s in weights else weights["*"] * other[s] / other.total() for s in found}
    served, last = collections.Counter(), max(r.slot for r in rows if r.phase == 0)
    for t in range(last + 1):
        served[next(iter(by[t]))] += 1
        assert all(abs(served[s] - (t + 1) * q / sum(parts.values())) < 1 for s, q in parts.items())
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_weights_hold_after_a_tiny_source():
    """Of equally many blocks a is to have three in four until it runs dry; z is dry almost at once."""
    rows, _ = mixing.plan({"a": 3000, "b": 3000, "z": 1}, {"a": Fraction(3), "b": Fraction(1), "z": Fraction(1, 2)})
    served = {(r["phase"], r["_source"]): r["_high"] - r["_low"] for r in rows}
    assert served[0, "z"] == 1 and sum(served[0, s] for s in "ab") < 20
    assert abs(served[1, "a"] / (served[1, "a"] + served[1, "b"]) - 0.75) < 0.005 and served[0, "a"] + served[1, "a"] == 3000
    assert sum(served.values()) == 6001


@pytest.mark.parametrize("rows", [{"a": 100_000, "b": 250_000, "c": 777_000}, {"a": 1_600_000, "b": 300, "c": 40_000, "d": 1}])
def test_unequal_sources_keep_their_weights_over_many_slots(rows):
    """After each of up to 100,000 slots each source is less than a block from its weight, the root of its rows, or a given small one."""
    blocks = {s: -(-n // 16) for s, n in rows.items()}
    for weights in ({s: Fraction(max(1, int(n**0.5))) for s, n in rows.items()}, {s: mixing.exact(w) for s, w in zip(rows, (0.9123, 0.0002, 0.0873, 0.0002))}):
        planned, orders = mixing.plan(blocks, weights)
        assert all(sum(r["_high"] - r["_low"] for r in planned if r["_source"] == s) == n for s, n in blocks.items())
        for phase, order in enumerate(orders):
            here = [r for r in planned if r["phase"] == phase]
            length = sum(r["_high"] - r["_low"] for r in here)
            at = np.array([*mixing.turns([order]).to_pydict()["_at"]])
            for r in here:
                mine = np.flatnonzero(order == r["_k"])
                i = np.arange(min(r["_high"] - r["_low"], 100_000))
                slot = i // r["_parts"] * r["_around"] + mine[i % r["_parts"]]
                share = weights[r["_source"]] / sum(weights[x["_source"]] for x in here)
                # served before and after each of its slots, against what is due by then
                assert (np.abs(i - slot * float(share)) < 1 + 1e-6).all() and (np.abs(i + 1 - (slot + 1) * float(share)) < 1 + 1e-6).all()
                assert (slot < length).all()
            assert sorted(at) == list(range(len(order)))


def test_sources_of_weight_zero_come_last(spark):
    df = spark.createDataFrame([(i, "abz"[i % 3]) for i in range(900)], "doc_id long, source string")
    got = mixing.mix(df, {"a": 1.0, "b": 3.0}, block=4).collect()
    assert len(got) == 900 and min(r.slot for r in got if r.source == "z") > max(r.slot for r in got if r.source != "z")
    served = collections.Counter(r.source for r in got if r.phase == 0)
    assert abs(served["b"] - 3 * served["a"]) <= 16


def test_many_sources(spark):
    """Two large sources and 600 small ones, in blocks of two rows: all rows are scheduled, each source by its weight."""
    rows = [(i, f"big{i % 2}") for i in range(8000)] + [(8000 + i, f"small{i % 600}") for i in range(600 * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, {"big0": 300.0, "big1": 100.0, "*": 600.0}, block=2).collect()
    assert sorted((r.doc_id, r.source) for r in got) == rows and all(r.release <= r.slot < r.deadline for r in got)
    order = dict(sorted((r.slot, r.source) for r in got))
    assert list(order) == list(range(len(order))) and len({(r.slot, r.source) for r in got}) == len(order) and len({(r.slot, r.place) for r in got}) == len(got)
    weights, served = {"big0": 0.3, "big1": 0.1} | {f"small{i}": 0.001 for i in range(600)}, collections.Counter()
    for t in range(max(r.slot for r in got if r.phase == 0) + 1):
        served[order[t]] += 1
        assert all(abs(served[s] - (t + 1) * w) < 2 for s, w in weights.items() if t % 50 == 0 or s == order[t])
    assert t > 5000


def test_one_period_keeps_within_a_block():
    rng = random.Random(5)
    for _ in range(30):
        parts = [rng.randrange(1, 60) ** 2 for _ in range(rng.randrange(1, 12))]
        order, around = mixing.schedule(parts, sum(parts)), sum(parts)
        for k, q in enumerate(parts):
            slots = np.flatnonzero(order == k).tolist()
            assert len(slots) == q and all(i * around // q <= t < -(-(i + 1) * around // q) for i, t in enumerate(slots))


# 8: embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:100] + rng.normal(size=(100, 16)) * 0.12
    x[200:220] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = components_of(list(range(300)), lambda a, b: near[a, b])
    for small in ({}, {"chunk": 7}, {"chunk": 7, "most": 1}):
        for r in embedding_dedup.near_vectors(df, **small).collect():
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum() - 1, want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_pivots_prune_where_vectors_cluster():
    """Vectors round 64 centres: a vector goes to few cells besides its own, and the join is the whole one."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(64, 32))
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(64 * 60, 32)) * 0.12
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = np.sqrt(0.2)
    pivots = embedding_dedup.chosen_pivots(unit, 10**7, r, embedding_dedup.CHUNK, 1024)
    home, near, _ = embedding_dedup.cells_of(unit, pivots, None, r)
    reach = np.full(len(pivots), -2 * r)
    np.maximum.at(reach, home, near)
    assert len(pivots) == 64 and embedding_dedup.cells_of(unit, pivots, reach, r)[2].sum(axis=1).mean() < 1.5
    even = rng.normal(size=(2000, 64))
    assert len(embedding_dedup.chosen_pivots(even / np.linalg.norm(even, axis=1, keepdims=True), 10**5, r, embedding_dedup.CHUNK, 1024)) <= 4


def test_odd_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (10, [1e300, 0.0]), (11, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(None).cast("string") for c in CLASHES})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (4, 1) if i in (1, 2, 3, 10, 11) else (0, i) for i, _ in rows}
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


# 9: suffix arrays


def removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows():
    rng = random.Random(7)
    for _ in range(40):
        length = rng.choice([32, 45, 64])
        base = bytes(rng.choice(b"ab\x00c\xff") for _ in range(rng.choice([50, 300])))
        texts = [b"".join(base[rng.randrange(200) :][: rng.randrange(200)] if rng.random() < 0.6 else rng.choice([b"a" * rng.randrange(100), b"ab" * rng.randrange(60)]) for _ in range(4)) for _ in range(5)]
        seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(texts, length)] == want


@pytest.mark.parametrize("most", [suffix_dedup.GROUP_BYTES, 400, 10])
def test_strings(spark, odd, empty, monkeypatch, most):
    """most = 400 splits groups until they fit, most = 10 down to single windows."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common_text = noise(300)
    texts = [noise(rng.randrange(90)) + common_text[rng.choice([0, 0, 30]) : rng.choice([300, 200])] + noise(rng.randrange(60)) for _ in range(30)] + ["xy" * 60, "xy" * 70, None, "", "z" * 63, "z" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.where("doc_id <> 5").select(F.col("doc_id") + 100, "text"))
    rows = df.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, removed([(r.text or "").encode() for r in rows], 64), strict=True))
    assert collections.Counter(map(tuple, suffix_dedup.dedup_strings(df, 64).collect())) == want
    assert suffix_dedup.dedup_strings(empty, 64).count() == 0


def test_strings_of_many_near_copies(spark, monkeypatch):
    """300 copies of one text with a few letters changed in each: all share their hashes and are split."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = []
    for _ in range(300):
        t = list(base)
        for i in rng.sample(range(600), 6):
            t[i] = rng.choice("uvwxyz")
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    want = collections.Counter((i, *x) for i, x in enumerate(removed([t.encode() for t in texts + texts[:5]], 64)))
    assert collections.Counter(map(tuple, suffix_dedup.dedup_strings(df, 64).collect())) == want


def test_strings_of_one_period_in_many_lengths(spark, monkeypatch):
    """Runs of periods 1, 2 and 7, alone and inside other text: groups of them fit no suffix array, whatever the core."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 6000)
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["a" * (400 + i) for i in range(40)] + ["xy" * (150 + i) for i in range(40)] + [noise(rng.randrange(80)) + "-" * (70 + 3 * i) + noise(rng.randrange(80)) for i in range(60)]
    texts += [noise(30) + ("=-=-+-~" * 90)[rng.randrange(7) :][: 100 + 5 * i] + noise(40) for i in range(60)] + ["xy" * 20, "z" * 64, noise(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = collections.Counter((i, *x) for i, x in enumerate(removed([t.encode() for t in texts], 64)))
    assert collections.Counter(map(tuple, suffix_dedup.dedup_strings(df, 64).collect())) == want


def test_long_runs_in_a_group_beyond_one_array(spark):
    """60 runs of one letter, over 512 KB in all: each byte goes."""
    df = spark.createDataFrame([(i, "a" * (10_000 + i)) for i in range(60)], "doc_id long, text string")
    assert {(r.n_bytes - r.n_removed, r.n_spans) for r in suffix_dedup.dedup_strings(df).collect()} == {(0, 1)}


# 10: secrets


def test_secrets(spark, docs, odd, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    extra = ["token: secret: abcdefghij", 'PASSWD="abcdefgh" password==abcdefghi', "😀 AKIA" + "A" * 12 + " AKIA1 " + "ab0" * 11 + " apikey:short", "TOKEN = 12345678"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    for r in df.collect():
        spans = []
        for rank, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]):
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(r.text or "") if len(m[group]) >= least]
        base = ",".join(x[2] for x in sorted(spans))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[r.doc_id].spans.split(","))
    assert secrets.secret_spans(odd).count() == len(ODD) and secrets.secret_spans(empty).count() == 0


def test_links_equal_all_pairs(spark):
    """The interval join against every pair of parts, some far longer than the scope and some in other texts."""
    rng = random.Random(14)
    kinds = [x[0] for x in secrets.STRONG + secrets.WEAK]
    parts = []
    for k in range(40):
        for _ in range(rng.randrange(12)):
            low = rng.randrange(3000)
            parts.append((k % 7, k, rng.choice(kinds), low, low + rng.choice([1, 20, 60, 900])))
    parts = sorted(set(parts))
    for scope in (50, 200):
        want = [p for p in parts if any(p[:2] == q[:2] and (p[2], q[2]) in secrets.COMPLEMENTS and p[3] <= q[4] + scope and q[3] <= p[4] + scope for q in parts)]
        got = secrets.linked(spark.createDataFrame(parts, "k1 long, k2 long, kind string, start int, end int"), scope)
        assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(parts)


def test_weak_parts_need_company(spark):
    blob = "aB3" * 14
    rows = [(1, f"AKIA{'A' * 12} {blob}"), (2, f"plain {blob}"), (3, f"AKIA{'A' * 12} {'. ' * 200}{blob}"), (4, f"user: bob7 https://x.example/y password: hunter22")]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "access:0:16,blob:17:59", 2: "", 3: "access:0:16", 4: "ident:0:10,endpoint:11:30,assign:31:49"}


# the pipeline


def test_pipeline(spark, docs, bench, labels):
    kept = docs
    judged = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    stage = [f for _, f in corpus_pipeline.STAGES]
    one = common.cut(stage[0](spark, kept, DATA))
    assert {r.doc_id for r in one.collect()} == judged and one.columns == docs.columns
    two = common.cut(stage[1](spark, one, DATA))
    assert sorted(r.doc_id for r in two.collect()) == sorted(kept_of({r.doc_id: r.text for r in one.collect()})) and two.columns == docs.columns
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = two.collect()
    clean = {r.doc_id for r, x in zip(texts, contaminated([r.text for r in texts], items), strict=True) if not x[1]}
    three = common.cut(stage[2](spark, two, DATA))
    assert {r.doc_id for r in three.collect()} == clean and three.columns == docs.columns
    four = common.cut(stage[3](spark, three, DATA))
    assert sorted(map(tuple, four.collect())) == sorted(map(tuple, three.collect())) and four.columns == docs.columns
    want = sorted(map(tuple, stage[4](spark, four, DATA).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want and {r[0] for r in want} == clean


def test_slots_follow_the_mixture(spark, docs):
    """Without its mixing stage the pipeline would number these rows otherwise; shards are those of the ring."""
    schedule = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs).collect()}
    placed = corpus_pipeline.sharded(spark, docs, DATA).collect()
    plain = {r.doc_id: (r.shard, r.home) for r in sharding.shard(docs).collect()}
    assert {r.doc_id: (r.shard, r.home) for r in placed} == plain and len(placed) == docs.count()
    for s in {r.shard for r in placed}:
        mine = sorted((r.slot, r.doc_id) for r in placed if r.shard == s)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [schedule[d] for _, d in mine] == sorted(schedule[d] for _, d in mine)


def test_last_stages_on_repeated_and_null_keys(spark, odd, empty):
    """No row is lost or doubled, equal rows among them, and each shard's slots follow the order of the mixing stage."""
    for df in (odd, odd.union(odd).union(odd)):
        told = lambda rows, names=tuple(c for c in df.columns if c not in sharding.ADDED): [tuple(str(r[c]) for c in names) for r in rows]
        order = told(corpus_pipeline.mixed(spark, df, DATA).collect())
        assert collections.Counter(order) == collections.Counter(told(df.collect()))
        placed = corpus_pipeline.sharded(spark, df, DATA).collect()
        assert collections.Counter(told(placed)) == collections.Counter(order)
        sizes = collections.Counter(r.shard for r in placed)
        assert {sizes[s] for s in range(16)} <= {len(order) // 16, len(order) // 16 + 1}
        for s in sizes:
            mine = sorted((r for r in placed if r.shard == s), key=lambda r: r.slot)
            assert [r.slot for r in mine] == list(range(sizes[s]))
            later = iter(order)
            assert all(x in later for x in told(mine))
    assert corpus_pipeline.mixed(spark, empty, DATA).columns == empty.columns and corpus_pipeline.sharded(spark, empty, DATA).count() == 0


def test_pipeline_on_empty_documents(spark, docs, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
