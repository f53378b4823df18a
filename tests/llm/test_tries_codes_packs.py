"""Prefix tries, vector codes and packing against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwork.llm import packing, prefix_trie, queries, vector_codes
from tests.llm.test_llm import CLASHES, ODD

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def trie_rows(rows):
    convs = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    nodes, out = {}, {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        turns = convs.get(c - c % 100, [])[:h] + convs[c][h:]
        for d in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:d]), ([], []))
            members.append(c)
            if d == len(turns):
                ends.append(c)
    for k in sorted(nodes, key=len, reverse=True):
        members, ends = nodes[k]
        kids = [out[x] for x in nodes if x and x[:-1] == k]
        saved = (len(members) - 1) * len(k[-1][1]) if k else 0
        out[k] = (min(members), len(k), min(nodes[k[:-1]][0]) if k else None, len(members), len(kids), sum(x[5] for x in kids) or 1, saved + sum(x[6] for x in kids), hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("subtree", [prefix_trie.SUBTREE, 40, 0])
def test_prefix_trie(spark, subtree, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 50)
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert rows_of(prefix_trie.Trie(df, subtree=subtree).nodes()) == trie_rows(df.select("conv_id", "turn", "role", "text").collect())


def test_odd_conversations(spark, monkeypatch):
    """Null turns, roles, texts and ids, repeated and turnless conversations, a long one in segments, and many ids at one end."""
    monkeypatch.setattr(prefix_trie, "SEGMENT_BITS", 2)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["u", None]), rng.choice(["hi", "", None, "é😀"])) for c in [*range(190, 215), 400, 707] for t in [None, *range(rng.randrange(6))]]
    rows += [(3, 0, "u", "only"), (100, 0, "u", "a"), (None, 1, "u", "lost"), (500, 1, None, None), (2**40 + 1, 3, "u", "x")]
    rows += [(900, t, "u", "t" * (t % 7)) for t in range(60)] + [(901, t, "u", "t" * (t % 7)) for t in range(60)] + [(1000 + i, 0, "u", "same") for i in range(99)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in [*CLASHES, "c", "depth", "p1", "q1", "rank", "total", "size"]})
    want = trie_rows(rows)
    for subtree in (prefix_trie.SUBTREE, 20, 0):
        assert rows_of(prefix_trie.Trie(df, subtree=subtree).nodes()) == want
    assert prefix_trie.Trie(df.where("false")).nodes().collect() == []


def test_louds_is_a_tree_in_level_order(spark):
    parent, level = np.array([-1, 0, 0, 1, -1, 4, 3]), np.array([0, 1, 1, 2, 0, 1, 3])
    trie = prefix_trie.Louds(parent, level, np.array([5, 9, 2, 1, 4, 8, 7]), np.arange(7))
    assert trie.order.tolist() == [4, 0, 5, 2, 1, 3, 6]
    assert "".join(map(str, trie.unpacked().astype(int))) == "110" + "10" + "110" + "0" + "0" + "10" + "10" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 1, 1, 4, 5] and trie.degrees().tolist() == [1, 2, 0, 0, 1, 1, 0]
    assert trie.summed(np.ones(7, int)).tolist() == [2, 5, 1, 1, 3, 2, 1]
    of = prefix_trie.Trie(spark.read.parquet(f"{DATA}/conversations.parquet"))
    shards = of.tries().collect()
    assert sum(r.n for r in shards) == of.nodes_.where("not upper").count() and all(len(r.labels) == len(r.sizes) == 8 * r.n and len(r.bits) == -(-(2 * r.n + 1) // 8) for r in shards)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), of sound vectors whose length `parts` divides."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    vectors = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    n, code = len(vectors[0]) // parts, [[] for _ in rows]
    error, books = [0] * len(rows), []
    for p in range(parts):
        part = [v[p * n : (p + 1) * n] for v in vectors]
        book = [list(x) for x in part[:entries]]
        for r in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in enumerate(book)) for x in part]
            for i in range(len(book) if r < rounds else 0):
                mine = [x for x, b in zip(part, near) if b[1] == i]
                book[i] = [sum(c) // len(mine) for c in zip(*mine)] if mine else book[i]
        books.append(book)
        for k, (d, i) in enumerate(near):
            code[k].append(i)
            error[k] += d
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], bytes(c).hex(), e, total[r[2]]) for r, c, e in zip(rows, code, error)), key=repr), hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()


def test_vector_codes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.3, -0.7, rng.gauss(0, 0.4)]) for _ in range(12)], rng.choice([1, 2, None])) for i in rng.sample(range(1000), 420)]
    rows += rows[:5] + [(None, rows[0][1], 9)] + [(2000 + i, rows[7][1], 1) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in [*CLASHES, "vector", "code", "error", "entry"]})
    bad = [(-1, None, 1), (-2, [0.1] * 11 + [None], 1), (-3, [float("nan")] * 12, 2), (-4, [float("inf")] * 12, None)]
    df = df.unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<double>, label int"), allowMissingColumns=True)
    coded, books = vector_codes.vector_codes(df.repartition(5))
    got = sorted(((r[0], bytes(r[1]).hex(), r[2], r[3]) for r in coded.collect()), key=repr)
    assert (got, vector_codes.digest(books)) == brute_codes(rows)
    assert vector_codes.vector_codes(df.where("vec_id < 0"))[0].collect() == []
    short = spark.createDataFrame([(1, [0.5, 0.25, 1.0], 1), (2, [0.5], 1), (3, [], None)], "vec_id long, embedding array<float>, label int")
    assert [bytes(r.code).hex() for r in vector_codes.vector_codes(short)[0].orderBy("vec_id").collect()] == ["00000000", "00010100", "02010100"]
    assert {r.error for r in vector_codes.vector_codes(short)[0].collect()} == {0}
    huge = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(huge)


def test_the_search_equals_a_full_scan_and_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    for spread in (3, 400):
        centres = rng.integers(-1000, 1000, (40, 8))
        parts = centres[rng.integers(0, 40, 3000)] + rng.integers(-spread, spread, (3000, 8))
        book = np.r_[centres, centres[:7], parts[:80]]
        d = ((parts[:, None] - book[None]) ** 2).sum(2)
        monkeypatch.setattr(vector_codes, "RING", 8)
        for exact in (1000, 1 << 27):
            find, seen = vector_codes.Nearest(book, exact), []
            whole = vector_codes.squares
            monkeypatch.setattr(vector_codes, "squares", lambda x, y, e: seen.append(len(x) * len(y)) or whole(x, y, e))
            index, best = find(parts, rng.integers(0, len(book), len(parts)))
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
            seen.clear()
            again, _ = find(parts, index)
            assert (again == index).all() and (spread > 3 or sum(seen) < 0.5 * d.size)
            monkeypatch.setattr(vector_codes, "squares", whole)


def check_packs(rows, pieces, window=packing.WINDOW):
    """pieces (doc, start, length, ids, doc_tokens, sequence, offset) hold every id of the rows (doc, text) once, without padding."""
    tok = Tokenizer.from_file(BPE)
    want = sorted((repr(d), tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in rows)
    docs, seqs = {}, {}
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(ids) > 0
        docs.setdefault((repr(r.doc_id), r.doc_tokens), []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = []
    for (d, n), parts in docs.items():
        parts.sort()
        while parts:  # rows that share a key and a length
            row = []
            while len(row) < n:
                i = next(i for i, (s, _) in enumerate(parts) if s == len(row))
                row += parts.pop(i)[1]
            got.append((d, tuple(row)))
    assert sorted(got) == want
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= window and total & (total - 1) == 0
    return seqs


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 5000])
def test_packing(spark, block):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    seqs = check_packs([tuple(r) for r in df.select("doc_id", "text").collect()], packing.pack(df, BPE, block=block).collect())
    assert sum(sum(n for _, n in p) < packing.WINDOW for p in seqs.values()) <= 11


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 300)
    monkeypatch.setattr(packing, "LONG_TEXT", 5000)
    rng = random.Random(2)
    chars = [*map(chr, range(128)), *map(chr, range(0xA0, 0x180)), *"‐‧‰‾  ²½Ⅷ中文́🂡𐋡ʼn", "  ", "'s", "'LL", "<|endoftext|>", " the", "é "]
    rows = [(i, "".join(rng.choices(chars, k=rng.randrange(60)))) for i in range(150)] + [(i, "".join(map(chr, range(i, i + 64)))) for i in range(0, 0x3000, 64)] + [(r[0], r[1][:30_000] if r[1] else r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in [*CLASHES, "start", "ids", "length", "offset"]})
    check_packs(rows, packing.pack(df.repartition(3), BPE, block=4096).collect())
    assert packing.pack(df.where("false"), BPE).collect() == []


def test_balance():
    rng = random.Random(4)
    lengths = [rng.choice([1, 7, 100, 700, 2048, 2500, rng.randrange(1, 6000)]) for _ in range(900)]
    pieces = packing.balanced(lengths)
    rooms = {}
    for _, _, n, seq, off in sorted(pieces, key=lambda p: p[3:]):
        assert rooms.get(seq, 0) == off
        rooms[seq] = off + n
    assert sorted(rooms.values(), reverse=True)[: sum(lengths) // 2048] == [2048] * (sum(lengths) // 2048)
    # far fewer cuts than a plain concatenation makes
    assert len(pieces) - len(lengths) - sum(n // 2048 for n in lengths) < 0.2 * len(rooms)
    cost = lambda n: n * packing.EVEN + n * n
    by = {}
    for _, _, n, seq, _ in packing.balanced([300] * 100 + [100] * 300, 1200):
        by[seq] = by.get(seq, 0) + cost(n)
    assert max(by.values()) - min(by.values()) <= 2 * cost(100)


def test_queries_name_their_columns(spark):
    assert queries.op13_packing(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pivots_are_judged_by_other_vectors():
    """Even vectors in 64 dimensions get one pivot at any size, clustered ones many."""
    from leafwork.llm import embedding_dedup

    rng = np.random.default_rng(0)
    near = math.sqrt(2 - 2 * 0.9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    even = unit(rng.normal(size=(2048, 64)))
    middle = rng.normal(size=(200, 64))
    grouped = unit(middle[rng.integers(0, 200, 2048)] + 0.05 * rng.normal(size=(2048, 64)))
    for n in (10**5, 10**6, 10**7):
        assert len(embedding_dedup.chosen_pivots(even, n, near, 8192, 256)) == 1
        assert len(embedding_dedup.chosen_pivots(grouped, n, near, 8192, 256)) == 256
