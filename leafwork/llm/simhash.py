"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Every bit position has a
random code of RADIUS + 1 bits; mask v of the 2^(RADIUS+1) - 1 tables keeps the positions whose code has an odd
product with v. RADIUS positions span a space of at most RADIUS dimensions, so some v is orthogonal to the codes of
whichever bits differ: every pair within the radius agrees on all that this table keeps, and collides there.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import Scratch, components, cut, small, text_key

RADIUS = 3
SHINGLE = 3
#: Fingerprints of a table's bucket that one task compares with each other; larger buckets are cut into blocks.
BLOCK = 2048
#: For whole documents: shingles of five words, of which near copies share so much of all that both have.
WORDS, SIMILAR = 5, 0.8
#: Fingerprints of each text, the bits of one, and the differing bits at which one of them covers a pair.
PRINTS, PRINT_BITS, PRINT_RADIUS = 4, 40, 4
#: Of all 192 bits those in which candidates may differ: texts of that similarity differ in 29, give or take 5, others in 96.
SIEVE = 44
#: Rows of tables that a task makes, about.
TABLE_ROWS = 500_000
#: Fixed: words are runs of anything but ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingle hashes that are counted at once.
AT_ONCE = 1 << 17


def hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of the text's words; of all words if there are fewer."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # lower() on bytes folds A-Z alone
    if not words:
        return []
    runs = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return [digest(run, 42) for run in map(b" ".join, runs)]


def majority(hashed: list[int], ends: list[int]) -> np.ndarray:
    """The fingerprints of texts whose hashes end at `ends`: bits set in over half of them; 0 where there are none."""
    out = np.zeros(len(ends), np.uint64)
    counts, done = np.zeros((len(ends), 64), np.int64), 0
    of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    for i in range(0, len(hashed), AT_ONCE):
        some = np.array(hashed[i : i + AT_ONCE], np.uint64)
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = of[i : i + AT_ONCE]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        counts[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    sizes = np.diff([0, *ends])
    for bit in range(64):
        out |= (2 * counts[:, bit] > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of each row of docs; fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 64):
                hashed, ends = [], []
                for text in batch.column(1).slice(i, 64):
                    hashed += hashes(text.as_py(), shingle)
                    ends.append(len(hashed))
                found.append(majority(hashed, ends))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))], names=["key", "fp"])

    of = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return of.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, fp bigint").withColumnRenamed("key", key)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks of so many bits for a radius: 2^(radius+1) - 1 of them, each of about half of the bits."""
    codes = [random.Random(64 * radius + i).randrange(1, 2 ** (radius + 1)) for i in range(bits)]
    return [sum(((code & v).bit_count() & 1) << i for i, code in enumerate(codes)) for v in range(1, 2 ** (radius + 1))]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of the pairs (a, b) over nodes 0 to n - 1 that make a spanning forest."""
    up, keep = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def close_in_group(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of fingerprints within the radius; between unequal sides only, where there are two."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low, high = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    for i in range(0, len(low), 512):
        rows = low[i : i + 512]
        x, y = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, high]) <= radius)
        x, y = rows[x], high[y]
        x, y = x[x != y], y[x != y]
        some = forest(x, y, len(fp))
        found.append((x[some], y[some]))
    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
    some = forest(a, b, len(fp))
    return a[some], b[some]


def links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of rows (group, side, fp) that come sorted by group; groups may span batches."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch | None:
        group, side, fp = rows.T.view(np.uint64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        a, b = [], []
        for i, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            if n == 2:
                if (int(fp[i]) ^ int(fp[i + 1])).bit_count() <= radius:
                    a.append(fp[i : i + 1])
                    b.append(fp[i + 1 : i + 2])
                continue
            x, y = close_in_group(fp[i : i + n], side[i : i + n], radius)
            a.append(fp[i : i + n][x])
            b.append(fp[i : i + n][y])
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        if not len(rows):
            continue
        change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        whole = held + [rows[: change[-1]]] if len(change) else []
        if held and rows[0, 0] != held[-1][-1, 0]:
            if (found := out(np.concatenate(held))) is not None:
                yield found
            held, whole = [], [rows[: change[-1]]] if len(change) else []
        held = [rows[change[-1] :]] if len(change) else held + [rows]
        if whole and (found := out(np.concatenate(whole))) is not None:
            yield found
    if held and (found := out(np.concatenate(held))) is not None:
        yield found


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that connect exactly those that pairs within the radius connect.

    Every table's buckets are compared whole, but for pairs that others already connect. A bucket of more than
    `block` fingerprints is cut into blocks by hash, and each pair of blocks is a group of its own: rows grow by
    the number of blocks, and no task gets more than two blocks of a bucket.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for v, m in enumerate(masks(radius))]))
    # each fingerprint makes a row for every table, so a few of them are enough for a task
    spread = distinct.repartition(1 + distinct.count() * len(masks(radius)) // TABLE_ROWS)
    rows = spread.select("fp", tables.alias("t")).select("fp", F.xxhash64("t.v", "t.bits").alias("bucket"))
    large = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    rows = rows.join(small(large), "bucket", "left")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    group = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair)
    rows = rows.select(group.alias("g"), F.col("mine").cast("long").alias("side"), "fp")
    sorted_rows = rows.repartition("g").sortWithinPartitions("g")
    return sorted_rows.mapInArrow(lambda batches: links(batches, radius), "a bigint, b bigint")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) of each row of docs.

    component_id is the smallest key that a row reaches over fingerprints at most `radius` bits apart, itself
    included; equal fingerprints are one node, so copies cost nothing. Null, empty and word-less texts have
    fingerprint zero and are linked like any other. Null keys are never the smallest unless all are null. No
    rows give no rows; repeated rows give repeated results; other columns are ignored.
    """
    prints = cut(fingerprints(docs, text, key, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = cut(components(near_links(distinct.select("fp"), radius)))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select(key, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of what h hashes, for each turn."""
    x = h + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


NODE = ["w0", "w1", "w2"]


def wide_prints(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(key, w0, w1, w2): 192 bits of each row of docs, three fingerprints by different hashes of its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 64):
                each = [np.unique(np.array(hashes(t.as_py(), shingle), np.uint64)) for t in batch.column(1).slice(i, 64)]
                ends = np.cumsum([len(x) for x in each]).tolist()
                whole = np.concatenate(each)
                found.append([majority(mixed(whole, turn), ends) for turn in range(3)])
            words = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *words], names=["key", *NODE])

    of = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return of.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, w0 bigint, w1 bigint, w2 bigint").withColumnRenamed("key", key)


def nearest_tree(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of words (n, 3) at most `most` bits apart that make a spanning forest of least distances."""
    n = len(words)
    near, to = np.full(n, 1 << 30), np.zeros(n, np.int64)
    out, now, left = [], 0, np.ones(n, bool)
    for _ in range(n - 1):
        left[now] = False
        d = np.bitwise_count(words ^ words[now]).sum(axis=1, dtype=np.int64)
        closer = d < near
        near[closer], to[closer] = d[closer], now
        now = int(np.where(left, near, 1 << 31).argmin())
        if near[now] <= most:
            out.append((now, to[now]))
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return a, b


def candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(a0, a1, a2, b0, b1, b2) of candidates in the groups of rows (group, w0, w1, w2) that come sorted by group; groups may span batches."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch | None:
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        size = np.diff(np.r_[first, len(rows)])
        words = rows[:, 1:].view(np.uint64)
        two = first[size == 2]
        two = two[np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1, dtype=np.int64) <= most]
        pairs = [(two, two + 1)]
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = nearest_tree(words[i : i + n], most)
            pairs.append((i + a, i + b))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[a, 1:].T, *rows[b, 1:].T)], names=[*"a0 a1 a2 b0 b1 b2".split()])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        if not len(rows):
            continue
        if held and rows[0, 0] != held[-1][-1, 0]:
            if (found := out(np.concatenate(held))) is not None:
                yield found
            held = []
        change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        if len(change):
            if (found := out(np.concatenate([*held, rows[: change[-1]]]))) is not None:
                yield found
            held = [rows[change[-1] :]]
        else:
            held.append(rows)
    if held and (found := out(np.concatenate(held))) is not None:
        yield found


def in_blocks(rows: DataFrame, block: int, scratch: Scratch, *ids: str) -> DataFrame:
    """(g, ids) from rows (bucket, ids): groups of at most two blocks, such that every two rows of a bucket meet in one."""
    large = scratch.cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    rows = rows.join(small(large), "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(*ids, F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair).alias("g"), *ids)


def wide_candidates(nodes: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b), structs of NODE: pairs at most SIEVE of 192 bits apart, of each bucket a spanning forest of the closest.

    160 of the bits are four fingerprints of 40, each with the covering tables of radius 4. A pair at most 19 of those
    bits apart has a fingerprint within the radius, and so meets for certain; others meet as the tables happen to fall.
    """
    low = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << n) - 1))
    high = lambda c, n: F.shiftrightunsigned(c, n)
    prints = [low("w0", 40), high("w0", 40).bitwiseOR(F.shiftleft(low("w1", 16), 24)), high("w1", 16).bitwiseAND(F.lit((1 << 40) - 1)), high("w1", 56).bitwiseOR(F.shiftleft(low("w2", 32), 8))]
    each = enumerate(masks(PRINT_RADIUS, PRINT_BITS))
    masked = [F.xxhash64(F.lit(p), F.lit(v), bits.bitwiseAND(F.lit(m))) for v, m in each for p, bits in enumerate(prints[:PRINTS])]
    spread = nodes.repartition(1 + nodes.count() * len(masked) // TABLE_ROWS)
    rows = spread.select(*NODE, F.explode(F.array(*masked)).alias("bucket"))
    dealt = in_blocks(rows, block, scratch, *NODE).repartition("g").sortWithinPartitions("g")
    names = "a0 a1 a2 b0 b1 b2".split()
    found = dealt.mapInArrow(lambda batches: candidates(batches, SIEVE), ", ".join(f"{x} bigint" for x in names))
    end = lambda x: F.struct(*[F.col(f"{x}{i}").alias(c) for i, c in enumerate(NODE)])
    return found.select(F.least(end("a"), end("b")).alias("a"), F.greatest(end("a"), end("b")).alias("b")).distinct()


def shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (node, text): the sorted distinct hashes of a text's shingles as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            sets = [np.unique(np.array(hashes(t.as_py(), shingle), np.uint64)).tobytes() for t in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The (a, b) of rows (a, b, x, y) whose sets x and y share at least so much of their union; two empty sets do."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(2)], names=["a", "b"])


def distinct_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILAR, shingle: int = WORDS) -> DataFrame:
    """The rows of docs less exact and near copies: one row of each group stays.

    Of rows of equal text the one of the smallest key stays, null keys last; ties are alike but for other columns, and
    one of them stays. Texts are linked if their sets of word shingles share `least` of their union. Candidates come from
    the fingerprints: see wide_candidates(); of a bucket, only a forest of the closest pairs is compared, shingle by
    shingle, and texts that are linked in steps are a group, of which that of the smallest key stays, ties by the
    text's hash. Texts of equal fingerprints, 192 bits, are one node. Null, empty and word-less texts are a group. No rows
    give no rows; columns may have any names.
    """
    scratch = Scratch()
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    rows = docs.select(*text_key(F.col(text)), order.alias("place"), F.struct(*docs.columns).alias("row"))
    once = scratch.cut(rows.groupBy("k1", "k2").agg(F.min("place").alias("place"), F.min_by("row", "place").alias("row")))
    named = once.select(F.struct("place", "k1", "k2").alias("id"), F.col("row")[text].alias("text"))
    prints = scratch.cut(wide_prints(named, "text", "id", shingle).select("id", F.struct(*NODE).alias("node")))
    pairs = scratch.cut(wide_candidates(prints.select("node.*").distinct(), scratch))
    ends = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # one text speaks for each node
    speaker = scratch.cut(prints.join(small(ends), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("node", "id.k1", "id.k2"))
    said = once.select("k1", "k2", F.col("row")[text].alias("text")).join(small(speaker), ["k1", "k2"]).select("node", "text")
    node = prints.schema["node"].dataType.simpleString()
    sets = scratch.cut(said.mapInArrow(lambda batches: shingle_sets(batches, shingle), f"node {node}, shingles binary"))
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = scratch.cut(met.mapInArrow(lambda batches: similar(batches, least), f"a {node}, b {node}"))
    roots = scratch.cut(components(links).withColumnRenamed("node", "at"))
    grouped = scratch.cut(prints.join(small(roots), prints["node"] == roots["at"], "left").select("id", F.coalesce("root", "node").alias("grp")))
    first = grouped.groupBy("grp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = grouped.join(small(scratch.cut(first)), "grp").where(F.col("id") != F.col("first")).select("id.k1", "id.k2")
    out = cut(once.join(small(scratch.cut(gone)), ["k1", "k2"], "left_anti").select("row"))
    scratch.drop()
    return out.select("row.*")
