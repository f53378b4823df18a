"""Removal of long repeated byte strings by suffix arrays.

Every window of LENGTH bytes goes by its least 16-byte gram, the one of the smallest hash, and by how far into the
window that stands. Windows of about the same distance, neighbours in the text, make a segment; what they all share,
their core, is equal wherever an equal window stands, so segments of one core meet. Segments that occur twice are
repeated as a whole; the distinct segments of one core meet in one task, which sorts their suffixes in two stages:
those smaller than their successors directly, all others induced by scans of the first bytes' buckets. Neighbours in
that order whose common prefix reaches LENGTH are repeated windows. Where too many segments share a core for one
array, they are cut into parts with longer cores, again and again until a group fits. What never fits, such as runs
of one period in many lengths, differs in a byte or two at the ends: there whole windows are counted by content, once for
each that a segment has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import Scratch, cut, drop_cut, small, text_key

LENGTH = 400
GRAM = 16
#: Windows of one segment, and of a text that are hashed at once; longer ones are cut.
WINDOWS = 1 << 16
#: Bytes of a group of distinct segments, or parts of them, that one suffix array takes; larger groups are split.
GROUP_BYTES = 256 << 10
#: Bits of a packed hash that hold its position in a block.
PLACE_BITS = 17
#: Bytes of neighbouring groups that share a suffix array.
ARRAY_BYTES = 1 << 20


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position of data (uint8, eight or more), as one unsigned number."""
    return np.ndarray((len(data) - 7,), f"{order}u8", data.tobytes(), strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    words = words_at(data, "<")
    h = (words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (words[:-8] >> np.uint64(29))) + words[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours: of the rest of a block and the beginning of the next."""
    n = len(h) - width + 1
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def widths(length: int) -> list[int]:
    """Distances that fall in one cell: of segments, then of the parts that groups too large for one array are cut into."""
    found = [-(-(length - GRAM + 1) // 2)]
    while found[-1] > 1:
        found.append(max(1, found[-1] // 3))
    return found


def spots_of(data: np.ndarray, length: int) -> np.ndarray:
    """Where the least gram of each window stands, the leftmost of equal ones; the highest bits of its hash decide."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    packed = gram_hashes(data) & ~place
    packed |= np.arange(len(packed), dtype=np.uint64)
    return (least_of(packed, length - GRAM + 1) & place).astype(np.int64)


def cells_of(text: bytes, start: np.ndarray, spot: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, cores, own) of the runs of windows of one core; start: ascending windows, spot: their grams' places.

    Equal windows have their grams at the same distance, so they are in cells of the same number and share the bytes
    that all windows of that cell share. own: a run of several grams, as in a periodic text, whose windows may equal
    each other; those of one gram differ.
    """
    cell = (spot - start) // width
    first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(spot) != 0) | (np.diff(cell) != 0)])
    digest, edge = xxhash.xxh3_64_intdigest, spot[first] - cell[first] * width
    core = np.array([digest(text[e : e + length - width + 1], c) for e, c in zip(edge.tolist(), cell[first].tolist(), strict=True)], np.uint64).view(np.int64)
    fresh = np.flatnonzero(np.r_[True, (np.diff(core) != 0) | (np.diff(start[first]) != first[1:] - first[:-1])])
    begin = first[fresh]
    return begin, np.diff(np.r_[begin, len(start)]), core[fresh], np.diff(np.r_[fresh, len(first)]) > 1


def segments_of(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, windows, cores, own) of the segments of a text, block by block."""
    width = widths(length)[0]
    for i in range(0, len(text) - length + 1, WINDOWS):
        data = np.frombuffer(text, np.uint8, min(len(text) - i, WINDOWS + length - 1), i)
        spot = spots_of(data, length)
        begin, n, core, own = cells_of(text[i : i + len(data)], np.arange(len(spot)), spot, width, length)
        yield begin + i, n, core, own


def segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, start, n, route, own, s1, s2) of each segment of each text (k1, k2, text)."""
    for batch in batches:
        texts, who, parts, digests = batch.column(2), [], [], []

        def out() -> pa.RecordBatch:
            start, n, route, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.repeat(np.array(who), [len(x[0]) for x in parts])
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = [batch.column(i).take(pa.array(row)) for i in range(2)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(route), pa.array(own), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["k1", "k2", "start", "n", "route", "own", "s1", "s2"])

        for i in range(len(texts)):
            text = texts[i].as_py().encode("utf-8", "surrogatepass")
            for part in segments_of(text, length):
                who.append(i)
                parts.append(part)
                digests += [xxhash.xxh3_128_digest(text[s : s + n + length - 1]) for s, n in zip(part[0].tolist(), part[1].tolist(), strict=True)]
            if len(digests) > 50_000:
                yield out()
                who, parts, digests = [], [], []
        if parts:
            yield out()


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(route, s1, s2, hot, bytes) of the wanted segments of texts (text, wanted: list of struct start, n, route, s1, s2, hot)."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(0)[i].as_py().encode("utf-8", "surrogatepass")
            rows = batch.column(1)[i].values.flatten()
            cuts = [text[s : s + n + length - 1] for s, n in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True)]
            for j in range(0, len(cuts), 4096):
                yield pa.RecordBatch.from_arrays([*[x.slice(j, 4096) for x in rows[2:]], pa.array(cuts[j : j + 4096], pa.binary())], names=["route", "s1", "s2", "hot", "bytes"])


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of t is smaller than its successor; t ends in the smallest symbol."""
    step = np.sign(np.diff(t.astype(np.int32), append=t[-1] + 1))
    known = np.where(step != 0, np.arange(len(t)), len(t) - 1)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def sort_directly(at: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Positions `at` ordered by the first `length` bytes that stand there; words: eight of them from each position.

    Eight bytes a round; only ties go on, and only where a tied group disagrees is it sorted again.
    """
    order = at[np.argsort(words[at], kind="stable")]
    group = np.cumsum(np.r_[True, words[order[1:]] != words[order[:-1]]]) - 1
    live = np.arange(len(order))
    for offset in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = group[live[1:]] == group[live[:-1]]
        live = live[np.r_[same, False] | np.r_[False, same]]
        if not len(live):
            break
        key = words[np.minimum(order[live] + offset, len(words) - 1)]
        first = np.r_[True, group[live[1:]] != group[live[:-1]]]
        number = np.cumsum(first) - 1
        odd = np.zeros(number[-1] + 1, bool)
        odd[number[1:][~first[1:] & (key[1:] != key[:-1])]] = True
        mixed = np.flatnonzero(odd[number])
        if len(mixed):
            fresh = mixed[np.lexsort((key[mixed], number[mixed]))]
            order[live[mixed]], key[mixed] = order[live[fresh]], key[fresh]
            # members that differ from the one before start a group, named by where it starts
            new = np.r_[True, key[1:] != key[:-1]] | first
            starts = np.where(new, live, 0)
            group[live] = np.where(odd[number], len(order) + np.maximum.accumulate(starts), group[live])
    return order


def suffix_order(t: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """The suffixes of t (uint16, 0 between and after the pieces) in the order of their first `length` symbols."""
    small_type = smaller_than_next(t)
    direct = sort_directly(np.flatnonzero(small_type), words, length)
    by_head = np.split(direct, np.searchsorted(t[direct], np.arange(1, 258)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []
    for head in range(258):
        def before(found: np.ndarray, head: int = head) -> np.ndarray:
            """Pushes the larger predecessors of these to the ends of their buckets; returns those of this bucket."""
            prior = found[found > 0] - 1
            prior = prior[~small_type[prior]]
            symbol = t[prior]
            later = prior[symbol > head]
            later = later[np.argsort(t[later], kind="stable")]
            bounds = np.flatnonzero(np.r_[True, t[later][1:] != t[later][:-1]]) if len(later) else []
            for part in np.split(later, bounds[1:]) if len(later) else []:
                waiting[t[part[0]]].append(part)
            return prior[symbol == head]

        wave = np.concatenate(waiting[head]) if waiting[head] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = before(wave)
        if head < len(by_head) and len(by_head[head]):
            out.append(by_head[head])
            before(by_head[head])
    return np.concatenate(out)


def shared_prefix(a: np.ndarray, b: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix at the positions a and b is `length` bytes or longer."""
    live = np.arange(len(a))
    for offset in [*range(0, length - 7, 8), length - 8]:
        live = live[words[a[live] + offset] == words[b[live] + offset]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows of `length` bytes that also start anywhere else in the pieces."""
    data = np.frombuffer(b"".join(x + bytes(1) for x in texts) + bytes(8), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    t = data[: ends[-1]].astype(np.uint16) + 1
    t[ends - 1] = 0
    words = words_at(data, ">")
    order = suffix_order(t, words, length)
    room = np.repeat(ends - 1, np.diff(np.r_[0, ends])) - np.arange(len(t))
    order = order[room[order] >= length]
    equal = shared_prefix(order[:-1], order[1:], words, length)
    found = np.zeros(len(t), bool)
    found[order[:-1][equal]] = found[order[1:][equal]] = True
    return [np.flatnonzero(found[e - len(x) - 1 : e]) for x, e in zip(texts, ends.tolist(), strict=True)]


KEY = ["route", "s1", "s2"]
RUNS = "route bigint, s1 bigint, s2 bigint, low int, n int"


def runs(keys: list[tuple[int, int, int, int]], starts: list[np.ndarray]) -> pa.RecordBatch:
    """(route, s1, s2, low, n) of the runs of consecutive starts of each piece (route, s1, s2, its place in the segment)."""
    rows = []
    for (*key, place), at in zip(keys, starts, strict=True):
        if len(at):
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            rows += [(*key, place + low, n) for low, n in zip(at[first].tolist(), np.diff(np.r_[first, len(at)]).tolist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], names=[*KEY, "low", "n"])


def by_suffix_array(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of pieces (grp, route, s1, s2, low, bytes) that come sorted by grp; groups share an array, small ones with others."""
    keys: list[tuple[int, int, int, int]] = []
    texts: list[bytes] = []
    held, now = 0, None
    for batch in batches:
        for grp, *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held > ARRAY_BYTES and grp != now:
                yield runs(keys, repeated_windows(texts, length))
                keys, texts, held = [], [], 0
            now = grp
            keys.append(tuple(key))
            texts.append(text)
            held += len(text)
    if keys:
        yield runs(keys, repeated_windows(texts, length))


def sorted_groups(pieces_of: DataFrame, length: int) -> DataFrame:
    """The repeated windows (route, s1, s2, low, n) of pieces (grp, route, s1, s2, low, bytes), group by group."""
    dealt = pieces_of.repartition("grp").sortWithinPartitions("grp", *KEY, "low")
    return dealt.mapInArrow(partial(by_suffix_array, length=length), RUNS)


def listed(lows: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """All windows of runs of ns windows from lows on."""
    return np.repeat(lows, ns) + np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)


def cores(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """(route, s1, s2, low, n, core, own, x1, x2) of the parts of pieces (route, s1, s2, bytes, lows, ns).

    A part is a run of the given windows of one cell and core; x1, x2 digest the part itself; own: see cells_of().
    """
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(3)[i].as_py()
            lows, ns = batch.column(4)[i].values.to_numpy(), batch.column(5)[i].values.to_numpy()
            start = listed(lows, ns)
            begin, n, core, own = cells_of(text, start, spots_of(np.frombuffer(text, np.uint8), length)[start], width, length)
            low = start[begin]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a : a + k - 1 + length]) for a, k in zip(low.tolist(), n.tolist(), strict=True)), np.int64).reshape(-1, 2)
            same = [pa.array([batch.column(j)[i].as_py()] * len(low), pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(core), pa.array(own), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=[*KEY, "low", "n", "core", "own", "x1", "x2"])


def parts_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(grp, route, s1, s2, low, bytes) of the wanted parts of pieces (route, s1, s2, bytes, lows, ns, grps)."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(3)[i].as_py()
            lows, ns, grps = (batch.column(j)[i].values for j in (4, 5, 6))
            cuts = [text[low : low + n - 1 + length] for low, n in zip(lows.to_pylist(), ns.to_pylist(), strict=True)]
            same = [pa.array([batch.column(j)[i].as_py()] * len(cuts), pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([grps, *same, lows, pa.array(cuts, pa.binary())], names=["grp", *KEY, "low", "bytes"])


def contents(text: bytes, lows: np.ndarray, ns: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, digests) of the given windows; digests: two 64-bit numbers each, in one field."""
    start = listed(lows, ns)
    found = b"".join(xxhash.xxh3_128_digest(text[a : a + length]) for a in start.tolist())
    return start, np.frombuffer(found, [("x1", np.int64), ("x2", np.int64)])


def counted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(route, s1, s2, x1, x2, n) of each distinct window of pieces (route, s1, s2, bytes, lows, ns)."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, found = contents(batch.column(3)[i].as_py(), *(batch.column(j)[i].values.to_numpy() for j in (4, 5)), length)
            each, n = np.unique(found, return_counts=True)
            same = [pa.array([batch.column(j)[i].as_py()] * len(each), pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(each["x1"].copy()), pa.array(each["x2"].copy()), pa.array(n.astype(np.int64))], names=[*KEY, "x1", "x2", "n"])


def found_again(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """RUNS of the windows of pieces (route, s1, s2, bytes, lows, ns, again: list of struct x1, x2) whose digests are in again."""
    for batch in batches:
        for i in range(batch.num_rows):
            start, found = contents(batch.column(3)[i].as_py(), *(batch.column(j)[i].values.to_numpy() for j in (4, 5)), length)
            x1, x2 = (x.to_numpy() for x in batch.column(6)[i].values.flatten())
            again = np.empty(len(x1), found.dtype)
            again["x1"], again["x2"] = x1, x2
            each, place = np.unique(found, return_inverse=True)
            key = tuple(batch.column(j)[i].as_py() for j in range(3))
            yield runs([(*key, 0)], [start[np.isin(each, again)[place]]])


def split_groups(cuts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated windows (route, s1, s2, low, n) of the pieces of groups that are too large for one suffix array.

    Pieces are cut into parts of narrower cells, whose longer cores make the new groups. Parts that occur twice are
    repeated as a whole; parts of one gram whose core no other content has hold nothing that is repeated; one part of
    each other content goes on, to a suffix array of its group where that fits, else to narrower cells. Windows of
    groups that fit in no cells of two or more are counted by content. Counts are pre-aggregated and one part of each
    content goes on, so no task sees a group beyond GROUP_BYTES.
    """
    group = ["route", "core"]
    first = cuts.select(*KEY, "bytes", F.array(F.lit(0)).alias("lows"), F.array(F.octet_length("bytes") - length + 1).alias("ns"))
    out = None
    for width in widths(length)[1:-1]:
        kind = RUNS + ", core bigint, own boolean, x1 bigint, x2 bigint"
        rows = scratch.cut(first.mapInArrow(partial(cores, length=length, width=width), kind))
        # one row for each distinct content of a core, with a part that has it; first() takes all columns from one row
        each = scratch.cut(rows.groupBy(*group, "x1", "x2").agg(F.count(F.lit(1)).alias("c"), F.bool_or("own").alias("own"), *[F.first(x).alias(x) for x in ("s1", "s2", "low", "n")]))
        twice = each.where("c > 1").select(*group, "x1", "x2")
        found = rows.join(small(scratch.cut(twice)), [*group, "x1", "x2"], "left_semi").select(*KEY, "low", "n")
        met = each.groupBy(*group).agg(F.count(F.lit(1)).alias("d"), F.bool_or("own").alias("own"), F.sum(F.col("n") - 1 + length).alias("size")).where("d > 1 or own")
        met = scratch.cut(met.select(*group, (F.col("size") <= GROUP_BYTES).alias("fits")))
        parts = scratch.cut(each.drop("own").join(small(met), group))
        fit = parts.where("fits").groupBy(*KEY).agg(F.collect_list(F.struct("low", "n", F.xxhash64(*group).alias("grp"))).alias("parts"))
        pieces_of = cuts.join(scratch.cut(fit), KEY).select(*KEY, "bytes", F.col("parts.low").alias("lows"), F.col("parts.n").alias("ns"), F.col("parts.grp").alias("grps"))
        found = found.unionByName(sorted_groups(pieces_of.mapInArrow(partial(parts_out, length=length), "grp bigint, route bigint, s1 bigint, s2 bigint, low int, bytes binary"), length))
        out = found if out is None else out.unionByName(found)
        wide = scratch.cut(parts.where("not fits").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("low", "n"))).alias("parts")))
        if wide.isEmpty():
            return out
        first = cuts.join(wide, KEY).select(*KEY, "bytes", F.col("parts.low").alias("lows"), F.col("parts.n").alias("ns"))
    each = scratch.cut(first.mapInArrow(partial(counted, length=length), "route bigint, s1 bigint, s2 bigint, x1 bigint, x2 bigint, n bigint"))
    more = scratch.cut(each.groupBy("x1", "x2").agg(F.sum("n").alias("n")).where("n > 1").select("x1", "x2"))
    again = scratch.cut(each.join(small(more), ["x1", "x2"], "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("x1", "x2")).alias("again")))
    found = first.join(again, KEY).select(*KEY, "bytes", "lows", "ns", "again").mapInArrow(partial(found_again, length=length), RUNS)
    return found if out is None else out.unionByName(found)


def of_keys(rows: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose (k1, k2) are in keys; where keys are not few, written as they are joined, so that Spark can split the copies of a text."""
    keys = keys.select("k1", "k2")
    few = small(keys)
    found = rows.join(few, ["k1", "k2"], "left_semi")
    return scratch.cut(found) if few is keys else found


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, the sorted disjoint byte ranges (low, high) they cover."""
    rows = docs.select(*text_key(F.col(text)), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    found = scratch.cut(rows.mapInArrow(partial(segments, length=length), "k1 bigint, k2 bigint, start int, n int, route bigint, own boolean, s1 bigint, s2 bigint"))
    # one row for each distinct segment, with some text that has it; first() takes all columns from one row
    each = scratch.cut(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.bool_or("own").alias("own"), *[F.first(x).alias(x) for x in ("k1", "k2", "start", "n")]))
    shared = each.groupBy("route").agg(F.sum("c").alias("all"), (F.bool_or("own") | (F.count(F.lit(1)) > 1)).alias("varied"), F.sum(F.col("n") + length - 1).alias("size")).where("all > 1 or varied")
    # written as it is joined, so that Spark can split a frequent hash
    distinct = scratch.cut(each.drop("own").join(scratch.cut(shared.select("route", "varied", (F.col("size") > GROUP_BYTES).alias("hot"))), "route"))
    wanted = scratch.cut(distinct.where("varied").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", *KEY, "hot")).alias("wanted")))
    # copies of a text give the same pieces; dropping them by key first would need a shuffle of the texts as well
    once = of_keys(rows, wanted, scratch).groupBy("k1", "k2").agg(F.max("text").alias("text"))
    cuts = scratch.cut(once.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(partial(pieces, length=length), "route bigint, s1 bigint, s2 bigint, hot boolean, bytes binary"))
    marked = sorted_groups(cuts.where("not hot").select(F.col("route").alias("grp"), *KEY, F.lit(0).alias("low"), "bytes"), length)
    many = cuts.where("hot").select(*KEY, "bytes")
    if not many.isEmpty():
        marked = marked.unionByName(split_groups(many, length, scratch))
    marked = marked.groupBy(*KEY).agg(F.collect_list(F.struct("low", "n")).alias("parts"))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("n")))
    marks = distinct.select(*KEY, "c", "n").join(scratch.cut(marked), KEY, "left")
    marks = marks.select(*KEY, F.when(F.col("c") > 1, whole).otherwise(F.col("parts")).alias("parts")).where("parts is not null")
    spans = found.select("k1", "k2", "start", *KEY).join(scratch.cut(marks), KEY).select("k1", "k2", "start", F.inline("parts"))
    spans = spans.select("k1", "k2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("low") + F.col("n") - 1 + length).alias("high"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans")).select("k1", "k2", joined(F.array_sort("spans")).alias("spans"))


def joined(spans):
    """Sorted ranges (low, high) with overlapping and touching ones merged: those that start beyond all before."""
    none = F.array().cast("array<struct<low:int,high:int>>")
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["low"].alias("low"), F.greatest(last(acc)["high"], x["high"]).alias("high"))))
    return F.aggregate(spans, none, lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["high"] >= x["low"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, kept): the bytes of each text that no span covers."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
            rows = batch.column(3)[i].values.flatten()
            lows, highs = rows[0].to_pylist(), rows[1].to_pylist()
            kept = b"".join(text[a:b] for a, b in zip([0, *highs], [*lows, len(text)], strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(i, 1) for j in range(2)], pa.array([kept], pa.binary())], names=["k1", "k2", "kept"])


def kept_bytes(docs: DataFrame, spans: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(k1, k2, kept): what is left of each distinct text that spans covers in part."""
    rows = docs.select(*text_key(F.col(text)), F.col(text).alias("text"))
    part = of_keys(rows, spans, scratch).groupBy("k1", "k2").agg(F.max("text").alias("text"))
    return part.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(cut_out, "k1 bigint, k2 bigint, kept binary")


def dedup_strings(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    A byte goes if a string of `length` bytes that also starts anywhere else covers it; all copies go, none stays.
    Overlaps count, matches don't cross rows, and all is judged on the input. Null and empty texts, and those of
    fewer bytes, lose nothing. Repeated rows are copies of each other. Other columns are ignored; no rows give no
    rows. `length` is at least 32.
    """
    scratch = Scratch()
    spans = cut(repeats(docs, scratch, length, text).withColumn("n_removed", F.aggregate("spans", F.lit(0), lambda a, s: a + s["high"] - s["low"]).cast("long")))
    scratch.drop()
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), *text_key(F.col(text)), F.octet_length(full).cast("long").alias("n_bytes"), F.sha2(full, 256).alias("whole"))
    digest = kept_bytes(docs, spans, scratch, text).select("k1", "k2", F.sha2("kept", 256).alias("kept_sha256"))
    of = cut(spans.select("k1", "k2", "n_removed", F.size("spans").cast("long").alias("n_spans")).join(digest, ["k1", "k2"]))
    scratch.drop()
    drop_cut(spans)
    out = rows.join(of, ["k1", "k2"], "left")
    return out.select(F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
