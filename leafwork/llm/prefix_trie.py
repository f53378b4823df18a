"""Prefix tries of conversations, as succinct level-order tries shard by shard.

A node is a prefix of turns and goes by the exclusive or of its turns' hashes, each with its depth. Nodes that too many
paths pass are the upper levels; below them the trie falls into subtrees, which tasks take in shards of bounded size.
A task lays its subtrees out as a LOUDS: level by level, a bit vector with a one for each child and a zero after each
node, and arrays of labels. It sums leaves and savings from the last level up. The upper levels are merged apart: what
their subtrees sum to is carried up along one path for each of their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import Scratch, cut, small
from leafwork.operators.ranges import ranked, running

#: Ids that share their first turns, with the one that they are rounded down to; and how many turns, at most, that is.
FAMILY, HEADS = 100, 6
#: Turns below a node, summed over the distinct conversations through it, from which on it is of the upper levels.
SUBTREE = 1 << 15
#: Nodes that a task lays out in one trie, unless one subtree has more.
SHARD = 1 << 16
#: Turns of a conversation, and ids, that are put together first.
SEGMENT_BITS = 12
ID = ["p1", "p2"]


def turns_of(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, rank, k1, k2, size) of every turn: its place from 1, two hashes of role and text, and the text's code points."""
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    of = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"), F.xxhash64(*said).alias("k1"), F.xxhash64(F.lit(1), *said).alias("k2"), F.char_length(said[1]).alias("size"))
    # rows without a turn are told apart by their hash, by which they are ordered
    bucket = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.shiftright("turn", SEGMENT_BITS), F.shiftright("k1", 52)).alias("part"))
    return ranked(of, ["c"], ["turn", "k1", "k2"], bucket).select("c", "rank", "k1", "k2", "size")


def rebuilt(own: DataFrame, scratch: Scratch, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(c, depth, total, k1, k2, size) of the turns of conversations whose first ones are their family's, and (c, total) of all.

    The first h turns are those of conversation c - c % family, h being crc32(c) % heads; c's own ones after the h-th follow.
    """
    convs = own.groupBy("c").agg(F.max("rank").alias("n")).select("c", "n", (F.col("c") - F.col("c") % family).alias("base"), (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
    convs = scratch.cut(convs)
    first = scratch.cut(convs.where("c = base").select("base", F.col("n").alias("has")))
    convs = convs.join(small(first), "base", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0))))
    convs = scratch.cut(convs.select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    shared = own.where((F.col("c") % family == 0) & (F.col("rank") < heads)).select(F.col("c").alias("base"), F.col("rank").alias("depth"), "k1", "k2", "size")
    fore = convs.join(shared, "base").where("depth <= h").select("c", "depth", "total", "k1", "k2", "size")
    rest = own.join(convs, "c").where("rank > h").select("c", (F.col("rank") - F.col("h") + F.col("head")).alias("depth"), "total", "k1", "k2", "size")
    return fore.unionByName(rest), convs.select("c", "total")


def paths_of(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, depth, total, size, p1, p2, q1, q2): the node of each turn, and the one before it. The root is (0, 0).

    Long conversations run segment by segment behind the segments before.
    """
    rows = scratch.cut(turns.select("c", "depth", "total", "size", F.xxhash64("depth", "k1", "k2").alias("x1"), F.xxhash64(F.lit(7), "depth", "k2", "k1").alias("x2"), F.shiftright(F.col("depth") - 1, SEGMENT_BITS).alias("segment")))
    here = Window.partitionBy("c", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.where(F.col("total") > 1 << SEGMENT_BITS).groupBy("c", "segment").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = scratch.cut(whole.select("c", "segment", F.bit_xor("x1").over(earlier).alias("b1"), F.bit_xor("x2").over(earlier).alias("b2")).where("b1 is not null"))
    run = rows.withColumns({"p1": F.bit_xor("x1").over(here), "p2": F.bit_xor("x2").over(here)}).join(small(before), ["c", "segment"], "left")
    run = run.withColumns({p: F.col(p).bitwiseXOR(F.coalesce(b, F.lit(0))) for p, b in (("p1", "b1"), ("p2", "b2"))})
    return run.select("c", "depth", "total", "size", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))


def hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, ends) from parts (p1, p2, part, ids) that come sorted: the digest of the parts joined by commas, as they pass."""
    now, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*ID, "ends"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if now != (a, b):
                if now:
                    yield out()
                now, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now:
        yield out()


def ends_of(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(p1, p2, ends): SHA-256 of the ids (c, p1, p2) of each node, ascending and joined by commas.

    Ids are joined range by range first; the parts of a node with more than one range are hashed as they come.
    """
    parts = ends.groupBy(*ID, F.shiftright("c", SEGMENT_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = scratch.cut(parts)
    many = small(scratch.cut(parts.groupBy(*ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ID)))
    one = parts.join(many, ID, "left_anti").select(*ID, F.sha2("ids", 256).alias("ends"))
    more = parts.join(many, ID, "left_semi").repartition(*ID).sortWithinPartitions(*ID, "part")
    return one.unionByName(more.select(*ID, "part", "ids").mapInArrow(hashed_lists, "p1 bigint, p2 bigint, ends string"))


class Louds:
    """A forest in level order: bits has a one for each root and a zero, then for each node a one for each child and a zero.

    order: the given nodes in that order; labels and sizes are arrays in it.
    """

    def __init__(self, parent: np.ndarray, level: np.ndarray, label: np.ndarray, size: np.ndarray) -> None:
        """parent: the index of each node's parent, -1 for roots; level: 0 for roots."""
        by_level = np.argsort(level, kind="stable")
        self.starts = np.r_[0, np.cumsum(np.bincount(level))] if len(level) else np.zeros(1, np.int64)
        place = np.zeros(len(level) + 1, np.int64)
        place[-1] = -1  # of the roots' parent
        self.order = np.empty(len(level), np.int64)
        for low, high in zip(self.starts[:-1], self.starts[1:], strict=True):
            at = by_level[low:high]
            at = at[np.lexsort((label[at], place[parent[at]]))]
            self.order[low:high] = at
            place[at] = np.arange(low, high)
        children = np.bincount(place[parent] + 1, minlength=len(level) + 1)
        bits = np.ones(int(children.sum()) + len(children), bool)
        bits[np.cumsum(children + 1) - 1] = False
        self.n, self.bits, self.labels, self.sizes = len(level), np.packbits(bits), label[self.order], size[self.order]

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n + 1).astype(bool)

    def parents(self) -> np.ndarray:
        """Each node's parent in level order, by the zeros before its one; -1 for roots."""
        bits = self.unpacked()
        return np.cumsum(~bits)[bits] - 1

    def degrees(self) -> np.ndarray:
        """Each node's children, by the distance of its zero from the one before."""
        return np.diff(np.flatnonzero(~self.unpacked())) - 1

    def summed(self, values: np.ndarray) -> np.ndarray:
        """values in level order, each summed over its subtree, from the last level up."""
        out, parent = values.copy(), self.parents()
        for low, high in zip(self.starts[-2:0:-1], self.starts[:1:-1], strict=True):
            np.add.at(out, parent[low:high], out[low:high])
        return out


LIGHT = ["t1", "t2", "level", "p1", "p2", "q1", "q2", "size", "saved"]


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], Louds]]:
    """(columns, trie) of shards of the nodes LIGHT, which come subtree by subtree, named by (t1, t2)."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> tuple[list[np.ndarray], Louds]:
        cols = list(rows.T)
        ids = np.ascontiguousarray(np.r_[rows[:, 3:5], rows[:, 5:7]]).view([("a", np.int64), ("b", np.int64)]).ravel()
        _, number = np.unique(ids, return_inverse=True)
        at = np.full(number.max() + 1, -1)
        at[number[: len(rows)]] = np.arange(len(rows))
        parent = np.where(cols[2] == 0, -1, at[number[len(rows) :]])
        return cols, Louds(parent, cols[2], cols[3] ^ cols[5], cols[7])

    n = 0
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(LIGHT))], axis=1)
        if not len(rows):
            continue
        if n >= SHARD:
            # a subtree is whole where the next one begins
            change = np.flatnonzero((rows[:, :2] != np.r_[held[-1][-1:, :2], rows[:-1, :2]]).any(axis=1))
            if len(change):
                yield out(np.concatenate([*held, rows[: change[0]]]))
                held, n, rows = [], 0, rows[change[0] :]
        held.append(rows)
        n += len(rows)
    if held:
        yield out(np.concatenate(held))


def rolled_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, q1, q2, level, n_children, n_leaves, saved_tokens) of the nodes of each shard."""
    for cols, trie in sharded(batches):
        of = trie.order
        degree = trie.degrees()
        found = [trie.summed((degree == 0).astype(np.int64)), trie.summed(cols[8][of])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*[cols[i][of] for i in (3, 4, 5, 6, 2)], degree, *found)], names=["p1", "p2", "q1", "q2", "level", "n_children", "n_leaves", "saved_tokens"])


def succinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, bits, labels, sizes) of each shard's trie; labels and sizes as little-endian 64-bit numbers."""
    for _, trie in sharded(batches):
        said = [trie.bits.tobytes(), trie.labels.astype("<i8").tobytes(), trie.sizes.astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([trie.n]), *[pa.array([x], pa.binary()) for x in said]], names=["n", "bits", "labels", "sizes"])


class Trie:
    """The tables of a trie over conversations, of which nodes() makes a row for each node and tries() the succinct shards.

    rows: one for each turn. Null roles and texts are empty; a turn's place is that of its number, null first, ties by a
    hash of role and text. Rows without a conversation are of none and are left out. Conversations are rebuilt as
    rebuilt() says unless `whole`. Repeated rows are turns of their own. Other columns are ignored, whatever their names.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", whole: bool = False, subtree: int = SUBTREE) -> None:
        scratch = self.scratch = Scratch()
        own = scratch.cut(turns_of(rows, conv, turn, role, text))
        if whole:
            convs = scratch.cut(own.groupBy("c").agg(F.max("rank").alias("total")))
            turns = own.join(convs, "c").withColumnRenamed("rank", "depth")
        else:
            turns, convs = rebuilt(own, scratch)
        paths = scratch.cut(paths_of(turns, scratch))
        root = [F.lit(0).cast("long").alias(x) for x in ID]
        ends = scratch.cut(paths.where("depth = total").select("c", *ID).unionByName(convs.where("total = 0").select("c", *root)))
        self.ends = scratch.cut(ends_of(ends, scratch))
        # of equal conversations the one of the smallest id stands for all
        alike = scratch.cut(ends.groupBy(*ID).agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c")))
        self.paths = scratch.cut(paths.join(small(alike.select("c", "m")), "c"))
        each = self.paths.groupBy(*ID).agg(F.sum("m").alias("n_convs"), F.min("c").alias("conv_id"), F.min("depth").alias("depth"), *[F.min(x).alias(x) for x in ("q1", "q2", "size")], F.sum(F.col("total") - F.col("depth")).alias("below"))
        nodes = each.select(*ID, "q1", "q2", "depth", "conv_id", "n_convs", "size", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("below") > subtree).alias("upper"))
        zero = F.lit(0).cast("long")
        top = alike.agg(F.sum("m").alias("n_convs"), F.min("c").alias("conv_id")).where("conv_id is not null")
        nodes = nodes.unionByName(top.select(*root, *[zero.alias(x) for x in ("q1", "q2", "depth")], "conv_id", "n_convs", F.lit(0).alias("size"), zero.alias("saved"), F.lit(True).alias("upper")))
        self.nodes_ = scratch.cut(nodes)
        self.upper = small(scratch.cut(self.nodes_.where("upper").select(*ID)))

    def light(self) -> DataFrame:
        """The nodes below the upper levels, as LIGHT, dealt by the subtrees that they are of."""
        depths = self.scratch.cut(self.paths.join(self.upper, ID, "left_semi").groupBy("c").agg(F.max("depth").alias("deep")))
        place = self.paths.join(small(depths), "c", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
        tops = self.scratch.cut(place.where("depth = deep + 1").select(F.col("c").alias("conv_id"), "deep", F.col("p1").alias("t1"), F.col("p2").alias("t2")))
        light = self.nodes_.where("not upper").join(tops, "conv_id")
        cols = light.select("t1", "t2", (F.col("depth") - F.col("deep") - 1).alias("level"), *ID, "q1", "q2", F.col("size").cast("long").alias("size"), "saved")
        return cols.repartition("t1", "t2").sortWithinPartitions("t1", "t2")

    def tries(self) -> DataFrame:
        """(n, bits, labels, sizes) of the succinct tries below the upper levels."""
        return self.light().mapInArrow(succinct, "n bigint, bits binary, labels binary, sizes binary")

    def nodes(self) -> DataFrame:
        """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

        conv_id is the smallest of the n_convs conversations that begin with the node. n_leaves counts the childless nodes
        of its subtree, saved_tokens sums over that (n_convs - 1) times the code points of a node's text, and ends_sha256
        is of the ids that end there. No conversations give no rows.
        """
        longs = ["n_children", "n_leaves", "saved_tokens"]
        light = self.scratch.cut(self.light().mapInArrow(rolled_up, ", ".join(f"{x} bigint" for x in [*ID, "q1", "q2", "level", *longs])))
        above = self.upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        children = self.nodes_.where("depth > 0").join(above, ["q1", "q2"], "left_semi").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"))
        given = light.where("level = 0").groupBy("q1", "q2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        named = lambda df: df.withColumnsRenamed({"q1": "p1", "q2": "p2"})
        upper = self.nodes_.where("upper").select(*ID, "conv_id", "saved").join(named(children), ID, "left").join(named(given), ID, "left")
        none = F.col("n_children").isNull()
        upper = self.scratch.cut(upper.select(*ID, "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(none, 1).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("long").alias("leaves"), (F.col("saved") + F.coalesce("saved_tokens", F.lit(0))).alias("saved")))
        # each upper node's sums go to the node itself and to all above it, along the path of its smallest conversation
        owners = small(self.scratch.cut(upper.select(F.col("conv_id").alias("c")).distinct()))
        mine = F.col("c") == F.col("conv_id")
        steps = self.paths.select("c", "depth", *ID)
        zero = F.lit(0).cast("long")
        steps = steps.unionByName(self.nodes_.where("upper").select(F.col("conv_id").alias("c")).distinct().select("c", zero.alias("depth"), *[zero.alias(x) for x in ID]))
        steps = steps.join(owners, "c", "left_semi").join(small(upper), ID)
        steps = steps.select("c", *ID, (-F.col("depth")).alias("up"), F.shiftright(-F.col("depth"), SEGMENT_BITS).alias("segment"), *[F.when(mine, F.col(x)).otherwise(0).alias(x) for x in ("leaves", "saved")])
        summed = running(steps, ["c"], "up", "segment", ["leaves", "saved"]).groupBy(*ID).agg(F.sum("leaves_upto").alias("n_leaves"), F.sum("saved_upto").alias("saved_tokens"))
        merged = upper.select(*ID, "n_children").join(summed, ID)
        stats = self.scratch.cut(light.select(*ID, *longs).unionByName(merged.select(*ID, *longs)))
        parents = self.nodes_.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
        # the root's ids are zero, as is its parent's; the depth tells them apart
        out = self.nodes_.join(stats, ID).join(parents, ["q1", "q2"], "left").join(self.ends, ID, "left")
        parent = F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id")
        rows = cut(out.select("conv_id", "depth", parent, "n_convs", *longs, F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
        self.scratch.drop()
        return rows
