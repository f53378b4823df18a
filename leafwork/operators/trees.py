"""Ordered trees: depth-first numbers by list ranking, and the differences of two trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.documents import dropped, written


def tree_order(nodes: DataFrame, node: str, parent: str, pos: str, doc: str) -> DataFrame:
    """(doc, node, parent, preorder, last, depth, leaf): the places of each node in a walk of its tree, parents first.

    Siblings go by pos, ties by node. preorder counts from 0 in each document, last is that of the last node below, depth
    is 0 at roots, and leaf numbers the childless nodes, null for others. The walk enters and leaves each node; every step
    knows the next one, and rounds of doubling add up what follows it, so a tree of any depth or width takes about log2
    of its steps in rounds, each a join of narrow rows. Nodes in a circle, or below a missing parent, are left out; of
    rows that repeat a node one is taken. Documents may hold any number of roots.
    """
    rows = nodes.select(F.col(doc).alias("d"), F.col(node).alias("n"), F.col(parent).alias("up"), F.col(pos).alias("pos")).dropDuplicates(["d", "n"])
    beside = Window.partitionBy("d", "up").orderBy("pos", "n")
    placed, tree = written(rows.select("d", "n", "up", F.lead("n").over(beside).alias("next"), F.row_number().over(beside).alias("rank")))
    first = placed.where("up is not null and rank = 1").select("d", F.col("up").alias("n"), F.col("n").alias("child"))
    each = placed.join(first, ["d", "n"], "left")
    leaf = F.col("child").isNull().cast("long")
    # a step is (node, whether it leaves); the entered node's child comes next, or else its own leaving
    enter = each.select("d", "n", F.lit(False).alias("out"), F.coalesce("child", "n").alias("n2"), F.col("child").isNull().alias("out2"), F.lit(1).cast("long").alias("w"), leaf.alias("l"), F.lit(1).cast("long").alias("up_down"))
    beyond = F.coalesce("next", "up")
    leave = each.select("d", "n", F.lit(True).alias("out"), beyond.alias("n2"), F.when(beyond.isNotNull(), F.col("next").isNull()).alias("out2"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("l"), F.lit(-1).cast("long").alias("up_down"))
    now, path = written(enter.unionByName(leave))
    ended, paths = None, [tree]
    for _ in range(now.count().bit_length() + 1):
        done = now.where("n2 is null")
        ended = done if ended is None else ended.unionByName(done)
        paths.append(path)
        # only steps that end nowhere yet go on; they add what the step that they know knows
        live = now.where("n2 is not null")
        if live.isEmpty():
            break
        to = ended.select("d", F.col("n").alias("n2"), F.col("out").alias("out2"), *[F.col(c).alias(f"{c}_on") for c in ("w", "l", "up_down")], F.lit(None).cast(now.schema["n2"].dataType).alias("n3"), F.lit(None).cast("boolean").alias("out3"))
        on = live.select("d", F.col("n").alias("n2"), F.col("out").alias("out2"), *[F.col(c).alias(f"{c}_on") for c in ("w", "l", "up_down")], F.col("n2").alias("n3"), F.col("out2").alias("out3"))
        met = live.join(to.unionByName(on), ["d", "n2", "out2"])
        now, path = written(met.select("d", "n", "out", F.col("n3").alias("n2"), F.col("out3").alias("out2"), *[(F.col(c) + F.col(f"{c}_on")).alias(c) for c in ("w", "l", "up_down")]))
    total = ended.where("not out").groupBy("d").agg(F.count(F.lit(1)).alias("all"), F.max("l").alias("leaves"))
    inside = ended.groupBy("d", "n").agg(F.max(F.when(~F.col("out"), F.col("w"))).alias("w"), F.max(F.when(F.col("out"), F.col("w"))).alias("after"), F.max(F.when(~F.col("out"), F.col("l"))).alias("l"), F.max(F.when(~F.col("out"), F.col("up_down"))).alias("u"), F.max(F.when(F.col("out"), F.col("l"))).alias("l_after"))
    found = inside.join(total, "d").join(rows.select("d", "n", "up"), ["d", "n"])
    # what follows the entering of a node, all leavings counted, leaves as many more than it enters as the node is deep
    childless = (F.col("w") - F.col("after") == 1)
    out, _ = written(found.select(F.col("d").alias(doc), F.col("n").alias(node), F.col("up").alias(parent), (F.col("all") - F.col("w")).alias("preorder"), (F.col("all") - F.col("after") - 1).alias("last"), (-F.col("u")).alias("depth"), F.when(childless, F.col("leaves") - F.col("l")).alias("leaf")))
    for p in {path, *paths}:
        dropped(out, p)
    return out


def paths_of(nodes: DataFrame, node: str, parent: str, key: str, doc: str) -> DataFrame:
    """(d, n, p1, p2, depth): the digest of the keys from a node's root down to itself, each with its depth from there.

    Every round doubles the ancestors that a node has added up. Nodes in a circle or below a missing parent are left out.
    """
    # a key counts by its distance from the node, so what two stretches add up to is moved by the length of the lower one
    base = 1_000_003
    mix = lambda seed: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2_147_483_647))
    now, path = written(nodes.select(F.col(doc).alias("d"), F.col(node).alias("n"), F.col(parent).alias("up"), mix(1).alias("p1"), mix(2).alias("p2"), F.lit(base).cast("long").alias("b"), F.lit(0).cast("long").alias("depth")))
    for _ in range(now.count().bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        above = now.select("d", F.col("n").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"{c}_on") for c in ("p1", "p2", "b", "depth")])
        met = now.where("up is not null").join(above, ["d", "up"])
        prime = F.lit(2_147_483_647)
        moved = met.select("d", "n", F.col("next").alias("up"), *[F.pmod(F.col(p) + F.col(f"{p}_on") * F.col("b"), prime).alias(p) for p in ("p1", "p2")], F.pmod(F.col("b") * F.col("b_on"), prime).alias("b"), (F.col("depth") + F.col("depth_on") + 1).alias("depth"))
        before = path
        now, path = written(now.where("up is null").unionByName(moved))
        dropped(now, before)
    return now.where("up is null").select("d", "n", "p1", "p2", "depth")


def tree_differences(left: DataFrame, right: DataFrame, node: str, parent: str, key: str, value: str, doc: str) -> DataFrame:
    """(doc, depth, left_node, right_node, kind): where two trees of a document differ, from the root down.

    Nodes meet by the keys on their way from the root, whatever their own names. kind is "value" where values differ, "left"
    or "right" where only one tree has the node. Below a missing node nothing is told, as all of it is missing. Values may
    be null, which equals null. Keys of siblings differ. Equal trees give no rows.
    """
    sides = []
    for name, side in (("left", left), ("right", right)):
        rows = side.select(F.col(doc).alias("d"), F.col(node).alias("n"), F.col(parent).alias("up"), F.col(key).alias("key"), F.xxhash64(value, F.col(value).isNull()).alias("v"))
        met = rows.join(paths_of(rows, "n", "up", "key", "d"), ["d", "n"])
        sides.append(met.select("d", "p1", "p2", "depth", "key", F.col("n").alias(f"{name}_node"), F.col("up").alias(f"{name}_up"), F.col("v").alias(f"{name}_v")))
    both, _ = written(sides[0].join(sides[1], ["d", "p1", "p2", "depth", "key"], "full"))
    kind = F.when(F.col("right_node").isNull(), "left").when(F.col("left_node").isNull(), "right").when(F.col("left_v") != F.col("right_v"), "value")
    told = both.withColumn("kind", kind).where("kind is not null")
    for name in ("left", "right"):
        gone = told.where(F.col("kind") == name).select("d", F.col(f"{name}_node").alias(f"{name}_up"), F.lit(True).alias(f"{name}_gone"))
        told = told.join(gone, ["d", f"{name}_up"], "left").where((F.col("kind") != name) | F.col(f"{name}_gone").isNull())
    return told.select(F.col("d").alias(doc), "depth", "left_node", "right_node", "kind")


def first_difference(differences: DataFrame, order: DataFrame, node: str, doc: str) -> DataFrame:
    """The first of tree_differences() in each document by the left tree's walk (doc, node, preorder); what only the right tree has comes last."""
    placed = differences.join(order.select(F.col(doc), F.col(node).alias("left_node"), "preorder"), [doc, "left_node"], "left")
    at = F.struct(F.col("preorder").isNull().alias("last"), "preorder", "right_node")
    first = placed.groupBy(doc).agg(F.min_by(F.struct("depth", "left_node", "right_node", "kind"), at).alias("f"))
    return first.select(doc, "f.*")
