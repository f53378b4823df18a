"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard stands at several points of a ring of 64-bit hashes and owns the arcs that end there. A key belongs to the
arc it falls in; keys of a full shard continue clockwise to the next point whose shard has room. Who stays and who
continues depends on the number of keys in each arc alone, so the walk around the ring is planned over these counts,
of which there are as many as points, whatever the number of rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut, small

SHARDS = 16
#: Points of each shard on the ring.
POINTS = 64
#: Bits of a ring position by which the points near it are looked up.
CELL_BITS = 12
#: Bits that name the part of the ring, at least; keys are ranked part by part.
PART_BITS = 8
#: Rows that a part has on average, at most; more rows make more parts.
PART_ROWS = 100_000
#: What shard() adds.
ADDED = ["size", "text_crc32", "shard", "slot", "home"]


def ring(spark: SparkSession, shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of every point, clockwise."""
    # a shard's points are the same however many shards there are
    rows = spark.range(shards * points).select(F.xxhash64(F.lit("point"), "id").alias("at"), F.floor(F.col("id") / points).cast("int").alias("shard"))
    return sorted((r.at, r.shard) for r in rows.collect())


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): where the keys of each arc go.

    counts: keys by arc; owners: the shard at the end of each arc; room: rows that each shard takes. In round r
    the keys still waiting in an arc ask the r-th point clockwise; a shard serves the arcs in ring order.
    """
    waiting, served, used, out = list(counts), [0] * len(counts), [0] * len(room), []
    for r in range(len(owners)):
        open_arcs = [a for a in range(len(counts)) if waiting[a]]
        if not open_arcs:
            break
        for a in open_arcs:
            shard = owners[(a + r) % len(owners)]
            if n := min(waiting[a], room[shard] - used[shard]):
                out.append((a, served[a], served[a] + n, shard, used[shard]))
                served[a], waiting[a], used[shard] = served[a] + n, waiting[a] - n, used[shard] + n
    return out


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame of a few planned rows, as a JSON literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def measures(text: str = "text", key: str = "doc_id") -> list[Column]:
    """What a row's place depends on: (_key, size, text_crc32, _at)."""
    full = F.coalesce(F.col(text), F.lit(""))
    return [F.col(key).alias("_key"), (F.octet_length(full) + 1).cast("long").alias("size"), F.crc32(full).alias("text_crc32"), F.xxhash64(F.lit("key"), F.col(key), full).alias("_at")]


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with (size, text_crc32, shard, slot, home): every row in one of `shards` shards.

    The shards' row counts are at most one apart: that is the bound of their loads. slot numbers the rows of a shard from 0
    without gaps; home is the shard whose arc the row falls in, where it is unless that was full. size is the
    UTF-8 length of the text plus 1, a null text counting as empty. A row's place on the ring comes from its key
    and text; rows equal in both are interchangeable. Null keys are keys like any other. Empty input gives no rows.
    Columns of docs called like the added ones are replaced.
    """
    # the row travels as one column, so that its names meet none of those below
    kept = [c for c in docs.columns if c not in ADDED]
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    taken = dealt(docs.select(row.alias("_row"), *measures(text, key)), shards, points)
    return taken.select(*[F.col("_row")[c].alias(c) for c in kept], *ADDED)


def dealt(placed: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """placed (measures() and any columns else) with (shard, slot, home), without _key and _at; see shard()."""
    spark = placed.sparkSession
    carried = [c for c in placed.columns if c not in ("_key", "_at")]
    nodes = ring(spark, shards, points)
    total = placed.count()
    bits = max(PART_BITS, (total // PART_ROWS).bit_length())
    cell = F.shiftright("_at", 64 - CELL_BITS).cast("int")
    # the points inside each cell of the ring, and the arc that its end belongs to
    inside: dict[int, list[dict]] = {c: [] for c in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)}
    for arc, (at, _) in enumerate(nodes):
        inside[at >> (64 - CELL_BITS)].append({"at": at, "arc": arc})
    rows, after = [], 0
    for c, found in inside.items():
        after += len(found)
        rows.append({"_cell": c, "inner": found, "next": after % len(nodes)})
    cells = literal(spark, rows, "_cell:int,inner:array<struct<at:bigint,arc:int>>,next:int")
    first = F.get(F.filter("inner", lambda p: p["at"] >= F.col("_at")), 0)["arc"]
    placed = placed.withColumn("_cell", cell).join(F.broadcast(cells), "_cell").withColumn("_arc", F.coalesce(first, F.col("next"))).drop("inner", "next", "_cell")
    placed = placed.withColumn("_part", F.shiftright("_at", 64 - bits))
    sizes = cut(placed.groupBy("_arc", "_part").agg(F.count(F.lit(1)).alias("n")))
    counts = [0] * len(nodes)
    for r in sizes.groupBy("_arc").agg(F.sum("n").alias("n")).collect():
        counts[r["_arc"]] = r["n"]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    plan = [dict(zip(("_arc", "_low", "_high", "shard", "_first"), x, strict=True)) for x in walk(counts, [s for _, s in nodes], room)]
    plan_rows = literal(spark, plan, "_arc:int,_low:bigint,_high:bigint,shard:int,_first:bigint")
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_at", "_key", "size", "text_crc32")) - 1
    ranked = placed.withColumn("_rank", rank).join(small(before), ["_arc", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    homes = literal(spark, [{"_arc": a, "home": s} for a, (_, s) in enumerate(nodes)], "_arc:int,home:int")
    taken = ranked.join(F.broadcast(homes), "_arc").join(F.broadcast(plan_rows), "_arc").where("_rank >= _low and _rank < _high")
    return taken.select(*carried, "shard", (F.col("_first") + F.col("_rank") - F.col("_low")).alias("slot"), "home")


def by_turn(taken: DataFrame) -> DataFrame:
    """taken with the slots of each shard dealt anew in the order of _turn, ranked part by part of the turns; ties by the old slot.

    _turn: numbers from 0, about one for each row. taken is written, so it should be narrow.
    """
    taken = cut(taken.withColumn("_part", F.expr(f"_turn div {PART_ROWS}")))
    sizes = taken.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = cut(sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")).drop("n"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_turn", "slot")) - 1
    ranked = taken.withColumn("_rank", rank).join(small(before), ["shard", "_part"])
    return ranked.withColumn("slot", F.col("_before") + F.col("_rank")).select(*[c for c in taken.columns if c != "_part"])
