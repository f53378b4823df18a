"""Embedding near-dedup as an exact metric range join.

Unit vectors of cosine >= c lie within the chord r = sqrt(2 - 2c). Every vector is at home in the cell of its nearest
pivot p and is copied to the cell of another pivot q only if a vector within r of it may be at home there: by the
triangle inequality that needs d(v, q) - d(v, p) <= 2r and d(v, q) <= r + the radius of cell q; in this geometry also
(d(v, q)^2 - d(v, p)^2) / 2d(p, q) <= r, its distance to the plane between them. A cell then holds all partners of
its home vectors and is joined by itself; inside it, only vectors whose distances to the pivot differ by r at most are
compared. As either of two cells would find a pair, one of them is told to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import components, cut

COSINE = 0.9
#: Distinct vectors, of the smallest key hashes, from which pivots are chosen. All vectors are joined whichever they are.
SAMPLE = 4096
#: Pivots at most.
PIVOTS = 1024
#: Home vectors of a cell that a task holds; cells of more are cut into chunks that each meet all of the cell.
CHUNK = 8192
#: About how many comparisons cost as much as a row that is copied; by this the number of pivots is chosen.
ROW_COST = 500
#: Vectors that stream past a chunk at once.
AT_ONCE = 1024
#: Below the least cosine by more than this, single precision decides; closer pairs are computed in double precision.
SLACK = 1e-4
#: Of the cost of fewer pivots, what more may cost at most.
LEAST_GAIN = 0.8


def vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, as doubles scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cells_of(unit: np.ndarray, pivots: np.ndarray, reach: np.ndarray | None, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell, distance to its pivot, matrix of the cells that hold a copy, home included)."""
    d = np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))
    home = d.argmin(axis=1)
    near = d[np.arange(len(d)), home]
    if reach is None:
        return home, near, np.empty((0, 0))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-300))[home]
    eps = 1e-6
    copies = (d - near[:, None] <= 2 * r + eps) & (d <= r + reach + eps) & (d**2 - near[:, None] ** 2 <= 2 * between * (r + eps) + eps)
    copies[np.arange(len(d)), home] = True
    return home, near, copies


def farthest_first(unit: np.ndarray, most: int) -> np.ndarray:
    """Vectors each of which is as far as can be from those before; copies of earlier ones are left out."""
    chosen, gap = [0], 1 - unit @ unit[0]
    while len(chosen) < most and gap.max() > 1e-9:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, 1 - unit @ unit[chosen[-1]])
    return unit[chosen]


def chosen_pivots(unit: np.ndarray, n: int, r: float, chunk: int, most: int) -> np.ndarray:
    """As many pivots, a power of four, as half of the sample shows to be cheapest for n vectors: more cells hold fewer
    comparisons but more copies. Where vectors are spread evenly in many dimensions no pivot tells them apart."""
    # pivots are near themselves, so their cost is that of the other half of the sample
    found, apart = farthest_first(unit[::2], most), unit[1::2] if len(unit) > 1 else unit
    best, m = (np.inf, unit[:1]), 1
    while m <= len(found):
        home, near, _ = cells_of(apart, found[:m], None, r)
        share, reach = np.bincount(home, minlength=m) * (n / len(apart)), np.full(m, -2 * r)
        np.maximum.at(reach, home, near)
        copies = cells_of(apart, found[:m], reach, r)[2].mean(axis=0)
        cost = float(copies @ (np.ceil(share / chunk) * ROW_COST + share))
        if cost < LEAST_GAIN * best[0]:  # a few per cent are within the estimate's error
            best = cost, found[:m]
        m *= 4
    return best[1]


def measure(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, n, reach): home vectors of each cell in this partition, and the farthest of them."""
    n, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            home, near, _ = cells_of(vectors(batch.column("embedding").slice(i, AT_ONCE)), pivots, None, 0)
            n += np.bincount(home, minlength=len(pivots))
            np.maximum.at(reach, home, near)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(n), pa.array(reach)], names=["cell", "n", "reach"])


def deal(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, chunks: np.ndarray, reach: np.ndarray, r: float) -> Iterator[pa.RecordBatch]:
    """(cell, chunk, guest, id, copies, embedding): each vector at home in one chunk and a guest of others of its cells.

    Of two chunks, numbered throughout, the later one takes the other's vectors as guests if the sum of their numbers
    is even, the earlier one if it is odd; so every pair of chunks meets once and the work is even.
    """
    base = np.cumsum(chunks) - chunks
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(i, AT_ONCE)
            home, _, copies = cells_of(vectors(some.column("embedding")), pivots, reach, r)
            own = (some.column("id").to_numpy() * 0x9E3779B1 % (1 << 32) * chunks[home]) >> 32
            who, cell = np.nonzero(copies)
            times = chunks[cell]
            who, cell = np.repeat(who, times), np.repeat(cell, times)
            chunk = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            mine, other = (base[home] + own)[who], base[cell] + chunk
            met = np.where((mine + other) % 2 == 0, mine < other, mine > other)
            who, cell, chunk = who[met], cell[met], chunk[met]
            row = np.r_[np.arange(len(home)), who]
            for j in range(0, len(row), AT_ONCE):
                part = slice(j, j + AT_ONCE)
                out = some.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[home, cell][part].astype(np.int32)), pa.array(np.r_[own, chunk][part].astype(np.int32)), pa.array(np.r_[np.zeros(len(home), np.int32), np.ones(len(who), np.int32)][part].astype(np.int32)), *out.columns], names=["cell", "chunk", "guest", *out.schema.names])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component over edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == old).all():
            return root


class Chunk:
    """The home vectors of a chunk, by their distance to the pivot, and what they and the guests that stream past have shown."""

    def __init__(self, pivot: np.ndarray, cosine: float) -> None:
        self.pivot, self.cosine, self.r = pivot, cosine, sqrt(2 - 2 * cosine)
        self.home: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.unit = None

    def away(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * unit @ self.pivot, 0))

    def settle(self) -> None:
        self.id, self.copies, self.unit = (np.concatenate(x) for x in zip(*self.home, strict=True))
        far = self.away(self.unit)
        order = np.argsort(far, kind="stable")
        self.id, self.copies, self.unit, self.far = self.id[order], self.copies[order], self.unit[order], far[order]
        self.single, self.links, self.pairs = self.unit.astype(np.float32), self.copies.astype(np.int64), []
        for i in range(0, len(self.id), AT_ONCE // 4):  # a home vector meets itself and its copies as one
            part = slice(i, i + AT_ONCE // 4)
            x, y = self.close(self.unit[part], self.far[part])
            x, y = x[x + i != y] + i, y[x + i != y]
            np.add.at(self.links, x, self.copies[y])
            self.pairs.append(np.stack([x, y], axis=1)[x < y])

    def close(self, unit: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of these vectors, of the home vectors) that are near enough."""
        low, high = np.searchsorted(self.far, [far.min() - self.r - 1e-6, far.max() + self.r + 1e-6])
        x, y = np.nonzero(unit.astype(np.float32) @ self.single[low:high].T >= self.cosine - SLACK)
        sure = np.einsum("ij,ij->i", unit[x], self.unit[low + y]) >= self.cosine
        return x[sure], low + y[sure]

    def meet(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts links of the home vectors; returns the guests that have links, their links, and a home vector of each."""
        if self.unit is None:
            self.settle()
        far = self.away(unit)
        order, found = np.argsort(far, kind="stable"), []
        for i in range(0, len(order), AT_ONCE // 4):
            some = order[i : i + AT_ONCE // 4]
            x, y = self.close(unit[some], far[some])
            found.append((some[x], y))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        np.add.at(self.links, y, copies[x])
        links, first = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        np.add.at(links, x, self.copies[y])
        first[x[::-1]] = y[::-1]
        self.pairs.append(np.unique(np.stack([y, first[x]], axis=1)[y != first[x]], axis=0))
        met = np.flatnonzero(first >= 0)
        return ids[met], links[met], self.id[first[met]]

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their links, edges that connect home vectors)."""
        if self.unit is None:
            self.settle()
        pairs = np.concatenate([*self.pairs, np.empty((0, 2), np.int64)]).astype(np.int64)
        root = roots(pairs[:, 0], pairs[:, 1], len(self.id))
        return self.id, self.links, np.stack([self.id, self.id[root]], axis=1)


def join(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, cosine: float) -> Iterator[pa.RecordBatch]:
    """(id, links, other): links of vectors where other is null, edges where links is null. Rows come by cell and chunk, home first."""
    now, chunk = None, None

    def rows(ids: np.ndarray, links: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
        null = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids), null if links is None else pa.array(links), null if other is None else pa.array(other)], names=["id", "links", "other"])

    def last() -> Iterator[pa.RecordBatch]:
        if chunk and chunk.home:
            ids, links, edges = chunk.finish()
            edges = edges[edges[:, 0] != edges[:, 1]]
            yield rows(ids, links, None)
            yield rows(edges[:, 0], None, edges[:, 1])

    for batch in batches:
        at = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            cell, number, guest = at[i]
            if now != (cell, number):
                yield from last()
                now, chunk = (cell, number), Chunk(pivots[cell], cosine)
            for k in range(i, j, AT_ONCE):
                some = batch.slice(k, min(AT_ONCE, j - k))
                ids, copies, unit = some.column("id").to_numpy(), some.column("copies").to_numpy(), vectors(some.column("embedding"))
                if not guest:
                    chunk.home.append((ids, copies, unit))
                elif chunk.home:
                    met, links, other = chunk.meet(ids, copies, unit)
                    yield rows(met, links, None)
                    yield rows(met[met != other], None, other[met != other])
    yield from last()


def near_vectors(table: DataFrame, cosine: float = COSINE, key: str = "vec_id", embedding: str = "embedding", chunk: int = CHUNK, most: int = PIVOTS) -> DataFrame:
    """(key, n_links, component_id, kept) of each row of table.

    n_links counts the other vectors of cosine >= `cosine`, copies included; component_id is the smallest key
    reachable by links, itself included; kept: it is its own component. Equal vectors are joined as one and
    counted as many. Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths don't link. Keys are integers; rows of a null key have a null component and
    link with nothing; rows that repeat a key count as vectors of their own and share the component. Other columns
    are ignored; no rows give no rows.
    """
    spark = table.sparkSession
    vec = F.col(embedding).cast("array<double>")
    sound = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False)) & F.col(key).isNotNull()
    rows = table.select(F.col(key).alias("key"), F.when(sound, F.col(embedding)).alias("embedding"))
    # links, edges and copies are between distinct vectors, each named by the least key that has it
    distinct = cut(rows.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies")).select(F.col("id").cast("long").alias("id"), "copies", "embedding"))
    r, found = sqrt(2 - 2 * cosine), []
    for width, n in [(x["w"], x["n"]) for x in distinct.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()]:
        same = distinct.where(F.size("embedding") == width)
        sample = vectors(pa.array([x["embedding"] for x in same.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()], pa.list_(pa.float64())))
        pivots = chosen_pivots(sample, n, r, chunk, most)
        reach, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for x in same.select("id", "copies", "embedding").mapInArrow(partial(measure, pivots=pivots), "cell bigint, n bigint, reach double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect():
            sizes[x["cell"]], reach[x["cell"]] = x["n"], x["reach"]
        reach[sizes == 0] = -2 * r  # nobody is at home there
        chunks = np.maximum(1, -(-sizes // chunk))
        kind = distinct.schema["embedding"].dataType.simpleString()
        dealt = same.mapInArrow(partial(deal, pivots=pivots, chunks=chunks, reach=reach, r=r), f"cell int, chunk int, guest int, id bigint, copies bigint, embedding {kind}")
        ordered = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "guest")
        found.append(ordered.mapInArrow(partial(join, pivots=pivots, cosine=cosine), "id bigint, links bigint, other bigint"))
    met = spark.createDataFrame([], "id bigint, links bigint, other bigint") if not found else found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    met = cut(met)
    root = cut(components(met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))))
    links = met.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    each = distinct.join(links, "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left")
    each = each.select("embedding", (F.coalesce("links", F.lit(1)) - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    whole = rows.join(each, "embedding", "left")
    component = F.coalesce("component_id", F.col("key")).cast("long")
    return whole.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
