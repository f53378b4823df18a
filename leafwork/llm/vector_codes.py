"""Compression of vectors to codes of a few bytes by codebooks, one for each part of a vector.

The codebooks are improved in rounds: every part goes to its nearest entry, every entry to the mean of its parts. All is
in whole numbers, so results don't depend on the order of sums. The nearest entry is found by an exponion search: from
a part's entry of the round before, at distance u, only entries within 2u of that entry can be as near, so its list of
neighbours, sorted by distance, is scanned ring by ring, and no farther than the best entry found so far demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.common import Scratch, small

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Components beyond it, after scaling, are refused.
LARGEST = 1 << 30
#: Neighbours that are compared at once.
RING = 32
#: Positions of a part whose sums make one row.
CHUNK = 16


def whole_numbers(vector: Column, scale: int) -> Column:
    """The components as whole numbers; null for a vector that is null or holds null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    safe = F.transform(scaled, lambda x: F.when(F.abs(x) > LARGEST, F.raise_error("a component is too large for exact whole-number distances")).otherwise(x).cast("int"))
    return F.when(sound, safe)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of whole numbers; shorter ones are filled up with zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(n, width).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def squares(x: np.ndarray, y: np.ndarray, exact: type) -> np.ndarray:
    """Squared distances of every row of x from every row of y; exact: a type that holds them without rounding."""
    x, y = x.astype(exact), y.astype(exact)
    return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)


class Nearest:
    """Exponion search for the nearest entry of one part's codebook, ties to the lower index."""

    def __init__(self, book: np.ndarray, largest: int) -> None:
        self.book = book
        # sums of squares below 2^53 are exact in floating point, which multiplies faster
        self.exact = np.float64 if 4 * book.shape[1] * (2 * largest) ** 2 < 1 << 53 else np.int64
        between = squares(book, book, self.exact)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.apart = np.take_along_axis(between, self.order, 1)

    def __call__(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part, searched from the entries `start`."""
        u = ((parts - self.book[start]) ** 2).sum(1)
        index, best = start.astype(np.int64), u.copy()
        rows = np.argsort(start, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(start[rows]) > 0, True]) if len(rows) else []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            live = rows[low:high]
            entry = int(start[live[0]])
            root = np.floor(np.sqrt(u[live])).astype(np.int64)
            for ring in range(0, len(self.book), RING):  # an entry like it may come before itself
                # one nearer than the best is no farther from the entry than u and the best together; + 1 each rounds up
                reach = (root + np.floor(np.sqrt(best[live])).astype(np.int64) + 2) ** 2
                near = self.apart[entry, ring] <= reach
                live, root = live[near], root[near]
                if not len(live):
                    break
                among = np.sort(self.order[entry, ring : ring + RING])
                d = squares(parts[live], self.book[among], self.exact)
                which = d.argmin(1)
                d, which = d[np.arange(len(live)), which], among[which]
                better = (d < best[live]) | (d == best[live]) & (which < index[live])
                best[live[better]], index[live[better]] = d[better], which[better]
        return index, best


def assign(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], largest: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Vectors (key, label, vector, code) with the code anew; if last, (key, label, code, error) of them."""
    search, n = [Nearest(b, largest) for b in books], books[0].shape[1]
    for batch in batches:
        rows = matrix(batch.column(2), n * len(books))
        # before the first round every search begins at the first entry
        old = [x or bytes(len(books)) for x in batch.column(3).to_pylist()]
        start = np.frombuffer(b"".join(old), np.uint8).reshape(-1, len(books)).astype(np.int64)
        found = [f(rows[:, p * n : (p + 1) * n], start[:, p]) for p, f in enumerate(search)]
        code = np.stack([x[0] for x in found], axis=1).astype(np.uint8)
        codes = pa.array([c.tobytes() for c in code], pa.binary())
        if last:
            error = pa.array(sum(x[1] for x in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, error], names=["key", "label", "code", "error"])
        else:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], codes], names=["key", "label", "vector", "code"])


def sums(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(entry, chunk, n, s0 ...) of a task's vectors (vector, code): how many parts each entry has, and their sums by position."""
    parts, entries, n = shape
    total, count = np.zeros((parts * entries, n), np.int64), np.zeros(parts * entries, np.int64)
    for batch in batches:
        rows = matrix(batch.column(0), n * parts).reshape(-1, n)
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
        which = (code + np.arange(parts) * entries).ravel()
        count += np.bincount(which, minlength=len(count))
        order = np.argsort(which, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
        if len(order):
            total[which[order[first]]] += np.add.reduceat(rows[order], first, axis=0)
    used = np.flatnonzero(count)
    for chunk in range(-(-n // CHUNK)):
        part = np.zeros((len(used), CHUNK), np.int64)
        some = total[used, chunk * CHUNK : (chunk + 1) * CHUNK]
        part[:, : some.shape[1]] = some
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), chunk)), pa.array(count[used]), *[pa.array(x) for x in part.T]], names=["entry", "chunk", "n", *[f"s{i}" for i in range(CHUNK)]])


def improved(books: list[np.ndarray], assigned: DataFrame) -> list[np.ndarray]:
    """The codebooks with each entry at the mean of its parts, rounded down; unused entries stay."""
    parts, (entries, n) = len(books), books[0].shape
    names = ["n", *[f"s{i}" for i in range(CHUNK)]]
    rows = assigned.select("vector", "code").mapInArrow(partial(sums, shape=(parts, entries, n)), ", ".join(f"{c} bigint" for c in ["entry", "chunk", *names]))
    out = [b.copy() for b in books]
    # as many rows as the codebooks have chunks, whatever the number of vectors
    for r in rows.groupBy("entry", "chunk").agg(*[F.sum(c).alias(c) for c in names]).collect():
        part, entry = divmod(r["entry"], entries)
        at = slice(r["chunk"] * CHUNK, min(n, (r["chunk"] + 1) * CHUNK))
        out[part][entry, at] = (np.array(r[3:], np.int64) // r["n"])[: at.stop - at.start]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the codebooks' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((key, code, error, label_error), codebooks): the code of each vector, a byte for each part, and its squared distance from it.

    The codebooks begin as the vectors of the smallest keys, null keys last, ties by components and label, and have up to 256
    entries, fewer if there are fewer vectors. label_error sums the errors of a label; null is a label. Vectors that are
    null or hold null or non-finite components are left out. Shorter vectors than the longest, and all if `parts` doesn't
    divide that, are filled up with zeros. Repeated rows are vectors of their own. No vectors give no rows and no
    codebooks. Components so large that squared distances would exceed 63 bits are an error. Other columns are ignored.
    Each round reads and writes the whole numbers once; a task holds one batch and the codebooks, and sends sums alone.
    """
    scratch = Scratch()
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), whole_numbers(F.col(vector), scale).alias("vector")).where("vector is not null")
    now = scratch.cut(rows.withColumn("code", F.lit(None).cast("binary")))
    seen = now.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest")).first()
    kind = {f.name: f.dataType for f in now.schema.fields}
    if seen["width"] is None:
        none = now.select(F.col("key").alias(key), "code", F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, []
    n, largest = max(1, -(-seen["width"] // parts)), seen["largest"] or 0
    if 4 * n * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact whole-number distances")
    begin = np.zeros((0, n * parts), np.int64)
    for r in now.orderBy(F.col("key").asc_nulls_last(), "vector", "label").limit(min(entries, 256)).select("vector").collect():
        begin = np.r_[begin, np.pad(np.array(r["vector"], np.int64), (0, n * parts - len(r["vector"])))[None]]
    books = [begin[:, p * n : (p + 1) * n] for p in range(parts)]
    for _ in range(rounds):
        old, now = now, scratch.cut(now.mapInArrow(partial(assign, books=books, largest=largest, last=False), now.schema))
        scratch.drop_one(old)
        books = improved(books, now)
    fields = [T.StructField("key", kind["key"]), T.StructField("label", kind["label"]), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    keep = Scratch()
    coded = keep.cut(now.mapInArrow(partial(assign, books=books, largest=largest, last=True), T.StructType(fields)))
    scratch.drop()
    each = keep.cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    of = small(each.withColumnRenamed("label", "_label"))
    out = coded.join(of, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error"), books
