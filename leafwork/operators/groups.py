"""Groups of rows handed to Python many at a time: for work on small groups whose rows depend on one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType

#: Rows of runs that are taken apart at once.
PART = 1 << 16


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before in a key; nulls are equal to each other."""
    out = np.zeros(max(0, len(table) - 1), bool)
    for k in keys:
        c = table[k].combine_chunks()
        a, b = c[1:], c[:-1]
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def kinds(rows: DataFrame, *names: str) -> str:
    """The columns and their types, as a schema says them; of lists the type of an item."""
    item = lambda kind: kind.elementType if isinstance(kind, ArrayType) else kind
    return ", ".join(f"`{c}` {item(rows.schema[c].dataType).simpleString()}" for c in names)


def keyed(column: pa.ChunkedArray) -> np.ndarray:
    """A column of numbers to sort by, nulls before all others."""
    floating = pa.types.is_floating(column.type)
    return pc.fill_null(column, -np.inf if floating else np.iinfo(column.type.to_pandas_dtype()).min).to_numpy()


def lagged(column: pa.ChunkedArray, first: np.ndarray) -> pa.Array:
    """The value of the row before, null in the rows that begin a group."""
    c = column.combine_chunks()
    return pc.if_else(pa.array(first), pa.scalar(None, c.type), pa.concat_arrays([pa.nulls(min(1, len(c)), c.type), c[:-1]]))


def doubles(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return column.cast(pa.float64(), safe=False)


def exceeds(a: pa.Array, b: pa.Array | float) -> pa.Array:
    """Whether a > b, in double precision, with NaN over all other numbers, as Spark has it; null if one is."""
    b = pa.scalar(b, pa.float64()) if isinstance(b, float) else b
    return pc.or_kleene(pc.greater(a, b), pc.and_kleene(pc.is_nan(a), pc.invert(pc.is_nan(b))))


def extreme(column: pa.ChunkedArray, starts: np.ndarray, least: bool) -> pa.Array:
    """The least or the greatest value of each group, groups beginning at starts; nulls don't count, NaN is the greatest."""
    kind = column.type.to_pandas_dtype()
    low, high = (-np.inf, np.inf) if pa.types.is_floating(column.type) else (np.iinfo(kind).min, np.iinfo(kind).max)
    values = pc.fill_null(column, high if least else low).to_numpy()
    found = (np.fmin if least else np.maximum).reduceat(values, starts)
    absent = np.logical_and.reduceat(pc.is_null(column).to_numpy(), starts)
    return pa.array(found, column.type, mask=absent)


def joined(pieces: pa.Array, starts: np.ndarray) -> pa.Array:
    """The pieces of each group put together; starts: where each group begins and the last ends. Null pieces are left out."""
    whole = pc.fill_null(pieces, "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole), "")


def by_groups(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What `each` makes of whole groups (keys), sorted by `order` inside; it gets many of them in one table, and where each begins and the last ends.

    A group is a pandas frame of its own under applyInPandas, which costs more than the work where groups are small.
    Rows are dealt by the keys and sorted, which Spark spills; a task holds a batch and the group that the batch ends in.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: whole_groups(map(pa.Table.from_batches, ([b] for b in batches)), keys, each), schema)


def whole_groups(parts: Iterator[pa.Table], keys: list[str], each: Callable[[pa.Table, np.ndarray], pa.Table]) -> Iterator[pa.RecordBatch]:
    """What `each` makes of the groups of parts whose rows come by keys."""
    held: list[pa.Table] = []

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from each(table.combine_chunks(), starts).combine_chunks().to_batches()

    for part in parts:
        if not part.num_rows:
            continue
        joint = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), part]) if held else part
        fresh = np.flatnonzero(begins(joint, keys)) + (0 if held else 1)
        if not len(fresh):
            held.append(part)
            continue
        # rows of this part from the last beginning on wait for the next one
        whole = pa.concat_tables([*held, part.slice(0, fresh[-1])])
        before = len(whole) - fresh[-1]
        held = [part.slice(fresh[-1])]
        yield from done(whole, np.unique(np.concatenate([[0], fresh + before])))
    if held:
        whole = pa.concat_tables(held)
        yield from done(whole, np.array([0, len(whole)]))


def in_order(table: pa.Table, starts: np.ndarray, order: list[str]) -> pa.Table:
    """The rows of each group sorted by columns of numbers or strings, as Spark sorts them. Later columns are looked at only where ties are left."""
    ties = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for name in order:
        c = table[name]
        place = pc.rank(c, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) if pa.types.is_string(c.type) else keyed(c)
        a, b = place[:-1], place[1:]
        after = (a > b) | ((a != a) & (b == b))
        if (after & (ties[1:] == ties[:-1])).any():
            by = np.lexsort((place, ties))
            table, place, ties = table.take(pa.array(by)), place[by], ties[by]
            a, b = place[:-1], place[1:]
        fresh = (ties[1:] != ties[:-1]) | ~((a == b) | ((a != a) & (b != b)))
        if fresh.all():
            break
        ties = np.concatenate([[0], np.cumsum(fresh)])[: len(table)]
    return table


def by_runs(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """by_groups for rows that may stand for runs of rows of one group: columns of lists are taken apart, others hold for the whole run.

    A row handed to Python costs some microseconds however short it is, an item of a list a fraction of one, and
    only runs are dealt and sorted. Rows without lists, one of each, go by by_groups.
    """
    lists = [c for c in rows.columns if isinstance(rows.schema[c].dataType, ArrayType)]
    if not lists:
        return by_groups(rows, keys, order, each, schema)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            runs = pa.Table.from_batches([batch])
            ends = np.cumsum(pc.fill_null(pc.list_value_length(runs[lists[0]]), 0).to_numpy())
            if not len(runs) or not ends[-1]:
                continue
            # some PART rows at once, or one run that has more
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PART, ends[-1], PART)) + 1, len(runs)))
            for i, j in pairwise(np.append(0, cuts)):
                some = runs.slice(i, j - i)
                of = pa.array(np.repeat(np.arange(j - i), np.diff(ends[i:j], prepend=ends[i - 1] if i else 0)))
                yield pa.table({c: pc.list_flatten(some[c]) if c in lists else some[c].take(of) for c in runs.column_names})

    def sorted_each(table: pa.Table, starts: np.ndarray) -> pa.Table:
        return each(in_order(table, starts, order).combine_chunks(), starts)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *takewhile(lambda c: c not in lists, order))
    return dealt.mapInArrow(lambda batches: whole_groups(apart(batches), keys, sorted_each), schema)
