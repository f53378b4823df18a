"""Objects of documents: uniting documents with their references, logs of changes, and visibility programs held in data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.numbering import once
from leafwork.operators.documents import written
from leafwork.operators.ranges import running

#: Documents whose first numbers are summed together.
RANGE = 4096
#: Fixed: how deep a visibility expression may be.
DEPTH = 50


def united(objects: DataFrame, doc: str = "doc_id", num: str = "num", fields: str = "fields") -> DataFrame:
    """(doc, num, fields, old): the objects of all documents as those of one, in the order of the documents.

    fields is an array of struct with key, ref and other members; ref is the number of an object of the same document, or
    null. Numbers and references move past the greatest number of all documents before; references to what their
    document doesn't hold become null. Offsets are summed range by range of documents. Repeated rows of a number: the one of
    the least fields stays. Null documents are left out.
    """
    rows = objects.where(F.col(doc).isNotNull() & F.col(num).isNotNull())
    rows = rows.groupBy(doc, num).agg(F.min(fields).alias(fields))
    sizes = rows.groupBy(doc).agg((F.max(num) + 1).alias("_size")).withColumn("_range", F.floor(F.col(doc) / RANGE))
    starts, _ = written(running(sizes.withColumn("_all", F.lit(0)), ["_all"], doc, "_range", ["_size"]).select(doc, (F.col("_size_upto") - F.col("_size")).alias("_start")))
    # a reference is looked up once for each document and number that is named
    named = rows.select(doc, F.explode(F.filter(F.transform(fields, lambda f: f["ref"]), lambda r: r.isNotNull())).alias("_ref")).distinct()
    known = named.join(rows.select(doc, F.col(num).alias("_ref")), [doc, "_ref"], "left_semi")
    held = rows.select(doc, num, F.explode_outer(fields).alias("_f")).select(doc, num, F.col("_f.ref").alias("_ref"))
    met = held.where("_ref is not null").join(known, [doc, "_ref"], "left_semi").groupBy(doc, num).agg(F.collect_set("_ref").alias("_known"))
    placed = rows.join(starts, doc).join(met, [doc, num], "left")
    has = lambda r: F.coalesce(F.array_contains("_known", r), F.lit(False))
    moved = F.transform(fields, lambda f: f.withField("ref", F.when(has(f["ref"]), f["ref"] + F.col("_start"))))
    return placed.select(doc, (F.col(num) + F.col("_start")).alias(num), moved.alias(fields), F.col(num).alias("old"))


def first_named(entries: DataFrame, name: str, doc: str) -> DataFrame:
    """The entries of a name tree or form of several documents as one: of equal names that of the first document stands, ties by all columns."""
    rest = [c for c in entries.columns if c not in (name, doc)]
    first = entries.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(F.struct(doc, *rest)).alias("_first"))
    return first.select(name, *[F.col("_first")[c].alias(c) for c in (doc, *rest)])


def state_at(log: DataFrame, key: str, version: str, at: int | None = None, gone: str = "deleted") -> DataFrame:
    """The objects of a log of changes as of a version, the last one if none is given: each key's row of the greatest version.

    Rows whose `gone` is true delete their key, which a later row brings back. generation counts how often a key was
    deleted before. Changes of one key are pre-aggregated, so a key with any number of them is no hot group. Of rows equal in
    key and version the greatest stands, deletions first.
    """
    rows = log if at is None else log.where(F.col(version) <= at)
    rest = [c for c in log.columns if c != key]
    row = F.struct(version, (~F.coalesce(F.col(gone), F.lit(False))).alias("_live"), *[c for c in rest if c not in (version, gone)])
    top = rows.groupBy(key).agg(F.max(row).alias("_top"), F.count_if(F.coalesce(F.col(gone), F.lit(False))).alias("generation"))
    found = [c for c in rest if c != gone]
    return top.where("_top._live").select(key, *[F.col("_top")[c].alias(c) for c in found], "generation")


def append_changes(log_path: str, changes: DataFrame) -> None:
    """Adds changes to a log, a new file each time; nothing that is there is written again."""
    changes.write.mode("append").parquet(log_path)


def compacted(log: DataFrame, key: str, version: str, at: int, gone: str = "deleted", base: str = "base") -> DataFrame:
    """The log with all changes up to a version replaced by one row for each key: states from that version on stay what they were.

    The rows keep the version of the change that stands, and deleted keys stay as deletions; `base` carries the deletions
    that a key had by then, for states to count them in: see state_of().
    """
    old = log.where(F.col(version) <= at)
    rest = [c for c in log.columns if c not in (key, base)]
    count = F.sum(F.coalesce(F.col(gone), F.lit(False)).cast("long") + (F.col(base) if base in log.columns else F.lit(0))).alias("_n")
    live = (~F.coalesce(F.col(gone), F.lit(False))).alias("_live")
    top = old.groupBy(key).agg(F.max(F.struct(version, live, *[c for c in rest if c not in (version, gone)])).alias("_top"), count)
    kept = top.select(key, *[(~F.col("_top._live")).alias(gone) if c == gone else F.col("_top")[c].alias(c) for c in rest], (F.col("_n") - (~F.col("_top._live")).cast("long")).alias(base))
    later = log.where(F.col(version) > at).select(key, *rest, F.col(base).alias(base) if base in log.columns else F.lit(0).cast("long").alias(base))
    return kept.unionByName(later)


def state_of(compact: DataFrame, key: str, version: str, at: int | None = None, gone: str = "deleted", base: str = "base") -> DataFrame:
    """state_at() of a log that was compacted."""
    rows = compact if at is None else compact.where(F.col(version) <= at)
    before = rows.groupBy(key).agg(F.sum(base).alias("_before"))
    now = state_at(rows.drop(base), key, version, None, gone)
    return now.join(before, key).withColumn("generation", F.col("generation") + F.col("_before")).drop("_before")


def visible_program(program: Column, states: Column, most: int = DEPTH) -> Column:
    """Whether content shows by a visibility expression held in data: an array of struct (op, arg) in postfix order.

    op is Layer, whose arg is a number into states (boolean; null and unknown layers are on), or Not, And or Or, whose arg is
    how many of the last results it takes. And of none is true, Or of none is false. A null or empty program shows. An
    operator without enough results, a program that leaves other than one, or one that is deeper than `most` is an error.
    """
    none = F.array().cast("array<struct<on:boolean,deep:int>>")
    wrong = lambda what: F.raise_error(F.lit(f"visibility expression: {what}"))

    def step(stack: Column, x: Column) -> Column:
        layer = F.struct(F.coalesce(F.get(states, x["arg"]), F.lit(True)).alias("on"), F.lit(1).alias("deep"))
        n = F.when(x["op"] == "Layer", 0).otherwise(x["arg"])
        taken = F.slice(stack, F.size(stack) - n + 1, n)
        deep = F.coalesce(F.array_max(F.transform(taken, lambda t: t["deep"])), F.lit(0)) + 1
        on = F.when(x["op"] == "And", F.forall(taken, lambda t: t["on"])).when(x["op"] == "Or", F.exists(taken, lambda t: t["on"])).when((x["op"] == "Not") & (n == 1), ~F.get(taken, F.lit(0))["on"])
        result = F.struct(F.when(on.isNull(), wrong("no such operator").cast("boolean")).otherwise(on).alias("on"), F.when(deep > most, wrong("too deep").cast("int")).otherwise(deep).alias("deep"))
        left = F.when(n > F.size(stack), wrong("too few results").cast("array<struct<on:boolean,deep:int>>")).otherwise(F.slice(stack, F.lit(1), F.size(stack) - n))
        return F.when(x["op"] == "Layer", F.concat(stack, F.array(layer))).otherwise(F.concat(left, F.array(result)))

    ended = F.aggregate(program, none, step)
    return F.when(program.isNull() | (F.size(program) == 0), True).otherwise(once(ended, lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))["on"]).otherwise(wrong("results left").cast("boolean"))))
