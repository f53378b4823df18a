"""Line dedup by overlapping windows of three consecutive lines.

Windows are hashed, those that occur more than once anywhere are found, and all but the first occurrence give up
their lines; covered lines of overlapping windows merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, small, text_key

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(rows: DataFrame, n: int) -> DataFrame:
    """(w1, w2, key, t1, t2, at): a 128-bit hash of every window of n lines of rows (key, t1, t2, lines), and where it starts."""
    lines = F.col("lines")
    shifted = [F.slice(lines, i + 1, F.greatest(F.size(lines) - n + 1, F.lit(0))).alias(f"l{i}") for i in range(n)]
    whole = F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws("\n", *[z[f"l{i}"] for i in range(n)]))
    found = rows.select("key", "t1", "t2", F.posexplode(whole).alias("at", "window"))
    return found.select(F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2"), "key", "t1", "t2", "at")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = LINES) -> DataFrame:
    """docs with its text less the repeated lines, and (n_lines, n_removed).

    A window is n consecutive lines; its first occurrence, by key, then text, then line, stays, and every line of a
    later one goes. Texts of fewer than n lines have no windows. A document is a key and a text: rows equal in both
    are the same document, and all keep what its first occurrence keeps; rows of one key and other texts are documents
    of their own. Null keys come first. Null texts stay null with 0 lines; an empty text is one empty line. Copies and common
    passages make hot windows; these are reduced before they are shuffled, and joined with what Spark can split.
    Columns called like the added ones are replaced.
    """
    full = F.col(text)
    t1, t2 = text_key(full)
    body = docs.select(F.col(key).alias("key"), t1.alias("t1"), t2.alias("t2"), lines_of(full).alias("lines"))
    found = windows(body, n)
    place = F.struct("key", "t1", "t2", "at")
    repeated = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = found.join(repeated, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    covered = cut(later.groupBy("key", "t1", "t2").agg(F.collect_set("at").alias("_starts")))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the row travels as one column, so that its names meet none of those below
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(key).alias("_id"), t1.alias("_t1"), t2.alias("_t2"), full.alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("key")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2"))
    joined = rows.join(small(covered), same, "left").withColumn("_lines", lines_of(F.col("_text")))
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + n - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    less = F.when(F.col("_starts").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return joined.select(*[less.alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept], n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
