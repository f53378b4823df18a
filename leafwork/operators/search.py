"""Text search on laid-out pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import fold_accents


def searched_body(text: Column, fold: bool, ignore_case: bool) -> Column:
    """The text that is searched: accents and case folded if told, one character for each, so that places stay."""
    body = fold_accents(text) if fold else text
    return F.lower(body) if ignore_case else body


def pattern_of(needle: str, whole_words: bool) -> str:
    """needle as a pattern: white space also fits a line's end, and between any two characters a hyphen may end the line."""
    quoted = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c) for c in needle]
    parts = ["[ \\n]" if c == " " else c for c in quoted]
    broken = ["(?:-\\n|\\n)?" if a == "-" else "" if " " in (a, b) else "(?:-\\n)?" for a, b in zip(needle, needle[1:], strict=False)]
    pattern = "".join(p + g for p, g in zip(parts, [*broken, ""], strict=True))
    return f"(?<![\\p{{L}}\\p{{N}}]){pattern}(?![\\p{{L}}\\p{{N}}])" if whole_words else pattern


def searched(text: Column, needle: str, ignore_case: bool = False, ignore_accents: bool = False, whole_words: bool = False) -> Column:
    """The number of places where needle stands in text, not overlapping.

    Accents are ignored only for needles without any. Line ends count as spaces, and words may be broken over two
    lines by a hyphen, whether or not needle has one there.
    """
    body = searched_body(text, ignore_accents and needle.isascii(), ignore_case)
    return F.regexp_count(body, F.lit(pattern_of(needle.lower() if ignore_case else needle, whole_words))).cast("long")


def places(text: Column, needle: str, ignore_case: bool = False, ignore_accents: bool = False, whole_words: bool = False, backward: bool = False, start: int = 0, stop: int | None = None) -> Column:
    """Array of (first, last, line): the characters, from 0, where needle stands in text, and the line it begins on.

    The flags are those of searched(). backward gives the last place first. start and stop bound the first character.
    """
    body = searched_body(text, ignore_accents and needle.isascii(), ignore_case)
    pattern = pattern_of(needle.lower() if ignore_case else needle, whole_words)
    gaps, hits = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.array().cast("array<struct<first:int,last:int,line:int>>").alias("out"))
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def step(acc: Column, x: Column) -> Column:
        first, line = acc["at"] + F.length(x["gap"]), acc["line"] + lines(x["gap"])
        end = first + F.length(x["hit"])
        here = F.struct(first.alias("first"), (end - 1).alias("last"), line.alias("line"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), (line + lines(x["hit"])).alias("line"), F.concat(acc["out"], F.array(here)).alias("out")))

    found = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), zero, step)["out"]
    found = F.filter(found, lambda p: (p["first"] >= start) & (F.lit(True) if stop is None else p["first"] < stop))
    return F.when(F.size(hits) == 0, F.array().cast("array<struct<first:int,last:int,line:int>>")).otherwise(F.reverse(found) if backward else found)


def find_in(pages: DataFrame, needle: str, text: str = "text", **flags: bool) -> DataFrame:
    """The pages that hold needle, with hits."""
    return pages.withColumn("hits", searched(F.col(text), needle, **flags)).where("hits > 0")


def character_box(words: DataFrame, first: int, last: int, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2): the box of the characters first to last of each group's text, words in order (baseline, x1) and one space between."""
    order = Window.partitionBy(*keys).orderBy("baseline", "x1").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)))
    inside = placed.where((F.col("at") <= last) & (F.col("at") + F.length("text") > first))
    low, high = F.greatest(F.lit(0), first - F.col("at")), F.greatest(F.lit(0), F.col("at") + F.length("text") - 1 - last)
    return inside.groupBy(*keys).agg(F.min(F.col("x1") + low).alias("x1"), F.min("baseline").alias("y1"), F.max(F.col("x2") - high).alias("x2"), (F.max("baseline") + 1).alias("y2"))
