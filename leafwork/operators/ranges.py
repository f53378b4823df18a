"""Interval tables: cumulative starts and the range join that finds each point's interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.numbering import from_letters, roman_numbers


def running_ranges(spans: DataFrame, order: str, length: str) -> DataFrame:
    """spans with base, the sum of the lengths before; spans are few, as there is one for each numbering style of a document."""
    return spans.withColumn("base", F.sum(length).over(Window.orderBy(order)) - F.col(length))


def in_ranges(points: DataFrame, spans: DataFrame, point: str, base: str, length: str, bin_size: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """points joined with the interval [base, base + length) of the same `by` that holds them: both meet by bins, then by bounds."""
    inside = (F.col(point) >= F.col(base)) & (F.col(point) < F.col(base) + F.col(length))
    bins = spans.where(F.col(length) > 0).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(base) / bin_size), F.floor((F.col(base) + F.col(length) - 1) / bin_size))))
    return points.withColumn("_bin", F.floor(F.col(point) / bin_size)).join(bins, [*by, "_bin"]).where(inside).drop("_bin")


def mapped_codes(chars: DataFrame, maps: DataFrame, bin_size: int = 256) -> DataFrame:
    """chars (font, code) with unicode, by maps (font, base, length, target) of ranges of codes to code points from target on.

    Null if the font has no range for the code; of several the one that begins last holds. Each code of a font is looked
    up once, however often it occurs.
    """
    codes = chars.select("font", "code").where(F.col("font").isNotNull() & F.col("code").isNotNull()).distinct()
    met = in_ranges(codes, maps, "code", "base", "length", bin_size, ("font",))
    to = met.groupBy("font", "code").agg(F.max_by(F.col("target") + F.col("code") - F.col("base"), F.struct("base", "target")).alias("unicode"))
    return chars.join(to, ["font", "code"], "left")


def ranked(rows: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """rows with rank, from 1 by `order` in each key. bucket never falls as `order` rises: rows are ranked bucket by
    bucket behind the counts of those before, so a key of many rows is split over tasks."""
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return cut.withColumn("_place", place).join(before, [*keys, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


def running(rows: DataFrame, keys: list[str], order: str, bucket: str, sums: list[str]) -> DataFrame:
    """rows with <name>_upto for each of the named columns: its total over the rows of the key up to this one by `order`.

    bucket never falls as `order` rises: totals run bucket by bucket behind those before, so a key of many rows is split
    over tasks. Null keys are a key; rows equal in key and order get the same totals.
    """
    totals = rows.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    of = [*keys, bucket]
    before = totals.select(*[F.col(k).alias(f"_{k}_of") for k in of], *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    here = Window.partitionBy(*of).orderBy(order)
    placed = rows.withColumns({f"_{c}_here": F.sum(c).over(here) for c in sums})
    met = placed.join(before, [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in of])
    return met.select(*rows.columns, *[(F.col(f"_{c}") + F.col(f"_{c}_here")).alias(f"{c}_upto") for c in sums])


def label_index(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """labels (label) with index and pages: the page of a label, by ranges (base, length, style, prefix, first), and all of that range that bear it; null if no range has it.

    Of several ranges the first holds. Labels are cut at the lengths that prefixes have, which are no more than the longest
    prefix has characters, and looked up among the prefixes by an equi-join.
    """
    lengths = spans.select(F.length("prefix").alias("_k")).where("_k is not null").distinct()
    parts = labels.select("label").distinct().join(F.broadcast(lengths), F.col("_k") <= F.length("label"))
    parts = parts.select("label", F.substring("label", F.lit(1), F.col("_k")).alias("prefix"), F.expr("substring(label, _k + 1)").alias("_rest"))
    rest, last = F.col("_rest"), F.col("first") + F.col("length") - 1
    one = lambda n: F.when(n.isNotNull(), F.array(n.cast("long")))
    numbers = F.when(F.col("style") == "D", one(F.when(rest.rlike("^[0-9]+$"), rest.try_cast("long")))).when(F.col("style").isin("R", "r"), roman_numbers(rest, last)).when(F.col("style").isin("A", "a"), one(from_letters(rest)))
    met = parts.join(spans, "prefix")
    plain = F.col("style").isNull() & (F.col("length") == 1) & (rest == "")
    known = F.filter(numbers, lambda n: (n >= 0) & (n - F.col("first") < F.col("length")))
    pages = F.when(plain, F.array(F.col("base").cast("long"))).otherwise(F.transform(known, lambda n: (F.col("base") + n - F.col("first")).cast("long")))
    # what is left out is so by the aggregate: a filter would be pushed below and find the pages a second time
    first = F.min(F.when(F.size("_pages") > 0, F.struct("base", "_pages")))
    found = met.select("label", "base", pages.alias("_pages")).groupBy("label").agg(first.alias("_first")).select("label", F.col("_first._pages").alias("pages"))
    return labels.join(found, "label", "left").select(*labels.columns, F.get("pages", F.lit(0)).alias("index"), "pages")
