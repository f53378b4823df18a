"""Curation of glyph bitmaps: merge, fold, rank, measure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import SYNONYMS
from leafwork.operators.ranges import ranked

WHITE = 255


def merge(glyphs: DataFrame) -> DataFrame:
    """(unicode, bitmap, n): the greatest count in each source, then the sum over sources."""
    return glyphs.groupBy("source", "unicode", "bitmap").agg(F.max("n").alias("n")).groupBy("unicode", "bitmap").agg(F.sum("n").alias("n"))


def fold(merged: DataFrame) -> DataFrame:
    """merged with look-alike code points counted as one. The table of synonyms is fixed, so it goes as a literal."""
    canon = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return merged.withColumn("unicode", F.coalesce(canon[F.col("unicode")], "unicode")).groupBy("unicode", "bitmap").agg(F.sum("n").alias("n"))


def statistics(merged: DataFrame) -> DataFrame:
    """One row: bitmaps, (bitmap, code point) combinations, bitmaps of several code points, and their share."""
    each = merged.groupBy("bitmap").agg(F.count(F.lit(1)).alias("k"))
    many = F.count_if(F.col("k") > 1)
    return each.agg(F.count(F.lit(1)).alias("bitmaps"), F.sum("k").alias("combinations"), many.alias("multiple"), F.round(many / F.count(F.lit(1)), 6).alias("share"))


def best_code_point(merged: DataFrame) -> DataFrame:
    """(bitmap, unicode, n, share): each bitmap's most frequent code point, ties to the greater, and its share of the counts."""
    top = F.max(F.struct("n", "unicode"))
    return merged.groupBy("bitmap").agg(top.alias("top"), F.sum("n").alias("total")).select("bitmap", "top.unicode", "top.n", F.round(F.col("top.n") / F.col("total"), 6).alias("share"))


def is_private(code: Column) -> Column:
    return code.between(0xE000, 0xF8FF) | code.between(0xF0000, 0xFFFFD) | code.between(0x100000, 0x10FFFF - 2)


def is_control(code: Column) -> Column:
    return code.between(0, 0x20) | code.between(0x7F, 0x9F) | code.between(0xFFF0, 0xFFFF)


def is_blank(bitmap: Column) -> Column:
    return F.forall(bitmap, lambda x: x == WHITE)


def bilevel(bitmap: Column) -> Column:
    """Only pure black stays ink."""
    return F.transform(bitmap, lambda x: F.when(x > 0, WHITE).otherwise(0))


def average(glyphs: DataFrame) -> DataFrame:
    """(unicode, pos, mean): the mean image of each code point, pixels as parts of white."""
    return glyphs.select("unicode", F.posexplode("bitmap").alias("pos", "v")).groupBy("unicode", "pos").agg(F.round(F.avg(F.col("v") / WHITE), 6).alias("mean"))


def distances(glyphs: DataFrame, key: str = "vec_id") -> DataFrame:
    """glyphs with distance: Euclidean, from the mean image of their code point.

    Means are one row for each code point, made by pre-aggregated sums; the join is by code point.
    """
    means = glyphs.select("unicode", F.posexplode("bitmap").alias("pos", "v")).groupBy("unicode", "pos").agg(F.avg(F.col("v") / WHITE).alias("m"))
    images = means.groupBy("unicode").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("image"))
    gap = F.aggregate(F.zip_with("bitmap", "image", lambda v, m: (v / WHITE - m) * (v / WHITE - m)), F.lit(0.0), lambda a, x: a + x)
    return glyphs.join(images, "unicode").withColumn("distance", F.round(F.sqrt(gap), 6)).drop("image")


def rank_and_cut(measured: DataFrame, cut: float, key: str = "vec_id") -> DataFrame:
    """measured with (rank, valid): by distance in each code point, the farthest `cut` of them not valid."""
    placed = ranked(measured, ["unicode"], ["distance", key], F.floor(F.col("distance") * 8))
    sizes = measured.groupBy("unicode").agg(F.count(F.lit(1)).alias("_all"))
    return placed.join(sizes, "unicode").withColumn("valid", F.col("rank") <= F.col("_all") - F.floor(F.col("_all") * cut)).drop("_all")


def downscale(bitmap: Column, width: int, factor: int, height: int) -> Column:
    """Means of blocks of factor x factor pixels."""
    cells = [[bitmap[(y * factor + j) * width + x * factor + i] for j in range(factor) for i in range(factor)] for y in range(height // factor) for x in range(width // factor)]
    return F.array(*[sum(block[1:], block[0]) / (factor * factor) for block in cells])


def ink_box(bitmap: Column, width: int) -> dict[str, Column]:
    """First and last rows and columns with ink (anything but white), -1 without, and the ink's size."""
    at = F.filter(F.transform(bitmap, lambda v, i: F.when(v != WHITE, i).otherwise(-1)), lambda i: i >= 0)
    rows, cols = F.transform(at, lambda i: F.floor(i / width).cast("int")), F.transform(at, lambda i: i % width)
    or_none = lambda c: F.coalesce(c, F.lit(-1))
    size = lambda c: F.coalesce(F.array_max(c) - F.array_min(c) + 1, F.lit(0))
    return {"top": or_none(F.array_min(rows)), "bottom": or_none(F.array_max(rows)), "ink_height": size(rows), "ink_width": size(cols)}


def touches_edge(bitmap: Column, width: int, height: int) -> Column:
    ink = F.transform(bitmap, lambda v, i: (v != WHITE) & ((i % width == 0) | (i % width == width - 1) | (i < width) | (i >= width * (height - 1))))
    return F.exists(ink, lambda x: x)


def quartiles(bitmap: Column) -> Column:
    """The values at a quarter, half and three quarters of the sorted pixels less the run of the greatest ones."""
    ordered = F.array_sort(bitmap)
    n = F.size(F.filter(ordered, lambda v: v < F.array_max(bitmap)))
    return F.array(*[F.get(ordered, F.floor(n * q).cast("int")) for q in (0.25, 0.5, 0.75)])


def folds(glyphs: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """glyphs with fold: the i-th of each code point, in hashed order, in fold i mod k."""
    hashed = glyphs.withColumn("_hash", F.md5(F.col(key).cast("string")))
    placed = ranked(hashed, ["unicode"], ["_hash"], F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int"))
    return placed.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("_hash", "rank")


def covariances(glyphs: DataFrame, size: int) -> DataFrame:
    """(unicode, i, j, covariance) of every two pixels of each code point, by n - 1; null for a single glyph. Sums are pre-aggregated."""
    cells = glyphs.select("unicode", F.posexplode("bitmap").alias("i", "x"), "bitmap")
    sums = [F.sum(F.col("x").cast("double") * F.get("bitmap", F.lit(j))).alias(f"p{j}") for j in range(size)]
    rows = cells.groupBy("unicode", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s"), *sums)
    whole = rows.groupBy("unicode").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("all"))
    each = rows.join(whole, "unicode").select("unicode", "i", "n", "s", "all", F.posexplode(F.array(*[f"p{j}" for j in range(size)])).alias("j", "p"))
    return each.select("unicode", "i", "j", F.when(F.col("n") > 1, (F.col("p") - F.col("s") * F.get("all", F.col("j")) / F.col("n")) / (F.col("n") - 1)).alias("covariance"))


def counters(merged: DataFrame, fewest: int) -> DataFrame:
    """One row of counts over (unicode, bitmap, n): combinations that are private or control codes, blank, or of few occurrences, and bitmaps of one or several code points."""
    each = merged.groupBy("bitmap").agg(F.count(F.lit(1)).alias("k"), F.count_if(is_private(F.col("unicode"))).alias("private"), F.count_if(is_control(F.col("unicode"))).alias("control"), F.count_if(F.col("n") < fewest).alias("rare"), F.first(is_blank(F.col("bitmap"))).alias("blank"))
    return each.agg(F.count_if(F.col("k") == 1).alias("single"), F.count_if(F.col("k") > 1).alias("multiple"), *[F.sum(c).alias(c) for c in ("private", "control", "rare")], F.count_if("blank").alias("blank"))


def cumulative(merged: DataFrame) -> DataFrame:
    """merged with reached: the share of a bitmap's counts that its code points make up, from the most frequent on."""
    by = Window.partitionBy("bitmap")  # as many rows as a bitmap has code points
    return merged.withColumn("reached", F.sum("n").over(by.orderBy(F.desc("n"), F.desc("unicode"))) / F.sum("n").over(by))


def likeness(glyphs: DataFrame, chosen: int, key: str = "vec_id") -> DataFrame:
    """glyphs with distance: Euclidean, from the chosen glyph's image; one row is sent to all."""
    one = F.broadcast(glyphs.where(F.col(key) == chosen).limit(1).select(F.col("bitmap").alias("_image")))
    gap = F.aggregate(F.zip_with("bitmap", "_image", lambda v, m: (v - m) * (v - m) / float(WHITE * WHITE)), F.lit(0.0), lambda a, x: a + x)
    return glyphs.join(one, F.lit(True)).withColumn("distance", F.sqrt(gap)).drop("_image")


def resorted(ordered: DataFrame, by: str, current: int, key: str = "vec_id") -> DataFrame:
    """ordered (unicode, rank) with ranks anew: glyphs up to the current rank stay, those behind it come by `by`, ties by key.

    by holds whole numbers, such as a height; glyphs that share one are ranked in parts by their key.
    """
    part = F.struct(F.col(by), F.floor(F.col(key) / 65_536))
    behind = ranked(ordered.where(F.col("rank") > current).drop("rank"), ["unicode"], [by, key], part)
    return ordered.where(F.col("rank") <= current).unionByName(behind.withColumn("rank", F.col("rank") + current))


def confident(merged: DataFrame, trials: int = 100, seed: int = 0) -> DataFrame:
    """(bitmap, codes, confident): whether a bitmap's most frequent code point would also come out so by chance.

    As many code points as counted are drawn by their shares, `trials` times; the most frequent must beat all others each
    time. A single code point is sure. Draws depend on seed and bitmap alone, so a task that runs again draws the same. A
    row holds the counts of one bitmap, of which there are as many as it has code points.
    """

    @F.pandas_udf("boolean")
    def sure(counts: pd.Series, key: pd.Series) -> pd.Series:
        def one(n: np.ndarray, k: int) -> bool:
            n = np.sort(n)[::-1]
            drawn = np.random.default_rng([seed, k & (1 << 63) - 1]).multinomial(n.sum(), n / n.sum(), trials)
            return len(n) == 1 or bool((drawn[:, :1] > drawn[:, 1:]).all())

        return pd.Series([one(np.asarray(n, np.int64), k) for n, k in zip(counts, key, strict=True)], dtype=bool)

    rows = merged.where(F.col("n") > 0).groupBy("bitmap").agg(F.collect_list(F.col("n").cast("long")).alias("counts"))
    return rows.select("bitmap", F.size("counts").alias("codes"), sure("counts", F.xxhash64("bitmap")).alias("confident"))


def activated(glyphs: DataFrame, order: str, low: float | None = None, high: float | None = None, on: bool = True) -> DataFrame:
    """glyphs (valid) switched on or off where `order` lies between low and high; without bounds all of them."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(order) >= low)
    if high is not None:
        inside = inside & (F.col(order) <= high)
    return glyphs.withColumn("valid", F.when(inside, F.lit(on)).otherwise(F.col("valid")))


def jittered(bitmap: Column, width: int, height: int, dx: Column, dy: Column, flip: bool = False) -> Column:
    """A bitmap moved by whole pixels, turned left to right if told; what comes in from outside is white."""

    def pixel(i: Column) -> Column:
        x, y = i % width - dx, F.floor(i / width).cast("int") - dy
        x = width - 1 - x if flip else x
        return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), F.get(bitmap, (y * width + x).cast("int"))).otherwise(F.lit(WHITE))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def balanced_sample(glyphs: DataFrame, share: float, key: str = "vec_id", power: float = 0.5) -> DataFrame:
    """A sampling operator: each glyph with the chance share * n^-power of its code point's n, by a hash of its key, so that runs agree."""
    sizes = glyphs.groupBy("unicode").agg(F.count(F.lit(1)).alias("_n"))
    chance = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    return glyphs.join(sizes, "unicode").where(chance < share * F.pow("_n", F.lit(-power))).drop("_n")


def mahalanobis(glyphs: DataFrame, width: int, height: int, factor: int = 2, key: str = "vec_id", least: float = 1e-7) -> DataFrame:
    """(key, unicode, distance) from the class mean by the pseudo-inverse of the class covariance of downscaled images.

    Moments are sums that Spark pre-aggregates, so a class of any size is one row of moments to its scorers; the
    scoring streams. Singular values up to `least` are dropped; where none is left, the distance is Euclidean.
    """
    small = glyphs.select(F.col(key).alias("key"), "unicode", downscale(F.transform("bitmap", lambda v: v / WHITE), width, factor, height).alias("x"))
    d = (width // factor) * (height // factor)
    cells = small.select("unicode", F.posexplode("x").alias("i", "xi"), F.col("x").alias("x"))
    sums = [F.sum(F.col("xi") * F.get("x", F.lit(j))).alias(f"p{j}") for j in range(d)]
    moments = cells.groupBy("unicode", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("xi").alias("s"), *sums)
    rows = moments.groupBy("unicode").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", F.array(*[f"p{j}" for j in range(d)]).alias("p")))).alias("m"))
    joined = small.join(rows.select("unicode", "n", F.col("m.s").alias("s"), F.flatten("m.p").alias("p")), "unicode")

    def score(batches):
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            out = np.zeros(len(pdf))
            for code, rows in pdf.groupby("unicode").indices.items():
                if code not in known:
                    first = pdf.iloc[rows[0]]
                    s, n = np.asarray(first.s), first.n
                    cov = (np.asarray(first.p).reshape(d, d) - np.outer(s, s / n)) / max(n - 1, 1)
                    u, w, vt = np.linalg.svd(cov)
                    known[code] = (s / n, (vt.T[:, w > least] / w[w > least]) @ u.T[w > least])
                mean, inverse = known[code]
                gap = np.stack(pdf.x.iloc[rows].to_numpy()) - mean
                # where nothing of the covariance is left, the plain distance
                out[rows] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", gap, inverse, gap), 0)) if inverse.any() else np.sqrt((gap**2).sum(axis=1))
            yield pd.DataFrame({"key": pdf.key, "unicode": pdf.unicode, "distance": out})

    return joined.mapInPandas(score, "key long, unicode int, distance double").withColumnRenamed("key", key)
