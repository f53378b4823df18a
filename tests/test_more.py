"""Code maps, layout modes, page ranges and glyph order on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.functions import numbering
from leafwork.operators import documents, glyphs, layout, ranges, rendering
from leafwork.sources.tables import glyphs_of


def test_codes_are_mapped_by_ranges(spark):
    """Unmapped and null codes stay without a code point; of overlapping ranges the later one holds; repeats are kept."""
    chars = spark.createDataFrame([("f", 5), ("f", 5), ("f", 300), ("g", 5), ("f", None), (None, 5), ("f", 12)], "font string, code long")
    maps = spark.createDataFrame([("f", 0, 20, 65), ("f", 10, 5, 1000), ("f", 200, 400, 5000), ("h", 0, 9, 1), ("g", 0, 0, 7)], "font string, base long, length long, target long")
    got = sorted(ranges.mapped_codes(chars, maps).collect(), key=repr)
    want = sorted([("f", 5, 70), ("f", 5, 70), ("f", 300, 5100), ("g", 5, None), ("f", None, None), (None, 5, None), ("f", 12, 1002)], key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert ranges.mapped_codes(chars, maps.where("false")).where("unicode is null").count() == 7


def test_text_by_mode(spark):
    """The right column was written first."""
    rows = [(1, 0, 0, 1, 0, 50, "c"), (1, 0, 1, 1, 1, 50, "d"), (1, 0, 2, 0, 0, 0, "a"), (1, 0, 3, 0, 0, 5, "b"), (1, 0, 4, 0, 1, 0, "e")]
    words = spark.createDataFrame(rows, "doc_id long, page int, content_pos long, column_no int, baseline int, x1 long, text string")
    got = {m: rendering.text_by_mode(words, m).first().text for m in ("raw", "physical", "reading")}
    assert got == {"raw": "c\nd\na b\ne", "physical": "a b c\ne d", "reading": "a b\ne\nc\nd"}
    assert rendering.text_by_mode(words.where("false"), "raw").count() == 0


def test_page_ranges_and_gaps_are_checked(spark):
    pages = spark.range(1, 11).withColumnRenamed("id", "page")
    of = lambda **k: sorted(r.page for r in documents.page_range(pages, **k).collect())
    assert (of(first=8), of(last=3), of(first=2, last=6, parity=0), of(first=3, last=3)) == ([8, 9, 10], [1, 2, 3], [2, 4, 6], [3])
    with pytest.raises(ValueError):
        documents.page_range(pages, 5, 4)
    for gap in (0, -1, 10.5):
        with pytest.raises(ValueError):
            layout.word_groups(pages, gap=gap)


def test_clusters_by_size(spark):
    rows = [(1, 0, 7), (1, 0, 7), (1, 0, 3), (1, 0, 9), (1, 0, 9), (2, 0, 1)]
    got = {(r.doc_id, r.cluster_id): (r.n, r.size_rank) for r in layout.clusters_by_size(spark.createDataFrame(rows, "doc_id long, page int, cluster_id long")).collect()}
    assert got == {(1, 7): (2, 1), (1, 9): (2, 2), (1, 3): (1, 3), (2, 1): (1, 1)}


def test_resorted_behind_the_current_glyph(spark):
    rows = [(65, k, k, h) for k, h in enumerate([9, 8, 7, 3, 7, 1], 1)]
    ordered = spark.createDataFrame(rows, "unicode int, rank int, vec_id long, height int")
    got = [r.vec_id for r in glyphs.resorted(ordered, "height", 2).orderBy("rank").collect()]
    assert got == [1, 2, 6, 4, 3, 5]
    assert [r.rank for r in glyphs.resorted(ordered, "height", 2).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]


def test_confident_code_points(spark):
    """Sure where one code point is alone or far ahead, unsure at a tie; the same again for the same seed."""
    rows = [(65, "a", 1), (65, "b", 5000), (66, "b", 1), (65, "c", 50), (66, "c", 50), (66, "d", 3), (67, "d", 2)]
    merged = spark.createDataFrame(rows, "unicode int, bitmap string, n long")
    got = {r.bitmap: (r.codes, r.confident) for r in glyphs.confident(merged).collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (2, False), "d": (2, False)}
    assert got == {r.bitmap: (r.codes, r.confident) for r in glyphs.confident(merged.repartition(5)).collect()}
    assert glyphs.confident(merged.where("false")).count() == 0


def test_roman_labels_of_long_ranges(spark):
    """From 4000 on the numerals had no value, and their labels none; a label is now found on all pages that bear it."""
    pages = spark.range(1, 24_001).select(F.col("id").alias("n"), numbering.label(F.lit("R"), F.col("id"), F.lit("s-")).alias("label"))
    at = {r.n: r.label for r in pages.collect()}
    assert [at[n] for n in (3999, 4000, 4001, 5009, 8000, 10_000, 23_456)] == ["s-MMMCMXCIX", "s-MM", "s-MMI", "s-MIX", "s-MMMM", "s-", "s-MMMCDLVI"]
    spans = spark.createDataFrame([(100, 24_000, "R", "s-", 1), (0, 9, "D", "t", 1)], "base long, length long, style string, prefix string, first int")
    found = ranges.label_index(pages.select("label").where("label <> 's-'").distinct(), spans)
    got = {(r.label, page) for r in found.collect() for page in r.pages}
    assert got == {(label, n + 99) for n, label in at.items() if label != "s-"}
    assert {(r["label"], r["index"]) for r in found.where("label in ('s-MM', 's-MMMM')").collect()} == {("s-MM", 2099), ("s-MMMM", 8099)}


def test_labels_are_cut_only_where_prefixes_end(spark):
    spans = spark.createDataFrame([(0, 9, "a", "s-", 1), (9, 9, "a", "abc-", 1)], "base long, length long, style string, prefix string, first int")
    labels = spark.createDataFrame([("s-" + "b" * 900,), ("abc-d",)], "label string")
    plan = ranges.label_index(labels, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, length(label" not in plan
    assert {(r["label"][:5], r["index"]) for r in ranges.label_index(labels, spans).collect()} == {("s-bbb", None), ("abc-d", 12)}


def test_glyphs_scale_in_single_precision(spark):
    """0.18 as a float is a little less than 0.18; its product with 100 is 18 in single precision and less in double."""
    df = spark.createDataFrame([(1, [0.18, 0.57, -0.29], 3)], "vec_id long, embedding array<float>, label long")
    assert [r.bitmap for r in glyphs_of(df).collect()] == [[int(np.floor(np.float32(x) * np.float32(100))) for x in (0.18, 0.57, -0.29)]]
    assert glyphs_of(df).first().bitmap[0] == 18
