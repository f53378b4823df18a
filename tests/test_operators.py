"""Layout, search, files and streams on hand-worked pages."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.functions import numbering, text
from leafwork.operators import documents, glyphs, layout, models, ranges, rendering, search
from leafwork.sources import files
from leafwork.streaming import streams


def test_chars_to_words(spark):
    rows = [("a", 0.0, 1.0, 0.0), ("b", 1.05, 2.0, 0.0), ("b", 1.06, 2.0, 0.0), (" ", 2.0, 3.0, 0.0), ("c", 3.0, 4.0, 0.0), ("d", 4.5, 5.0, 0.0), ("e", 5.0, 6.0, 2.0), ("f", float("nan"), 7.0, 2.0)]
    chars = spark.createDataFrame([(1, 0, i, t, a, b, y, 1.0) for i, (t, a, b, y) in enumerate(rows)], "doc_id long, page int, char_pos long, text string, x1 double, x2 double, baseline double, font_size double")
    got = [(r.text, r.x1, r.x2) for r in layout.chars_to_words(chars).orderBy("word").collect()]
    assert got == [("ab", 0.0, 2.0), ("c", 3.0, 4.0), ("d", 4.5, 5.0), ("e", 5.0, 6.0)]


def test_data_regions_merge_unless_blocked(spark):
    rows = [(1, 0, 1, "UNKNOWN", 0.0, 0.0, 1.0, 1.0), (1, 0, 2, "UNKNOWN", 0.0, 2.0, 1.0, 3.0), (1, 0, 3, "UNKNOWN", 9.0, 0.0, 10.0, 1.0), (1, 0, 4, "TEXT", 4.0, 0.0, 5.0, 1.0)]
    got = {r.box_id: r.merged_id for r in layout.data_regions(spark.createDataFrame(rows, "doc_id long, page int, box_id long, category string, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_scripts_are_taken_once(spark):
    rows = [(1, 0, 10, 1, 1.0), (1, 0, 10, 2, 0.5), (1, 0, 11, 2, 0.6)] + [(1, 0, 20 + i, 3, float(i)) for i in range(6)]
    got = {r.script_id: r.target_id for r in layout.attach_scripts(spark.createDataFrame(rows, "doc_id long, page int, script_id long, target_id long, distance double")).collect()}
    assert got == {10: 2, 11: 2, 20: 3, 21: 3, 22: 3, 23: 3}


@pytest.mark.parametrize(
    ("needle", "flags", "hits"),
    [
        ("eclair", {}, 0), ("Éclair", {}, 1), ("eclair", {"ignore_case": True, "ignore_accents": True}, 1), ("éclair", {"ignore_accents": True}, 0), ("ÉCLAIR", {"ignore_case": True}, 1),
        ("short", {}, 2), ("short", {"whole_words": True}, 1), ("broken", {}, 1), ("over lines", {}, 1), ("a.b", {}, 1), ("well-known", {}, 2),
    ],
)
def test_search(spark, needle, flags, hits):
    page = spark.createDataFrame([("Éclair short shorts\nbro-\nken over\nlines a.b axb well-\nknown well-known",)], "text string")
    assert page.select(search.searched(F.col("text"), needle, **flags)).first()[0] == hits


def test_filters(spark):
    data = b"the the the\x00\x00\x00\x00" * 20
    df = spark.createDataFrame([(b"48 65 6C6c 6F7>",), (None,)], "b binary")
    assert [r[0] for r in df.select(files.decoded(F.col("b"), ["ASCIIHexDecode"])).collect()] == [b"Hellop", None]
    flat = spark.createDataFrame([(zlib.compress(data),), (b"junk",)], "b binary")
    assert [r[0] for r in flat.select(files.decoded(F.col("b"), ["FlateDecode"])).collect()] == [data, None]
    assert files.run_lengths(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    assert files.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert files.png_rows(bytes([1, 1, 1, 1, 2, 1, 1, 1]), 3) == bytes([1, 2, 3, 2, 3, 4])


def test_glyph_files(spark, tmp_path):
    rows = [("a", 65, 3, 2, 2, b"\x00\xff\x00\xff"), ("a", 66, 1, 1, 1, b"\x07"), ("b", 65, 9, 2, 2, b"\x00\xff\x00\xff")]
    packed = files.glyph_files(spark.createDataFrame(rows, files.GLYPH_SCHEMA)).collect()
    for r in packed:
        (tmp_path / f"{r.source}.gz").write_bytes(r.content)
    (tmp_path / "bad.gz").write_bytes(b"not gzip")
    (tmp_path / "cut.gz").write_bytes(gzip.compress(struct.pack(files.RECORD, 1, 1, 9, 9)))
    got = files.read_glyphs(spark, str(tmp_path))
    assert sorted((r.source[-4], r.unicode, r.n, r.width, r.height, bytes(r.bitmap)) for r in got.collect()) == rows
    assert sorted((r.unicode, r.n) for r in glyphs.merge(got).collect()) == [(65, 12), (66, 1)]


def test_work_list_and_pages(spark, tmp_path):
    (tmp_path / "list.tsv").write_text("whatever\tc\ta\tu\tl\n# note\nx/1\tc\ta\tu\tl\nbroken\tline\n")
    assert [r.path for r in files.read_work_list(spark, str(tmp_path / "list.tsv")).collect()] == ["x/1"]
    files.write_pages(spark.createDataFrame([(4, 0, "a\nb"), (5, 0, "c")], "doc_id int, page int, text string"), str(tmp_path / "out"), "\r\n")
    assert "a\r\nb\r\n\f" in next((tmp_path / "out" / "doc_id=4" / "page=0").glob("*.txt")).read_bytes().decode()


def test_stream_goes_on_without_counting_twice(spark, tmp_path):
    schema = "source string, unicode int, n long, bitmap string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: streams.merge_glyphs(streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put([("a", 65, 3, "x"), ("a", 65, 5, "x")], 1)
    start()
    put([("a", 65, 4, "x"), ("b", 65, 2, "x")], 2)
    start()
    start()
    assert [r.n for r in streams.merged(spark, str(tmp_path / "out")).collect()] == [7]


def test_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (30, 16))
    df = spark.createDataFrame([(i, 1, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, unicode int, bitmap array<int>")
    small = x.reshape(30, 2, 2, 2, 2).mean(axis=(2, 4)).reshape(30, 4) / 255
    gap = small - small.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(np.cov(small.T)), gap))
    got = [r.distance for r in glyphs.mahalanobis(df, 4, 4).orderBy("vec_id").collect()]
    assert np.allclose(got, want, atol=1e-8)


def test_models(spark):
    assert np.allclose(spark.range(1).select(models.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0], [0.5, 0.5])
    p = F.array(F.lit(0.6), F.lit(0.005), F.lit(0.395))
    assert list(spark.range(1).select(models.accepted(p, F.lit(1)), models.accepted(p, F.lit(2)), models.accepted(p, F.lit(0))).first()) == [True, False, False]


def test_no_depth_is_too_deep(spark):
    path = spark.range(70).selectExpr("id AS src", "id + 1 AS dst").coalesce(1)
    assert documents.reachable(path, spark.range(1).withColumnRenamed("id", "node")).count() == 71
    outline = spark.createDataFrame([(0, None, 90), *[(i, i - 1, 180 if i == 9 else None) for i in range(1, 11)], (20, 21, None), (21, 20, None), (30, 99, None)], "node int, parent int, rotate int")
    got = {r.node: r.effective for r in documents.inherited(outline, "node", "parent", "rotate").collect()}
    assert got == {i: 90 if i < 9 else 180 for i in range(11)} | {20: None, 21: None, 30: None}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    assert documents.same_rows(a, a) and not documents.same_rows(a, a.distinct())
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert sorted(r.node for r in documents.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_fragments_merge_by_pairs(spark):
    rows = [(1, 0.0, "ab", 0.0, 2.0, 1.0), (1, 0.0, "cd", 2.05, 4.0, 1.0), (1, 0.0, "ef", 4.05, 6.0, 1.0), (1, 0.0, "x", 9.0, 10.0, 1.0), (1, 0.0, "y", 10.05, 11.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, baseline double, text string, x1 double, x2 double, font_size double")
    assert [r.text for r in layout.merge_fragments(df, "doc_id").orderBy("x1").collect()] == ["abcd", "ef", "xy"]


def test_baselines_snap(spark):
    rows = [(1, 0, 1, 1, 0.0, 0.0, 10.0, 9.0, 10.0), (1, 0, 1, 2, 5.0, 1.0, 11.0, 11.0, 10.0), (1, 0, 1, 3, 0.0, 12.0, 22.0, 21.0, 10.0), (1, 0, 1, 4, 5.0, 17.0, 27.0, 27.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, cluster_id int, word_id int, x1 double, y1 double, y2 double, baseline double, font_size double")
    assert [r.baseline for r in layout.align_baselines(df).orderBy("word_id").collect()] == [9.0, 9.0, 21.0, 27.0]


def test_outline_edits(spark):
    rows = [(1, 1, None, 0, "a"), (1, 2, None, 1, "b"), (1, 3, 1, 0, "c"), (1, 4, 3, 0, "d"), (2, 1, None, 0, "z")]
    tree = spark.createDataFrame(rows, "doc_id int, node int, parent int, pos int, title string")
    put = documents.outline_retitle(documents.outline_insert(tree, 1, None, 1, 9, "new"), 1, 4, "dd")
    assert sorted((r.title, r.pos) for r in put.where("doc_id = 1").collect()) == [("a", 0), ("b", 2), ("c", 0), ("dd", 0), ("new", 1)]
    assert sorted((r.doc_id, r.title, r.pos) for r in documents.outline_remove(tree, 1, 1).collect()) == [(1, "b", 0), (2, "z", 0)]
    assert {r.name for r in documents.qualified_names(tree).collect()} == {"a", "b", "a.c", "a.c.d", "z"}


def test_places(spark):
    page = spark.createDataFrame([("an Ant\nand bro-\nken an",)], "text string")
    of = lambda *a, **b: [tuple(p) for p in page.select(search.places(F.col("text"), *a, **b)).first()[0]]
    assert of("an") == [(0, 1, 0), (7, 8, 1), (20, 21, 2)] and of("an", backward=True, start=1) == [(20, 21, 2), (7, 8, 1)]
    assert of("an", ignore_case=True, stop=7) == [(0, 1, 0), (3, 4, 0)] and of("broken") == [(11, 18, 1)] and of("Ant and") == [(3, 9, 0)] and of("zz") == []


def test_tables_keep_their_columns(spark):
    """Left edges meet, then right edges; the second line's gap is as wide as its characters tell."""
    rows = [(0.0, 0.0, 4.0, "name"), (0.0, 10.0, 15.0, "price"), (1.0, 0.0, 2.0, "ab"), (1.0, 12.0, 15.0, "100"), (2.0, 0.0, 3.0, "c d"), (2.0, 10.0, 12.0, "no")]
    df = spark.createDataFrame([(1, 0, 2, *r, 1.0) for r in rows], "doc_id int, page int, cluster_id int, baseline double, x1 double, x2 double, text string, font_size double")
    assert rendering.rendered_tables(df).first().text.split("\n") == ["name      price", "ab          100", "c d       no"]


def test_trees_of_any_depth(spark):
    chain = [(1, i, i - 1 if i else None, f"n{i}") for i in range(201)]
    odd = [(2, 1, 2, "a"), (2, 2, 1, "b"), (2, 3, 9, "c"), (2, 4, None, None), (2, 5, 4, "e / f")]
    df = spark.createDataFrame(chain + odd, "doc_id int, node int, parent int, title string")
    got = {(r.doc_id, r.node): (r.depth, r.path) for r in documents.walk_down(df, "node", "parent", "doc_id", "title").collect()}
    assert got == {(1, i): (i, " / ".join(f"n{j}" for j in range(i + 1))) for i in range(201)} | {(2, 4): (0, ""), (2, 5): (1, " / e / f")}
    assert {r.node: r.name for r in documents.qualified_names(df.where("doc_id = 2")).collect()} == {4: "", 5: "e / f"}


def test_tiny_and_lost_characters(spark, monkeypatch):
    monkeypatch.setattr(layout, "TINY_MOST", 3)
    rows = [(1, 0, i, "a", float(i), i + 1.0, 5.0, 1.0) for i in range(6)] + [(1, 0, 9, "b", 9.0, 14.0, 5.0, 9.0), (1, 0, 10, "c", -9.0, -8.0, 5.0, 9.0), (1, 0, 11, "d", 1.0, 2.0, 999.0, 9.0), (2, 0, 1, "e", 0.0, 1.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, char_pos int, text string, x1 double, x2 double, baseline double, font_size double")
    assert sorted((r.doc_id, r.char_pos) for r in layout.on_page_chars(df, 100, 100).collect()) == [(1, 0), (1, 1), (1, 2), (1, 9), (2, 1)]


def test_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 0, int(i), float(x), float(x + w), float(y), float(s), int(t)) for i, (x, w, y, s, t) in enumerate(zip(rng.uniform(0, 60, 300), rng.uniform(1, 5, 300), rng.uniform(0, 60, 300), rng.uniform(0.5, 2, 300), rng.integers(0, 2, 300), strict=True))]
    df = spark.createDataFrame(rows, "doc_id int, page int, word_id int, x1 double, x2 double, row double, font_size double, rotation int")
    near = lambda a, b: a[7] == b[7] and abs(a[5] - b[5]) <= 1.4 * min(a[6], b[6]) and ((a[3] <= b[4] and b[3] <= a[4]) or min(abs(p - q) for p in a[3:5] for q in b[3:5]) <= min(a[6], b[6]))
    root = list(range(300))
    for _ in range(300):
        old = list(root)
        for i in range(300):
            for j in range(300):
                if near(rows[i], rows[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if old == root:
            break
    assert {r.word_id: r.cluster_id for r in layout.cluster_words(df).collect()} == dict(enumerate(root))


def test_dates_and_codes(spark):
    df = spark.createDataFrame([("D:191040915140000",), ("D:20040915140000+01'30'",), ("1999",), ("D:20041315",), ("x",)], "d string")
    assert [r[0] for r in df.select(F.date_format(numbering.parse_date(F.col("d")), "yyyy-MM-dd HH:mm")).collect()] == ["2004-09-15 14:00", "2004-09-15 12:30", "1999-01-01 00:00", None, None]
    raw = spark.createDataFrame([(b"\x18\x92\xa0\xe9A",), (b"\xef\xbb\xbf\xc3\xa9",), (b"\xfe\xff\x00A",)], "b binary")
    assert [r[0] for r in raw.select(text.decode_text(F.col("b"))).collect()] == ["\u02d8\u2122\u20ac\u00e9A", "é", "A"]
    assert spark.createDataFrame([("ﬁx e\u0301",)], "t string").select(text.compatible_places(F.col("t"))).first()[0] == [0, 0, 1, 2, 3]
    labels = spark.createDataFrame([("iv",), ("A-3",), ("A-9",), ("cover",)], "label string")
    spans = spark.createDataFrame([(0, 1, None, "cover", 1), (1, 6, "r", "", 1), (7, 5, "D", "A-", 1)], "base int, length int, style string, prefix string, first int")
    assert {r["label"]: r["index"] for r in ranges.label_index(labels, spans).collect()} == {"iv": 4, "A-3": 9, "A-9": None, "cover": 0}


def test_predictors_and_networks(spark, tmp_path):
    data = bytes([1, 1, 1, 1, 2, 1, 1, 1])
    df = spark.createDataFrame([(zlib.compress(data),)], "b binary")
    undone = [files.decoded(F.col("b"), [("FlateDecode", {"predictor": p, "columns": n})]).alias(f"p{p}") for p, n in ((15, 3), (2, 4))]
    assert list(map(bytes, df.select(*undone).first())) == [bytes([1, 2, 3, 2, 3, 4]), bytes([1, 2, 3, 4, 2, 3, 4, 5])]
    layers = [models.Layer([[1.0, 2.0]], [0.5], "relu"), models.Layer([[1.0], [2.0]], [0.0, 1.0], "softmax")]
    models.save_network(spark, layers, str(tmp_path / "net"), 7)
    assert models.load_network(spark, str(tmp_path / "net"), 7) == layers


def test_batches_are_tried_again():
    seen, skipped = [], []

    def fail(df, i):
        seen.append(i)
        raise ValueError

    streams.retried(fail, 3, 0, lambda df, i: skipped.append(i))(None, 5)
    with pytest.raises(ValueError):
        streams.retried(fail, 2, 0)(None, 6)
    assert (seen, skipped) == ([5, 5, 5, 6, 6], [5])


def test_split_entropy_over_many_ranges(spark):
    """Against plain counting; values without order in the table, null values and null labels, a class of a third of the rows."""
    rng = np.random.default_rng(3)
    rows = [(float(v) / 4 if v % 50 else None, "often" if k < 3 else None if k == 3 else f"c{k}") for v, k in zip(rng.integers(0, 900, 4000), rng.integers(0, 9, 4000), strict=True)]
    got = {r.threshold: r.entropy for r in models.split_entropy(spark.createDataFrame(rows, "v double, l string"), "v", "l").collect()}
    known = [(v, k) for v, k in rows if v is not None]
    values = sorted({v for v, _ in known})

    def bits(side):
        counts = np.array([side.count(k) for k in set(side)]) / max(len(side), 1)
        return -len(side) * float((counts * np.log2(counts)).sum())

    want = {(a + b) / 2: (bits([k for v, k in known if v <= a]) + bits([k for v, k in known if v > a])) / len(known) for a, b in zip(values, values[1:], strict=False)}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-5 for t in want)
    assert models.split_entropy(spark.createDataFrame([], "v double, l string"), "v", "l").count() == 0
    assert models.split_entropy(spark.createDataFrame([(1.0, "a")], "v double, l string"), "v", "l").count() == 0
