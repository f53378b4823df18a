"""Reports and XML pages, line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.operators import trees
from leafwork.sources import files, reports


def test_reports(spark):
    fonts = spark.createDataFrame([(1, 2, None, "Type 3", None, None, False, True, None, None), (1, 1, "A" * 40, "TrueType", "WinAnsi", True, True, False, 12, 3)], "doc_id long, place int, name string, type string, encoding string, embedded boolean, subset boolean, unicode boolean, num int, gen int")
    want = reports.FONT_HEAD + "\n" + "A" * 40 + f" {'TrueType':17} {'WinAnsi':16} yes yes no      12  3\n" + f"{'[none]':36} {'Type 3':17} {'':16} no  no  yes [none]\n"
    assert reports.font_report(fonts).collect() == [(1, want)]
    links = spark.createDataFrame([(1, 12, 0, "u"), (1, 3, 1, "http://b"), (1, 3, 0, None), (2, 12345, 0, "x")], "doc_id long, page int, pos int, uri string")
    assert dict(map(tuple, reports.url_report(links).collect())) == {1: reports.URL_HEAD + "\n   3  Annotation    http://b\n  12  Annotation    u\n", 2: reports.URL_HEAD + "\n12345  Annotation    x\n"}
    kind = "doc_id long, page int, n int, type string, width int, height int, color string, components int, bits int, encoding string, interpolate boolean, num int, gen int, x_ppi double, y_ppi double, size long, ratio double"
    images = spark.createDataFrame([(1, 1, 0, "image", 640, 480, "rgb", 3, 8, "jpeg", False, 7, 0, 72.0, 0.25, 10_240, 1.5), (1, 2, 1, "smask", 5, 6, "gray", 1, 1, "ccitt", True, None, None, 150.4, 150.4, None, None)], kind)
    lines = reports.image_report(images).first().report.split("\n")
    assert lines[2:4] == ["   1     0 image     640   480  rgb     3   8  jpeg   no         7  0    72 0.250 10.0K 1.5%", "   2     1 smask       5     6  gray    1   1  ccitt  yes  [none]       150   150    -    - "]
    sizes = spark.createDataFrame([(5,), (1023,), (1024,), (10_235,), (103_000,), (5 << 20,), (3 << 30,), (None,)], "s long")
    assert [r.t for r in sizes.select(reports.image_size(F.col("s")).alias("t")).collect()] == ["   5B", "1023B", "1.00K", "10.0K", " 101K", "5.00M", "3.00G", "   - "]


def test_xml(spark):
    pages = spark.createDataFrame([(1, 1, 10.6, 20.0), (1, 2, 5.0, 5.0)], "doc long, number int, height double, width double").withColumn("page", F.col("number"))
    fonts = spark.createDataFrame([(1, 1, 0, 12, 'A"B', "#fff")], "doc long, page int, id int, size int, family string, color string")
    images = spark.createDataFrame([(1, 1, 3, 1.0, 2.0, 3.0, 4.0, None)], "doc long, page int, id int, x double, y double, width double, height double, src string")
    strings = spark.createDataFrame([(1, 1, 1, 5.0, 9.0, 3.0, 4.0, 0, "b<c", True, True, None), (1, 1, 0, 7.0, 1.5, 3.0, 4.0, 0, "first", None, None, "u&v"), (1, 1, 2, 0.0, 0.0, 1.0, 1.0, 0, None, None, None, None), (9, 9, 0, 0.0, 0.0, 1.0, 1.0, 0, "lost", None, None, None)], "doc long, page int, id int, x double, y double, width double, height double, font int, text string, bold boolean, italic boolean, href string")
    got = dict(((r.doc, r.page), r.xml) for r in reports.xml_pages(pages, fonts, images, strings, ["doc", "page"]).collect())
    assert got == {
        (1, 1): '<page number="1" position="absolute" top="0" left="0" height="11" width="20">\n\t<fontspec id="0" size="12" family="A&quot;B" color="#fff"/>\n<image top="2" left="1" width="3" height="4" src=""/>\n'
        '<text top="2" left="7" width="3" height="4" font="0"><a href="u&amp;v">first</a></text>\n<text top="9" left="5" width="3" height="4" font="0"><b><i>b&lt;c</i></b></text>\n</page>\n',
        (1, 2): '<page number="2" position="absolute" top="0" left="0" height="5" width="5">\n</page>\n',
    }
    nodes = spark.createDataFrame([(1, 1, None, 0, "a", 4), (1, 2, 1, 0, "b&", None), (1, 3, 2, 0, "c", 1), (1, 4, None, 1, None, 2)], "doc long, node long, parent long, pos int, title string, page int")
    order = trees.tree_order(nodes, "node", "parent", "pos", "doc").join(nodes.select("doc", "node", "title", "page"), ["doc", "node"])
    assert reports.xml_outline(order, "doc").first().xml == '<outline>\n<item page="4">a</item>\n<outline>\n<item>b&amp;</item>\n<outline>\n<item page="1">c</item>\n</outline>\n</outline>\n<item page="2"></item>\n</outline>\n'


def test_pages_by_ranges(spark, tmp_path):
    rows = [(d, p, f"t{d}.{p}") for d in range(40) for p in range(3)]
    files.write_pages(spark.createDataFrame(rows[::-1], "doc_id int, page int, text string"), str(tmp_path / "out"), apart=False)
    parts = sorted((tmp_path / "out").glob("*.txt"))
    assert "".join(p.read_text() for p in parts).split("\n\f\n")[:-1] == [r[2] for r in rows]
