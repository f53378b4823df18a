"""Whole pages as XML, and reports of fixed columns, as texts of one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import escape_html

#: Fixed: heads of the reports.
FONT_HEAD = "name                                 type              encoding         emb sub uni object ID\n------------------------------------ ----------------- ---------------- --- --- --- ---------"
IMAGE_HEAD = "page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio\n--------------------------------------------------------------------------------------------"
URL_HEAD, DEST_HEAD = "Page  Type          URL", "Page  Destination                 Name"


def lines_of(rows: DataFrame, line: Column, order: list[str], doc: str, head: str) -> DataFrame:
    """(doc, report): a head and the lines of each document, by order, ties by line. Null lines are left out."""
    each = rows.select(F.col(doc).alias(doc), F.struct(*order, line.alias("_line")).alias("_l")).where("_l._line is not null")
    said = F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["_line"]), "\n")
    return each.groupBy(doc).agg(F.concat(F.lit(head + "\n"), said, F.lit("\n")).alias("report"))


def object_id(num: str, gen: str) -> Column:
    return F.when(F.col(num).isNull(), " [none]").otherwise(F.format_string(" %6d %2d", F.col(num), F.coalesce(F.col(gen), F.lit(0))))


def yes(flag: str) -> Column:
    return F.rpad(F.when(F.coalesce(F.col(flag), F.lit(False)), "yes").otherwise("no"), 3, " ")


def padded(value: Column, width: int) -> Column:
    """value with spaces behind it up to a width; longer ones stay whole."""
    return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def font_report(fonts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, report) of fonts (doc, place, name, type, encoding, embedded, subset, unicode, num, gen): null names and objects are [none]."""
    said = lambda c: F.coalesce(F.col(c), F.lit("[none]"))
    line = F.concat_ws(" ", padded(said("name"), 36), padded(F.coalesce("type", F.lit("unknown")), 17), padded(F.coalesce("encoding", F.lit("")), 16), yes("embedded"), yes("subset"), yes("unicode"))
    return lines_of(fonts, F.concat(line, object_id("num", "gen")), ["place"], doc, FONT_HEAD)


def url_report(links: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, report) of links (doc, page, pos, uri); links without a URI are left out."""
    line = F.when(F.col("uri").isNotNull(), F.concat(F.lpad(F.col("page").cast("string"), F.greatest(F.length(F.col("page").cast("string")), F.lit(4)), F.lit(" ")), F.lit("  Annotation    "), F.col("uri")))
    return lines_of(links, line, ["page", "pos"], doc, URL_HEAD)


def image_size(size: Column) -> Column:
    """Bytes in five characters: 1234B, then K, M and G, with two, one or no digits behind the point, as many as fit."""
    value, out = size.cast("double"), F.lit(None).cast("string")
    for unit, least in (("G", 1 << 30), ("M", 1 << 20), ("K", 1 << 10)):
        v = value / least
        text = F.when(F.round(v, 2) < 10, F.format_string("%4.2f", v)).when(F.round(v, 1) < 100, F.format_string("%4.1f", v)).otherwise(F.format_string("%4.0f", v))
        out = F.coalesce(out, F.when(size >= (least if least > 1 << 10 else 1024), F.concat(text, F.lit(unit))))
    return F.when(size.isNull(), "   - ").otherwise(F.coalesce(out, F.concat(F.lpad(size.cast("string"), 4, " "), F.lit("B"))))


def image_report(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, report) of images (doc, page, n, type, width, height, color, components, bits, encoding, interpolate, num, gen, x_ppi, y_ppi, size, ratio)."""
    number = lambda c, form: F.format_string(form, F.col(c))
    ppi = lambda c: F.when(F.col(c) >= 1, number(c, "%5.0f ")).otherwise(number(c, "%5.3f "))
    ratio = F.when(F.col("ratio").isNull(), "   - ").when(F.col("ratio") >= 9.95, number("ratio", " %3.0f%%")).otherwise(number("ratio", " %3.1f%%"))
    ref = F.when(F.col("num").isNull(), "[none]     ").otherwise(F.format_string(" %6d %2d ", F.col("num"), F.coalesce("gen", F.lit(0))))
    line = F.concat(number("page", "%4d "), number("n", "%5d "), padded(F.col("type"), 7), number("width", " %5d "), number("height", "%5d  "), padded(F.col("color"), 5), number("components", "  %2d  "), number("bits", "%2d  "), padded(F.col("encoding"), 5), F.lit("  "), yes("interpolate"), F.lit("  "), ref, ppi("x_ppi"), ppi("y_ppi"), image_size(F.col("size")), ratio)
    return lines_of(images, line, ["page", "n"], doc, IMAGE_HEAD)


def xml_pages(pages: DataFrame, fonts: DataFrame, images: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml): a page element for each page, with its fonts, images and strings.

    pages (keys, number, height, width), fonts (keys, id, size, family, color), images (keys, id, x, y, width, height, src),
    strings (keys, id, x, y, width, height, font, text, bold, italic, href); whatever has coordinates rounds them. Elements
    come by id, strings by y, then x, then id. Pages without any of them are empty elements; rows of no page are left out.
    """
    whole = lambda c: F.round(F.col(c)).cast("long").cast("string")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    box = [attribute("top", whole("y")), attribute("left", whole("x")), attribute("width", whole("width")), attribute("height", whole("height"))]
    font = F.concat(F.lit("\t<fontspec"), *[attribute(c, escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in ("id", "size", "family", "color")], F.lit("/>"))
    image = F.concat(F.lit("<image"), *box, attribute("src", escape_html(F.coalesce("src", F.lit("")))), F.lit("/>"))
    inner = escape_html(F.col("text"))
    for flag, tag in (("italic", "i"), ("bold", "b")):
        inner = F.when(F.coalesce(F.col(flag), F.lit(False)), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)
    inner = F.when(F.col("href").isNotNull(), F.concat(F.lit('<a href="'), escape_html(F.col("href")), F.lit('">'), inner, F.lit("</a>"))).otherwise(inner)
    said = F.concat(F.lit("<text"), *box, attribute("font", F.col("font").cast("string")), F.lit(">"), inner, F.lit("</text>"))
    rows = None
    for k, (df, line, order) in enumerate(((fonts, font, [F.lit(0.0), F.lit(0.0), F.col("id")]), (images, image, [F.lit(0.0), F.lit(0.0), F.col("id")]), (strings.where("text is not null"), said, [F.col("y"), F.col("x"), F.col("id")]))):
        order = [o.cast("long" if i == 2 else "double").alias(f"o{i}") for i, o in enumerate(order)]
        some = df.select(*keys, F.struct(F.lit(k).alias("kind"), *order, line.alias("line")).alias("e"))
        rows = some if rows is None else rows.unionByName(some)
    body = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat(e["line"], F.lit("\n"))), "").alias("body"))
    head = F.concat(F.lit("<page"), attribute("number", F.col("number").cast("string")), F.lit(' position="absolute" top="0" left="0"'), attribute("height", whole("height")), attribute("width", whole("width")), F.lit(">\n"))
    return pages.join(body, keys, "left").select(*keys, F.concat(head, F.coalesce("body", F.lit("")), F.lit("</page>\n")).alias("xml"))


def xml_outline(entries: DataFrame, doc: str) -> DataFrame:
    """(doc, xml): the outline of each document from entries (doc, preorder, depth, title, page): an item for each, and nested outlines for what is below it.

    preorder and depth are those of tree_order(); each step down opens an outline, and each step up closes as many.
    """
    order = Window.partitionBy(doc).orderBy("preorder")
    before, after = F.coalesce(F.lag("depth").over(order), F.lit(-1)), F.coalesce(F.lead("depth").over(order), F.lit(-1))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(' page="'), F.col("page").cast("string"), F.lit('"'))).otherwise("")
    item = F.concat(F.lit("<item"), page, F.lit(">"), escape_html(F.coalesce("title", F.lit(""))), F.lit("</item>\n"))
    opened = F.repeat(F.lit("<outline>\n"), F.greatest(F.col("depth") - before, F.lit(0)).cast("int"))
    closed = F.repeat(F.lit("</outline>\n"), F.greatest(F.col("depth") - after, F.lit(0)).cast("int"))
    lines = entries.select(doc, F.struct("preorder", F.concat(opened, item, closed).alias("line")).alias("e"))
    return lines.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "").alias("xml"))
