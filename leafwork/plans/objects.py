"""Queries over registered formats, ordered trees, objects, changes, visibility programs, font cursors and lines of two directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import text
from leafwork.operators import forest, objects, trees
from leafwork.operators.documents import outline_tree
from leafwork.plans.streams import scratch
from leafwork.sources import registered, reports
from leafwork.sources.tables import GLYPHS_SQL, glyphs_of, headings_of, links_of, table
from leafwork.streaming import streams


def registered_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph files written by a registered format and read again: records, counts and images of each code point."""
    registered.register(spark)
    path = f"{scratch(spark)}/glyphs"
    byte = lambda v: F.lpad(F.hex(v + 128), 2, "0")
    rows = glyphs_of(table(spark, sf_dir, "embeddings")).where("bitmap is not null")
    rows = rows.select(F.lit("").alias("source"), "unicode", F.col("n").cast("long").alias("n"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform("bitmap", byte), "")).alias("bitmap"))
    rows.write.format(registered.NAME).option("suffix", ".glyphs.gz").mode("append").save(path)
    read = spark.read.format(registered.NAME).load(path)
    return read.groupBy("unicode").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("n"), F.min(F.md5(F.hex("bitmap").cast("binary"))).alias("first"), F.max(F.md5(F.hex("bitmap").cast("binary"))).alias("last"), F.sum(F.col("width") * F.col("height")).alias("pixels"))


def registered_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work list of the pages, written and read again in pieces of 4 KB."""
    registered.register(spark)
    path = f"{scratch(spark)}/lists"
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("url").alias("path"), F.md5("html").alias("citation"), F.concat(F.lit("P"), "page_id").alias("accession"), F.lit("2020-01-01").alias("updated"), F.when(F.col("page_id") % 3 > 0, "CC").alias("license"))
    rows.write.format(registered.NAME).option("suffix", ".worklist.tsv").mode("append").save(path)
    read = spark.read.format(registered.NAME).option("pieceBytes", 4096).load(path)
    return read.select("path", "citation", "accession", "license")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of each 400 documents: a chain of 200 below one another, and the others below its first one, longest first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    at = F.col("doc_id") % 400
    parent = F.when(at == 0, None).when(at < 200, F.col("doc_id") - 1).otherwise(F.col("doc_id") - at)
    return docs.select(F.floor(F.col("doc_id") / 400).alias("tree"), F.col("doc_id").alias("node"), parent.alias("parent"), F.when(at < 200, 0).otherwise(-F.col("n_chars")).cast("long").alias("pos"))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_order(page_nodes(spark, sf_dir), "node", "parent", "pos", "tree")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_tree(headings_of(table(spark, sf_dir, "pages")))


def outline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines walked depth first with siblings by title."""
    entries = outline(spark, sf_dir).withColumn("by", F.struct("title", "pos"))
    return trees.tree_order(entries, "pos", "parent", "by", "page_id")


def revised(entries: DataFrame) -> DataFrame:
    """Another version of outlines: every seventh title changed, and every eleventh entry gone with what is below it."""
    return entries.where("pos = 0 or (page_id + pos) % 11 <> 5").withColumn("title", F.when((F.col("page_id") + F.col("pos")) % 7 == 3, F.concat("title", F.lit("!"))).otherwise(F.col("title"))).withColumn("pos", F.col("pos") + 1000).withColumn("parent", F.col("parent") + 1000)


def outline_versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    entries = outline(spark, sf_dir).withColumn("key", F.col("pos"))
    return [entries, revised(entries)]


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_differences(*outline_versions(spark, sf_dir), "pos", "parent", "key", "title", "page_id")


def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = trees.tree_order(outline(spark, sf_dir), "pos", "parent", "pos", "page_id")
    return trees.first_difference(differences(spark, sf_dir), order.select("page_id", F.col("pos"), "preorder"), "pos", "page_id")


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each heading of a page, that refers to its parent and to the object of the same number as the next link, if there is any."""
    entries = outline(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "pos", "parent", "title")
    links = links_of(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "pos", (F.col("pos") * 2).alias("ref"))
    met = entries.join(links, ["doc_id", "pos"], "left")
    field = lambda key, ref, said: F.struct(F.lit(key).alias("key"), F.col(ref).cast("long").alias("ref"), said.alias("text"))
    return met.select("doc_id", F.col("pos").cast("long").alias("num"), F.array(field("Parent", "parent", F.lit(None).cast("string")), field("Dest", "ref", F.lit(None).cast("string")), F.struct(F.lit("Title").alias("key"), F.lit(None).cast("long").alias("ref"), F.col("title").alias("text"))).alias("fields"))


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = objects.united(page_objects(spark, sf_dir))
    of = lambda i, c: F.col("fields")[i][c]
    return moved.select("doc_id", "num", of(0, "ref").alias("parent"), of(1, "ref").alias("dest"), of(2, "text").alias("title"), "old")


def united_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named destinations of all pages as one tree: titles, the first page's entry of each."""
    return objects.first_named(outline(spark, sf_dir).select("title", "page_id", "pos"), "title", "page_id")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes of objects: lines of orders change their part, those that came back delete it."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("num"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("version"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("body"), (F.col("l_returnflag") == "R").alias("deleted"))


#: The version up to which logs are compacted, and the one whose state is asked.
COMPACT, ASKED = 150_000, 400_000


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.state_at(changes(spark, sf_dir), "num", "version", ASKED)


def compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state of a log that is compacted twice, written and read again in between, with a part appended."""
    path = f"{scratch(spark)}/log"
    log = changes(spark, sf_dir)
    first = objects.compacted(log.where(F.col("version") <= 2 * COMPACT), "num", "version", COMPACT)
    objects.append_changes(path, first)
    objects.append_changes(path, log.where(F.col("version") > 2 * COMPACT).withColumn("base", F.lit(0).cast("long")))
    again = objects.compacted(spark.read.parquet(path), "num", "version", 2 * COMPACT)
    return objects.state_of(again, "num", "version", ASKED)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility of orders by their lines: odd orders from the first line on, even ones from the last line back."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") > 25).alias("on"), (F.col("l_returnflag") == "R").alias("turned")))).alias("lines"))
    op = lambda name, n: F.struct(F.lit(name).alias("op"), F.lit(n).alias("arg"))
    layer = lambda i: F.struct(F.lit("Layer").alias("op"), i.cast("int").alias("arg"))
    joined = lambda x: F.when(x["l_linenumber"] % 2 == 0, op("And", 2)).otherwise(op("Or", 2))
    said = lambda x, i: F.when(x["turned"], F.array(layer(i), op("Not", 1))).otherwise(F.array(layer(i)))
    forward = F.flatten(F.transform("lines", lambda x, i: F.when(i == 0, said(x, i)).otherwise(F.concat(said(x, i), F.array(joined(x))))))
    backward = F.concat(F.flatten(F.transform("lines", said)), F.reverse(F.transform(F.expr("slice(lines, 2, size(lines))"), joined)))
    program = F.when(F.col("l_orderkey") % 2 == 1, forward).otherwise(backward)
    return lines.select("l_orderkey", objects.visible_program(program, F.transform("lines", lambda x: x["on"])).alias("visible"))


def fonts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, font): tags as fonts, every 20 pages' ids modulo 20 a document."""
    pages = table(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") % 20).alias("doc"), F.col("page_id").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))).alias("font"))


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts by the page that shows them first, from a scan that stops after half of the pages and goes on."""
    base = scratch(spark)
    rows = fonts_of_pages(spark, sf_dir)
    half = table(spark, sf_dir, "pages").agg(F.percentile_approx("page_id", 0.5).alias("m")).first()["m"]
    for part in (F.col("page") <= half, F.col("page") > half):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        with streams.keyed_state(spark):
            told = streams.font_cursor(streams.read_stream(spark, f"{base}/in", rows.schema))
            keep = lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
            told.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc long, font string, page long, cursor long").option("recursiveFileLookup", "true").parquet(f"{base}/out").select("doc", "font", "page")


#: The least rows right of a split, and the levels, of the tree that is grown as a query.
LEAF, LEVELS = 20, 2


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of a tree of two levels over all glyphs, its nodes numbered from 1, and its leaves' classes."""
    rows = glyphs_of(table(spark, sf_dir, "embeddings"))
    tree = forest.grow_forest(rows, 1, leaf=LEAF, depth=LEVELS, key="vec_id", features="bitmap", label="unicode")[0]
    out, waiting = [], [(1, tree)]
    while waiting:
        n, node = waiting.pop()
        out.append((n, None, None) if node.label is not None else (n, node.feature, node.threshold))
        waiting += [] if node.label is not None else [(2 * n, node.left), (2 * n + 1, node.right)]
    return spark.createDataFrame(out, "node long, feature int, threshold double")


#: Fixed: letters that stand for others where lines of two directions are made.
LATIN, HEBREW = "abcdefghijklmnopqrstuv", "אבגדהוזחטיכלמנסעפצקרשת"


def two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents with words of small letters from a to v in another script, as they are seen."""
    line = F.substring_index(F.substring_index("text", "\n", 1), ". ", 2)
    mixed = F.translate(line, LATIN, HEBREW)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(text.visual_order(mixed)).alias("left"), F.md5(text.visual_order(mixed, right=True)).alias("right"))


def font_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the fonts of every 20th page together, tags standing for fonts."""
    fonts = fonts_of_pages(spark, sf_dir).groupBy(F.col("doc").alias("doc_id"), F.col("font").alias("name")).agg(F.min("page").alias("place"), F.count(F.lit(1)).alias("n"))
    size = F.length("name")
    rows = fonts.withColumns({"type": F.when(size % 2 == 0, "TrueType").otherwise("Type 1C"), "encoding": F.when(size < 3, "WinAnsi").otherwise("Custom"), "embedded": F.col("n") > 3, "subset": size > 2, "unicode": F.col("n") % 2 == 0, "num": F.when(F.col("n") % 5 > 0, F.col("place")), "gen": F.lit(0)})
    return reports.font_report(rows)


def url_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three links of every 20th page together."""
    links = links_of(table(spark, sf_dir, "pages"))
    return reports.url_report(links.select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page"), "pos", F.when(F.col("pos") % 3 > 0, F.col("target")).alias("uri")))


def xml_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages of one string each, with a font for each role, and an image on even turns."""
    turns = table(spark, sf_dir, "conversations")
    keys = ["conv_id", "turn"]
    pages = turns.select(*keys, F.col("turn").alias("number"), F.lit(792.4).alias("height"), F.lit(612).alias("width"))
    fonts = turns.select(*keys, F.lit(0).alias("id"), F.length("role").alias("size"), F.col("role").alias("family"), F.lit("#000000").alias("color"))
    images = turns.where("turn % 2 = 0").select(*keys, F.lit(1).alias("id"), F.lit(10.4).alias("x"), F.lit(20.6).alias("y"), F.lit(5.0).alias("width"), F.lit(6.0).alias("height"), F.concat(F.lit("a&b-"), "turn", F.lit(".png")).alias("src"))
    strings = turns.select(*keys, F.lit(0).alias("id"), F.lit(72.0).alias("x"), (F.col("turn") * 12.25).alias("y"), F.length("text").alias("width"), F.lit(12).alias("height"), F.lit(0).alias("font"), "text", (F.col("turn") % 3 == 0).alias("bold"), (F.col("turn") % 2 == 1).alias("italic"), F.when(F.col("turn") == 1, "x?a=1&b").alias("href"))
    return reports.xml_pages(pages, fonts, images, strings, keys).select(*keys, F.md5("xml").alias("digest"))


def xml_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as XML; SQL counts what they must hold."""
    entries = outline(spark, sf_dir)
    order = trees.tree_order(entries, "pos", "parent", "pos", "page_id").join(entries.select("page_id", "pos", "title"), ["page_id", "pos"])
    xml = reports.xml_outline(order.withColumn("page", F.col("pos")), "page_id")
    count = lambda t: (F.size(F.split("xml", t)) - 1).alias(t.strip("</>"))
    items = F.array_join(F.regexp_extract_all("xml", F.lit('<item page="([0-9]+)">'), F.lit(1)), ",")
    return xml.select("page_id", count("<item"), count("<outline>"), (F.size(F.split("xml", "</outline>")) - 1).alias("closed"), items.alias("pages"))


QUERIES = {
    "sink_font_report": font_reports, "sink_url_report": url_reports, "sink_xml_pages": xml_reports, "sink_xml_outline": xml_outlines,
    "source_registered_glyphs": registered_glyphs, "source_registered_work_list": registered_work_list,
    "page_tree_order": page_order, "outline_tree_order": outline_order, "doc_tree_differences": differences, "doc_first_difference": first_differences,
    "doc_united_objects": united, "doc_united_names": united_names, "doc_state_at": state, "doc_compacted_state": compact_state,
    "doc_visibility_program": programs, "stream_font_cursor": cursor, "text_two_ways": two_ways, "model_forest_splits": grown,
}

HEADINGS_SQL = """
    heads AS (SELECT page_id, list_concat(['0'], regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h', 1)) AS l, list_concat([regexp_extract(html, '<title>(.*?)</title>', 1)], regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h', 2)) AS t FROM pages),
    h AS (SELECT page_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l)::int AS level, unnest(t) AS title FROM heads),
    entries AS (SELECT page_id, pos, title, (SELECT max(b.pos) FROM h b WHERE b.page_id = a.page_id AND b.pos < a.pos AND b.level < a.level) AS parent FROM h a)
"""
#: Walks a table tree (d, n, up, pos) down, keeping the way; then numbers nodes by their ways.
WALK_SQL = """
    walk AS (
        SELECT d, n, up, [(pos, n)] AS way, 0 AS depth FROM tree WHERE up IS NULL
        UNION ALL SELECT t.d, t.n, t.up, list_append(w.way, (t.pos, t.n)), w.depth + 1 FROM walk w JOIN tree t ON t.d = w.d AND t.up = w.n
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY d ORDER BY way) - 1 AS preorder, n NOT IN (SELECT up FROM tree x WHERE x.d = walk.d AND up IS NOT NULL) AS childless FROM walk
    ), placed AS (
        SELECT *, CASE WHEN childless THEN sum(childless::int) OVER (PARTITION BY d ORDER BY preorder) - 1 END AS leaf,
               coalesce(min(nxt) OVER (PARTITION BY d ORDER BY preorder ROWS BETWEEN CURRENT ROW AND CURRENT ROW), 0) AS nxt_
        FROM (SELECT a.*, (SELECT min(b.preorder) FROM numbered b WHERE b.d = a.d AND b.preorder > a.preorder AND b.depth <= a.depth) AS nxt, (SELECT max(b.preorder) FROM numbered b WHERE b.d = a.d) AS most FROM numbered a)
    )
"""
PLACED = "preorder::bigint AS preorder, coalesce(nxt - 1, most)::bigint AS last, depth::bigint AS depth, leaf::bigint AS leaf FROM placed"
GONE = "pos <> 0 AND (page_id + pos) % 11 = 5"
VERSIONS_SQL = f"""
    below AS (
        SELECT page_id, pos, parent, title, 0 AS depth, {GONE} AS gone, false AS lost FROM entries WHERE parent IS NULL
        UNION ALL SELECT e.page_id, e.pos, e.parent, e.title, b.depth + 1, e.pos <> 0 AND (e.page_id + e.pos) % 11 = 5, b.gone OR b.lost FROM below b JOIN entries e ON e.page_id = b.page_id AND e.parent = b.pos
    ), told AS (
        SELECT page_id, depth::bigint AS depth, pos AS left_node, CASE WHEN gone THEN NULL ELSE pos + 1000 END AS right_node, CASE WHEN gone THEN 'left' ELSE 'value' END AS kind
        FROM below WHERE NOT lost AND (gone OR (page_id + pos) % 7 = 3)
    )
"""
STATE_SQL = f"""
    WITH log AS (
        SELECT l_partkey AS num, l_orderkey * 8 + l_linenumber AS version, l_linestatus || l_suppkey AS body, l_returnflag = 'R' AS deleted FROM lineitem
    ), top AS (
        SELECT *, row_number() OVER (PARTITION BY num ORDER BY version DESC) AS rn, sum(deleted::int) OVER (PARTITION BY num) AS generation FROM log WHERE version <= {ASKED}
    ) SELECT num, version, body, generation::bigint AS generation FROM top WHERE rn = 1 AND NOT deleted
"""
# both write code points alike
TURNED = "array_to_string(list_reverse(regexp_extract_all({x}, '{p}')), '')"



def splits_sql() -> str:
    """A level after the other: rows with their node, class weights on both sides of every value, and the best split of each node."""
    out = [
        f"at0 AS MATERIALIZED (SELECT vec_id, unicode AS y, bitmap AS x, 1 AS node FROM {GLYPHS_SQL})",
        "w AS (SELECT y, 1 / sqrt(count(*)) AS w FROM at0 GROUP BY y)",
    ]
    for k in range(LEVELS):
        out += [
            f"cells{k} AS MATERIALIZED (SELECT node, f, v, y, count(*) AS n FROM (SELECT node, y, unnest(generate_series(0, len(x) - 1)) AS f, unnest(x) AS v FROM at{k}) GROUP BY ALL)",
            f"grid{k} AS (SELECT node, f, v, y FROM (SELECT DISTINCT node, f, v FROM cells{k}) JOIN (SELECT DISTINCT node, y FROM cells{k}) USING (node))",
            f"sides{k} AS (SELECT node, f, v, y, sum(coalesce(n, 0)) OVER (PARTITION BY node, f, y ORDER BY v) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY node, f, y) AS t FROM grid{k} LEFT JOIN cells{k} USING (node, f, v, y))",
            f"weighed{k} AS (SELECT node, f, v, l * w AS l, (t - l) * w AS r, t * w AS t, l AS nl, t - l AS nr FROM sides{k} JOIN w USING (y))",
            f"scored{k} AS (SELECT node, f, v, sum(nl) AS nl, sum(nr) AS nr, " + ", ".join(f"sum({c}) * log2(greatest(sum({c}), 1e-300)) - sum(CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END) AS e{c}" for c in "lrt") + f", sum(t) AS all_w FROM weighed{k} GROUP BY node, f, v)",
            f"best{k} AS MATERIALIZED (SELECT node, f, (v + nxt) / 2.0 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round((el + er) / all_w, 9), f, v) AS rn FROM (SELECT *, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt FROM scored{k}) WHERE nl > {LEAF} AND nr >= {LEAF} AND round((el + er) / all_w, 9) < round(et / all_w, 9)) WHERE rn = 1)",
            f"at{k + 1} AS MATERIALIZED (SELECT vec_id, y, x, CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + (x[b.f + 1] > threshold)::int END AS node, b.node IS NULL AS done FROM at{k} a LEFT JOIN best{k} b ON b.node = a.node)",
        ]
    splits = " UNION ALL ".join(f"SELECT node, f, threshold FROM best{k}" for k in range(LEVELS))
    return f"WITH {', '.join(out)}, s AS ({splits}) SELECT node::bigint AS node, f::int AS feature, threshold::double AS threshold FROM s UNION ALL SELECT DISTINCT node::bigint, NULL::int, NULL::double FROM at{LEVELS}"


def escaped(x: str) -> str:
    """x with the entities that escape_html() writes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, chr(160), '&#160;')"


ORACLE_SQL = {
    "sink_font_report": f"""
        WITH f AS (SELECT page_id % 20 AS doc_id, name, min(page_id) AS place, count(*) AS n FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS name FROM pages) GROUP BY ALL),
        l AS (SELECT doc_id, place, printf('%-36s %-17s %-16s %-3s %-3s %-3s', name, CASE WHEN length(name) % 2 = 0 THEN 'TrueType' ELSE 'Type 1C' END, CASE WHEN length(name) < 3 THEN 'WinAnsi' ELSE 'Custom' END,
              CASE WHEN n > 3 THEN 'yes' ELSE 'no' END, CASE WHEN length(name) > 2 THEN 'yes' ELSE 'no' END, CASE WHEN n % 2 = 0 THEN 'yes' ELSE 'no' END) || CASE WHEN n % 5 > 0 THEN printf(' %6d %2d', place, 0) ELSE ' [none]' END AS line FROM f)
        SELECT doc_id, '{reports.FONT_HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY place, line) || chr(10) AS report FROM l GROUP BY doc_id
    """,
    "sink_url_report": f"""
        WITH l AS (SELECT page_id, unnest(t) AS target, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS t FROM pages))
        SELECT page_id % 20 AS doc_id, '{reports.URL_HEAD}' || chr(10) || string_agg(printf('%4d  Annotation    %s', page_id, target), chr(10) ORDER BY page_id, pos) || chr(10) AS report
        FROM l WHERE (pos - 1) % 3 > 0 GROUP BY 1
    """,
    "sink_xml_pages": f"""
        SELECT conv_id, turn, md5('<page number="' || turn || '" position="absolute" top="0" left="0" height="792" width="612">' || chr(10)
            || chr(9) || '<fontspec id="0" size="' || length(role) || '" family="' || role || '" color="#000000"/>' || chr(10)
            || CASE WHEN turn % 2 = 0 THEN '<image top="21" left="10" width="5" height="6" src="a&amp;b-' || turn || '.png"/>' || chr(10) ELSE '' END
            || '<text top="' || round(turn * 12.25)::bigint || '" left="72" width="' || length(text) || '" height="12" font="0">' || CASE WHEN turn = 1 THEN '<a href="x?a=1&amp;b">' ELSE '' END
            || CASE WHEN turn % 3 = 0 THEN '<b>' ELSE '' END || CASE WHEN turn % 2 = 1 THEN '<i>' ELSE '' END || {escaped("text")} || CASE WHEN turn % 2 = 1 THEN '</i>' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '</b>' ELSE '' END
            || CASE WHEN turn = 1 THEN '</a>' ELSE '' END || '</text>' || chr(10) || '</page>' || chr(10)) AS digest FROM conversations
    """,
    "sink_xml_outline": f"""
        WITH {HEADINGS_SQL} SELECT page_id, count(*)::int AS item, count(DISTINCT coalesce(parent, -1))::int AS outline, count(DISTINCT coalesce(parent, -1))::int AS closed, string_agg(pos::varchar, ',' ORDER BY pos) AS pages FROM entries GROUP BY page_id
    """,
    "model_forest_splits": splits_sql(),
    "source_registered_glyphs": """
        WITH g AS (SELECT label AS unicode, (vec_id % 5 + 1) AS n, array_to_string(list_transform(embedding, lambda v: printf('%02X', floor(v * 100::float)::int + 128)), '') AS hex FROM embeddings WHERE embedding IS NOT NULL)
        SELECT unicode, count(*)::bigint AS records, sum(n)::bigint AS n, min(md5(hex)) AS first, max(md5(hex)) AS last, (64 * count(*))::bigint AS pixels FROM g GROUP BY unicode
    """,
    "source_registered_work_list": "SELECT url AS path, md5(html) AS citation, 'P' || page_id AS accession, CASE WHEN page_id % 3 > 0 THEN 'CC' END AS license FROM pages",
    "page_tree_order": f"""
        WITH RECURSIVE tree AS (
            SELECT doc_id // 400 AS d, doc_id AS n, CASE WHEN doc_id % 400 = 0 THEN NULL WHEN doc_id % 400 < 200 THEN doc_id - 1 ELSE doc_id - doc_id % 400 END AS up,
                   CASE WHEN doc_id % 400 < 200 THEN 0 ELSE -n_chars END AS pos FROM documents
        ), {WALK_SQL} SELECT d AS tree, n AS node, up AS parent, {PLACED}
    """,
    "outline_tree_order": f"WITH RECURSIVE {HEADINGS_SQL}, tree AS (SELECT page_id AS d, pos AS n, parent AS up, (title, pos) AS pos FROM entries), {WALK_SQL} SELECT d AS page_id, n AS pos, up AS parent, {PLACED}",
    "doc_tree_differences": f"WITH RECURSIVE {HEADINGS_SQL}, {VERSIONS_SQL} SELECT * FROM told",
    "doc_first_difference": f"WITH RECURSIVE {HEADINGS_SQL}, {VERSIONS_SQL} SELECT page_id, f.depth, f.left_node, f.right_node, f.kind FROM (SELECT page_id, arg_min(told, left_node) AS f FROM told GROUP BY page_id)",
    "doc_united_objects": f"""
        WITH {HEADINGS_SQL}, links AS (
            SELECT page_id, unnest(generate_series(0, len(r) - 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS r FROM pages)
        ), o AS (
            SELECT e.page_id, e.pos, e.title, e.parent, l.pos * 2 AS ref FROM entries e LEFT JOIN links l ON l.page_id = e.page_id AND l.pos = e.pos
        ), starts AS (
            SELECT page_id, sum(n) OVER (ORDER BY page_id) - n AS start FROM (SELECT page_id, max(pos) + 1 AS n FROM o GROUP BY page_id)
        )
        SELECT o.page_id AS doc_id, (o.pos + start)::bigint AS num, (o.parent + start)::bigint AS parent,
               CASE WHEN EXISTS (SELECT 1 FROM o x WHERE x.page_id = o.page_id AND x.pos = o.ref) THEN (o.ref + start)::bigint END AS dest, o.title, o.pos::bigint AS old
        FROM o JOIN starts s ON s.page_id = o.page_id
    """,
    "doc_united_names": f"WITH {HEADINGS_SQL} SELECT title, f[1] AS page_id, f[2]::int AS pos FROM (SELECT title, min([page_id, pos]) AS f FROM entries GROUP BY title)",
    "doc_state_at": STATE_SQL,
    "doc_compacted_state": STATE_SQL,
    "doc_visibility_program": """
        WITH l AS (SELECT l_orderkey, list(((l_quantity > 25) <> (l_returnflag = 'R'), l_linenumber % 2 = 0) ORDER BY l_linenumber, l_quantity > 25, l_returnflag = 'R') AS x FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 1
            THEN list_reduce(x, lambda a, b: (CASE WHEN b[2] THEN a[1] AND b[1] ELSE a[1] OR b[1] END, true))[1]
            ELSE list_reduce(list_reverse(x), lambda a, b: (CASE WHEN a[2] THEN a[1] AND b[1] ELSE a[1] OR b[1] END, b[2]))[1] END AS visible FROM l
    """,
    "stream_font_cursor": "SELECT page_id % 20 AS doc, f AS font, min(page_id) AS page FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS f FROM pages) GROUP BY ALL",
    "text_two_ways": f"""
        WITH l AS (
            SELECT doc_id, translate(array_to_string(string_split(string_split(text, chr(10))[1], '. ')[1:2], '. '), '{LATIN}', '{HEBREW}') AS x FROM documents WHERE text IS NOT NULL
        ) SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(x, '{text.RIGHT_RUN}|[^{text.RTL}]+'), lambda r: CASE WHEN regexp_matches(r, '^[{text.RTL}]') THEN {TURNED.format(x="r", p=text.RIGHT_PARTS)} ELSE r END), '')) AS "left",
                 md5({TURNED.format(x="x", p=text.RIGHT_LINE)}) AS "right" FROM l
    """,
}
