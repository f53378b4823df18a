"""Queries over structure trees, forms, images, attachments, links, fonts and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import maths
from leafwork.functions.text import escape_html
from leafwork.operators import documents
from leafwork.plans.documents import OUTLINE_SQL, fonts, outline
from leafwork.plans.rendering import turn_words
from leafwork.sources.tables import TURN_WORDS_SQL, table


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees: each turn below the one of half its number."""
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("node"), parent.alias("parent"), F.col("role").alias("title"), "text")


def whole(df: DataFrame) -> DataFrame:
    """Nodes numbered through all documents."""
    number = lambda c: F.col("doc_id") * 1000 + F.col(c)
    return df.withColumns({"node": number("node"), "parent": number("parent")})


def struct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.subtree_text(tree(spark, sf_dir).withColumn("order", F.col("node")), "node", "parent", "doc_id", "text", "order")
    return found.select("doc_id", "node", F.md5("text").alias("digest"))


def struct_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third node has a value by one owner, every fourth by one that comes first, every second by one that doesn't count."""
    nodes = whole(tree(spark, sf_dir)).select("node", "parent")
    turn = F.col("node") % 1000
    by = lambda k, owner: nodes.where(turn % k == 0).select("node", F.lit(owner).alias("owner"), F.concat(F.lit(owner), turn.cast("string")).alias("value"))
    stated = by(3, "Layout").unionByName(by(4, "List")).unionByName(by(2, "Other")).where(turn > 2)
    return documents.attributes(nodes, stated, "node", "parent", ["List", "Layout"]).select("node", F.col("effective").alias("value"))


def struct_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roles, each mapped to the one of a third of its number; multiples of 11 go in a circle; 0 to 4 are standard."""
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    roles = table(spark, sf_dir, "part").select(name(F.col("p_partkey")).alias("role"), name(F.when(F.col("p_partkey") % 11 == 0, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 3))).alias("target"))
    standard = spark.range(5).select(name(F.col("id")).alias("type"))
    return documents.resolved_roles(roles, standard)


def outline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of each page as list items with their depth."""
    placed = outline(spark, sf_dir)
    depth = documents.walk_down(placed, "pos", "parent", "page_id", "title").select("page_id", "pos", "depth")
    item = F.concat(F.lit('<li class="d'), F.col("depth").cast("string"), F.lit('">'), escape_html(F.col("title")), F.lit("</li>"))
    rows = placed.join(depth, ["page_id", "pos"]).select("page_id", F.struct("pos", item.alias("t")).alias("s"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("html"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images."""
    width, height, parts = F.col("p_size") * 16 + 3, F.col("p_partkey") % 50 + 1, F.col("p_partkey") % 4 + 1
    found = maths.image_ratios(width, height, parts, F.lit(8), F.col("p_partkey") % 977 + 10, F.col("p_size") + 20, F.lit(36))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.*")


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.col("p_size") / 8.0, (F.col("p_partkey") % 7) / 8.0, (F.col("p_partkey") % 5) / 8.0, F.lit(1.5), F.lit(10.0), F.lit(-4.0)]
    q = [F.col("p_size") / 8.0, F.lit(0.25), F.lit(0.25), F.lit(1.5)]
    at, size = maths.moved(m, F.lit(2.0), F.lit(3.0)), maths.unit_size(m)
    box = lambda k: F.struct((F.col("p_partkey") * k % 50).alias("x1"), (F.col("p_partkey") * k % 40).alias("y1"), (F.col("p_partkey") * k % 50 + 5).alias("x2"), (F.col("p_partkey") * k % 40 + 3).alias("y2"))
    return table(spark, sf_dir, "part").select("p_partkey", at["x"].alias("x"), at["y"].alias("y"), F.round(size["width"], 6).alias("width"), F.round(size["height"], 6).alias("height"), maths.same_matrix(m, q).alias("same"), maths.corner_distance(box(3), box(7)).alias("apart"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as attached files; the user's are detached, and each first one is replaced by a shorter one of its name."""
    files = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("name"), "turn", "role", "text")
    newer = files.where("turn = 0").select("name", "turn", "role", F.substring("text", 1, 20).alias("text"))
    kept = documents.replaced(files, newer, "name").where("role <> 'user' or turn = 0")
    return kept.select("name", F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


def signature_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by their full names; the assistant's are signatures, and have a widget where a link refers to them."""
    nodes = tree(spark, sf_dir)
    names = documents.qualified_names(nodes.select("doc_id", "node", "parent", "title"))
    signed = nodes.where("title = 'assistant'").select("doc_id", "node", F.length("text").cast("long").alias("signed"))
    widgets = nodes.where("node % 4 = 1").select("doc_id", "node", (F.col("node") * 10).alias("widget"))
    return signed.join(names, ["doc_id", "node"]).join(widgets, ["doc_id", "node"], "left")


def link_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside the link boxes of every third line: columns 5 to 30 and 20 to 60."""
    words = turn_words(spark, sf_dir)
    lines = words.where("baseline % 3 = 0").select("doc_id", "baseline").distinct()
    boxes = F.inline(F.array(*[F.struct(F.lit(i).alias("link"), F.lit(a).alias("lx1"), F.lit(b).alias("lx2")) for i, a, b in ((0, 5, 30), (1, 20, 60))]))
    found = documents.inside_links(words.select("doc_id", "baseline", F.col("pos").alias("id"), "x1", "x2"), lines.select("doc_id", "baseline", boxes), ["doc_id", "baseline"])
    return found.groupBy("doc_id", "link").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("left"))


def font_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as characters whose font comes from a cache of suppliers, the first that fits; few keys have none."""
    cache = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 23).alias("font"), F.col("s_suppkey").alias("o"), F.col("s_name").alias("name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("font"))
    return documents.first_match(rows, cache, "font", "o")


def fonts_from_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fonts (tags) that the pages from the tenth on show first."""
    return documents.new_fonts(fonts(spark, sf_dir), 0, 10).withColumn("scan", F.lit(1)).unionByName(documents.new_fonts(fonts(spark, sf_dir), 10, 1 << 30).withColumn("scan", F.lit(2)))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return documents.latest(orders, "o_custkey", "o_orderkey")


def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of two documents under common names; the first document's stand."""
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("page"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.col("s_suppkey").alias("page"))
    return documents.merged_names([a, b], "name")


def content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of what stands on each page: words, and rules under every fourth line."""
    words = turn_words(spark, sf_dir)
    text = words.select("doc_id", "page", "x1", F.col("baseline").alias("y1"), "x2", (F.col("baseline") + 1).alias("y2"))
    rules = words.where("baseline % 4 = 0").select("doc_id", "page", F.lit(-2).cast("long").alias("x1"), (F.col("baseline") + 1).alias("y1"), F.lit(70).cast("long").alias("x2"), (F.col("baseline") + 2).alias("y2"))
    return text.unionByName(rules).groupBy("doc_id", "page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


QUERIES = {
    "struct_text": struct_text, "struct_attributes": struct_attributes, "struct_roles": struct_roles, "sink_outline_html": outline_html, "doc_images": images, "math_matrices": matrices, "doc_attachments": attachments,
    "doc_signature_fields": signature_fields, "doc_link_strings": link_strings, "doc_font_lookup": font_lookup, "doc_new_fonts": fonts_from_cursor, "set_latest_versions": latest_versions, "set_merged_names": merged_names, "page_content_boxes": content_boxes,
}

TREE_SQL = "WITH RECURSIVE tree AS (SELECT conv_id AS doc_id, turn::int AS node, CASE WHEN turn > 0 THEN ((turn - 1) // 2)::int END AS parent, role AS title, text FROM conversations)"
ORACLE_SQL = {
    "struct_text": TREE_SQL + """, below AS (SELECT doc_id, node AS top, node, text FROM tree UNION ALL SELECT b.doc_id, b.top, t.node, t.text FROM below b JOIN tree t ON t.doc_id = b.doc_id AND t.parent = b.node)
        SELECT doc_id, top AS node, md5(string_agg(text, chr(10) ORDER BY node)) AS digest FROM below GROUP BY doc_id, top""",
    "struct_attributes": TREE_SQL + """, own AS (SELECT doc_id, node, parent, CASE WHEN node > 2 AND node % 4 = 0 THEN 'List' || node WHEN node > 2 AND node % 3 = 0 THEN 'Layout' || node END AS value FROM tree),
        up AS (SELECT doc_id, node AS n, value, parent FROM own UNION ALL SELECT u.doc_id, u.n, o.value, o.parent FROM up u JOIN own o ON o.doc_id = u.doc_id AND o.node = u.parent WHERE u.value IS NULL)
        SELECT doc_id * 1000 + n AS node, max(value) AS value FROM up GROUP BY doc_id, n""",
    "struct_roles": """WITH RECURSIVE roles AS (SELECT p_partkey AS r, CASE WHEN p_partkey % 11 = 0 THEN p_partkey ELSE p_partkey // 3 END AS t FROM part WHERE p_partkey > 4),
        way AS (SELECT r, t FROM roles UNION SELECT w.r, x.t FROM way w JOIN roles x ON x.r = w.t WHERE w.t > 4)
        SELECT 'r' || r AS role, 'r' || min(t) FILTER (WHERE t <= 4) AS type FROM way GROUP BY r""",
    "sink_outline_html": OUTLINE_SQL.replace("WITH found", "WITH RECURSIVE found") + """, walk AS (SELECT page_id, pos, 0 AS depth, title FROM outline WHERE parent IS NULL UNION ALL SELECT o.page_id, o.pos, w.depth + 1, o.title FROM walk w JOIN outline o ON o.page_id = w.page_id AND o.parent = w.pos)
        SELECT page_id, string_agg('<li class="d' || depth || '">' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(160), '&#160;') || '</li>', '' ORDER BY pos) AS html FROM walk GROUP BY page_id""",
    "doc_images": """SELECT p_partkey, raw, round(100 * size / raw::double, 1) AS ratio, round(w * 72 / (p_size + 20)::double, 0)::int AS xppi, round(h * 72 / 36::double, 0)::int AS yppi FROM (
        SELECT *, (w * c * h)::bigint AS raw FROM (SELECT p_partkey, p_size, p_size * 16 + 3 AS w, p_partkey % 50 + 1 AS h, p_partkey % 4 + 1 AS c, p_partkey % 977 + 10 AS size FROM part))""",
    "math_matrices": """SELECT p_partkey, a * 2 + c * 3 + 10 AS x, b * 2 + 1.5::double * 3 - 4 AS y, round(sqrt(a * a + b * b), 6) AS width, round(sqrt(c * c + 2.25::double), 6) AS height, b = 0.25 AND c = 0.25 AS same,
        least((x3 - x7) ** 2, (x3 - x7 - 5) ** 2, (x3 - x7 + 5) ** 2)::bigint + least((y3 - y7) ** 2, (y3 - y7 - 3) ** 2, (y3 - y7 + 3) ** 2)::bigint AS apart FROM (
        SELECT p_partkey, p_size / 8.0::double AS a, (p_partkey % 7) / 8.0::double AS b, (p_partkey % 5) / 8.0::double AS c, p_partkey * 3 % 50 AS x3, p_partkey * 7 % 50 AS x7, p_partkey * 3 % 40 AS y3, p_partkey * 7 % 40 AS y7 FROM part)""",
    "doc_attachments": "SELECT conv_id || '-' || turn AS name, strlen(t)::bigint AS size, md5(t) AS digest FROM (SELECT *, CASE WHEN turn = 0 THEN text[:20] ELSE text END AS t FROM conversations) WHERE role <> 'user' OR turn = 0",
    "doc_signature_fields": TREE_SQL + """, named AS (SELECT doc_id, node, title AS name FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.node, n.name || '.' || t.title FROM named n JOIN tree t ON t.doc_id = n.doc_id AND t.parent = n.node)
        SELECT t.doc_id, t.node, length(t.text)::bigint AS signed, n.name, CASE WHEN t.node % 4 = 1 THEN (t.node * 10)::int END AS widget FROM tree t JOIN named n ON n.doc_id = t.doc_id AND n.node = t.node WHERE title = 'assistant'""",
    "doc_link_strings": TURN_WORDS_SQL + """SELECT doc_id, link, count(*)::bigint AS n, sum(x1)::bigint AS "left" FROM (SELECT *, CASE WHEN baseline % 3 <> 0 THEN NULL WHEN x1 >= 5 AND x2 <= 30 THEN 0 WHEN x1 >= 20 AND x2 <= 60 THEN 1 END::int AS link FROM words) GROUP BY doc_id, link""",
    "doc_font_lookup": "SELECT p_partkey, p_partkey % 25 AS font, name FROM part LEFT JOIN (SELECT s_suppkey % 23 AS f, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) ON f = p_partkey % 25",
    "doc_new_fonts": "SELECT font, min(page_id) AS page_id, CASE WHEN min(page_id) < 10 THEN 1 ELSE 2 END::int AS scan FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS font FROM pages) GROUP BY font",
    "set_latest_versions": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
    "set_merged_names": "SELECT name, arg_min(page, o * 1000000000 + page) AS page FROM (SELECT 'k' || (c_custkey % 40) AS name, c_custkey AS page, 0 AS o FROM customer UNION ALL SELECT 'k' || (s_suppkey % 60), s_suppkey, 1 FROM supplier) GROUP BY name",
    "page_content_boxes": TURN_WORDS_SQL + """SELECT doc_id, page, min(CASE WHEN baseline % 4 = 0 THEN -2 ELSE x1 END)::bigint AS x1, min(baseline)::int AS y1, max(CASE WHEN baseline % 4 = 0 THEN greatest(x2, 70) ELSE x2 END)::bigint AS x2, max(baseline + CASE WHEN baseline % 4 = 0 THEN 2 ELSE 1 END)::int AS y2 FROM words GROUP BY doc_id, page""",
}
