"""Queries over links, outlines, destinations, layers, sets, search and event profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.text import base_name, escape_html
from leafwork.operators import documents, layout, search
from leafwork.plans.layout import TEXT_SQL
from leafwork.plans.scalars import fold_sql
from leafwork.sources.tables import WORDS_SQL, headings_of, links_of, table, word_runs, words_of


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(pages(spark, sf_dir))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.outline_tree(headings_of(pages(spark, sf_dir))).select("page_id", "pos", "level", "title", F.col("parent").cast("int").alias("parent"))


def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.walk_down(outline(spark, sf_dir), "pos", "parent", "page_id", "title")


def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tags of each page, in the place of its fonts."""
    found = pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1))).alias("font"))
    return found.groupBy("page_id", "font").agg(F.count(F.lit(1)).alias("uses"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = pages(spark, sf_dir).select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.parse_url("url", F.lit("HOST")).alias("host"), F.contains("html", F.lit("<script")).alias("has_script"), F.octet_length("html").cast("long").alias("bytes"),
    )
    return info.withColumn("report", F.format_string("%-8s %6d bytes", "lang", "bytes"))


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets by name from two sources, those of pages before those of sites; the first to name one wins."""
    named = links(spark, sf_dir).where("kind = 'goto'").groupBy(base_name(F.col("target")).alias("name")).agg(F.min("page_id").alias("page_id"))
    hosts = pages(spark, sf_dir).groupBy(F.regexp_extract("url", "^[a-z]+://([a-z0-9]+)", 1).alias("name")).agg(F.max("page_id").alias("page_id"))
    return documents.first_wins([named, hosts], "name")


def destinations_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = pages(spark, sf_dir).where(F.col("page_id") >= 10).select("page_id", "url")
    return destinations(spark, sf_dir).join(inside, "page_id")


def layer_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i: F.when(F.getbit("o_orderkey", F.lit(6)) == 1, None).otherwise(F.getbit("o_orderkey", F.lit(i)) == 1)
    states = F.array(F.getbit("o_orderkey", F.lit(0)) == 1, F.getbit("o_orderkey", F.lit(1)) == 1, bit(2))
    policy = F.element_at(F.array(*map(F.lit, ("AllOn", "AllOff", "AnyOn", "AnyOff"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    rule = documents.visible_by(["Or", ["And", 0, 1], ["Not", 2]], states)
    return table(spark, sf_dir, "orders").groupBy(policy.alias("policy")).agg(F.count_if(documents.visible(states, policy)).alias("shown"), F.count_if(rule).alias("by_rule"), F.count(F.lit(1)).alias("n"))


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation that every third heading states and the others take from the nearest one above."""
    tree = outline(spark, sf_dir).select((F.col("page_id") * 1000 + F.col("pos")).alias("node"), (F.col("page_id") * 1000 + F.col("parent")).alias("parent"), F.when(F.col("pos") % 3 == 0, F.col("pos") * 90 % 360).alias("rotate"))
    return documents.inherited(tree, "node", "parent", "rotate").select("node", F.col("effective").alias("rotate"))


def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def restored_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.restored(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


def replaced_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("size")).groupBy("name").agg(F.max("size").alias("size"))
    new = old.where("size % 3 = 0").select("name", (F.col("size") * -1).alias("size"))
    return documents.replaced(old, new, "name")


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return documents.concatenated([a, b], "key")


def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation")
    b = a.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, -1).otherwise(F.col("n_regionkey")))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def common_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda r: links(spark, sf_dir).where(F.col("page_id") % 2 == r).select("target")
    return of(0).intersect(of(1))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first page's links reach, pages being linked to those of the next numbers that share a target."""
    ends = links(spark, sf_dir).where("kind = 'goto'").select("target", "page_id").distinct()
    edges = ends.alias("a").join(ends.alias("b"), (F.col("a.target") == F.col("b.target")) & (F.col("b.page_id") > F.col("a.page_id")) & (F.col("b.page_id") <= F.col("a.page_id") + 3))
    edges = edges.select(F.col("a.page_id").alias("src"), F.col("b.page_id").alias("dst")).distinct()
    return documents.reachable(edges, spark.range(4).withColumnRenamed("id", "node"))


def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = None
    for name, needle, flags in SEARCHES:
        rows = search.find_in(docs.select("doc_id", "text"), needle, **flags).select("doc_id", F.lit(name).alias("search"), "hits")
        found = rows if found is None else found.unionByName(rows)
    return found


SEARCHES = [("plain", "the", {}), ("case", "THE", {"ignore_case": True}), ("word", "the", {"whole_words": True}), ("accents", "ete", {"ignore_accents": True, "ignore_case": True}), ("sign", "!!", {})]


def character_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.character_box(words_of(table(spark, sf_dir, "documents")), 50, 199, "doc_id")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = layout.page_text(word_runs(table(spark, sf_dir, "documents")))
    body = F.concat(F.lit('<div id="p'), F.col("page").cast("string"), F.lit('">'), F.replace(escape_html(F.col("text")), F.lit("\n"), F.lit("<br/>")), F.lit("</div>"))
    return text.select("doc_id", "page", F.md5(body).alias("digest"))


def xml_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(table(spark, sf_dir, "documents"))
    line = F.format_string('<text top="%d" left="%d" width="%d">%s</text>', "baseline", "x1", F.col("x2") - F.col("x1"), escape_html(F.col("text")))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(line)).alias("length"))


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.profile(table(spark, sf_dir, "events"), "event_type", "value")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-of and all-of scans by region of supply."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy("s_nationkey").agg(F.bool_or(F.col("s_acctbal") < 0).alias("any_debt"), F.bool_and(F.col("s_acctbal") < 9000).alias("all_small"))


def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events of the greatest value: a top-k report."""
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd pages from 11 on, as a range scan."""
    return documents.page_range(pages(spark, sf_dir), 11, parity=1, page="page_id").select("page_id", F.length("html").cast("long").alias("n"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return by.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "most")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    "doc_links": links, "doc_outline": outline, "doc_outline_paths": outline_paths, "doc_fonts": fonts, "doc_metadata": metadata, "doc_destinations": destinations,
    "doc_destinations_in_range": destinations_in_range, "doc_layer_visibility": layer_visibility, "doc_inheritance": inheritance, "doc_page_range": page_range,
    "set_pending": pending_work, "set_restored": restored_marks, "set_replaced": replaced_attachments, "set_united": united, "set_equality": equality, "set_common": common_targets, "set_closure": closure,
    "search_text": find_text, "search_character_boxes": character_boxes, "sink_html_pages": html_pages, "sink_xml_words": xml_words,
    "event_profile": event_profile, "event_capabilities": capabilities, "event_slowest": slowest, "event_tumbling": tumbling, "event_sessions": sessions,
}

LINKS_SQL = """(SELECT page_id, (i - 1)::int AS pos, target, CASE WHEN regexp_matches(target, '^[a-z]+://') THEN 'uri' WHEN target LIKE '#%' THEN 'named' ELSE 'goto' END AS kind
    FROM (SELECT page_id, unnest(t) AS target, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS t FROM pages)))"""
OUTLINE_SQL = """WITH found AS (
    SELECT page_id, ['0'] || regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h', 1) AS lv, [regexp_extract(html, '<title>(.*?)</title>', 1)] || regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h', 2) AS ti FROM pages
), heads AS (
    SELECT page_id, unnest(range(len(lv)))::int AS pos, unnest(lv)::int AS level, unnest(ti) AS title FROM found
), outline AS (
    SELECT h.page_id, h.pos, h.level, h.title, (SELECT max(p.pos) FROM heads p WHERE p.page_id = h.page_id AND p.pos < h.pos AND p.level < h.level)::int AS parent FROM heads h
)"""
DEST_SQL = f"""(SELECT name, page_id FROM (SELECT name, page_id, row_number() OVER (PARTITION BY name ORDER BY o) AS rn FROM (
        SELECT regexp_extract(target, '([^/]*)$', 1) AS name, min(page_id) AS page_id, 0 AS o FROM {LINKS_SQL} WHERE kind = 'goto' GROUP BY 1
        UNION ALL SELECT regexp_extract(url, '^[a-z]+://([a-z0-9]+)', 1) AS name, max(page_id), 1 FROM pages GROUP BY 1)) WHERE rn = 1)"""


def _search_sql() -> str:
    body = "replace(replace({t}, '-' || chr(10), ''), chr(10), ' ')"
    forms = [
        ("plain", body.format(t="text"), "the"), ("case", body.format(t="lower(text)"), "the"), ("word", None, None),
        ("accents", f"lower({body.format(t=fold_sql())})", "ete"), ("sign", body.format(t="text"), "!!"),
    ]
    parts = []
    for name, text, needle in forms:
        if needle:
            hits = f"((length({text}) - length(replace({text}, '{needle}', ''))) // {len(needle)})"
        else:
            spaced = body.format(t="text")
            hits = f"len(list_filter(regexp_split_to_array({spaced}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w = 'the'))"
        parts.append(f"SELECT doc_id, '{name}' AS search, {hits}::bigint AS hits FROM documents")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0"


ORACLE_SQL = {
    "doc_links": f"SELECT * FROM {LINKS_SQL}",
    "doc_outline": OUTLINE_SQL + "SELECT * FROM outline",
    "doc_outline_paths": OUTLINE_SQL.replace("WITH found", "WITH RECURSIVE found") + ", walk AS (SELECT page_id, pos, 0 AS depth, title AS path FROM outline WHERE parent IS NULL UNION ALL SELECT o.page_id, o.pos, w.depth + 1, w.path || ' / ' || o.title FROM walk w JOIN outline o ON o.page_id = w.page_id AND o.parent = w.pos) SELECT * FROM walk",
    "doc_fonts": "SELECT page_id, font, count(*)::bigint AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS font FROM pages) GROUP BY page_id, font",
    "doc_metadata": """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, lang, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, contains(html, '<script') AS has_script, strlen(html)::bigint AS bytes, printf('%-8s %6d bytes', lang, strlen(html)) AS report
        FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)""",
    "doc_destinations": f"SELECT * FROM {DEST_SQL}",
    "doc_destinations_in_range": f"SELECT page_id, name, url FROM {DEST_SQL} JOIN pages USING (page_id) WHERE page_id >= 10",
    "doc_layer_visibility": """SELECT ['AllOn', 'AllOff', 'AnyOn', 'AnyOff'][p + 1] AS policy,
        count(*) FILTER (WHERE CASE p WHEN 0 THEN a AND b AND c WHEN 1 THEN NOT (a OR b OR c) WHEN 2 THEN a OR b OR c ELSE NOT (a AND b AND c) END)::bigint AS shown,
        count(*) FILTER (WHERE (a AND b) OR NOT c)::bigint AS by_rule, count(*)::bigint AS n
        FROM (SELECT o_custkey % 4 AS p, o_orderkey & 1 > 0 AS a, o_orderkey & 2 > 0 AS b, o_orderkey & 64 > 0 OR o_orderkey & 4 > 0 AS c FROM orders) GROUP BY p""",
    "doc_inheritance": OUTLINE_SQL.replace("WITH found", "WITH RECURSIVE found") + """, up AS (
        SELECT page_id, pos, CASE WHEN pos % 3 = 0 THEN pos * 90 % 360 END AS rotate, parent, 0 AS d FROM outline
        UNION ALL SELECT u.page_id, u.pos, CASE WHEN o.pos % 3 = 0 THEN o.pos * 90 % 360 END, o.parent, d + 1 FROM up u JOIN outline o ON o.page_id = u.page_id AND o.pos = u.parent WHERE u.rotate IS NULL)
        SELECT page_id * 1000 + pos AS node, max(rotate)::int AS rotate FROM up GROUP BY page_id, pos""",
    "doc_page_range": "SELECT page_id, length(html)::bigint AS n FROM pages WHERE page_id >= 11 AND page_id % 2 = 1",
    "set_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "set_restored": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS valid FROM documents",
    "set_replaced": "SELECT name, CASE WHEN size % 3 = 0 THEN -size ELSE size END AS size FROM (SELECT p_name AS name, max(p_partkey) AS size FROM part GROUP BY p_name)",
    "set_united": "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_name FROM supplier",
    "set_equality": "SELECT n_nationkey, n_name, n_regionkey, 'left' AS side FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_nationkey, n_name, -1, 'right' FROM nation WHERE n_nationkey = 3",
    "set_common": f"SELECT target FROM {LINKS_SQL} WHERE page_id % 2 = 0 INTERSECT SELECT target FROM {LINKS_SQL} WHERE page_id % 2 = 1",
    "set_closure": f"""WITH RECURSIVE ends AS (SELECT DISTINCT target, page_id FROM {LINKS_SQL} WHERE kind = 'goto'),
        edges AS (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM ends a JOIN ends b ON a.target = b.target AND b.page_id > a.page_id AND b.page_id <= a.page_id + 3),
        reach AS (SELECT unnest(range(4))::bigint AS node UNION SELECT dst FROM reach JOIN edges ON src = node) SELECT DISTINCT node FROM reach""",
    "search_text": _search_sql(),
    "search_character_boxes": WORDS_SQL + """, counted AS (
        SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY baseline, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS at_ FROM words
    ) SELECT doc_id, min(x1 + greatest(0, 50 - at_))::bigint AS x1, min(baseline) AS y1, max(x2 - greatest(0, at_ + length(text) - 1 - 199))::bigint AS x2, max(baseline) + 1 AS y2
      FROM counted WHERE at_ <= 199 AND at_ + length(text) > 50 GROUP BY doc_id""",
    "sink_xml_words": WORDS_SQL + """SELECT doc_id, count(*)::bigint AS n, sum(length(printf('<text top="%d" left="%d" width="%d">%s</text>', baseline, x1, x2 - x1, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))))::bigint AS length FROM words GROUP BY doc_id""",
    "event_profile": "SELECT event_type, count(*)::bigint AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "event_capabilities": "SELECT s_nationkey, bool_or(s_acctbal < 0) AS any_debt, bool_and(s_acctbal < 9000) AS all_small FROM supplier GROUP BY s_nationkey",
    "event_slowest": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "event_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::bigint AS n, max(value) AS most FROM events GROUP BY ALL",
    "event_sessions": """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM gaps) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::bigint AS n FROM runs GROUP BY user_id, run""",
}
ORACLE_SQL["sink_html_pages"] = "SELECT doc_id, page, md5('<div id=\"p' || page || '\">' || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(160), '&#160;'), chr(10), '<br/>') || '</div>') AS digest FROM (" + WORDS_SQL + TEXT_SQL.format(source="words") + ")"
