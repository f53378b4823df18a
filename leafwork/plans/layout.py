"""Queries over the layout of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators import layout
from leafwork.sources.tables import PAGE_LINES, WORDS_SQL, table, word_runs, words_of

#: Width of the grid page, in cells.
PAGE_WIDTH = 100


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(table(spark, sf_dir, "documents"))


def paragraph_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout.cluster_boxes(words(spark, sf_dir), "doc_id", "para")
    return boxes.select("doc_id", "para", "n_lines", "n_words", "alpha_words", "density", layout.body_category().alias("category"))


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_boxes(words(spark, sf_dir), "doc_id")


def on_page(found: DataFrame) -> DataFrame:
    return found.withColumn("baseline", F.col("baseline") % PAGE_LINES)


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout.cluster_boxes(on_page(words(spark, sf_dir)), "doc_id", "page", "para")
    return boxes.select("doc_id", "page", "para", "x1", "y1", "x2", "y2", layout.page_category(PAGE_WIDTH, PAGE_LINES).alias("category"))


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sections(spark, sf_dir).where(~F.col("category").isin("HEADER", "FOOTER")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = page_sections(spark, sf_dir).withColumnRenamed("para", "box_id")
    return layout.reading_order(boxes).select("doc_id", "page", "box_id", F.col("column_no").cast("int").alias("column_no"), "reading_pos")


def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = words(spark, sf_dir).withColumn("word_id", F.col("baseline") * 100 + F.col("pos") % 12).withColumn("font_size", F.lit(1.0))
    # a script's gap rules keep paragraphs two rows apart; words of a line are one cell apart
    return layout.cluster_words(placed)


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(word_runs(table(spark, sf_dir, "documents")))


def grouped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every third word opens a gap as wide as it is itself
    spread = words(spark, sf_dir).withColumn("shift", F.floor(F.col("pos") / 3)).select("doc_id", "baseline", "text", (F.col("x1") + F.col("shift")).alias("x1"), (F.col("x2") + F.col("shift")).alias("x2"))
    return layout.word_groups(spread, "doc_id", gap=1.5)


def nearest_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of one or two characters the nearest longer word within three cells on its line or the next."""
    placed = words(spark, sf_dir).select("doc_id", "page", (F.col("baseline") * 100 + F.col("pos") % 12).cast("long").alias("id"), F.col("x2").alias("x"), F.col("baseline").cast("long").alias("y"), F.length("text").alias("n"))
    pairs = layout.near_pairs(placed.where("n <= 2").drop("n"), placed.where("n > 2").drop("n"), ["doc_id", "page"], 3, 1)
    away = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    best = pairs.groupBy("doc_id", "page", "left_id").agg(F.min(F.struct(away.alias("d"), "right_id")).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return best.select("doc_id", "page", F.col("left_id").alias("script_id"), F.col("b.right_id").alias("target_id"), F.col("b.d").alias("distance"), "candidates")


def attached_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_scripts(spark, sf_dir)
    return layout.attach_scripts(near.select("doc_id", "page", "script_id", "target_id", F.col("distance").cast("double").alias("distance")))


def text_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on every page in the columns 10 to 40 of the lines 5 to 15."""
    inside = words(spark, sf_dir).where("x1 >= 10 and x2 <= 40 and baseline % 50 between 5 and 15")
    return layout.page_text(inside)


QUERIES = {
    "layout_words": words,
    "layout_line_boxes": line_boxes,
    "layout_paragraph_categories": paragraph_categories,
    "layout_page_sections": page_sections,
    "layout_section_counts": section_counts,
    "layout_reading_order": reading,
    "layout_word_clusters": word_clusters,
    "layout_rendered_pages": rendered_pages,
    "layout_word_groups": grouped_words,
    "layout_nearest_scripts": nearest_scripts,
    "layout_attached_scripts": attached_scripts,
    "layout_text_in_box": text_in_box,
}

LINES_SQL = """, lines AS (
    SELECT {keys}, baseline, min(x1) AS x1, max(x2) AS x2, count(*)::bigint AS n_words, sum(x2 - x1)::bigint AS ink,
           count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]'))::bigint AS alpha_words
    FROM words GROUP BY {keys}, baseline
), boxes AS (
    SELECT {keys}, min(x1) AS x1, min(baseline) AS y1, max(x2) AS x2, max(baseline) + 1 AS y2, count(*)::bigint AS n_lines,
           sum(n_words)::bigint AS n_words, sum(alpha_words)::bigint AS alpha_words,
           round(coalesce((sum(ink) FILTER (WHERE n_words > 1))::double / (sum(x2 - x1) FILTER (WHERE n_words > 1))::double, 0.0), 6) AS density
    FROM lines GROUP BY {keys}
), labelled AS (
    SELECT *, CASE WHEN n_lines = 1 OR (n_lines > 1 AND density > 0.7 AND alpha_words::double / n_lines > 5) THEN 'TEXT' ELSE 'DATA' END AS body FROM boxes
)"""
PAGES_SQL = WORDS_SQL.replace("baseline::int AS baseline", f"(baseline % {PAGE_LINES})::int AS baseline") + LINES_SQL.format(keys="doc_id, page, para") + f""", sections AS (
    SELECT doc_id, page, para, x1, y1, x2, y2,
           CASE WHEN x1 >= {layout.RIGHT * PAGE_WIDTH} THEN 'RIGHT_MARGIN' WHEN y1 >= {layout.FOOTER * PAGE_LINES} THEN 'FOOTER'
                WHEN x2 <= {layout.LEFT * PAGE_WIDTH} THEN 'LEFT_MARGIN' WHEN y2 <= {layout.HEADER * PAGE_LINES} THEN 'HEADER' ELSE body END AS category
    FROM labelled
)"""
TEXT_SQL = """, spaced AS (
    SELECT doc_id, page, baseline, x1, CASE WHEN x1 - lag(x2) OVER (PARTITION BY doc_id, page, baseline ORDER BY x1) > 0.1 THEN ' ' ELSE '' END || text AS t FROM {source}
), line_text AS (
    SELECT doc_id, page, baseline, string_agg(t, '' ORDER BY x1) AS t FROM spaced GROUP BY doc_id, page, baseline
)
SELECT doc_id, page, string_agg(t, chr(10) ORDER BY baseline) AS text FROM line_text GROUP BY doc_id, page"""

ORACLE_SQL = {
    "layout_words": WORDS_SQL + "SELECT * FROM words",
    "layout_line_boxes": WORDS_SQL + LINES_SQL.format(keys="doc_id") + "SELECT * FROM lines",
    "layout_paragraph_categories": WORDS_SQL + LINES_SQL.format(keys="doc_id, para") + "SELECT doc_id, para, n_lines, n_words, alpha_words, density, body AS category FROM labelled",
    "layout_page_sections": PAGES_SQL + "SELECT * FROM sections",
    "layout_section_counts": PAGES_SQL + "SELECT category, count(*)::bigint AS n, sum((x2 - x1) * (y2 - y1))::bigint AS area FROM sections WHERE category NOT IN ('HEADER', 'FOOTER') GROUP BY category",
    "layout_reading_order": PAGES_SQL + """, ranked AS (
        SELECT *, CASE category WHEN 'HEADER' THEN 0 WHEN 'LEFT_MARGIN' THEN 1 WHEN 'RIGHT_MARGIN' THEN 2 WHEN 'FOOTER' THEN 4 ELSE 3 END AS r FROM sections
    ), reach AS (
        SELECT *, max(x2) OVER (PARTITION BY doc_id, page, r ORDER BY x1, y1, para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked
    ), columned AS (
        SELECT *, (sum(CASE WHEN before IS NULL OR before < x1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, r ORDER BY x1, y1, para) - 1)::int AS column_no FROM reach
    )
    SELECT doc_id, page, para AS box_id, column_no, (row_number() OVER (PARTITION BY doc_id, page ORDER BY r, column_no, y1, x1, para) - 1)::int AS reading_pos FROM columned""",
    "layout_word_clusters": WORDS_SQL + "SELECT doc_id, page, (baseline * 100 + pos % 12)::bigint AS word_id, (min(baseline * 100 + pos % 12) OVER (PARTITION BY doc_id, page, para))::bigint AS cluster_id FROM words",
    "layout_rendered_pages": WORDS_SQL + TEXT_SQL.format(source="words"),
    "layout_text_in_box": WORDS_SQL + TEXT_SQL.format(source="(SELECT * FROM words WHERE x1 >= 10 AND x2 <= 40 AND baseline % 50 BETWEEN 5 AND 15)"),
    "layout_word_groups": WORDS_SQL + """, spread AS (
        SELECT doc_id, baseline, text, x1 + pos // 3 AS x1, x2 + pos // 3 AS x2 FROM words
    ), gaps AS (
        SELECT *, x1 - lag(x2) OVER (PARTITION BY doc_id, baseline ORDER BY x1) AS gap FROM spread
    ), marked AS (
        SELECT *, (sum(CASE WHEN gap IS NULL OR gap > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, baseline ORDER BY x1) - 1)::bigint AS grp FROM gaps
    )
    SELECT doc_id, baseline, grp, min(x1)::bigint AS x1, max(x2)::bigint AS x2, ltrim(string_agg(CASE WHEN gap > 0.1 THEN ' ' ELSE '' END || text, '' ORDER BY x1)) AS text
    FROM marked GROUP BY doc_id, baseline, grp""",
    "layout_nearest_scripts": WORDS_SQL + """, points AS (
        SELECT doc_id, page, (baseline * 100 + pos % 12)::bigint AS id, x2 AS x, baseline::bigint AS y, length(text) AS n FROM words
    ), pairs AS (
        SELECT l.doc_id, l.page, l.id AS script_id, r.id AS target_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d
        FROM points l JOIN points r ON l.doc_id = r.doc_id AND l.page = r.page AND r.y BETWEEN l.y - 1 AND l.y + 1
        WHERE l.n <= 2 AND r.n > 2 AND abs(l.x - r.x) <= 3
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, page, script_id ORDER BY d, target_id) AS rn,
               count(*) OVER (PARTITION BY doc_id, page, script_id) AS candidates FROM pairs
    )
    SELECT doc_id, page, script_id, target_id, d::bigint AS distance, candidates::bigint AS candidates FROM ranked WHERE rn = 1""",
}
