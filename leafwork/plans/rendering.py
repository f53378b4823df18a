"""Queries over characters, tables, margins, strings and marks of laid-out pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators import layout, rendering
from leafwork.plans.layout import PAGES_SQL, page_sections
from leafwork.sources.tables import TURN_WORDS_SQL, WORDS_SQL, char_runs, table, turns_of, words_of


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(turns_of(table(spark, sf_dir, "conversations")))


def spread(words: DataFrame) -> DataFrame:
    """Every third word opens a gap as wide as its number among them."""
    shift = F.floor(F.col("pos") / 3)
    return words.withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of turns in runs, some doubled as fake bold; lines stand as columns 20 apart in turn."""
    rows = char_runs(turns_of(table(spark, sf_dir, "conversations")))
    rows = rows.withColumn("m0", F.when(F.col("baseline") % 4 == 0, 1.0).when(F.col("baseline") % 4 == 2, -1.0).otherwise(0.05)).withColumn("m2", F.when(F.col("baseline") % 4 == 1, 1.0).when(F.col("baseline") % 4 == 3, -1.0).otherwise(0.0))
    rows = rows.withColumn("rotation", layout.rotation_class(F.col("m0"), -F.col("m2"), F.col("m2"), F.col("m0"))).drop("m0", "m2")
    every = F.filter(F.sequence(F.lit(0), F.size("char_pos") - 1), lambda i: F.col("char_pos")[i] % 7 == 0)
    again = rows.withColumn("copy", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("every", F.when(F.col("copy"), every))
    doubled = lambda name, own, copied: F.when(F.col("copy"), F.transform("every", lambda i: copied(F.col(name)[i]))).otherwise(own).alias(name)
    lists = [doubled("char_pos", F.transform("char_pos", lambda p: p * 2), lambda p: p * 2 + 1), doubled("text", F.col("text"), lambda t: t)]
    lists += [doubled(c, F.col(c), lambda x: x + 0.05) for c in ("x1", "x2")]
    return again.select("doc_id", "page", "baseline", "font_size", "rotation", *lists)


def chars_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.chars_to_words(chars(spark, sf_dir), 60.0, 1e9)
    return found.select("doc_id", "page", F.col("baseline").cast("int").alias("baseline"), F.floor("x1").cast("int").alias("x1"), "text")


def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation, slant, drop caps and empty glyphs of orders read as font matrices."""
    m = [(F.col("o_orderkey") * k % 21 - 10).cast("double") for k in (3, 5, 7, 11)]
    letter = F.char((F.lit(60) + F.col("o_orderkey") % 40).cast("int"))
    size = F.col("o_custkey") % 30
    rows = table(spark, sf_dir, "orders").select(layout.rotation_class(*m).alias("rotation"), layout.is_diagonal(m[0], m[1]).alias("diagonal"), layout.is_drop_cap(letter, size).alias("cap"), (layout.shown(letter, size < 3) == " ").alias("space"))
    return rows.groupBy("rotation").agg(F.count_if("diagonal").alias("diagonal"), F.count_if("cap").alias("caps"), F.count_if("space").alias("spaces"), F.count(F.lit(1)).alias("n"))


def column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = layout.word_groups(spread(turn_words(spark, sf_dir)), "doc_id", gap=1.5)
    return rendering.column_positions(groups, "doc_id").select("doc_id", "baseline", "grp", "col", F.length("text").alias("n"))


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph of a turn as a table. What a line does depends on all before it, so a brute-force test stands for SQL."""
    words = spread(turn_words(spark, sf_dir)).select("doc_id", "page", F.col("para").alias("cluster_id"), "baseline", F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"), "text", F.lit(1.0).alias("font_size"))
    return rendering.rendered_tables(words)


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents by sections, margins in tags, data left out."""
    sections = page_sections(spark, sf_dir)
    placed = layout.reading_order(sections.withColumnRenamed("para", "box_id")).select("doc_id", "page", "box_id", "category", "reading_pos")
    counted = words_of(table(spark, sf_dir, "documents")).groupBy("doc_id", "page", F.col("para").alias("box_id")).agg(F.count(F.lit(1)).cast("string").alias("text"))
    return rendering.tagged(placed.join(counted, ["doc_id", "page", "box_id"]), skip=("DATA",))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical layout of spread words: gaps stay as wide as they are."""
    return rendering.padded_lines(spread(turn_words(spark, sf_dir)), "doc_id")


def boxes_of_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = rendering.text_boxes(turn_words(spark, sf_dir))
    last = F.element_at("chars", -1)
    return boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chars")).alias("chars"), F.sum(last["x2"]).cast("long").alias("right"), F.sum(F.col("chars")[0]["x1"]).cast("long").alias("left"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selection over the columns 10 to 40 of the even lines holds on every page, and the region of each line."""
    inside = turn_words(spark, sf_dir).where("x1 >= 10 and x2 <= 40 and baseline % 2 = 0")
    return layout.word_groups(inside, "doc_id", "page", gap=None).select("doc_id", "page", "baseline", "x1", "x2", "text")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by marks of five and fonts by length; every third mark has a replacement."""
    words = turn_words(spark, sf_dir).select("doc_id", (F.col("baseline") * 100 + F.col("pos") % 12).alias("pos"), F.floor(F.col("baseline") * 12 / 5).cast("int").alias("mcid"), (F.length("text") % 2).alias("font"), "text", "x1", "x2")
    spans = rendering.marked_spans(words, "doc_id")
    actual = spans.where("mcid % 3 = 0").select("doc_id", "mcid", F.lit("(figure)").alias("actual")).distinct()
    return rendering.replaced_spans(spans, actual, "doc_id").select("doc_id", "mcid", F.col("span").cast("int").alias("span"), "font", "x1", "x2", F.md5("text").alias("digest"))


def html_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as strings, every third doubled as a shadow, then merged to paragraphs."""
    strings = layout.word_groups(turn_words(spark, sf_dir), "doc_id", "page", "para", gap=None)
    row = F.col("baseline") + 2 * F.col("para")
    rows = strings.select("doc_id", "page", (F.col("baseline") * 2).alias("id"), "text", F.col("x1").cast("double").alias("x1"), (row * 10.0).alias("y1"), (F.col("x2") * 5.0).alias("x2"), (row * 10.0 + 8).alias("y2"), "baseline")
    shadow = rows.where("baseline % 3 = 0").withColumns({"id": F.col("id") + 1, "x1": F.col("x1") + 0.3, "x2": F.col("x2") + 0.3, "y1": F.col("y1") + 0.2, "y2": F.col("y2") + 0.2})
    kept = rendering.without_shadows(rows.unionByName(shadow).drop("baseline"), "doc_id", "page")
    return rendering.paragraphs(kept, "doc_id", "page").select("doc_id", "page", "run", "y1", "y2", F.md5("text").alias("digest"))


def turned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last words of each document's pages when they are turned by its number, and the largest paragraph."""
    words = turn_words(spark, sf_dir).withColumn("turn", (F.col("doc_id") % 4).cast("int"))
    keys = rendering.rotated_order(F.col("turn"), F.col("baseline"), F.col("x1"), F.col("x2"))
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    sized = words.groupBy("doc_id", "page", "para").agg(F.count(F.lit(1)).alias("n"))
    largest = sized.groupBy("doc_id", "page").agg(F.max(F.struct("n", (-F.col("para")).alias("p"))).alias("m")).select("doc_id", "page", (-F.col("m.p")).alias("largest"))
    ends = words.groupBy("doc_id", "page").agg(F.min_by("text", order).alias("first"), F.max_by("text", order).alias("last"))
    return ends.join(largest, ["doc_id", "page"])


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words clustered by distance, lines out of each other's reach, and the clusters of a page by size."""
    shift = F.floor(F.col("pos") * F.col("pos") / 7)
    placed = turn_words(spark, sf_dir).withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift, "row": F.col("baseline") * 10, "word_id": F.col("baseline") * 100 + F.col("pos") % 12, "font_size": F.lit(1.0)})
    return layout.clusters_by_size(layout.cluster_words(placed))


def two_columns(words: DataFrame) -> DataFrame:
    """Words with paragraphs two by two beside one another."""
    return words.withColumns({"x1": F.col("x1") + F.col("para") % 2 * 1_000_000, "x2": F.col("x2") + F.col("para") % 2 * 1_000_000, "baseline": F.col("line").cast("long") + F.floor(F.col("para") / 2) * 100_000, "content_pos": F.col("para").cast("long") * 10_000_000 + F.col("pos")})


def text_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns, found by where the paragraphs stand, as raw, physical and reading text."""
    words = two_columns(words_of(table(spark, sf_dir, "documents").where("doc_id is not null")))
    modes = ("raw", "physical", "reading")
    return rendering.text_by_modes(words, modes, "para").select("doc_id", "page", *[F.md5(m).alias(m) for m in modes])


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth word of a line is large, and the three after it are scripts, each behind the one before."""
    words = turn_words(spark, sf_dir)
    big = F.col("pos") % 4 == 0
    placed = words.select("doc_id", "page", (F.col("baseline").cast("long") * 100 + F.col("pos") % 12).alias("word_id"), "x1", "x2", (F.col("baseline") * 10 + F.when(big, 0).otherwise(F.col("pos") % 2)).alias("baseline"), F.when(big, 2.0).otherwise(1.0).alias("font_size"))
    return layout.script_chains(placed)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line up to 0.4 off its baseline, aligned in each paragraph, and then merged where they are cut in two."""
    off = (F.col("pos") % 3) * 0.2
    words = turn_words(spark, sf_dir).select("doc_id", "page", F.col("para").alias("cluster_id"), (F.col("baseline").cast("long") * 100 + F.col("pos") % 12).alias("word_id"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"), "text", (F.col("baseline") * 2 + off).alias("baseline"), F.lit(1.0).alias("font_size"))
    words = words.withColumns({"y1": F.col("baseline") - 1.0, "y2": F.col("baseline") + 0.5})
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.struct(F.substring("text", F.lit(1), half).alias("t"), F.col("x1").alias("a"), (F.col("x1") + half).alias("b")), F.struct(F.substring("text", half + 1, F.length("text")).alias("t"), (F.col("x1") + half).alias("a"), F.col("x2").alias("b")))
    moved = layout.align_baselines(words).withColumn("h", F.explode(F.when((F.length("text") > 3), halves).otherwise(F.array(F.struct(F.col("text").alias("t"), F.col("x1").alias("a"), F.col("x2").alias("b"))))))
    cut = moved.select("doc_id", "page", "cluster_id", F.round("baseline", 6).alias("baseline"), F.col("h.a").alias("x1"), F.col("h.b").alias("x2"), F.col("h.t").alias("text"), "font_size")
    return layout.merge_fragments(cut, "doc_id", "page", "cluster_id").select("doc_id", "page", "cluster_id", "baseline", "x1", "x2", F.col("text"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages as boxes of unknown content but for every third one, which is text that no region may cross."""
    lines = turn_words(spark, sf_dir).groupBy("doc_id", "page", F.col("baseline").cast("long").alias("box_id")).agg(F.min("x1").cast("double").alias("x1"), F.max("x2").cast("double").alias("x2"))
    boxes = lines.withColumns({"y1": F.col("box_id") * 10.0, "y2": F.col("box_id") * 10.0 + 5, "category": F.when(F.col("box_id") % 3 == 2, "TEXT").otherwise("UNKNOWN")})
    # every box begins at the left edge, so what lies between two boxes of one region meets its union
    found = layout.data_regions(boxes.withColumn("x1", F.lit(0.0)))
    return found.select("doc_id", "page", "box_id", "x2", "y1", "y2")


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_margins(page_sections(spark, sf_dir).withColumnRenamed("para", "box_id"))


QUERIES = {
    "layout_merged_margins": margins,
    "layout_script_chains": chains, "layout_aligned_fragments": aligned, "layout_data_regions": regions,
    "layout_line_clusters": line_clusters, "layout_text_modes": text_modes,
    "layout_chars_to_words": chars_to_words, "layout_char_classes": char_classes, "layout_column_positions": column_groups, "layout_table_text": table_texts, "layout_tagged_pages": tagged_pages, "layout_padded_lines": padded,
    "layout_character_boxes": boxes_of_characters, "layout_selection": selection, "layout_marked_spans": marks, "layout_html_strings": html_strings, "layout_rotated_order": turned_order,
}

SPREAD_SQL = TURN_WORDS_SQL + ", spread AS (SELECT doc_id, baseline, text, x1 + pos // 3 AS x1, x2 + pos // 3 AS x2 FROM words)"
ORACLE_SQL = {
    "layout_merged_margins": PAGES_SQL + """SELECT doc_id, page, min(para) AS box_id, category, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*)::bigint AS n
        FROM sections GROUP BY doc_id, page, category, CASE WHEN category IN ('HEADER', 'FOOTER', 'LEFT_MARGIN', 'RIGHT_MARGIN') THEN -1 ELSE para END""",
    "layout_script_chains": TURN_WORDS_SQL + """SELECT doc_id, page, baseline * 100::bigint + pos % 12 AS word_id, baseline * 100::bigint + (pos - pos % 4) % 12 AS head_id FROM words""",
    "layout_aligned_fragments": TURN_WORDS_SQL + """SELECT doc_id, page, para AS cluster_id, round((min(baseline * 2 + (pos % 3) * 0.2::double) OVER (PARTITION BY doc_id, page, para, baseline)), 6) AS baseline, x1::double AS x1, x2::double AS x2, text FROM words""",
    "layout_data_regions": TURN_WORDS_SQL + """, boxes AS (
            SELECT doc_id, page, baseline::bigint AS box_id, max(x2)::double AS x2 FROM words GROUP BY doc_id, page, baseline
        ) SELECT doc_id, page, box_id, max(x2) OVER p AS x2, min(box_id * 10.0::double) OVER p AS y1, max(box_id * 10.0::double + 5) OVER p AS y2
          FROM boxes WHERE box_id % 3 <> 2 WINDOW p AS (PARTITION BY doc_id, page, box_id // 3)""",
    "layout_line_clusters": TURN_WORDS_SQL + """, apart AS (
            SELECT doc_id, page, baseline, baseline * 100 + pos % 12 AS word_id, x1 + pos * pos // 7 AS x1, x2 + pos * pos // 7 AS x2 FROM words
        ), steps AS (
            SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY doc_id, page, baseline ORDER BY x1) <= 1 THEN 0 ELSE 1 END AS fresh FROM apart
        ), runs AS (
            SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, baseline ORDER BY x1) AS run FROM steps
        ), sized AS (
            SELECT doc_id, page, min(word_id)::bigint AS cluster_id, count(*)::bigint AS n FROM runs GROUP BY doc_id, page, baseline, run
        ) SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, cluster_id))::int AS size_rank FROM sized""",
    "layout_text_modes": WORDS_SQL + """, lines AS (
            SELECT doc_id, page, para, line, string_agg(text, ' ' ORDER BY pos) AS t FROM words GROUP BY doc_id, page, para, line
        ), beside AS (
            SELECT doc_id, page, para // 2 AS band, line, string_agg(t, ' ' ORDER BY para) AS t FROM lines GROUP BY doc_id, page, para // 2, line
        ), across AS (
            SELECT doc_id, page, md5(string_agg(t, chr(10) ORDER BY band, line)) AS physical FROM beside GROUP BY doc_id, page
        ) SELECT l.doc_id, l.page, md5(string_agg(t, chr(10) ORDER BY para, line)) AS raw, any_value(physical) AS physical, md5(string_agg(t, chr(10) ORDER BY para % 2, para, line)) AS reading
          FROM lines l JOIN across a ON a.doc_id = l.doc_id AND a.page = l.page GROUP BY l.doc_id, l.page""",
    "layout_chars_to_words": TURN_WORDS_SQL + """SELECT doc_id, page, baseline, x1::int AS x1, text[:61 - x1] AS text FROM words WHERE x1 <= 60""",
    "layout_char_classes": """SELECT CASE WHEN abs(a * d) > abs(b * c) THEN CASE WHEN a > 0 OR d < 0 THEN 0 ELSE 2 END ELSE CASE WHEN c > 0 THEN 1 ELSE 3 END END AS rotation,
        count(*) FILTER (WHERE CASE WHEN abs(a) >= abs(b) THEN abs(b) > abs(a) * 0.1::double ELSE abs(a) > abs(b) * 0.1::double END)::bigint AS diagonal,
        count(*) FILTER (WHERE l BETWEEN 65 AND 90 AND s >= 20)::bigint AS caps, count(*) FILTER (WHERE s < 3)::bigint AS spaces, count(*)::bigint AS n
        FROM (SELECT o_orderkey * 3 % 21 - 10 AS a, o_orderkey * 5 % 21 - 10 AS b, o_orderkey * 7 % 21 - 10 AS c, o_orderkey * 11 % 21 - 10 AS d, 60 + o_orderkey % 40 AS l, o_custkey % 30 AS s FROM orders) GROUP BY 1""",
    "layout_column_positions": SPREAD_SQL + """, gaps AS (
            SELECT *, x1 - lag(x2) OVER (PARTITION BY doc_id, baseline ORDER BY x1) AS gap FROM spread
        ), marked AS (
            SELECT *, (sum(CASE WHEN gap IS NULL OR gap > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, baseline ORDER BY x1) - 1)::bigint AS grp FROM gaps
        ), groups AS (
            SELECT doc_id, baseline, grp, min(x1) AS x1, (sum(length(text)) + count(*) - 1)::int AS n FROM marked GROUP BY doc_id, baseline, grp
        )
        SELECT doc_id, baseline, grp, coalesce(sum(n + 1) OVER (PARTITION BY doc_id, baseline ORDER BY x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS col, n FROM groups""",
    "layout_tagged_pages": PAGES_SQL + """, ranked AS (
            SELECT *, CASE category WHEN 'HEADER' THEN 0 WHEN 'LEFT_MARGIN' THEN 1 WHEN 'RIGHT_MARGIN' THEN 2 WHEN 'FOOTER' THEN 4 ELSE 3 END AS r FROM sections
        ), reach AS (
            SELECT *, max(x2) OVER (PARTITION BY doc_id, page, r ORDER BY x1, y1, para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked
        ), columned AS (
            SELECT *, sum(CASE WHEN before IS NULL OR before < x1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, r ORDER BY x1, y1, para) AS column_no FROM reach
        ), counted AS (SELECT doc_id, page, para, count(*)::varchar AS text FROM words GROUP BY doc_id, page, para
        ), tagged AS (
            SELECT c.*, CASE category WHEN 'TEXT' THEN w.text WHEN 'HEADER' THEN '<header>' || w.text || '</header>' WHEN 'FOOTER' THEN '<footer>' || w.text || '</footer>'
                   WHEN 'LEFT_MARGIN' THEN '<left>' || w.text || '</left>' ELSE '<right>' || w.text || '</right>' END AS t FROM columned c JOIN counted w USING (doc_id, page, para) WHERE category <> 'DATA'
        ) SELECT doc_id, page, string_agg(t, chr(10) ORDER BY r, column_no, y1, x1, para) AS text FROM tagged GROUP BY doc_id, page""",
    "layout_padded_lines": SPREAD_SQL + """SELECT doc_id, baseline, string_agg(repeat(' ', gap::int) || text, '' ORDER BY x1) AS text FROM (
            SELECT *, x1 - coalesce(lag(x2) OVER (PARTITION BY doc_id, baseline ORDER BY x1), 0) AS gap FROM spread) GROUP BY doc_id, baseline""",
    "layout_character_boxes": TURN_WORDS_SQL + 'SELECT doc_id, count(*)::bigint AS n, sum(length(text))::bigint AS chars, sum(x2)::bigint AS "right", sum(x1)::bigint AS "left" FROM words GROUP BY doc_id',
    "layout_selection": TURN_WORDS_SQL + """SELECT doc_id, page, baseline, min(x1)::bigint AS x1, max(x2)::bigint AS x2, string_agg(text, ' ' ORDER BY x1) AS text FROM words WHERE x1 >= 10 AND x2 <= 40 AND baseline % 2 = 0 GROUP BY doc_id, page, baseline""",
    "layout_marked_spans": TURN_WORDS_SQL + """, spots AS (
            SELECT doc_id, baseline * 100 + pos % 12 AS pos, (baseline * 12 // 5)::int AS mcid, (length(text) % 2)::int AS font, text, x1, x2 FROM words
        ), steps AS (
            SELECT *, CASE WHEN mcid = lag(mcid) OVER o AND font = lag(font) OVER o THEN 0 ELSE 1 END AS fresh FROM spots WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ), runs AS (
            SELECT *, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::int AS span FROM steps
        ), spans AS (
            SELECT doc_id, mcid, span, font, min(x1)::bigint AS x1, max(x2)::bigint AS x2, string_agg(text, ' ' ORDER BY pos) AS text FROM runs GROUP BY doc_id, mcid, span, font
        )
        SELECT doc_id, mcid, span, font, x1, x2, md5(CASE WHEN mcid % 3 = 0 THEN '(figure)' ELSE text END) AS digest
        FROM (SELECT *, min(span) OVER (PARTITION BY doc_id, mcid) AS least FROM spans) WHERE mcid % 3 <> 0 OR span = least""",
    "layout_html_strings": TURN_WORDS_SQL + """, strings AS (
            SELECT doc_id, page, para, baseline, baseline + 2 * para AS r, string_agg(text, ' ' ORDER BY x1) AS text FROM words GROUP BY doc_id, page, para, baseline
        ), steps AS (
            SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY doc_id, page ORDER BY r) + 1 THEN 0 ELSE 1 END AS fresh FROM strings
        ), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS run FROM steps)
        SELECT doc_id, page, run::bigint AS run, min(r) * 10.0::double AS y1, max(r) * 10.0::double + 8 AS y2, md5(string_agg(text, '<br/>' ORDER BY r)) AS digest FROM runs GROUP BY doc_id, page, run""",
    "layout_rotated_order": TURN_WORDS_SQL + """, turned AS (
            SELECT *, doc_id % 4 AS t, CASE WHEN doc_id % 4 IN (1, 2) THEN -baseline ELSE baseline END AS l, CASE WHEN doc_id % 4 IN (2, 3) THEN -x2 ELSE x1 END AS e FROM words
        ), sized AS (SELECT doc_id, page, para, count(*) AS n FROM words GROUP BY doc_id, page, para)
        SELECT t.doc_id, t.page, first(text ORDER BY l, e) AS first, last(text ORDER BY l, e) AS last, any_value(largest) AS largest
        FROM turned t JOIN (SELECT doc_id, page, arg_max(para, n * 100000 - para) AS largest FROM sized GROUP BY doc_id, page) s ON s.doc_id = t.doc_id AND s.page = t.page GROUP BY t.doc_id, t.page""",
}
