"""Tables of a folder, and the document model derived from them: words, links, headings, glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a line and lines of a page where plain text is laid out.
LINE_WORDS = 12
PAGE_LINES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, baseline, para, line, words) of plain text: lines are runs of LINE_WORDS words of a paragraph, and baseline numbers a document's lines.

    A document is laid out in its own row, so nothing is shuffled. Null texts have no words.
    """
    body = F.transform(
        F.split("text", "\n"),
        lambda p, k: F.struct(k.alias("para"), F.filter(F.split(p, " "), lambda w: w != "").alias("words")),
    )
    cut = lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p["words"]) - 1) / LINE_WORDS).cast("int")),
        lambda j: F.struct(p["para"].alias("para"), j.alias("line"), F.slice(p["words"], j * LINE_WORDS + 1, F.lit(LINE_WORDS)).alias("words")),
    )
    lines = F.flatten(F.transform(F.filter(body, lambda p: F.size(p["words"]) > 0), cut))
    each = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(lines).alias("baseline", "l"))
    return each.select("doc_id", "baseline", "l.para", "l.line", "l.words")


def page_of(baseline: str) -> Column:
    return F.floor(F.col(baseline) / PAGE_LINES).cast("int").alias("page")


def words_of(docs: DataFrame) -> DataFrame:
    """Plain text laid out on a grid of unit cells: one row for each word, with its box.

    (doc_id, page, para, line, pos, text, x1, x2, baseline, row); row leaves two lines between paragraphs.
    """
    words = lines_of(docs).select("*", F.posexplode("words").alias("i", "text"))
    x1 = (F.length(F.array_join(F.slice("words", F.lit(1), F.col("i")), "")) + F.col("i")).cast("long")
    return words.select(
        "doc_id",
        page_of("baseline"),
        "para",
        "line",
        (F.col("line") * LINE_WORDS + F.col("i")).alias("pos"),
        "text",
        x1.alias("x1"),
        (x1 + F.length("text")).alias("x2"),
        "baseline",
        (F.col("baseline") + 2 * F.col("para")).alias("row"),
    )


def word_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, page, baseline, text, x1, x2): the words of words_of(), a row for each line with lists of texts and places."""
    widths = F.transform("words", lambda w: F.length(w).cast("long"))
    runs = lines_of(docs).select("doc_id", page_of("baseline"), "baseline", F.col("words").alias("text"), widths.alias("width"))
    # a line has LINE_WORDS words at most, so the sums are written out, which is many times faster than a lambda over slices
    steps = [F.when(F.size("width") > j, F.element_at("width", j + 1) + 1).otherwise(0) for j in range(LINE_WORDS - 1)]
    starts = F.array(*[sum(steps[:k], F.lit(0).cast("long")) for k in range(LINE_WORDS)])
    runs = runs.withColumn("x1", F.slice(starts, F.lit(1), F.size("width")))
    return runs.select("doc_id", "page", "baseline", "text", "x1", F.zip_with("x1", "width", lambda a, b: a + b).alias("x2"))


#: The same words for DuckDB, as the beginning of a WITH clause that ends in a table named words.
WORDS_SQL = f"""
    WITH paras AS (
        SELECT doc_id, unnest(generate_series(1, len(p))) - 1 AS para, unnest(p) AS body
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)
    ), tokens AS (
        SELECT doc_id, para, unnest(generate_series(1, len(w))) - 1 AS pos, unnest(w) AS text
        FROM (SELECT doc_id, para, list_filter(string_split(body, ' '), lambda x: x <> '') AS w FROM paras)
    ), placed AS (
        SELECT *, pos // {LINE_WORDS} AS line,
               coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, para, pos // {LINE_WORDS} ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS x1,
               dense_rank() OVER (PARTITION BY doc_id ORDER BY para, pos // {LINE_WORDS}) - 1 AS baseline
        FROM tokens
    ), words AS (
        SELECT doc_id, (baseline // {PAGE_LINES})::int AS page, para::int AS para, line::int AS line, pos::int AS pos, text,
               x1, x1 + length(text) AS x2, baseline::int AS baseline, (baseline + 2 * para)::int AS "row"
        FROM placed
    )
"""


def turns_of(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as documents (doc_id, text)."""
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


#: The words of turns for DuckDB, as WORDS_SQL has those of documents.
TURN_WORDS_SQL = WORDS_SQL.replace("FROM documents WHERE", "FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations) WHERE")


def char_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, page, baseline, font_size, char_pos, text, x1, x2) of the characters of words on the grid, and a space after each word: a row for each line, the last four lists."""
    lines = lines_of(docs).withColumn("joined", F.concat(F.array_join("words", " "), F.lit(" ")))
    at = F.sequence(F.lit(0), F.length("joined") - 1)
    start = F.col("baseline").cast("long") * 100_000
    pos = F.sequence(start, start + F.length("joined") - 1)
    x2 = F.sequence(F.lit(1), F.length("joined"))
    return lines.select("doc_id", page_of("baseline"), F.col("baseline").cast("double").alias("baseline"), F.lit(1.0).alias("font_size"), pos.alias("char_pos"), F.split("joined", "").alias("text"), at.cast("array<double>").alias("x1"), x2.cast("array<double>").alias("x2"))


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, pos, target, kind) of every link, in order; kind by the form of its target."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
    kind = F.when(F.col("target").rlike("^[a-z]+://"), "uri").when(F.col("target").startswith("#"), "named").otherwise("goto")
    return found.select("page_id", "pos", "target", kind.alias("kind"))


def headings_of(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, title) of every heading, in order; the page's title is heading 0 of level 0."""
    level = F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>(.*?)</h"), F.lit(1))
    title = F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>(.*?)</h"), F.lit(2))
    top = F.struct(F.lit("0").alias("level"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    rows = pages.select("page_id", F.posexplode(F.concat(F.array(top), F.arrays_zip(level.alias("level"), title.alias("title")))).alias("pos", "h"))
    return rows.select("page_id", "pos", F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))


def glyphs_of(embeddings: DataFrame) -> DataFrame:
    """(source, unicode, n, bitmap) with bitmaps of 8 x 8 whole numbers: vectors read as glyph images."""
    # in single precision, as the vectors are: a whole number is not missed by what a wider product shows behind it
    bitmap = F.transform("embedding", lambda v: F.floor(v * F.lit(100).cast("float")).cast("int"))
    return embeddings.select((F.col("vec_id") % 7).alias("source"), F.col("label").alias("unicode"), (F.col("vec_id") % 5 + 1).alias("n"), bitmap.alias("bitmap"), "vec_id")


#: The same glyphs for DuckDB, as a subquery.
GLYPHS_SQL = "(SELECT vec_id % 7 AS source, label AS unicode, vec_id % 5 + 1 AS n, list_transform(embedding, lambda v: floor(v * 100::float)::int) AS bitmap, vec_id FROM embeddings)"
