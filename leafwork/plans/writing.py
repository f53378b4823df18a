"""Queries over character codes, names, labels and places of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import numbering, text
from leafwork.operators import ranges, search
from leafwork.plans import scalars
from leafwork.sources.tables import table


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role stands for what case is kept in: ß is put before each text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.upper_each(F.concat(F.lit("ß"), F.col("text")))).alias("digest"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "benchmark").select("item_id", text.base64_of(raw).alias("coded"), (F.decode(F.unbase64(text.base64_of(raw)), "UTF-8") == F.col("text")).alias("same"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each turn in three encodings; arrows have none in the single-byte one."""
    said = F.concat(F.col("text"), F.lit(" \u2192"))
    latin = text.in_latin(said)
    size = lambda c, code: F.octet_length(F.encode(c, code)).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", size(said, "UTF-8").alias("utf8"), size(said, "UTF-16LE").alias("utf16"), size(latin, "ISO-8859-1").alias("latin"), F.md5(latin).alias("digest"))


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each e gets an acute accent after it, and takes it up."""
    accented = F.replace("text", F.lit("e"), F.lit("e\u00b4"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.combine_accents(accented)).alias("digest"))


def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 60_000
    hexed = F.lpad(F.hex(n), 4, "0")
    names = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("uni"), hexed, F.lit(".alt"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("u1"), hexed)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("g"), n.cast("string"))).otherwise("emdash")
    font = F.concat(F.lit("ABCDEF+"), F.replace("p_name", F.lit(" "), F.lit("")), F.when(F.col("p_size") % 2 == 0, "-Bold").otherwise(",Italic"))
    return table(spark, sf_dir, "part").select("p_partkey", text.glyph_code(names).alias("code"), text.family_name(font).alias("family"))


def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("A", "X", "VT", "UA", "E"))), (F.col("p_size") % 5 + 1).cast("int"))
    name = F.when(F.col("p_size") % 7 == 0, "none").otherwise(F.concat(F.lit("PDF/"), kind, F.lit("-"), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "B").otherwise("")))
    found = table(spark, sf_dir, "part").select("p_partkey", text.conformance(name).alias("c"))
    return found.groupBy("c.subtype", "c.part", "c.level").agg(F.count(F.lit(1)).alias("n"))


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are taken get a number: the first part of a name keeps it."""
    ranked = ranges.ranked(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], ["p_partkey"], F.floor(F.col("p_partkey") / 4096))
    return ranked.select("p_partkey", F.when(F.col("rank") == 1, F.col("p_name")).otherwise(F.concat("p_name", (F.col("rank") - 2).cast("string"))).alias("name"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%+05d|%x|%-12s|%.3f|%c", F.col("p_size"), F.col("p_partkey"), F.substring("p_name", 1, 10), "p_retailprice", (F.lit(65) + F.col("p_size") % 26).cast("int")).alias("line"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = ((F.col("o_orderkey") % 5 - 2) * 90).cast("int")
    late = F.concat(F.lit("D:191"), F.date_format("o_orderdate", "yyMMddHHmmss").substr(1, 12))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbering.iso_date(F.col("o_orderdate"), minutes).alias("iso"), F.date_format(numbering.parse_date(late), "yyyy-MM-dd HH:mm:ss").alias("late"))


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of number_page_labels back to pages; labels of another book have none."""
    spans = scalars.label_spans(spark, sf_dir)
    labels = scalars.page_labels(spark, sf_dir).select("label").distinct()
    found = ranges.label_index(labels.unionByName(labels.select(F.concat(F.lit("x"), "label").alias("label"))), spans)
    return found.where("index is not null").select("label", F.explode("pages").alias("index"))


def search_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where needles stand in each turn, forward and backward, from the 100th character on, or across lines."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", " ", "\n").alias("broken"), "text")
    found = F.array(
        *[F.struct(F.lit(name).alias("search"), p.alias("at")) for name, p in (
            ("plain", search.places(F.col("text"), "an")), ("case", search.places(F.col("text"), "LE", ignore_case=True)), ("last", search.places(F.col("text"), "en", backward=True)),
            ("range", search.places(F.col("text"), "re", start=100, stop=300)), ("lines", search.places(F.col("broken"), "e d")),
        )]
    )
    each = turns.select("conv_id", "turn", F.inline(found)).where(F.size("at") > 0)
    return each.select("conv_id", "turn", "search", F.size("at").alias("n"), F.col("at")[0]["first"].alias("first"), F.element_at("at", -1)["last"].alias("last"), F.col("at")[0]["line"].alias("line"))


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as codes of four fonts, each mapped by ranges of 60 in every 100 codes."""
    font = lambda c: (F.col(c) % 4).cast("int").alias("font")
    chars = table(spark, sf_dir, "lineitem").select(font("l_suppkey"), F.col("l_partkey").alias("code"))
    maps = table(spark, sf_dir, "supplier").select(font("s_suppkey"), (F.floor(F.col("s_suppkey") / 4) * 100).alias("base"), F.lit(60).alias("length"), (F.col("s_suppkey") * 7 + 200).alias("target"))
    return ranges.mapped_codes(chars, maps).groupBy("font", "unicode").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "text_code_map": code_map,
    "text_upper": upper, "text_base64": coded, "text_encodings": encodings, "text_composed": composed, "text_glyph_names": glyph_names, "text_conformance": conformance,
    "text_free_names": free_names, "text_formats": formats, "date_iso": iso_dates, "number_label_index": label_index, "search_places": search_places,
}


def _places_sql() -> str:
    """Gaps between the places, as DuckDB splits at them: the first place is behind the first gap."""
    forms = [("plain", "text", "an"), ("case", "lower(text)", "le"), ("last", "text", "en"), ("lines", "text", "e d")]
    parts = []
    for name, body, needle in forms:
        k = len(needle)
        first, last = "length(g[1])", f"length(b) - length(g[-1]) - {k}"
        at = f"{last}" if name == "last" else first
        end = f"length(g[1]) + {k - 1}" if name == "last" else f"length(b) - length(g[-1]) - 1"
        newline = "b[:{at}]".format(at=at)
        line = f"length({newline}) - length(replace({newline}, ' ', ''))" if name == "lines" else "0"
        line = f"length({newline}) - length(replace(replace({newline}, chr(10), ''), ' ', ''))" if name == "lines" else f"length({newline}) - length(replace({newline}, chr(10), ''))"
        parts.append(f"SELECT conv_id, turn, '{name}' AS search, (len(g) - 1)::int AS n, ({at})::int AS first, ({end})::int AS last, ({line})::int AS line FROM (SELECT *, string_split({'b2' if name == 'lines' else 'b'}, '{needle}') AS g FROM (SELECT conv_id, turn, {body} AS b, replace({body}, chr(10), ' ') AS b2 FROM conversations)) WHERE len(g) > 1")
    parts.append("""SELECT conv_id, turn, 'range' AS search, len(p)::int AS n, p[1]::int AS first, (p[-1] + 1)::int AS last, (length(text[:p[1]]) - length(replace(text[:p[1]], chr(10), '')))::int AS line FROM (
        SELECT conv_id, turn, text, list_filter(list_transform(range(1, len(g)), lambda i: length(array_to_string(g[:i], 're'))), lambda x: x >= 100 AND x < 300) AS p FROM (SELECT *, string_split(text, 're') AS g FROM conversations)) WHERE len(p) > 0""")
    return " UNION ALL ".join(parts)


ORACLE_SQL = {
    "text_code_map": """WITH maps AS (SELECT (s_suppkey % 4)::int AS font, s_suppkey // 4 * 100 AS base, s_suppkey * 7 + 200 AS target FROM supplier),
        chars AS (SELECT (l_suppkey % 4)::int AS font, l_partkey AS code FROM lineitem)
        SELECT c.font, target + code - base AS unicode, count(*)::bigint AS n FROM chars c LEFT JOIN maps m ON m.font = c.font AND code >= base AND code < base + 60 GROUP BY c.font, target + code - base""",
    "text_upper": "SELECT conv_id, turn, md5('ß' || replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß')) AS digest FROM conversations",
    "text_base64": "SELECT item_id, base64(encode(text)) AS coded, true AS same FROM benchmark",
    "text_encodings": "SELECT conv_id, turn, (strlen(text) + 4)::bigint AS utf8, ((length(text) + 2 + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) * 2)::bigint AS utf16, (length(text) + 2)::bigint AS latin, md5(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') || ' ?') AS digest FROM conversations",
    "text_composed": "SELECT conv_id, turn, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS digest FROM conversations",
    "text_glyph_names": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey % 60000 WHEN 1 THEN 65536 + p_partkey % 60000 WHEN 2 THEN p_partkey % 60000 ELSE 8212 END::int AS code, replace(p_name, ' ', '') AS family FROM part""",
    "text_conformance": "SELECT CASE WHEN p_size % 7 <> 0 THEN ['A', 'X', 'VT', 'UA', 'E'][p_size % 5 + 1] END AS subtype, CASE WHEN p_size % 7 <> 0 THEN (p_partkey % 9)::int END AS part, CASE WHEN p_size % 7 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END END AS level, count(*)::bigint AS n FROM part GROUP BY 1, 2, 3",
    "text_free_names": "SELECT p_partkey, CASE rn WHEN 1 THEN p_name ELSE p_name || (rn - 2) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)",
    "text_formats": "SELECT p_partkey, printf('%+05d|%x|%-12s|%.3f|%s', p_size, p_partkey, p_name[:10], p_retailprice, chr((65 + p_size % 26)::int)) AS line FROM part",
    "date_iso": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 5 WHEN 0 THEN '-03:00' WHEN 1 THEN '-01:30' WHEN 2 THEN 'Z' WHEN 3 THEN '+01:30' ELSE '+03:00' END AS iso,
        strftime(make_timestamp(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)), '%Y-%m-%d %H:%M:%S') AS late FROM orders""",
    "number_label_index": "SELECT label, page AS \"index\" FROM (" + scalars.ORACLE_SQL["number_page_labels"] + ")",
    "search_places": _places_sql(),
}
