"""Queries over text, numbers, labels, dates and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import maths, numbering, text
from leafwork.operators import ranges
from leafwork.sources.tables import table


def code_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters are counted where texts are read, so a few hundred texts send each of their characters once."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    counted = docs.mapInArrow(text.counted_codes, f"lang {docs.schema['lang'].dataType.simpleString()}, code int, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).select("lang", "code", text.from_code_point(F.col("code")).alias("char"), "n")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("\\p{L}").alias("letters"), count("\\p{N}").alias("numbers"), count("\\p{Lu}").alias("capitals"), count(text.SPACES).alias("spaces"), F.length(F.lower("text")).cast("long").alias("n"))


def ligature_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.replace(F.replace(F.col("text"), F.lit("ffi"), F.lit("ﬃ")), F.lit("ff"), F.lit("ﬀ"))
    rows = table(spark, sf_dir, "documents").select("doc_id", written.alias("written"))
    return rows.select("doc_id", F.length("written").cast("long").alias("short"), F.md5(text.split_ligatures(F.col("written"))).alias("digest"))


def synonym_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.translate("text", " .M", " ∙Μ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.fold_synonyms(odd)).alias("digest"))


def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(text.fold_accents(F.col("text"))).alias("folded"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("digest"), F.length(text.escape_html(F.col("html"))).cast("long").alias("n"))


def encoded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = text.decode_text(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("utf8"), text.utf16_units(F.col("text")).alias("utf16"), (back == F.col("text")).alias("same"))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \\n]")).alias("w"))
    parsed = words.select("doc_id", text.parse_number(F.col("w")).alias("v")).where("v is not null")
    return parsed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = F.concat(F.lit("ABCDEF+"), F.replace("p_name", F.lit(" "), F.lit("-")))
    path = F.concat_ws("/", "p_brand", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.subset_name(font).alias("font"), text.base_name(path).alias("base"), text.safe_name(F.col("p_brand")).alias("safe"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.format_string("%08.2f", "p_retailprice").alias("price"))


def distinguished_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # a fixed table of 25 rows
    dn = F.concat(F.lit("cn="), "c_name", F.lit(", ou = A\\,B, o="), "n_name", F.lit(",c="), F.col("n_regionkey").cast("string"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.parse_dn(dn).alias("dn"))
    return rows.select("c_custkey", F.size("dn").alias("parts"), *[text.first_value(F.col("dn"), k).alias(k.lower()) for k in ("CN", "OU", "O", "C")])


def number_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 3999 + 1).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", numbering.to_roman(n).alias("roman"), numbering.to_letters(n % 200 + 1).alias("letters"))
    return rows.select("*", numbering.from_roman(F.lower("roman")).alias("of_roman"), numbering.from_letters(F.col("letters")).cast("int").alias("of_letters"))


def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ranges of growing length, by part size."""
    sizes = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("length"))
    style = F.element_at(F.array(*map(F.lit, "DrRaA")), (F.col("p_size") % 5 + 1).cast("int"))
    return ranges.running_ranges(sizes, "p_size", "length").select("base", "length", style.alias("style"), F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("-")).alias("prefix"), F.lit(1).alias("first"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of customers as pages."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    found = ranges.in_ranges(pages, label_spans(spark, sf_dir), "page", "base", "length")
    n = (F.col("page") - F.col("base") + F.col("first")).cast("int")
    return found.select("page", numbering.label(F.col("style"), n, F.col("prefix")).alias("label"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = ((F.col("o_orderkey") % 5 - 2) * 90).cast("int")
    written = numbering.format_date(F.col("o_orderdate"), minutes)
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"), F.date_format(numbering.parse_date(written), "yyyy-MM-dd HH:mm:ss").alias("utc"), F.date_format(numbering.parse_date(F.substring(written, 3, 6)), "yyyy-MM-dd").alias("month"))


def functions_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount") * 10
    half = maths.stitched(x, [0.5], [lambda v: maths.exponential(v, 0.0, 10.0, 2.0), lambda v: maths.exponential(v, 10.0, 0.0, 1.0)], [(0, 1), (0, 1)], (0, 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.round(half, 6).alias("stitched"), F.round(maths.sampled(x, [0.0, 4.0, 1.0, 9.0]), 6).alias("sampled"))


CALCULATION = "2 copy add 3 1 roll exch sub abs 7 mod dup 3 gt {2 mul} {neg} ifelse exch 10 div floor"


def calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    out = maths.calculator(CALCULATION, a, b)
    bits = maths.calculator("dup 12 and exch 2 bitshift xor", a)
    angle = maths.calculator("atan", a.cast("double"), b.cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", out[0].cast("long").alias("folded"), out[1].alias("tens"), bits[0].alias("bits"), F.round(angle[0], 6).alias("angle"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda m, d: (F.col("l_orderkey") * m + F.col("l_partkey")) % d
    a = maths.rect(q(1, 100), q(3, 90), q(7, 100), q(11, 90))
    b = maths.rect(q(13, 100), q(17, 90), q(19, 100), q(23, 90))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", a.alias("a"), b.alias("b"))
    turned = maths.rotate(F.col("a"), F.col("l_partkey") % 4, F.lit(100), F.lit(90))
    return rows.groupBy((F.col("l_partkey") % 100).alias("k")).agg(
        F.count_if(maths.overlaps(F.col("a"), F.col("b"))).alias("hits"), F.count_if(maths.contains(F.col("a"), F.lit(50), F.lit(45))).alias("inside"),
        F.sum(maths.area(maths.clip(F.col("a"), F.col("b")))).alias("clipped"), F.sum(turned["x1"] * 3 + turned["y2"]).alias("turned"), F.min("a.x1").alias("x1"), F.max("a.x2").alias("x2"),
    )


def arrays_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    more = F.map_concat(info, F.create_map(F.lit("name"), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.element_at(more, "title"), F.element_at(more, "name")).alias("title"), F.size(more).alias("keys"), F.size(F.map_filter(more, lambda k, v: F.length(v) > 6)).alias("long_values"), F.map_contains_key(more, "brand").alias("has_brand"), F.element_at(F.array_append(F.split("p_name", " "), F.col("p_type")), -1).alias("last"))


def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") * F.col("c_custkey") * 977
    return table(spark, sf_dir, "customer").select("c_custkey", maths.size_text(n).alias("size"))


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i: F.getbit(F.col("o_orderkey"), F.lit(i)) == 1
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(bit(2)).alias("print"), F.count_if(bit(3)).alias("change"), F.count_if(bit(4)).alias("copy"), F.count_if(bit(5)).alias("notes"))


QUERIES = {
    "text_code_point_counts": code_point_counts,
    "text_class_counts": class_counts,
    "text_ligature_round_trip": ligature_round_trip,
    "text_synonym_fold": synonym_fold,
    "text_accent_fold": accent_fold,
    "text_html_escape": html_escape,
    "text_encoded_lengths": encoded_lengths,
    "text_number_parse": number_parse,
    "text_names": names,
    "text_distinguished_names": distinguished_names,
    "number_styles": number_styles,
    "number_page_labels": page_labels,
    "date_round_trip": dates,
    "math_functions_of_one": functions_of_one,
    "math_calculation": calculation,
    "math_rectangles": rectangles,
    "math_arrays_and_maps": arrays_and_maps,
    "math_byte_sizes": byte_sizes,
    "math_permissions": permissions,
}

DIGIT_SQL = "[" + ", ".join(f"'{x}'" for x in ("", "{a}", "{a}{a}", "{a}{a}{a}", "{a}{b}", "{b}", "{b}{a}", "{b}{a}{a}", "{b}{a}{a}{a}", "{a}{c}")) + "][n // {p} % 10 + 1]"
ROMAN_SQL = " || ".join(DIGIT_SQL.format(a=a, b=b or a, c=c or a, p=p) for p, a, b, c in numbering.PLACES)
LETTERS_SQL = "repeat(chr((97 + ({n} - 1) % 26)::int), (({n} - 1) // 26 + 1)::int)"


def fold_sql() -> str:
    table_ = {chr(c): text.unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(text.unicodedata.normalize("NFD", chr(c))) > 1}
    return f"translate(text, '{''.join(table_)}', '{''.join(table_.values())}')"


ORACLE_SQL = {
    "text_code_point_counts": "SELECT lang, unicode(c) AS code, c AS char, count(*)::bigint AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang, c",
    "text_class_counts": "SELECT doc_id, len(regexp_extract_all(text, '\\p{L}'))::bigint AS letters, len(regexp_extract_all(text, '\\p{N}'))::bigint AS numbers, len(regexp_extract_all(text, '\\p{Lu}'))::bigint AS capitals, len(regexp_extract_all(text, '[\\t\\n\\v\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]'))::bigint AS spaces, length(lower(text))::bigint AS n FROM documents",
    "text_ligature_round_trip": "SELECT doc_id, length(replace(replace(text, 'ffi', chr(64259)), 'ff', chr(64256)))::bigint AS short, md5(text) AS digest FROM documents",
    "text_synonym_fold": "SELECT conv_id, turn, md5(replace(replace(text, '.', chr(183)), 'M', 'M')) AS digest FROM conversations",
    "text_accent_fold": f"SELECT conv_id, turn, lower({fold_sql()}) AS folded FROM conversations",
    "text_html_escape": """SELECT page_id, md5(e) AS digest, length(e)::bigint AS n FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(160), '&#160;') AS e FROM pages)""",
    "text_encoded_lengths": "SELECT item_id, strlen(text)::bigint AS utf8, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::bigint AS utf16, true AS same FROM benchmark",
    "text_number_parse": "SELECT doc_id, count(*)::bigint AS n, max(w::double) AS most FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) WHERE regexp_full_match(w, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*') GROUP BY doc_id",
    "text_names": "SELECT p_partkey, replace(p_name, ' ', '-') AS font, p_name AS base, replace(p_brand, '#', '#23') AS safe, lpad(p_size::varchar, 4, '0') AS padded, printf('%08.2f', p_retailprice) AS price FROM part",
    "text_distinguished_names": "SELECT c_custkey, 4 AS parts, c_name AS cn, 'A,B' AS ou, n_name AS o, n_regionkey::varchar AS c FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "number_styles": f"SELECT o_orderkey, {ROMAN_SQL} AS roman, {LETTERS_SQL.format(n='(n % 200 + 1)')} AS letters, n::int AS of_roman, (n % 200 + 1)::int AS of_letters FROM (SELECT o_orderkey, o_orderkey % 3999 + 1 AS n FROM orders)",
    "number_page_labels": f"""WITH sizes AS (SELECT p_size, count(*) AS length FROM part GROUP BY p_size), spans AS (
            SELECT *, sum(length) OVER (ORDER BY p_size) - length AS base FROM sizes
        ), found AS (
            SELECT c_custkey AS page, p_size, (c_custkey - base + 1)::bigint AS n FROM customer JOIN spans ON c_custkey >= base AND c_custkey < base + length
        )
        SELECT page, 's' || p_size || '-' || CASE p_size % 5 WHEN 0 THEN n::varchar WHEN 1 THEN lower({ROMAN_SQL}) WHEN 2 THEN {ROMAN_SQL} WHEN 3 THEN {LETTERS_SQL.format(n='n')} ELSE upper({LETTERS_SQL.format(n='n')}) END AS label FROM found""",
    "date_round_trip": """SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE o_orderkey % 5 WHEN 0 THEN '-03''00''' WHEN 1 THEN '-01''30''' WHEN 2 THEN 'Z' WHEN 3 THEN '+01''30''' ELSE '+03''00''' END AS written,
        strftime(o_orderdate - to_minutes((o_orderkey % 5 - 2) * 90), '%Y-%m-%d %H:%M:%S') AS utc, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders""",
    "math_functions_of_one": """SELECT l_orderkey, l_linenumber, l_discount,
        round(CASE WHEN x < 0.5 THEN 0.0 + pow(least(greatest(x * 2.0, 0), 1), 2.0) * 10 ELSE 10.0 + least(greatest((x - 0.5) * 2.0, 0), 1) * -10 END, 6) AS stitched,
        round(CASE k WHEN 0 THEN 0 + (x * 3 - 0) * 4 WHEN 1 THEN 4 + (x * 3 - 1) * -3 ELSE 1 + (x * 3 - 2) * 8 END, 6) AS sampled
        FROM (SELECT *, least(floor(x * 3), 2) AS k FROM (SELECT l_orderkey, l_linenumber, l_discount, least(greatest(l_discount * 10, 0), 1)::double AS x FROM lineitem))""",
    "math_calculation": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN m > 3 THEN m * 2 ELSE -m END)::bigint AS folded,
        floor((l_partkey + l_suppkey)::double / 10) AS tens, xor(l_partkey & 12, l_partkey << 2)::bigint AS bits, round(degrees(atan2(l_partkey, l_suppkey)), 6) AS angle
        FROM (SELECT *, abs(l_suppkey - l_partkey) % 7 AS m FROM lineitem)""",
    "math_rectangles": """WITH raw AS (
            SELECT l_partkey, (l_orderkey + l_partkey) % 100 AS ax, (l_orderkey * 3 + l_partkey) % 90 AS ay, (l_orderkey * 7 + l_partkey) % 100 AS aX2, (l_orderkey * 11 + l_partkey) % 90 AS aY2,
                   (l_orderkey * 13 + l_partkey) % 100 AS bx, (l_orderkey * 17 + l_partkey) % 90 AS by_, (l_orderkey * 19 + l_partkey) % 100 AS bX2, (l_orderkey * 23 + l_partkey) % 90 AS bY2 FROM lineitem
        ), r AS (
            SELECT l_partkey, least(ax, aX2) AS a1, least(ay, aY2) AS a2, greatest(ax, aX2) AS a3, greatest(ay, aY2) AS a4, least(bx, bX2) AS b1, least(by_, bY2) AS b2, greatest(bx, bX2) AS b3, greatest(by_, bY2) AS b4 FROM raw
        ), t AS (
            SELECT *, CASE l_partkey % 4 WHEN 0 THEN a1 WHEN 1 THEN a2 WHEN 2 THEN 100 - a3 ELSE 90 - a4 END AS t1, CASE l_partkey % 4 WHEN 0 THEN a4 WHEN 1 THEN 100 - a1 WHEN 2 THEN 90 - a2 ELSE a3 END AS t4 FROM r
        )
        SELECT l_partkey % 100 AS k, count(*) FILTER (WHERE a1 <= b3 AND b1 <= a3 AND a2 <= b4 AND b2 <= a4)::bigint AS hits,
               count(*) FILTER (WHERE 50 BETWEEN a1 AND a3 AND 45 BETWEEN a2 AND a4)::bigint AS inside,
               sum((least(greatest(a3, b1), b3) - least(greatest(a1, b1), b3)) * (least(greatest(a4, b2), b4) - least(greatest(a2, b2), b4)))::bigint AS clipped,
               sum(t1 * 3 + t4)::bigint AS turned, min(a1)::bigint AS x1, max(a3)::bigint AS x2 FROM t GROUP BY k""",
    "math_arrays_and_maps": "SELECT p_partkey, p_name AS title, 3 AS keys, ((length(p_brand) > 6)::int + (length(p_type) > 6)::int + (length(p_name) > 6)::int) AS long_values, true AS has_brand, p_type AS last FROM part",
    "math_byte_sizes": "SELECT c_custkey, CASE WHEN n >= 1073741824 THEN printf('%.1fG', ((n * 10 + 536870912) // 1073741824) / 10) WHEN n >= 1048576 THEN printf('%.1fM', ((n * 10 + 524288) // 1048576) / 10) WHEN n >= 1024 THEN printf('%.1fK', ((n * 10 + 512) // 1024) / 10) ELSE n || 'B' END AS size FROM (SELECT c_custkey, c_custkey * c_custkey * 977 AS n FROM customer)",
    "math_permissions": "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey & 4 > 0)::bigint AS print, count(*) FILTER (WHERE o_orderkey & 8 > 0)::bigint AS change, count(*) FILTER (WHERE o_orderkey & 16 > 0)::bigint AS copy, count(*) FILTER (WHERE o_orderkey & 32 > 0)::bigint AS notes FROM orders GROUP BY o_orderstatus",
}
