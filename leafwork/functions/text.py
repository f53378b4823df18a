"""Unicode and string functions, as column expressions; what only Python's tables can say is Arrow-vectorised."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Ligatures and what they stand for.
LIGATURES = {
    0x00C6: "AE", 0x00E6: "ae", 0x0132: "IJ", 0x0133: "ij", 0x0152: "OE", 0x0153: "oe", 0x1D6B: "ue",
    0xA732: "AA", 0xA733: "aa", 0xA734: "AO", 0xA735: "ao", 0xA736: "AU", 0xA737: "au", 0xA738: "AV",
    0xA739: "av", 0xA73C: "AY", 0xA73D: "ay", 0xAB63: "uo", 0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl",
    0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "ft", 0xFB06: "st",
}
#: Look-alike code points and the one that each counts as.
SYNONYMS = {
    0x039C: 0x004D, 0x03BC: 0x00B5, 0x00A0: 0x0020, 0x2003: 0x0020, 0x2009: 0x0020, 0x2010: 0x002D,
    0x2011: 0x002D, 0x2013: 0x002D, 0x2014: 0x002D, 0x2212: 0x002D, 0x204E: 0x002A, 0x2206: 0x0394,
    0x2219: 0x00B7, 0x0424: 0x03A6, 0x03D5: 0x03C6, 0x2126: 0x03A9, 0x037E: 0x003B,
}
#: Accents that take space, and the combining ones.
ACCENTS = {
    0x0060: 0x0300, 0x00A8: 0x0308, 0x00AF: 0x0304, 0x00B4: 0x0301, 0x00B8: 0x0327, 0x02C6: 0x0302,
    0x02C7: 0x030C, 0x02D8: 0x0306, 0x02D9: 0x0307, 0x02DA: 0x030A, 0x02DC: 0x0303, 0x02DD: 0x030B,
}
#: The characters of the document encoding from 0x18 and from 0x80 on; the others are Latin-1.
DOCUMENT_CODES = {0x18: "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc", 0x80: "\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e", 0xA0: "\u20ac"}
#: Fixed: white space beyond what \s knows.
SPACES = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def code_points(text: Column) -> Column:
    """The code points of a string, in order."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def counted_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n): how often the texts of (lang, text) have each code point, in a few hundred texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            key = pc.dictionary_encode(some.column(0), null_encoding="encode")
            of, texts = key.indices.to_numpy(), some.column(1).cast(pa.binary()).to_pylist()
            owners, codes, sizes = [], [], []
            for k in range(len(key.dictionary)):
                whole = b"".join(texts[j] for j in np.flatnonzero(of == k) if texts[j] is not None).decode("utf-8", "replace")
                code, n = np.unique(np.frombuffer(whole.encode("utf-32-le"), np.uint32), return_counts=True)
                owners.append(np.full(len(code), k))
                codes.append(code)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([key.dictionary.take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(codes).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int64))], names=["lang", "code", "n"])


def from_code_point(code: Column) -> Column:
    """The character of a code point; U+FFFD for surrogates and what is out of range."""
    sound = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(code.isNull(), None).otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32"))


def is_space(char: Column) -> Column:
    return char.rlike(f"^{SPACES}$")


def split_ligatures(text: Column) -> Column:
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(chr(one)), F.lit(many))
    return text


def fold_synonyms(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, SYNONYMS)), "".join(map(chr, SYNONYMS.values())))


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks: the decomposition's base letters, by one translate."""
    table = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    return F.translate(text, "".join(table), "".join(table.values()))


def decode_text(raw: Column) -> Column:
    """A byte string by its mark: UTF-16 of either order, UTF-8, or else the document encoding."""
    latin = "".join(chr(at + i) for at, chars in DOCUMENT_CODES.items() for i in range(len(chars)))
    head = F.substring(raw, 1, 2)
    return (
        F.when(head == F.unhex(F.lit("FEFF")), F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE"))
        .when(head == F.unhex(F.lit("FFFE")), F.decode(F.substring(raw, 3, 1 << 30), "UTF-16LE"))
        .when(F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF")), F.decode(F.substring(raw, 4, 1 << 30), "UTF-8"))
        .otherwise(F.translate(F.decode(raw, "ISO-8859-1"), latin, "".join(DOCUMENT_CODES.values())))
    )


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (chr(160), "&#160;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def parse_number(text: Column) -> Column:
    """The number that a string is, whole or not; null otherwise."""
    return F.when(text.rlike("^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*$"), text.try_cast("double"))


def subset_name(font: Column) -> Column:
    """A font name without its subset tag of six capitals."""
    return F.regexp_replace(font, "^[A-Z]{6}\\+", "")


def safe_name(text: Column) -> Column:
    """A name whose special and non-printable characters are written as # and two hex digits."""
    parts = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike("^[()<>\\[\\]{}/%#\\x00-\\x20\\x7F]$"), F.concat(F.lit("#"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.array_join(parts, "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parse_dn(name: Column) -> Column:
    """A distinguished name as an array of (key, value), keys in upper case, with escaped commas kept whole."""
    pattern = F.lit(r"\s*([A-Za-z0-9.]+)\s*=\s*((?:\\.|[^,\\])*)")
    keys, values = F.regexp_extract_all(name, pattern, F.lit(1)), F.regexp_extract_all(name, pattern, F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(F.upper(k).alias("key"), F.trim(F.regexp_replace(v, r"\\(.)", "$1")).alias("value")))


def first_value(dn: Column, key: str) -> Column:
    return F.get(F.filter(dn, lambda x: x["key"] == key), 0)["value"]


def upper_each(text: Column) -> Column:
    """Upper case character by character: what would become two stays."""
    return F.translate(F.upper(F.translate(text, "ß", "\ue000")), "\ue000", "ß")


def in_latin(text: Column) -> Column:
    """text for an output of one byte a character; what that lacks becomes a question mark."""
    return F.regexp_replace(text, "[^\\x00-\\xFF]", "?")


def base64_of(raw: Column) -> Column:
    """Base 64 without line breaks."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


#: Fixed: glyph names of marks, signs and letters that no rule below gives, with their characters in the order of the names.
SIGN_NAMES = """space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash
    zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum
    underscore grave braceleft bar braceright asciitilde exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine
    guillemotleft logicalnot registered macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter
    onehalf threequarters questiondown multiply divide AE ae OE oe Eth eth Thorn thorn germandbls Oslash oslash Lslash lslash Dcroat dcroat Hbar hbar
    Tbar tbar dotlessi kgreenlandic Eng eng longs IJ ij florin circumflex caron breve dotaccent ring ogonek tilde hungarumlaut endash emdash quoteleft
    quoteright quotesinglbase quotedblleft quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand guilsinglleft guilsinglright
    fraction Euro trademark partialdiff product summation minus radical infinity integral approxequal notequal lessequal greaterequal lozenge
    ff fi fl ffi ffl""".split()
SIGNS = " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿×÷ÆæŒœÐðÞþßØøŁłĐđĦħŦŧıĸŊŋſĲĳƒˆˇ˘˙˚˛˜˝–—‘’‚“”„†‡•…‰‹›⁄€™∂∏∑−√∞∫≈≠≤≥◊ﬀﬁﬂﬃﬄ"
#: Fixed: how glyph names call accents.
ACCENT_NAMES = {"ACUTE": "acute", "GRAVE": "grave", "CIRCUMFLEX": "circumflex", "DIAERESIS": "dieresis", "TILDE": "tilde", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "MACRON": "macron", "BREVE": "breve", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut", "TONOS": "tonos", "DIALYTIKA": "dieresis", "DIALYTIKA AND TONOS": "dieresistonos"}
#: Fixed: letters whose cedilla stands apart, as a comma.
COMMA_LETTERS = "GKLNRTgklnrt"


@lru_cache(maxsize=1)
def glyph_names() -> dict[str, str]:
    """The characters of glyph names: signs, Latin letters with accents, and Greek letters, by the names that Unicode gives them."""
    out = dict(zip(SIGN_NAMES, SIGNS, strict=True)) | {c: c for c in string.ascii_letters}
    for code in [*range(0xC0, 0x180), *range(0x386, 0x3CF), *range(0x1E80, 0x1E86), 0x1EF2, 0x1EF3]:
        parts = re.fullmatch(r"(LATIN|GREEK) (CAPITAL|SMALL) LETTER (\w+)(?: WITH (.+))?", unicodedata.name(chr(code), ""))
        if not parts or parts[4] and parts[4] not in ACCENT_NAMES:
            continue
        script, case, letter, accent = parts.groups()
        if script == "LATIN" and (len(letter) > 1 or not accent):
            continue
        letter = letter.replace("LAMDA", "LAMBDA")
        base = (letter.capitalize() if case == "CAPITAL" else letter.lower()) if len(letter) > 1 else letter if case == "CAPITAL" else letter.lower()
        ending = "commaaccent" if accent == "CEDILLA" and base in COMMA_LETTERS else ACCENT_NAMES.get(accent, "")
        out.setdefault(base + ending, chr(code))
    return out


def glyph_code(name: Column) -> Column:
    """The code point that a glyph's name tells: a name of the list, uniXXXX, uXXXX to uXXXXXX, or up to two letters and a decimal number; suffixes after a dot don't count."""
    bare = F.regexp_extract(name, "^([^.]*)", 1)
    from_hex = lambda c: F.conv(c, 16, 10).try_cast("int")
    known = F.element_at(name_map(), bare)
    told = F.when(bare.rlike("^uni[0-9A-F]{4,}$"), from_hex(F.substring(bare, 4, 4))).when(bare.rlike("^u[0-9A-F]{4,6}$"), from_hex(F.substring(bare, 2, 6))).when(bare.rlike("^[A-Za-z]{0,2}[0-9]+$"), F.regexp_extract(bare, "([0-9]+)$", 1).try_cast("int"))
    return F.coalesce(F.when(known.isNotNull(), F.ascii(known)), told)


def name_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in glyph_names().items() for x in pair])


def glyph_text(name: Column) -> Column:
    """The text of a glyph whose name is composed: parts joined by underscores, each a name of the list, uni and groups of four digits, or u and four to six.

    What follows a dot doesn't count. Null if any part has no character, is a surrogate, or lies beyond Unicode; an empty name as well.
    """
    bare = F.regexp_extract(name, "^([^.]*)", 1)
    units = lambda p: F.regexp_extract_all(F.substring(p, F.lit(4), F.length(p)), F.lit("[0-9A-F]{4}"), F.lit(0))
    number = lambda h: F.conv(h, 16, 10).cast("int")
    char = lambda h: F.when(~number(h).between(0xD800, 0xDFFF) & (number(h) <= 0x10FFFF), from_code_point(number(h)))
    many = lambda p: F.aggregate(units(p), F.lit(""), lambda a, h: F.concat(a, char(h)))
    of = lambda p: F.coalesce(F.element_at(name_map(), p), F.when(p.rlike("^uni([0-9A-F]{4})+$"), many(p)).when(p.rlike("^u[0-9A-F]{4,6}$"), char(F.substring(p, F.lit(2), F.length(p)))))
    return F.when(bare != "", F.aggregate(F.split(bare, "_"), F.lit(""), lambda a, p: F.concat(a, of(p))))


def family_name(font: Column) -> Column:
    """A font's name without its subset tag and style."""
    return F.regexp_replace(subset_name(font), "[-,](Bold|Italic|Oblique|Regular|Roman|Light|Medium|BoldItalic|BoldOblique)+$", "")


def conformance(text: Column) -> Column:
    """(subtype, part, level) of names like PDF/A-2b; null where it isn't one."""
    pattern = "^PDF/(A|E|UA|VT|X)-?([0-9]+)([a-zA-Z]*)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("subtype"), part(2).cast("int").alias("part"), F.lower(part(3)).alias("level")))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC form."""
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def combine_accents(text: Column) -> Column:
    """Letters and the accents set after them as one character, where there is one."""
    marks, letters = "".join(map(chr, ACCENTS)), "\\p{L}"
    pairs = F.regexp_replace(text, f"({letters})([{marks}])", "$1\ue001$2")
    for spacing, mark in ACCENTS.items():
        pairs = F.replace(pairs, F.lit("\ue001" + chr(spacing)), F.lit(chr(mark)))
    return composed(pairs)


@F.pandas_udf(ArrayType(IntegerType()))
def compatible_places(text: pd.Series) -> pd.Series:
    """For each character of the NFKC form, where in the text its own part begins; parts are a character and the marks after it."""

    def places(s: str) -> list[int]:
        out, i = [], 0
        while i < len(s):
            j = i + 1
            while j < len(s) and (unicodedata.combining(s[j]) or 0x1160 <= ord(s[j]) <= 0x11FF):
                j += 1
            out += [i] * len(unicodedata.normalize("NFKC", s[i:j]))
            i = j
        return out

    return text.map(places, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC form."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def to_ascii(text: pd.Series) -> pd.Series:
    """Seven-bit form: compatibility decomposition without marks; what has none becomes U+001F."""

    def fold(s: str) -> str:
        parts = (unicodedata.normalize("NFKD", c) for c in s)
        return "".join("".join(x for x in p if not unicodedata.combining(x)) if p.isascii() or unicodedata.normalize("NFKD", p)[0].isascii() else "\x1f" for p in parts)

    return text.map(fold, na_action="ignore")


#: Fixed: right-to-left letters and marks; digits; what stands inside numbers; what stands at their ends.
RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}"
DIGITS = r"0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}"
SEPARATORS, ENDS = r"\.,:/+\-", r"#$%°€£"
NUMBER = rf"[{ENDS}]*[{DIGITS}](?:[{DIGITS}{SEPARATORS}{ENDS}]*[{DIGITS}])?[{ENDS}]*"
#: A character with its marks; of left-to-right letters; whatever is not one of them; and the runs of both directions.
CLUSTER = r"(?s:.)\p{M}*"
LEFT, NOT_LEFT = rf"[^\P{{L}}{RTL}]", rf"[{RTL}\P{{L}}]"
RIGHT_RUN = rf"[{RTL}]\p{{M}}*(?:{NOT_LEFT}*(?:[{RTL}]\p{{M}}*|[{DIGITS}][{ENDS}]*))?"
LEFT_RUN = rf"{LEFT}\p{{M}}*(?:[^{RTL}]*(?:{LEFT}\p{{M}}*|[{DIGITS}][{ENDS}]*))?"

#: What keeps its order in a line from right to left, a number right before a run of letters with it; and in a run of such a line.
RIGHT_LINE, RIGHT_PARTS = rf"(?:{NUMBER})?{LEFT_RUN}|{NUMBER}|{CLUSTER}", rf"{NUMBER}|{CLUSTER}"


def visual_order(text: Column, right: bool = False) -> Column:
    """A line in the order in which it is seen, from the left: right-to-left runs reversed, numbers and marks as they are.

    right: the line itself goes from right to left. Neutral characters go with the letters on both sides where these agree, else
    with the line; a number behind a left-to-right letter goes with it, else with right-to-left text, inside which
    its digits stay in order. A mark stays behind its letter. Digits of all scripts count alike; explicit marks of
    direction have no effect. Null stays null.
    """
    turned = lambda run, kinds: F.array_join(F.reverse(F.regexp_extract_all(run, F.lit(kinds), F.lit(0))), "")
    if right:
        return turned(text, RIGHT_LINE)
    runs = F.regexp_extract_all(text, F.lit(f"{RIGHT_RUN}|[^{RTL}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{RTL}]"), turned(r, RIGHT_PARTS)).otherwise(r)), "")
