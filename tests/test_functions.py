"""Scalar functions on hand-worked rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafwork.functions import maths, numbering, text


def values(spark, rows, make, kind="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("out")).collect()]


@pytest.mark.parametrize(
    ("written", "utc"),
    [
        ("D:20040101121110Z", "2004-01-01 12:11:10"), ("20040101121110", "2004-01-01 12:11:10"), ("D:2004", "2004-01-01 00:00:00"), ("D:200402", "2004-02-01 00:00:00"),
        ("D:20040101121110-04'00'", "2004-01-01 16:11:10"), ("D:20040101121110+05'00'", "2004-01-01 07:11:10"), ("D:20040101121110+08'30'", "2004-01-01 03:41:10"),
        (None, None), ("", None), ("D", None), ("D:", None), ("D:IAmNotAValidDate", None), ("D:20041301", None),
    ],
)
def test_dates(spark, written, utc):
    assert values(spark, [written], lambda v: F.date_format(numbering.parse_date(v), "yyyy-MM-dd HH:mm:ss")) == [utc]


def test_labels(spark):
    assert values(spark, [177, 4, 3999, 0, None], lambda v: F.lower(numbering.to_roman(v)), "v int") == ["clxxvii", "iv", "mmmcmxcix", None, None]
    assert values(spark, ["clxxvii", "MCMXC", "", "abc", None], numbering.from_roman) == [177, 1990, None, None, None]
    assert values(spark, [54, 1, 26, 27], numbering.to_letters, "v int") == ["bbb", "a", "z", "aa"]
    assert values(spark, ["ddd", "z", "ab"], numbering.from_letters) == [56 + 0, 26, None]


def test_code_points(spark):
    odd = ["", "abc", "Ünï", "Привет", "日本", "😀é", None]
    back = lambda v: F.array_join(F.transform(text.code_points(v), text.from_code_point), "")
    assert values(spark, odd, back) == odd
    assert values(spark, [0xD800, 0x110000, 65], text.from_code_point, "v int") == ["�", "�", "A"]
    assert values(spark, ["😀a"], text.utf16_units) == [3]


def test_decode_text(spark):
    raw = [b"\xfe\xff\x00a\x04\x3f", b"\xff\xfea\x00", b"\xef\xbb\xbf\xc3\xa9", b"\xe9a", None]
    assert values(spark, raw, text.decode_text, "v binary") == ["aп", "a", "é", "éa", None]


def test_unicode_tables(spark):
    assert values(spark, ["ﬁn", "Ⅷ½", None], text.compatible) == ["fin", "VIII1⁄2", None]
    assert values(spark, ["Ärger", "日"], text.to_ascii) == ["Arger", "\x1f"]
    assert values(spark, ["ab אבג c"], text.visual_order) == ["ab גבא c"]
    assert values(spark, ["ﬃ Æ"], text.split_ligatures) == ["ffi AE"]
    assert values(spark, [" ", " ", " ", "\u0085", "x"], text.is_space) == [True, True, True, True, False]


def test_names(spark):
    dn = values(spark, ["CN=A B, OU = X\\,Y,O=Z"], text.parse_dn)[0]
    assert [(r.key, r.value) for r in dn] == [("CN", "A B"), ("OU", "X,Y"), ("O", "Z")]
    assert values(spark, ["ABCDEF+Times", "Times"], text.subset_name) == ["Times", "Times"]
    assert values(spark, ["a b/c"], text.safe_name) == ["a#20b#2Fc"]
    assert values(spark, ["12", " -3.5 ", "x", "1e5", ""], text.parse_number) == [12.0, -3.5, None, None, None]


def test_calculator(spark):
    run = lambda program, *v: spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(maths.calculator(program, *[F.lit(x) for x in v]))]).first()
    assert list(run("exch sub", 3, 10)) == [7]
    assert list(run("1 2 3 3 1 roll")) == [3, 1, 2]
    assert list(run("7 -2 idiv -7 2 mod 2.5 round -2.5 truncate")) == [-3, -1, 3.0, -2.0]
    assert list(run("dup 5 gt {pop 1} {2 mul} ifelse", 3)) == [6]
    assert list(run("5 3 and 5 3 xor 1 4 bitshift true false or")) == [1, 6, 16, True]
    assert list(run("4 3 index pop 2 copy", 1, 2, 9)) == [1, 2, 9, 4, 9, 4]
    assert round(run("90 sin 0 cos add -1.0 0.0 atan")[1]) == 270
    with pytest.raises(ValueError):
        maths.calculator("copy", F.lit(1))


def test_geometry(spark):
    box = lambda *v: maths.rect(*[F.lit(x) for x in v])
    row = spark.range(1).select(maths.overlaps(box(0, 0, 2, 2), box(2, 2, 3, 3)).alias("touch"), maths.rotate(box(1, 2, 3, 4), F.lit(1), F.lit(10), F.lit(20)).alias("turned"), maths.area(maths.clip(box(0, 0, 9, 9), box(4, 4, 6, 7))).alias("area")).first()
    assert row.touch and tuple(row.turned) == (2, 7, 4, 9) and row.area == 6
    assert values(spark, [0, 1023, 1024, 5 << 20], maths.size_text, "v long") == ["0B", "1023B", "1.0K", "5.0M"]
