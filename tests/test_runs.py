"""Words and characters that come as runs, a row for each line, against one row for each."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafwork.operators import groups, layout
from leafwork.sources import tables

CHARS = "doc_id long, page int, char_pos long, text string, x1 double, x2 double, baseline double, font_size double, rotation int"


def test_characters_in_runs(spark, monkeypatch):
    """characters were read six times and dealt one row each."""
    monkeypatch.setattr(groups, "PART", 7)
    rng = random.Random(14)
    rows = []
    for doc in range(6):
        for line in range(8):
            x = 0.0
            for i in range(rng.randrange(1, 15)):
                x += rng.choice([0.0, 0.05, 1.0, 1.0, 1.0, 1.3])
                rows.append((doc, line // 4, line * 100 + i, rng.choice(["a", "b", " ", " \n", "\0", "\v"]), rng.choice([x] * 9 + [float("nan")]), x + 1, float(line // 2), rng.choice([1.0] * 9 + [2.0]), rng.choice([0] * 9 + [1])))
    rng.shuffle(rows)
    chars = spark.createDataFrame(rows, CHARS)
    own = ["doc_id", "page", "baseline", "font_size", "rotation"]
    items = F.collect_list(F.struct("char_pos", "text", "x1", "x2"))
    runs = chars.groupBy(*own, (F.col("char_pos") % 3).alias("third")).agg(items.alias("i")).select(*own, *[F.col("i")[c].alias(c) for c in ("char_pos", "text", "x1", "x2")])
    for size in ((), (9.0, 99.0)):
        got = layout.chars_to_words(runs, *size)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.chars_to_words(chars, *size).collect())) != []
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
    kept = layout.on_page_chars(runs, 9.0, 99.0).select(*chars.columns)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, layout.on_page_chars(chars, 9.0, 99.0).collect()))


def test_blanks_are_those_of_the_pattern(spark):
    texts = [a + b for a in " \t\n\v\f\rx\xa0" for b in ["", "\n", "\r", "\r\n", "\x85", "\u2028", "\u2029", " ", "\n\n"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("blank", F.col("t").rlike("^\\s$"))
    assert {r.t for r in df.where("blank").collect()} == set(layout.BLANKS.to_pylist())


def test_pages_of_lines_in_runs(spark, monkeypatch):
    """words were dealt by lines, sorted in a window, and dealt again by pages."""
    monkeypatch.setattr(groups, "PART", 5)
    text = "\n".join(" ".join(f"w{'é' * (i % 5)}" for i in range(n)) for n in (0, 1, 11, 12, 13, 700, 25))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " a  b "), (5, "x\n\n y")], "doc_id long, text string")
    runs, words = tables.word_runs(docs), tables.words_of(docs)
    flat = runs.select("doc_id", "page", "baseline", F.explode(F.arrays_zip("text", "x1", "x2")).alias("w")).select("doc_id", "page", "baseline", "w.*")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, words.select(*flat.columns).collect()))
    got = layout.page_text(runs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.page_text(words).collect()))
    assert {r.text for r in got.collect() if r.doc_id > 1} == {"a b", "x\ny"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1


def test_pages_of_odd_words(spark):
    rows = [(1, 0, 0, 5.0, 6.0, "c"), (1, 0, 0, 0.0, 1.0, "a"), (1, 0, 0, 1.0, 2.0, "b"), (1, 0, 0, 3.0, 4.0, None), (1, 0, 2, None, 1.0, "n"), (1, 0, 2, 7.0, 8.0, "o"), (1, 0, 1, 0.0, 1.0, None), (2, None, 0, float("nan"), 1.0, "z")]
    words = spark.createDataFrame(rows, "doc_id long, page int, baseline int, x1 double, x2 double, text string")
    assert {(r.doc_id, r.page, r.text) for r in layout.page_text(words, "|").collect()} == {(1, 0, "ab c||n o"), (2, None, "z")}


def test_order_as_spark_has_it():
    table = pa.table({"k": [1, 1, 1, 1, 2, 2, 2], "a": [3, None, 3, 1, 5, 5, 4], "b": [float("nan"), 0.0, 2.0, 9.0, None, 1.0, 0.0], "c": list("tuvwxyz")})
    got = groups.in_order(table, np.array([0, 4, 7]), ["a", "b", "c"])
    assert got["c"].to_pylist() == list("uwvtzxy")
