"""Pages handed to Python in batches, against plain ones, and what they shuffle."""

from __future__ import annotations

import random

import pytest
from conftest import DATA

from leafwork.operators import layout, rendering
from leafwork.plans import registry

MODES = ("raw", "physical", "reading")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_modes_shuffle_words_once(spark):
    """Each mode made its words again and joined them with their columns: 2.3 GB shuffled over 0.1 GB of documents."""
    shown = plan(registry.QUERIES["layout_text_modes"](spark, DATA))
    assert shown.count("Exchange hashpartitioning") == 1 and "Join" not in shown


@pytest.mark.parametrize("batch", [7, 10_000])
def test_text_modes_against_plain_ones(spark, batch):
    rng = random.Random(5)
    rows = []
    for page in range(40):
        for pos in range(rng.randrange(1, 30)):
            para = rng.randrange(4)
            x1 = rng.randrange(30) + para % 2 * 40
            rows.append((page % 3, page, pos, para, rng.randrange(5), x1, x1 + rng.randrange(1, 6), rng.choice(["a", "b", "cé", None])))
    df = spark.createDataFrame(rows, "doc_id long, page int, content_pos long, para int, baseline int, x1 long, x2 long, text string")
    want = {}
    for key in {r[:2] for r in rows}:
        words = [r[2:] for r in rows if r[:2] == key]
        boxes: dict = {}
        for _, para, _, x1, x2, _ in words:
            a, b = boxes.get(para, (x1, x2))
            boxes[para] = (min(a, x1), max(b, x2))
        column, reach, number = {}, None, -1
        for para in sorted(boxes, key=lambda p: (boxes[p][0], p)):
            number += reach is None or reach < boxes[para][0]
            reach = max(boxes[para][1], boxes[para][1] if reach is None else reach)
            column[para] = number
        texts = []
        for mode in MODES:
            lines: dict = {}
            for w in words:
                lines.setdefault((w[2],) if mode == "physical" else (column[w[1]], w[2]), []).append(w)
            order = sorted(lines, key=lambda k: min(w[0] for w in lines[k]) if mode == "raw" else k)
            inside = {"raw": lambda w: w[0], "physical": lambda w: (column[w[1]], w[3], w[0]), "reading": lambda w: (w[3], w[0])}[mode]
            texts.append("\n".join(" ".join(w[5] for w in sorted(lines[k], key=inside) if w[5] is not None) for k in order))
        want[key] = texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.doc_id, r.page): [r[m] for m in MODES] for r in rendering.text_by_modes(df, MODES, "para").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_word_groups_sort_lines_once(spark):
    """Windows and collected lists sorted the words of a line three times, and spilled 656 MB over 0.1 GB of documents."""
    rows = [(1, 0, 0, 2, "a"), (1, 0, 2, 4, "b"), (1, 0, 6, 7, "c"), (1, 0, 7, 9, None), (1, 0, 10, 11, " d"), (1, 1, 3, 4, " e"), (None, 0, 0, 1, "f"), (2, 0, None, 3, "g"), (2, 0, 4, None, "h"), (2, 0, 5, 6, "i")]
    words = spark.createDataFrame(rows, "doc_id long, baseline int, x1 long, x2 long, text string")
    found = layout.word_groups(words, "doc_id", gap=1.5)
    assert "Window" not in plan(found) and found.schema["grp"].dataType.simpleString() == "bigint"
    want = [(1, 0, 0, 0, 4, "ab"), (1, 0, 1, 6, 11, "c  d"), (1, 1, 0, 3, 4, "e"), (2, 0, 0, 4, 3, "g h"), (2, 0, 1, 5, 6, "i"), (None, 0, 0, 0, 1, "f")]
    assert sorted(map(str, found.select("doc_id", "baseline", "grp", "x1", "x2", "text").collect())) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, baseline int, grp long, x1 long, x2 long, text string").collect())
