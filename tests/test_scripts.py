"""Chains of scripts against rounds done pair by pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from leafwork.operators import layout


def rounds(words):
    """words: {id: (x1, x2, baseline, size)}; the head of each."""
    now = {i: [x1, x2, base, size] for i, (x1, x2, base, size) in words.items()}
    head = {i: i for i in words}
    while True:
        chosen = {}
        for s, (x, _, base, size) in now.items():
            fit = [((x - t[1]) ** 2 + (base - t[2]) ** 2, i) for i, t in now.items() if i != s and size <= layout.SCRIPT_SIZE * t[3] and abs(x - t[1]) <= layout.SCRIPT_GAP * t[3] and abs(base - t[2]) <= layout.SCRIPT_OFF * t[3]]
            if fit:
                chosen[s] = min(fit)
        pairs = {}
        for s, (d, t) in chosen.items():
            pairs[t] = min(pairs.get(t, (d, s)), (d, s))
        if not pairs:
            return head
        tails = {s: now[s][1] for _, s in pairs.values()}
        for t, (_, s) in pairs.items():
            head[s] = t
            if t in now:
                now[t][1] = max(now[t][1], tails[s])
        for s in tails:
            del now[s]


def test_script_chains(spark):
    rng = random.Random(11)
    rows, want = [], []
    for page in range(25):
        words = {i: (float(rng.randrange(24)), 0.0, rng.choice([0.0, 0.5, 1.0, 4.0]), rng.choice([1.0, 1.5, 2.0, 4.0])) for i in range(14)}
        words = {i: (a, a + rng.randrange(1, 4), b, s) for i, (a, _, b, s) in words.items()}
        rows += [(1, page, i, *w) for i, w in words.items()]
        want += [(1, page, i, h) for i, h in rounds(words).items()]
    assert sum(w[2] != w[3] for w in want) > 60
    rows += [(2, 0, 1, None, 1.0, 0.0, 1.0), (2, 0, 2, 1.0, 2.0, 0.0, 9.0)]
    want += [(2, 0, 1, 1), (2, 0, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, page int, word_id long, x1 double, x2 double, baseline double, font_size double").withColumn("head", F.lit(1))
    assert sorted(map(tuple, layout.script_chains(df).collect())) == sorted(want)
    assert layout.script_chains(df.where("false")).collect() == []


def test_near_pairs_copy_little(spark):
    rng = random.Random(5)
    points = [(i % 3, i, rng.randrange(-900, 900) / 10, rng.randrange(-300, 300) / 10) for i in range(400)]
    df = spark.createDataFrame(points, "page long, id long, x double, y double")
    got = [tuple(r) for r in layout.near_pairs(df, df, ["page"], 3, 1).select("left_id", "right_id").collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in points for q in points if p[0] == q[0] and abs(p[2] - q[2]) <= 3 and abs(p[3] - q[3]) <= 1)
    assert layout.touched_cells(df, 3, 1).count() < 2 * len(points)


def test_script_chains_broadcast_nothing(spark):
    seen = []
    original = layout.written
    layout.written = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), original(df))[1]
    try:
        rows = [(1, 0, i, float(i), i + 1.0, 0.1 * i, 2.0 if i % 3 == 0 else 1.0) for i in range(9)]
        out = layout.script_chains(spark.createDataFrame(rows, "doc_id long, page int, word_id long, x1 double, x2 double, baseline double, font_size double"))
    finally:
        layout.written = original
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in seen) > 3
    assert not any("Broadcast" in p for p in seen)
