"""Forests grown level by level against trees grown node by node."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafwork.operators import forest, models


def brute(rows, weights, leaf, depth):
    """rows: (features, label)."""
    count = Counter(y for _, y in rows)
    most = min(y for y, n in count.items() if n == max(count.values()))
    if len(rows) <= leaf or len(count) < 2 or depth == 0:
        return models.Node(label=most)

    def entropy(some):
        w = Counter()
        for _, y in some:
            w[y] += weights[y]
        return -sum(x * math.log2(x / w.total()) for x in w.values())

    whole, best = sum(weights[y] for _, y in rows), None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            left, right = [r for r in rows if r[0][f] <= a], [r for r in rows if r[0][f] > a]
            if len(left) > leaf and len(right) >= leaf:
                score = round((entropy(left) + entropy(right)) / whole, 9)
                if score < round(entropy(rows) / whole, 9) and (best is None or score < best[0]):
                    best = (score, f, (a + b) / 2, left, right)
    if best is None:
        return models.Node(label=most)
    return models.Node(best[1], best[2], brute(best[3], weights, leaf, depth - 1), brute(best[4], weights, leaf, depth - 1))


@pytest.mark.parametrize("leaf, depth", [(1, 16), (5, 16), (1, 3)])
def test_grown_trees(spark, leaf, depth):
    rng = random.Random(leaf + depth)
    rows = []
    for i in range(240):
        x = [rng.randrange(12), rng.randrange(5), rng.randrange(100), 7]
        rows.append((i, x, (x[0] > 6) + (x[2] > 40) * 2 if rng.random() < 0.9 else rng.randrange(4)))
    df = spark.createDataFrame(rows + [(999, None, 1), (1000, [1, 2, 3, None], 1), (1001, [1, 2, 3, 4], None)], "id long, features array<int>, label int").repartition(5)
    weights = {y: n**-0.5 for y, n in Counter(r[2] for r in rows).items()}
    assert forest.grow_forest(df, 1, leaf, depth) == [brute([r[1:] for r in rows], weights, leaf, depth)]


def test_bagged_forests_score(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50), rng.randrange(50), rng.randrange(50)], 0) for i in range(600)]
    rows = [(i, x, int(x[0] + x[1] > 50)) for i, x, _ in rows]
    df = spark.createDataFrame(rows, "id long, features array<int>, label int")
    trees = forest.grow_forest(df.where("id < 500"), 7, leaf=2, row_share=0.7, feature_share=0.7, seed=5)
    assert trees == forest.grow_forest(df.where("id < 500").repartition(3), 7, leaf=2, row_share=0.7, feature_share=0.7, seed=5) and len(set(trees)) > 3
    votes = df.where("id >= 500").select("label", models.forest_votes(trees, F.col("features"))[0]["label"].alias("said")).collect()
    assert sum(r.label == r.said for r in votes) > 80
    few = forest.grow_forest(df, 1, bins=4, depth=1)
    assert few[0].left is not None
    with pytest.raises(ValueError, match="no feature"):
        forest.grow_forest(df.withColumn("features", F.array(F.lit(1))), 1)
