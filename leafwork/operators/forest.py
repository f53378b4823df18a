"""Growing of decision forests level by level: one aggregation of class histograms for all open nodes of all trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators.documents import dropped, written
from leafwork.operators.models import Node

#: Values of a feature that are told apart; of more, neighbours share a bin.
BINS = 256
#: Levels of a tree, at most.
DEPTH = 16
#: Digits to which scores are compared: sums of weights differ in the last ones by their order.
DIGITS = 9


@dataclass
class Grown:
    """A tree as it grows: nodes by number, the root 1 and the children of i 2i and 2i + 1; open ones aren't decided yet."""

    features: list[int]
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    labels: dict[int, int] = field(default_factory=dict)
    open: set[int] = field(default_factory=lambda: {1})

    def places(self, x: np.ndarray) -> np.ndarray:
        """The open node that each row of x comes to; 0 for those that end in a leaf."""
        node = np.ones(len(x), np.int64)
        for level in range(max(n.bit_length() for n in self.splits) if self.splits else 0):
            at = [n for n in self.splits if n.bit_length() == level + 1]
            which = np.zeros(2 << level, np.int64) - 1
            which[at] = np.arange(len(at))
            feature, threshold = np.array([self.splits[n] for n in at]).reshape(-1, 2).T
            k = np.where(node < len(which), which[np.minimum(node, len(which) - 1)], -1)
            on = np.flatnonzero(k >= 0)
            k = k[on]
            node[on] = 2 * node[on] + (x[on, feature[k].astype(np.int64)] > threshold[k])
        return np.where(np.isin(node, list(self.open)), node, 0)

    def tree(self, node: int = 1) -> Node:
        if node in self.splits:
            feature, threshold = self.splits[node]
            return Node(int(feature), float(threshold), self.tree(2 * node), self.tree(2 * node + 1))
        return Node(label=self.labels[node])


def entropies(counts: np.ndarray) -> np.ndarray:
    """Weight times entropy of each row of class weights."""
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(counts > 0, counts * np.log2(counts), 0.0).sum(axis=-1)
        whole = counts.sum(axis=-1)
        return np.where(whole > 0, whole * np.log2(whole), 0.0) - part


def best_split(node: pd.DataFrame, weights: dict[int, float], leaf: int) -> tuple[int, float, float] | None:
    """(feature, threshold, score) of the split with the least mean entropy of both sides, ties to the first feature, then the lowest value.

    node: (feature, bin, label, n, value). A split leaves more than `leaf` rows on the left and at least as many as that on the right, and lowers the
    entropy.
    """
    labels = np.sort(node.label.unique())
    w = np.array([weights[x] for x in labels])
    found = None
    for feature, rows in sorted(node.groupby("feature"), key=lambda g: g[0]):
        values, at = np.unique(rows.value.to_numpy(), return_inverse=True)
        n = np.zeros((len(values), len(labels)))
        np.add.at(n, (at, np.searchsorted(labels, rows.label.to_numpy())), rows.n.to_numpy())
        left = n.cumsum(axis=0)
        right = left[-1] - left
        whole = entropies(left[-1] * w) / (left[-1] * w).sum()
        score = np.round((entropies(left * w) + entropies(right * w)) / (left[-1] * w).sum(), DIGITS)
        fits = (left.sum(1) > leaf) & (right.sum(1) >= max(leaf, 1)) & (score < np.round(whole, DIGITS))
        if fits.any():
            i = int(np.where(fits, score, np.inf).argmin())
            if found is None or score[i] < found[2]:
                found = (int(feature), float(values[i] + values[i + 1]) / 2, float(score[i]))
    return found


def deciding(weights: dict[int, float], leaf: int, last: bool):
    """A function of one node's histogram (tree, node, feature, value, label, n): its class, and its split or feature -1."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf.feature == pdf.feature.iloc[0]].groupby("label").n.sum()
        most = int(one[one == one.max()].index.min())
        split = best_split(pdf, weights, leaf) if one.sum() > leaf and len(one) > 1 and not last else None
        return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "node": [pdf.node.iloc[0]], "label": [most], "feature": [split[0] if split else -1], "threshold": [split[1] if split else 0.0]})

    return decide


def grow_forest(rows: DataFrame, trees: int, leaf: int = 1, depth: int = DEPTH, row_share: float = 1.0, feature_share: float = 1.0, seed: int = 0, bins: int = BINS, key: str = "id", features: str = "features", label: str = "label") -> list[Node]:
    """Trees grown on rows (key, features: array of whole numbers, label: whole number).

    Each tree takes its share of the rows, by a hash of key and seed, and of the features that vary. Classes weigh the
    inverse root of their rows. A node with at most `leaf` rows, of one class, at the last level, or without a split that
    lowers the weighted entropy is a leaf with its most frequent class, ties to the smaller. Each level is one pass: tasks
    count (tree, node, feature, bin, class) batch by batch, Spark sums that, and each node's best split comes to the driver,
    which holds the trees alone. Features of over `bins` values are cut into bins of equal width; then a threshold lies
    between the least values of neighbouring bins. Rows with null labels or features are left out. No rows, or no feature that
    varies, are an error.
    """
    known, path = written(rows.where(F.col(label).isNotNull() & F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())).select(F.xxhash64(key).alias("h"), F.col(features).cast("array<bigint>").alias("x"), F.col(label).cast("long").alias("y")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as classes
    each = known.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(counts.values())
    if any(r["n"] != total for r in each):
        raise ValueError("rows differ in their number of features")
    ranges = {r["f"]: (r["low"], max(1, -(-(r["high"] - r["low"] + 1) // bins))) for r in each if r["high"] > r["low"]}
    if not ranges:
        raise ValueError("no feature varies")
    weights = {y: n**-0.5 for y, n in counts.items()}
    rng = np.random.default_rng(seed)
    some = max(1, int(feature_share * len(ranges)))
    grown = [Grown(sorted(rng.permutation(sorted(ranges))[:some].tolist())) for _ in range(trees)]
    kind = "tree int, node bigint, feature int, value bigint, label bigint, n bigint"

    for level in range(depth + 1):
        now = [Grown(g.features, dict(g.splits), {}, set(g.open)) for g in grown]

        def histograms(batches: Iterator[pa.RecordBatch], now: list[Grown] = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                h, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                for t, g in enumerate(now):
                    if not g.open:
                        continue
                    node = g.places(x)
                    # the same rows in every pass
                    mixed = (h.view(np.uint64) ^ np.uint64(seed * 1_000_003 + t + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    mine = np.flatnonzero((node > 0) & ((mixed >> np.uint64(40)).astype(np.float64) < row_share * (1 << 24)))
                    for f in g.features:
                        low, width = ranges[f]
                        value = low + (x[mine, f] - low) // width * width
                        codes, n = np.unique(np.stack([node[mine], value, y[mine]], axis=1), axis=0, return_counts=True)
                        if len(codes):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(codes[:, 0]), pa.array(np.full(len(codes), f, np.int32)), pa.array(codes[:, 1]), pa.array(codes[:, 2]), pa.array(n)], names=["tree", "node", "feature", "value", "label", "n"])

        summed = known.mapInArrow(histograms, kind).groupBy("tree", "node", "feature", "value", "label").agg(F.sum("n").alias("n"))
        found = summed.groupBy("tree", "node").applyInPandas(deciding(weights, leaf, level == depth), "tree int, node bigint, label bigint, feature int, threshold double").collect()
        for g in grown:
            g.open = set()
        for r in found:
            g = grown[r["tree"]]
            if r["feature"] < 0:
                g.labels[r["node"]] = r["label"]
            else:
                g.splits[r["node"]] = (r["feature"], r["threshold"])
                g.open |= {2 * r["node"], 2 * r["node"] + 1}
        if not any(g.open for g in grown):
            break
    dropped(known, path)
    if any(not g.splits and not g.labels for g in grown):
        raise ValueError("a tree has no rows")
    return [g.tree() for g in grown]
