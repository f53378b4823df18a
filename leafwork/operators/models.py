"""Scoring with given models, and their metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.operators.documents import written
from leafwork.operators.ranges import running


@dataclass(frozen=True)
class Layer:
    weights: list[list[float]]
    bias: list[float]
    activation: str  # relu, logistic, softmax or identity


def softmax(x: Column) -> Column:
    """Shifted by the greatest, so that nothing overflows."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def predict(layers: list[Layer]):
    """A vectorised scorer of array columns: class probabilities."""
    shapes = [(np.array(x.weights), np.array(x.bias), x.activation) for x in layers]

    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()).astype(float) if len(features) else np.empty((0, shapes[0][0].shape[1]))
        for w, b, kind in shapes:
            x = x @ w.T + b
            if kind == "relu":
                x = np.maximum(x, 0)
            elif kind == "logistic":
                x = 1 / (1 + np.exp(-x))
            elif kind == "softmax":
                x = np.exp(x - x.max(axis=1, keepdims=True))
                x /= x.sum(axis=1, keepdims=True)
        return pd.Series(list(x))

    return run


def predict_distinct(rows: DataFrame, features: str, layers: list[Layer]) -> DataFrame:
    """rows with probabilities; equal feature vectors are scored once and joined back."""
    scored = rows.select(features).distinct().withColumn("probabilities", predict(layers)(F.col(features)))
    return rows.join(scored, features)


def accepted(probabilities: Column, own: Column, best: float = 0.25, least: float = 0.01) -> Column:
    """Whether a prediction replaces a character: the best is at least `best`, the character's own at most `least`, and they differ."""
    top = F.array_position(probabilities, F.array_max(probabilities)) - 1
    mine = F.coalesce(F.get(probabilities, own), F.lit(0.0))
    return (F.array_max(probabilities) >= best) & (mine <= least) & (top != own)


@dataclass(frozen=True)
class Node:
    """A decision: left where the feature is at most the threshold; a leaf has a label."""

    feature: int = 0
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    label: int | None = None


def tree_label(node: Node, features: Column) -> Column:
    """A tree as one nested condition."""
    if node.label is not None:
        return F.lit(node.label)
    return F.when(F.get(features, F.lit(node.feature)) <= node.threshold, tree_label(node.left, features)).otherwise(tree_label(node.right, features))


def forest_votes(trees: list[Node], features: Column) -> Column:
    """Array of (label, share) of the trees' votes, the most frequent first, ties to the smaller label."""
    votes = F.array(*[tree_label(t, features) for t in trees])
    shares = F.transform(F.array_distinct(votes), lambda x: F.struct((-F.size(F.filter(votes, lambda v: v == x))).alias("minus"), x.alias("label")))
    return F.transform(F.array_sort(shares), lambda s: F.struct(s["label"].alias("label"), (-s["minus"] / len(trees)).alias("share")))


def split_entropy(rows: DataFrame, feature: str, label: str) -> DataFrame:
    """(threshold, entropy) of every split between adjacent values of a feature: the weighted entropy of both sides.

    Counts by value and label are pre-aggregated and dealt by ranges of the value. A class's part in the entropy changes
    only at its own values, so running sums of these changes give that of each split. Rows without a value take no part;
    null labels are a class.
    """
    counts = rows.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("v"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    dealt, _ = written(counts.repartitionByRange("v").withColumn("bucket", F.spark_partition_id()))
    labels = dealt.groupBy("l").agg(F.sum("c").alias("total")).withColumnRenamed("l", "of")
    term = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    below, total = F.col("c_upto"), F.col("total")
    under, over = term(below) - term(below - F.col("c")), term(total - below) - term(total - below + F.col("c"))
    each = running(dealt, ["l"], "v", "bucket", ["c"]).join(labels, F.col("l").eqNullSafe(F.col("of")))
    changes, _ = written(each.groupBy("bucket", "v").agg(F.sum("c").alias("n"), F.sum(under).alias("a"), F.sum(over).alias("b")))
    whole = labels.agg(F.sum("total").alias("n"), F.sum(term(total)).alias("t")).first()
    n, na, nb = F.lit(whole["n"]), F.col("n_upto"), F.lit(whole["n"]) - F.col("n_upto")
    # the least value of the next range follows the last one of a range; there are as many rows as ranges
    starts = changes.groupBy("bucket").agg(F.min("v").alias("first")).select("bucket", F.lead("first").over(Window.orderBy("bucket")).alias("first"))
    after = F.coalesce(F.lead("v").over(Window.partitionBy("bucket").orderBy("v")), F.col("first"))
    sides = running(changes, [], "v", "bucket", ["n", "a", "b"]).join(starts, "bucket").withColumn("w", after).where("w is not null")
    bits = (term(na) - F.col("a_upto") + term(nb) - F.lit(whole["t"]) - F.col("b_upto")) / n
    return sides.select(((F.col("v") + F.col("w")) / 2).alias("threshold"), F.round(bits, 6).alias("entropy"))


def metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: micro accuracy, and macro accuracy, the mean over classes."""
    right = (F.col(actual) == F.col(predicted)).cast("int")
    each = scored.groupBy(actual).agg(F.sum(right).alias("k"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n"), F.round(F.sum("k") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro"))


def confusion(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, percent of the actual class)."""
    counts = scored.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(actual)), 6))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight, index): weights that make classes count alike; index encodes sorted labels."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy(label)  # over as many rows as there are classes
    return counts.select(label, "n", F.round(F.sum("n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n")), 6).alias("weight"), (F.dense_rank().over(whole) - 1).alias("index"))


def weighted_class(rows: DataFrame, by: str, label: str, weight: str) -> DataFrame:
    """(by, label, weight): the label of the greatest summed weight of each group, ties to the greater label."""
    sums = rows.groupBy(by, label).agg(F.sum(weight).alias("w"))
    return sums.groupBy(by).agg(F.max(F.struct("w", label)).alias("m")).select(by, F.col("m")[label].alias(label), F.col("m.w").alias("weight"))


def loss(probabilities: Column, actual: Column) -> Column:
    """Cross entropy of one prediction."""
    return -F.ln(F.greatest(F.get(probabilities, actual), F.lit(1e-300)))


def histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, extreme) of each class: extreme is most or least where no other class has more or fewer."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.max("n").alias("_most"), F.min("n").alias("_least"))  # one row
    marked = counts.join(F.broadcast(bounds), F.lit(True))
    return marked.withColumn("extreme", F.when(F.col("n") == F.col("_most"), "most").when(F.col("n") == F.col("_least"), "least")).drop("_most", "_least")


def save_network(spark: SparkSession, layers: list[Layer], path: str, model: int = 0) -> None:
    """A network's parameters as rows (model, layer, activation, bias, weights)."""
    rows = [(model, i, x.activation, list(map(float, x.bias)), [list(map(float, w)) for w in x.weights]) for i, x in enumerate(layers)]
    spark.createDataFrame(rows, "model int, layer int, activation string, bias array<double>, weights array<array<double>>").write.mode("append").parquet(path)


def load_network(spark: SparkSession, path: str, model: int = 0) -> list[Layer]:
    """The network of that number; a table has as many rows as its networks have layers."""
    rows = spark.read.parquet(path).where(F.col("model") == model).orderBy("layer").collect()
    return [Layer([list(w) for w in r.weights], list(r.bias), r.activation) for r in rows]
