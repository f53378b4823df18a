"""Quality classifier from weak labels.

Heuristic labellers vote on two questions, whether a text is of good quality and whether it is toxic; they overlap,
err, have nothing to say (0) or don't apply (.). Expectation-maximisation over the counts of their vote patterns estimates how often each votes which
way on either class, and so the posterior of every pattern. Posteriors then train a linear scorer over hashed
features, which judges all texts.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, drop_cut, small, text_key

#: Texts that train the scorer, about: labelled ones, if any are, of the smallest key hashes. EM and scoring use all.
SAMPLE = 20_000
#: Hash buckets of the scorer's features.
BUCKETS = 1 << 18
#: Training texts that must show a feature before it gets a weight.
LEAST_TEXTS = 20
#: Training steps, of one text each: eight passes over SAMPLE texts, more over fewer.
STEPS = 160_000
EM_ROUNDS = 200
#: How often a given label is right where it is given; the other labellers' accuracies are estimated.
TRUST = 0.995
#: A text goes from this probability of toxicity on: to miss one costs more than to lose one.
TOXIC_LIMIT = 0.1
#: Beginnings of words, in characters, that are features beside the words.
STEMS = (3, 4, 5, 6)
#: Fixed: words of insult, in two lists that vote apart.
INSULTS = [{"idiot", "moron", "stupid", "clown", "scum", "imbecile", "dumb", "jerk"}, {"trash", "loser", "pathetic", "worthless", "disgusting", "garbage", "vermin", "filth"}]
#: Fixed: frequent words of the insults' language. A text where they are rarer than ENGLISH isn't in it.
COMMON = {"the", "of", "and", "to", "in", "is", "that", "it", "a", "for", "was", "with"}
ENGLISH = 0.15
#: Fixed: the ASCII signs that mark up junk.
SIGNS = "#$%&*|!~^<>{}[]@_="
#: Shares above which a symptom counts.
LIMITS = [0.06, 0.4, 0.15, 0.15, 0.2]
#: Words that end in a sign twice.
MARKED = re.compile(r"\S([!-/:-@\[-`{-~])\1(?=\s|$)")
QUALITY = ["symbols", "shouting", "repetition", "tables", "marked_words", "prose"]
TOXIC = ["insults_a", "insults_b"]


def looked_at(text: str | None) -> tuple[str, set[str], list[float]]:
    """(votes of all labellers, a character of +-0. each; distinct words; shares of the symptoms) of a text."""
    text = text or ""
    low = text.lower()
    words = low.split()
    n = len(words)
    if not n:
        return "." * len(QUALITY + TOXIC), set(), []
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    letters = upper + int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    shares = [
        sum(map(text.count, SIGNS)) / len(text),
        upper / max(letters, 1),
        sum(map(eq, words, words[1:])) / n,
        words.count("|") / n,
        len(MARKED.findall(low)) / n,
    ]
    # each sees one symptom, so where it sees none it has nothing to say; the last sees ordinary prose
    votes = ["-" if x > limit else "0" for x, limit in zip(shares, LIMITS, strict=True)]
    votes.append("+" if all(2 * x < limit for x, limit in zip(shares, LIMITS, strict=True)) and n >= 5 else "0")
    distinct = set(words)
    english = sum(map(COMMON.__contains__, words)) >= ENGLISH * n
    for some in INSULTS:
        hit = any(map(low.__contains__, some)) and any(w.strip(string.punctuation) in some for w in distinct)
        votes.append("+" if hit else "0" if english else ".")
    return "".join(votes), distinct, shares


def features_of(text: str | None, cache: dict[str, list[int]]) -> tuple[str, np.ndarray]:
    """(votes, feature buckets) of a text: its words, their beginnings, the symptoms' shares and the votes."""
    votes, distinct, shares = looked_at(text)
    out: set[int] = set()
    for w in distinct:
        b = cache.get(w)
        if b is None:
            bare = w.strip(string.punctuation)
            b = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in [bare, *[f"{bare[:k]}-" for k in STEMS if len(bare) > k]]]
            if len(cache) >= 100_000:
                cache.clear()
            cache[w] = b
        out.update(b)
    shown = [f"share {i} {min(int(x * 20), 10)}" for i, x in enumerate(shares)] + [f"vote {i} {v}" for i, v in enumerate(votes)]
    out.update(zlib.crc32(x.encode()) % BUCKETS for x in shown if distinct)
    return votes, np.fromiter(out, np.int32, len(out))


def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, votes) of (key, text)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([looked_at(x.as_py())[0] for x in batch.column(1)], pa.string())], names=["key", "votes"])


def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, votes, features) of (key, text)."""
    cache: dict[str, list[int]] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            some = batch.slice(i, 512)
            rows = [features_of(x.as_py(), cache) for x in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([v for v, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.list_(pa.int32()))], names=["key", "votes", "features"])


@dataclass
class Scorer:
    """Weights by feature bucket for (quality, toxic), and what EM found."""

    weights: np.ndarray
    bias: np.ndarray
    accuracies: dict[str, dict[str, dict[str, float]]] = field(default_factory=dict)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.weights[features].sum(axis=0))))


def expectation_maximisation(patterns: list[str], counts: np.ndarray, trusted: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of the positive class by pattern, probabilities by class, labeller and vote +-0.).

    trusted: the labeller that EM starts from, whose accuracy is given; where it abstains, the others' majority.
    """
    code = np.array([["+-0.".index(v) for v in p] for p in patterns])
    lean = (code == 0).sum(axis=1) - (code == 1).sum(axis=1)
    post = np.where(code[:, trusted] == 0, 0.95, np.where(code[:, trusted] == 1, 0.05, np.clip(0.5 + 0.2 * lean, 0.1, 0.9)))
    given = np.array([[TRUST, 1 - TRUST, 1, 1], [1 - TRUST, TRUST, 1, 1]])
    for _ in range(EM_ROUNDS):
        rate, prior = [], []
        for weight in (counts * post, counts * (1 - post)):
            table = np.stack([[weight[code[:, j] == v].sum() for v in range(4)] for j in range(code.shape[1])]) + 0.5
            table /= table[:, :3].sum(axis=1, keepdims=True)
            table[:, 3] = 1  # what doesn't apply tells nothing
            table[trusted] = given[len(rate)]
            rate.append(table)
            prior.append(weight.sum() + 1)
        like = [np.log(p) + sum(np.log(r[j, code[:, j]]) for j in range(code.shape[1])) for p, r in zip(prior, rate, strict=True)]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, np.stack(rate)


def train(features: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights (AdaGrad) for soft targets of two questions, in a fixed random order."""
    weights, bias = np.zeros((BUCKETS, 2)), np.zeros(2)
    grown, grown_bias = np.full((BUCKETS, 2), 1e-2), np.full(2, 1e-2)
    texts = np.zeros(BUCKETS, np.int64)
    for f in features:
        texts[f] += 1  # a text has each of its features once
    kept = [f[texts[f] >= LEAST_TEXTS] for f in features]
    order = np.random.default_rng(0)
    for _ in range(max(1, STEPS // max(len(kept), 1))):
        for i in order.permutation(len(kept)):
            f = kept[i]
            error = 1 / (1 + np.exp(-np.clip(bias + weights[f].sum(axis=0), -30, 30))) - target[i]
            pull = error + 1e-4 * weights[f]
            grown[f] += pull**2
            weights[f] -= 0.1 * pull / np.sqrt(grown[f])
            grown_bias += error**2
            bias -= 0.1 * error / np.sqrt(grown_bias)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Scorer:
    """EM over the votes on all of docs, then a scorer trained on about `sample` of them, labelled ones if labels are given.

    labels: (key, quality, toxic) for some rows; they are one more labeller of each question, which may err too.
    Nulls in it abstain; of repeated keys the greater value counts. Null keys have no label. Null, empty and word-less
    texts vote on nothing. Rows of one key are texts of their own that share its label; rows equal in key and text
    vote as often as they occur, and train once. Other columns are ignored; without rows the scorer keeps all.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    votes = texts.mapInArrow(voted, f"key {kind}, votes string")
    total = docs.count()
    if not total:
        return Scorer(np.zeros((BUCKETS, 2)), np.array([30.0, -30.0]))
    vote = lambda c: F.when(F.col(c) == 1, "+").when(F.col(c) == 0, "-").otherwise(".").alias(c)
    if labels is None:
        told = None
    else:
        told = labels.groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("key", vote("quality"), vote("toxic"))

    def with_labels(df: DataFrame) -> DataFrame:
        out = df.withColumns({"quality": F.lit("."), "toxic": F.lit(".")}) if told is None else df.join(told, "key", "left")
        q, t = F.coalesce("quality", F.lit(".")), F.coalesce("toxic", F.lit("."))
        return out.withColumn("q", F.concat(F.substring("votes", 1, len(QUALITY)), q)).withColumn("t", F.concat(F.substring("votes", len(QUALITY) + 1, len(TOXIC)), t)).drop("votes", "quality", "toxic")

    posterior, rates = [], {}
    # as many rows as there are patterns of votes, at most, whatever the number of texts
    counted = with_labels(votes).groupBy("q", "t").agg(F.count(F.lit(1)).alias("n")).collect()
    for question, names in (("q", QUALITY), ("t", TOXIC)):
        patterns = sorted({r[question] for r in counted})
        counts = np.array([sum(r["n"] for r in counted if r[question] == p) for p in patterns], float)
        post, rate = expectation_maximisation(patterns, counts, len(names))
        posterior.append(dict(zip(patterns, post.tolist(), strict=True)))
        for j, name in enumerate([*names, f"labels_{question}"]):
            rates[name] = {side: dict(zip("+-0", rate[i, j, :3].round(4).tolist(), strict=True)) for i, side in enumerate(("positive", "negative"))}
    # repeats of a labelled row count once, so about `sample` rows reach the driver however often a key or a text occurs;
    # they are picked by hashes first, so that only their texts move
    hashed = texts.withColumn("h", F.xxhash64(F.lit("sample"), "key", "text"))
    marks = hashed.select("key", "h", *text_key(F.col("text")))
    marks = cut((marks if told is None else marks.join(told.select("key"), "key", "left_semi")).distinct())
    share = min(1.0, sample / max(marks.count(), 1))
    picked = hashed.join(small(cut(marks.where((F.col("h") / 2.0**64 + 0.5) <= share).select("h").distinct())), "h", "left_semi").drop("h")
    rows = with_labels(picked.dropDuplicates(["key", "text"]).mapInArrow(seen, f"key {kind}, votes string, features array<int>")).select(F.col("key").cast("string").alias("key"), "q", "t", "features")
    # one task trains, with a sample that doesn't grow with the corpus; the driver gets the weights alone
    found = rows.repartition(1).mapInArrow(partial(trained, posterior=posterior), "weights binary, bias binary").first()
    drop_cut(marks)
    if found is None:
        return Scorer(*train([], np.zeros((0, 2))), rates)
    return Scorer(np.frombuffer(found["weights"]).reshape(-1, 2), np.frombuffer(found["bias"]), rates)


def trained(batches: Iterator[pa.RecordBatch], posterior: list[dict[str, float]]) -> Iterator[pa.RecordBatch]:
    """The weights and bias, as bytes, of a scorer trained on all rows (key, q, t, features); the order of rows doesn't matter."""
    keys, features, target = [], [], []
    for batch in batches:
        keys += [str(k) for k in batch.column(0).to_pylist()]
        features += [x.values.to_numpy().copy() for x in batch.column(3)]
        target += [(posterior[0][q], posterior[1][t]) for q, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    if keys:
        order = sorted(range(len(features)), key=lambda i: (keys[i], zlib.crc32(features[i])))
        weights, bias = train([features[i] for i in order], np.array(target).reshape(-1, 2)[order])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (weights, bias)], names=["weights", "bias"])


def judged(batches: Iterator[pa.RecordBatch], scorer: object) -> Iterator[pa.RecordBatch]:
    cache: dict[str, list[int]] = {}
    score = scorer.value
    for batch in batches:
        p = np.array([score(features_of(x.as_py(), cache)[1]) for x in batch.column(1)]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *batch.columns[2:]], names=["p_quality", "p_toxic", *batch.schema.names[2:]])


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with (p_quality, p_toxic, kept): kept where p_quality is 0.5 at least and p_toxic under TOXIC_LIMIT.

    No shuffle. Null and empty texts have no features and get the scorer's bias. Columns of docs called like the
    added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS pairs of weights, whatever the corpus
    kept = [c for c in docs.columns if c not in ("p_quality", "p_toxic", "kept")]
    body = docs.select(F.lit(0).alias("_0"), F.col(text).alias("_text"), *kept)
    schema = ", ".join(["p_quality double", "p_toxic double", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]])
    out = body.mapInArrow(partial(judged, scorer=shared), schema)
    return out.select(*kept, "p_quality", "p_toxic", ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < TOXIC_LIMIT)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    return score(docs, fit(docs, labels, text, key), text)
