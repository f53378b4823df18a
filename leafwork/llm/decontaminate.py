"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

The index holds a posting (text, position, term) for every word of the training texts that the benchmark uses. For
each window of benchmark words, its rarest terms anchor the search: their postings, adjusted by the offset in the
item, meet where the window may occur. Of a window of w words with at least m in place at most w - m anchors are missing, so
w - m + 2 anchors leave two that meet. Only there are the postings of all words of the item intersected.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import Scratch, cut, small, text_key

#: Words of an exact window; shorter items are one window.
WINDOW = 10
#: Words of a window that must be in place for a proximity match.
NEAR = 8
#: Fixed: a run of anything but ASCII characters that are neither letters nor digits.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The term of the row that each document has besides its postings.
DOCUMENT = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def folded(word: Column) -> Column:
    """Lower case for A-Z alone; lower() does that where all is ASCII, and faster."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def item_words(bench: DataFrame, text: str, item: str) -> DataFrame:
    """(item, item_id, n, j, word, term): every word of every distinct benchmark item; null ids are empty strings."""
    each = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text")).distinct()
    each = each.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("words"))
    rows = each.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("j", "word")).withColumn("word", folded(F.col("word")))
    return rows.withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, vocabulary: DataFrame, text: str, key: str) -> DataFrame:
    """(key, k1, k2, n_words, term, pos): the postings of the vocabulary's words, and one DOCUMENT row for each row of docs.

    k1, k2 identify the text: rows of equal text share postings. vocabulary: (word, term), distinct.
    """
    rows = docs.select(F.col(key).alias("key"), *text_key(F.col(text)), words(F.col(text)).alias("words"))
    rows = rows.select("key", "k1", "k2", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(DOCUMENT)), "words")).alias("pos", "said"))
    rows = rows.withColumn("said", folded(F.col("said"))).withColumn("term", F.xxhash64("said")).withColumn("pos", F.col("pos") - 1)
    # joined by the hash alone, a long, which probes faster; the words themselves are compared as well
    same = (F.col("said") <= F.col("word")) & (F.col("said") >= F.col("word"))
    return rows.join(small(vocabulary), "term").where(same).select("key", "k1", "k2", "n_words", "term", "pos")


def needed(length: Column, window: int, near: int) -> Column:
    """Words that are in place in a proximity match of a window of that length: `near` of a whole window, in proportion for shorter ones."""
    return F.ceil(length * near / window)


def anchors(items: DataFrame, frequency: DataFrame, window: int, near: int) -> DataFrame:
    """(item, n, j, term): for each window, its words that are rarest in the training texts; two of them stand in every match."""
    length = F.least("n", F.lit(window))
    most = length - needed(length, window, near) + 2
    starts = items.select("item", "n", "j", "term", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - length + 1), F.least("j", F.col("n") - length))).alias("start"))
    rarest = Window.partitionBy("item", "start").orderBy(F.coalesce("seen", F.lit(0)), "term", "j")
    ranked = starts.join(frequency, "term", "left").withColumn("rank", F.row_number().over(rarest))
    return ranked.where(F.col("rank") <= most).select("item", "n", "j", "term").distinct()


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(k1, k2, item, delta, low, length, exact): where runs of item words stand in a text.

    exact rows are maximal runs of at least a window of consecutive item words, at text positions low to
    low + length - 1. The others, of length 0, tell that `near` of the words of some window are in place (in
    proportion for shorter items), a proximity match. cut writes the tables on the way.
    """
    postings = index.where(F.col("pos") >= 0)
    frequency = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("seen")))
    anchor = small(cut(anchors(items, small(frequency), window, near)))
    bit = F.expr("shiftleft(1L, cast(j % 64 as int))")  # two words of one window never share it
    hits = postings.join(anchor, "term").groupBy("k1", "k2", "item", "n", (F.col("pos") - F.col("j")).alias("delta")).agg(F.bit_or(bit).alias("seen"))
    length = F.least("n", F.lit(window))
    aligned = cut(hits.where(F.bit_count("seen") >= F.least(needed(length, window, near), F.lit(2))).drop("seen"))
    wanted = aligned.join(items.select("item", "j", "term"), "item").withColumn("pos", F.col("delta") + F.col("j")).where("pos >= 0")
    there = postings.join(small(aligned.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").select("k1", "k2", "pos", "term").distinct()
    met = wanted.join(there, ["k1", "k2", "pos", "term"])
    run = Window.partitionBy("k1", "k2", "item", "delta").orderBy("j")
    close = F.count(F.lit(1)).over(run.rangeBetween(0, window - 1)) >= needed(length, window, near)
    met = met.withColumn("island", F.col("j") - F.row_number().over(run)).withColumn("close", close)
    runs = met.groupBy("k1", "k2", "item", "delta", "n", "island").agg(F.min("pos").alias("low"), F.count(F.lit(1)).cast("int").alias("length"), F.bool_or("close").alias("close"))
    exact = F.col("length") >= length
    return runs.where(exact | F.col("close")).select("k1", "k2", "item", "delta", "low", F.when(exact, F.col("length")).otherwise(0).alias("length"), exact.alias("exact"))


def indexed(docs: DataFrame, bench: DataFrame, text: str, key: str, item: str, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The words of the benchmark's items, and the index of docs for them."""
    items = cut(item_words(bench, text, item))
    vocabulary = items.select("word", "term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(DOCUMENT).alias("word"), F.xxhash64(F.lit(DOCUMENT)).alias("term")))
    return items, cut(build_index(docs, vocabulary, text, key))


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: (key, n_words, n_hit, n_items, items, contaminated, n_near_items, k1, k2).

    n_hit counts the words inside any occurrence of a benchmark window; items lists the ids of the items with
    such windows, as sorted strings joined by commas; n_near_items counts the items with a proximity match. Null
    and empty texts have no words. Repeated rows give repeated results; copies share their matches, so they make
    no hot group. Benchmark items without words have no windows; repeated items count once; an empty benchmark
    leaves all documents clean. Other columns are ignored.
    """
    items, index = indexed(docs, bench, text, key, item, cut)
    found = cut(matches(index, items, window))
    exact = found.where("exact")
    covered = exact.select("k1", "k2", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("length") - 1)).alias("pos")).distinct()
    hit = covered.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.join(items.select("item", "item_id").distinct(), "item").groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("ids"), F.count_distinct("item_id").alias("n_near_items"))
    # written by itself, so that Spark can split the rows of a frequent text that it is joined with
    each = cut(named.join(hit, ["k1", "k2"], "left").select("k1", "k2", "n_hit", F.size("ids").alias("n_items"), F.array_join(F.array_sort("ids"), ",").alias("items"), "n_near_items"))
    rows = index.where(F.col("pos") < 0).select(F.col("key").alias(key), "k1", "k2", F.col("n_words").cast("long").alias("n_words"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")]
    return rows.join(small(each), ["k1", "k2"], "left").select(key, "n_words", *zero, F.coalesce("items", F.lit("")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"), "k1", "k2")


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose text holds no benchmark window; the index goes once it has been searched."""
    scratch = Scratch()
    items, index = indexed(docs, bench, text, key, "item_id", scratch.cut)
    dirty = cut(matches(index, items, cut=scratch.cut).where("exact").select("k1", "k2").distinct())
    scratch.drop()
    k1, k2 = text_key(docs[text])
    gone = small(dirty)
    return docs.join(gone, (k1 == gone["k1"]) & (k2 == gone["k2"]), "left_anti")
