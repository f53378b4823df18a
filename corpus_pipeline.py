"""A corpus pipeline of five of the operators, each stage written as Parquet and read again by the next.

The quality classifier drops what it rejects; of each group of exact or near copies (by five-word shingles)
the document of the smallest id stays; documents that hold benchmark passages go; the rest is put in the order of a mixture by target weights; and every
document gets its shard, whose slots follow that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.common import TOLD, cut, told_apart
from leafwork.llm.decontaminate import clean
from leafwork.llm.mixing import BLOCK, in_order, mix
from leafwork.llm.quality import classify
from leafwork.llm.sharding import ADDED, by_turn, dealt, measures
from leafwork.llm.simhash import distinct_documents


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained with the labels table, keeps."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one of the smallest id, and one text of each group of those that share 0.8 of their five-word shingles."""
    return distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of ten words of the benchmark table."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows that follow the mixture's schedule."""
    rows = told_apart(docs)
    turns = cut(mix(rows.select("_row.doc_id", "_row.source", *TOLD)).select(*TOLD, "slot", "place"))
    return in_order(rows.join(turns, TOLD)).select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and their slot in it; slots follow the mixture's schedule.

    Tables keep no order of rows, so the schedule, which depends on the rows alone, is made again. Schedule, shards and slots are found on
    narrow rows; whole ones are shuffled once, to meet theirs. Columns called like the added ones are replaced.
    """
    rows = told_apart(docs)
    narrow = cut(rows.select("_row.doc_id", "_row.source", *TOLD, *measures("_row.text", "_row.doc_id")))
    turn = (F.col("slot") * BLOCK + F.col("place")).alias("_turn")
    placed = by_turn(dealt(cut(mix(narrow).select(*[c for c in narrow.columns if c not in ("doc_id", "source")], turn))))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return rows.join(placed.select(*TOLD, *ADDED), TOLD).select(*kept, *ADDED)


STAGES = [("quality classifier", good), ("simhash near-dedup", distinct), ("benchmark decontamination", decontaminated), ("mixing to target weights", mixed), ("sharding", sharded)]

#: SQL expresses neither the trained classifier nor the walk around the ring; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
