"""What several operators share: the shared scratch folder, size-checked broadcasts, text keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side may be broadcast, and the bytes that they may be estimated to take.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-leafwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, so that a lost executor costs only this step."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table made by cut() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("cut-"):
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are cut on the way to a result, and go together once the result is written."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.held.append(cut(df))
        return self.held[-1]

    def drop_one(self, df: DataFrame) -> None:
        """Removes one of the tables now; others stay."""
        self.held = [x for x in self.held if x is not df]
        drop_cut(df)

    def drop(self) -> None:
        for df in self.held:
            drop_cut(df)
        self.held = []


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a look shows at most `most` rows, of at most BROADCAST_BYTES; without one otherwise, for Spark to shuffle."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8)) + 16 for c, kind in df.dtypes)
    found = df.limit(most + 1).select(width.alias("w")).agg(F.count("w").alias("n"), F.sum("w").alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= most and (found["bytes"] or 0) <= BROADCAST_BYTES else df


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes; rows of equal text share them. Null has a key of its own."""
    absent = text.isNull().cast("int")
    return [F.xxhash64(text, absent).alias("k1"), F.xxhash64(F.lit(1), text, absent).alias("k2")]


#: The columns by which told_apart() tells rows apart.
TOLD = ["_d1", "_d2", "_d3"]


def told_apart(docs: DataFrame) -> DataFrame:
    """(_row, and TOLD): each row as a struct, with three numbers that no other row shares.

    Steps that rank rows can so work on narrow rows, and whole ones are shuffled once, to meet what was found. The first two
    are hashes of all columns but maps. Only where rows share both, which equal rows do, the third tells them apart, and the table is written to hold it.
    """
    names = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    absent = [F.col(c).isNull() for c in names]
    both = [F.xxhash64(F.lit(seed), *names, *absent).alias(d) for seed, d in enumerate(TOLD[:2])]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *both)
    if rows.groupBy(*TOLD[:2]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return rows.withColumn("_d3", F.lit(0).cast("long"))
    return cut(rows.withColumn("_d3", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), of any orderable type.

    Returns (node, root) for every node of an edge other than a root itself; root is the smallest node of the
    component. Each round hooks every node to its smallest neighbour, shortens the chains by pointer jumping and
    contracts the edges to the chains' ends, so that at least half of the nodes leave. Minima are pre-aggregated and joins are of a hot side with a
    side of distinct keys, so one huge component can be split over tasks. Self-loops, null ends and repeated
    edges are ignored; no edges give no rows.
    """
    live = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        up = cut(live.groupBy("a").agg(F.min("b").alias("p")))
        while not up.join(up.select(F.col("a").alias("p")), "p", "left_semi").isEmpty():
            over = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            old, up = up, cut(up.join(over, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
            drop_cut(old)
        hooks.append(up)
        to = lambda end: up.select(F.col("a").alias(end), F.col("p").alias(f"{end}p"))
        moved = live.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select(F.coalesce("ap", "a").alias("a"), F.coalesce("bp", "b").alias("b"))
        rest = moved.where("a <> b")
        old, live = live, cut(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        drop_cut(old)
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # the later hooks of what a node hooked to, and those of the nodes that only later rounds hooked
    root = hooks[-1].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for up in reversed(hooks[:-1]):
        later = root.select(F.col("node").alias("p"), "root")
        mine = up.join(later, "p", "left").select(F.col("a").alias("node"), F.coalesce("root", "p").alias("root"))
        root = mine.unionByName(root.join(mine.select("node"), "node", "left_anti"))
    return root
