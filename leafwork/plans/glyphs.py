"""Queries over glyph bitmaps, read from vectors, and over models."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.operators import glyphs, models
from leafwork.operators.ranges import ranked
from leafwork.sources.tables import GLYPHS_SQL, glyphs_of, table

#: A small fixed network: 64 inputs, three hidden units, ten classes, weights in sixteenths.
_RANDOM = random.Random(7)
_W1 = [[_RANDOM.randrange(-8, 9) / 16 for _ in range(64)] for _ in range(3)]
_W2 = [[_RANDOM.randrange(-16, 17) / 16 for _ in range(3)] for _ in range(10)]
NETWORK = [models.Layer(_W1, [0.25, -0.25, 0.0], "relu"), models.Layer(_W2, [i / 16 for i in range(10)], "softmax")]
FOREST = [
    models.Node(0, 0.0, models.Node(1, 0.5, models.Node(label=1), models.Node(label=2)), models.Node(label=3)),
    models.Node(2, 0.25, models.Node(label=2), models.Node(3, -0.25, models.Node(label=1), models.Node(label=3))),
    models.Node(5, 0.0, models.Node(label=3), models.Node(label=2)),
]


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs_of(table(spark, sf_dir, "embeddings"))


def keyed(df: DataFrame) -> DataFrame:
    """Bitmaps as text, which both engines hash alike."""
    return df.withColumn("bitmap", F.md5(F.array_join(F.transform("bitmap", lambda v: v.cast("string")), ",")))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs in black and white, all pixels, so that bitmaps repeat."""
    return source(spark, sf_dir).withColumn("bitmap", F.transform("bitmap", lambda v: F.when(v > 0, 255).otherwise(0)))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.merge(coarse(spark, sf_dir)).withColumn("bitmap", F.array_join("bitmap", ","))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = coarse(spark, sf_dir).withColumn("unicode", F.element_at(F.array(*map(F.lit, (0x2D, 0x2010, 0x2013, 0x3BC, 0xB5, 0x20, 0xA0, 0x41, 0x42, 0x2126))), F.col("unicode") + 1))
    return glyphs.fold(glyphs.merge(codes)).withColumn("bitmap", F.array_join("bitmap", ","))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.statistics(glyphs.merge(coarse(spark, sf_dir)))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.best_code_point(glyphs.merge(coarse(spark, sf_dir))).withColumn("bitmap", F.array_join("bitmap", ","))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = glyphs.merge(source(spark, sf_dir)).groupBy("unicode").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))
    return rows.where("variants >= 10")


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderkey") * 7919 % 0x110000
    return table(spark, sf_dir, "orders").agg(F.count_if(glyphs.is_private(code)).alias("private"), F.count_if(glyphs.is_control(code)).alias("control"), F.count(F.lit(1)).alias("n"), F.min(code).alias("least"), F.max(code).alias("most"), F.count_distinct(code).alias("different"))


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.average(source(spark, sf_dir))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.rank_and_cut(glyphs.distances(source(spark, sf_dir)), 0.1).select("vec_id", "unicode", "distance", "valid")


def downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).select("vec_id", F.posexplode(glyphs.downscale(F.col("bitmap"), 8, 2, 8)).alias("pos", "v"))


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels over 10 are white; what is left is ink."""
    image = F.transform("bitmap", lambda v: F.when(v > 10, 255).otherwise(v))
    rows = source(spark, sf_dir).select("vec_id", image.alias("bitmap"))
    return rows.select("vec_id", *[c.alias(k) for k, c in glyphs.ink_box(F.col("bitmap"), 8).items()], glyphs.touches_edge(F.col("bitmap"), 8, 8).alias("clipped"), glyphs.is_blank(F.col("bitmap")).alias("blank"))


def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = glyphs.quartiles(F.col("bitmap"))
    return source(spark, sf_dir).select("vec_id", q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), F.aggregate(glyphs.bilevel(F.col("bitmap")), F.lit(0), lambda a, x: a + x).alias("white"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.folds(source(spark, sf_dir), 5).groupBy("unicode", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.mahalanobis(source(spark, sf_dir), 8, 8, 4).withColumn("distance", F.round("distance", 5))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return models.predict_distinct(rows, "x", NETWORK)


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probabilities")
    return scored(spark, sf_dir).select("vec_id", "label", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("predicted"), F.round(F.array_max(p), 6).alias("probability"), models.accepted(p, F.col("label")).alias("accepted"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.metrics(network(spark, sf_dir), "label", "predicted")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.confusion(network(spark, sf_dir), "label", "predicted")


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = models.forest_votes(FOREST, F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", votes[0]["label"].alias("predicted"), F.round(votes[0]["share"], 6).alias("share"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.class_weights(table(spark, sf_dir, "embeddings"), "label").select("label", "n", "weight", F.col("index").cast("int").alias("index"))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.split_entropy(table(spark, sf_dir, "part"), "p_size", "p_type")


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.covariances(source(spark, sf_dir), 64).withColumn("covariance", F.round("covariance", 4))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for code points of all kinds."""
    codes = coarse(spark, sf_dir).withColumn("unicode", F.element_at(F.array(*map(F.lit, (0xE001, 0x7F, 0x41, 0x42, 0xF0000, 0x20, 0x61, 0x62, 0x63, 0x64))), F.col("unicode") + 1))
    return glyphs.counters(glyphs.merge(codes), 3)


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = glyphs.cumulative(glyphs.merge(coarse(spark, sf_dir)))
    return found.select("unicode", F.md5(F.array_join("bitmap", ",")).alias("bitmap"), F.round("reached", 6).alias("reached"))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from glyph 7; those from 1.2 on are switched off."""
    measured = glyphs.likeness(source(spark, sf_dir), 7).withColumn("distance", F.round("distance", 6)).withColumn("valid", F.lit(True))
    return glyphs.activated(measured, "distance", low=1.2, on=False).select("vec_id", "distance", "valid")


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = (F.col("vec_id") % 3 - 1).cast("int"), (F.col("vec_id") % 5 - 2).cast("int")
    moved = glyphs.jittered(F.col("bitmap"), 8, 8, dx, dy)
    return source(spark, sf_dir).select("vec_id", F.md5(F.array_join(moved, ",")).alias("digest"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyphs.balanced_sample(source(spark, sf_dir), 3.0).select("vec_id", "unicode")


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points by how often they occur: as many rows as classes."""
    counted = glyphs.merge(source(spark, sf_dir)).groupBy("unicode").agg(F.sum("n").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy("n", "unicode")))


def loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scored(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(models.loss(F.col("probabilities"), F.col("label"))), 6).alias("loss"))
    return by


def heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of event that weighs most for each user, in cents."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("w"))
    return models.weighted_class(events, "user_id", "event_type", "w")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.histogram(table(spark, sf_dir, "part"), "p_type")


def resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs behind the third of each code point, by four measures of their ink in turn."""
    first = ranked(ink(spark, sf_dir).join(source(spark, sf_dir).select("vec_id", "unicode"), "vec_id"), ["unicode"], ["vec_id"], F.floor(F.col("vec_id") / 65_536))
    parts = [glyphs.resorted(first, by, 3).select("unicode", "vec_id", F.lit(by).alias("measure"), F.col("rank").cast("long").alias("rank")) for by in ("ink_height", "ink_width", "top", "bottom")]
    return reduce(DataFrame.unionByName, parts)


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black-and-white bitmaps whose code point is sure; draws are no matter of SQL, a test stands for it."""
    return glyphs.confident(merged(spark, sf_dir))


QUERIES = {
    "glyph_resorted": resorted, "glyph_confident": confidence,
    "glyph_merged": merged, "glyph_folded": folded, "glyph_statistics": statistics, "glyph_best_code_point": best, "glyph_variants": variants, "glyph_buckets": buckets,
    "glyph_averages": averages, "glyph_ranks": ranks, "glyph_downscaled": downscaled, "glyph_ink": ink, "glyph_quartiles": quartiles, "glyph_folds": folds,
    "glyph_mahalanobis": mahalanobis, "glyph_covariance": covariance, "model_network": network, "model_accuracy": accuracy, "model_confusion": confusion,
    "model_forest": forest, "model_class_weights": weights, "model_split_entropy": entropy,
    "glyph_counters": counters, "glyph_cumulative": cumulative, "glyph_similar": similar, "glyph_jittered": jittered, "glyph_balanced_sample": sampled, "glyph_abundance": abundance, "model_loss": loss, "model_weighted_class": heaviest, "model_histogram": histogram,
}

COARSE_SQL = f"(SELECT source, unicode, n, array_to_string(list_transform(bitmap, lambda v: CASE WHEN v > 0 THEN 255 ELSE 0 END), ',') AS bitmap FROM {GLYPHS_SQL})"
MERGED_SQL = "(SELECT unicode, bitmap, sum(n)::bigint AS n FROM (SELECT source, unicode, bitmap, max(n) AS n FROM {of} GROUP BY source, unicode, bitmap) GROUP BY unicode, bitmap)"
COARSE_MERGED = MERGED_SQL.format(of=COARSE_SQL)


def _network_sql() -> str:
    hidden = ", ".join(f"greatest(list_sum(list_transform(list_zip(e, {w}::double[]), lambda p: p[1] * p[2])) + {b}, 0)::double" for w, b in zip(_W1, NETWORK[0].bias, strict=True))
    out = ", ".join(" + ".join([f"h[{i + 1}] * {v}::double" for i, v in enumerate(w)] + [f"{b}::double"]) for w, b in zip(_W2, NETWORK[1].bias, strict=True))
    return f"""(SELECT vec_id, label, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (
            SELECT vec_id, label, list_transform(o, lambda v: exp(v - list_max(o))) AS x FROM (
                SELECT vec_id, label, [{out}] AS o FROM (SELECT vec_id, label, [{hidden}] AS h FROM (SELECT vec_id, label, embedding::double[] AS e FROM embeddings)))))"""


SCORES_SQL = _network_sql()
NETWORK_SQL = f"""(SELECT vec_id, label, (list_position(p, list_max(p)) - 1)::int AS predicted, round(list_max(p), 6) AS probability,
            list_max(p) >= 0.25 AND p[label + 1] <= 0.01 AND list_position(p, list_max(p)) - 1 <> label AS accepted FROM {SCORES_SQL})"""
ORACLE_SQL = {
    "glyph_merged": f"SELECT * FROM {COARSE_MERGED}",
    "glyph_folded": "SELECT u AS unicode, bitmap, sum(n)::bigint AS n FROM (SELECT CASE unicode WHEN 8208 THEN 45 WHEN 8211 THEN 45 WHEN 956 THEN 181 WHEN 160 THEN 32 WHEN 8486 THEN 937 ELSE unicode END AS u, bitmap, n FROM "
    + MERGED_SQL.format(of=f"(SELECT source, [45, 8208, 8211, 956, 181, 32, 160, 65, 66, 8486][unicode + 1] AS unicode, n, bitmap FROM {COARSE_SQL})") + ") GROUP BY u, bitmap",
    "glyph_statistics": f"SELECT count(*)::bigint AS bitmaps, sum(k)::bigint AS combinations, count(*) FILTER (WHERE k > 1)::bigint AS multiple, round(count(*) FILTER (WHERE k > 1) / count(*), 6) AS share FROM (SELECT bitmap, count(*) AS k FROM {COARSE_MERGED} GROUP BY bitmap)",
    "glyph_best_code_point": f"SELECT bitmap, unicode, n, round(n / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY bitmap) AS total, row_number() OVER (PARTITION BY bitmap ORDER BY n DESC, unicode DESC) AS rn FROM {COARSE_MERGED}) WHERE rn = 1",
    "glyph_variants": "SELECT unicode, count(*)::bigint AS variants, sum(n)::bigint AS n FROM " + MERGED_SQL.format(of=GLYPHS_SQL) + " GROUP BY unicode HAVING count(*) >= 10",
    "glyph_buckets": """SELECT count(*) FILTER (WHERE c BETWEEN 57344 AND 63743 OR c BETWEEN 983040 AND 1048573 OR c BETWEEN 1048576 AND 1114109)::bigint AS private,
        count(*) FILTER (WHERE c BETWEEN 0 AND 32 OR c BETWEEN 127 AND 159 OR c BETWEEN 65520 AND 65535)::bigint AS control, count(*)::bigint AS n, min(c)::bigint AS least, max(c)::bigint AS most, count(DISTINCT c)::bigint AS different
        FROM (SELECT o_orderkey * 7919 % 1114112 AS c FROM orders)""",
    "glyph_averages": f"SELECT unicode, pos, round(avg(v / 255.0), 6) AS mean FROM (SELECT unicode, unnest(bitmap)::double AS v, unnest(range(64))::int AS pos FROM {GLYPHS_SQL}) GROUP BY unicode, pos",
    "glyph_ranks": f"""WITH px AS (SELECT vec_id, unicode, unnest(bitmap)::double / 255 AS v, unnest(range(64)) AS pos FROM {GLYPHS_SQL}),
        means AS (SELECT unicode, pos, avg(v) AS m FROM px GROUP BY unicode, pos),
        d AS (SELECT vec_id, unicode, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM px JOIN means USING (unicode, pos) GROUP BY vec_id, unicode)
        SELECT vec_id, unicode, distance, row_number() OVER (PARTITION BY unicode ORDER BY distance, vec_id) <= count(*) OVER (PARTITION BY unicode) - floor(count(*) OVER (PARTITION BY unicode) * 0.1) AS valid FROM d""",
    "glyph_downscaled": f"SELECT vec_id, (y * 4 + x)::int AS pos, (bitmap[y * 16 + x * 2 + 1] + bitmap[y * 16 + x * 2 + 2] + bitmap[y * 16 + x * 2 + 9] + bitmap[y * 16 + x * 2 + 10])::double / 4 AS v FROM {GLYPHS_SQL}, range(4) a(x), range(4) b(y)",
    "glyph_resorted": f"""WITH px AS (SELECT vec_id, unicode, unnest(bitmap) AS v, unnest(range(64)) AS i FROM {GLYPHS_SQL}), inked AS (SELECT vec_id, unicode, i // 8 AS y, i % 8 AS x, v <= 10 AS black FROM px),
        sized AS (SELECT vec_id, unicode, coalesce(min(y) FILTER (WHERE black), -1) AS top, coalesce(max(y) FILTER (WHERE black), -1) AS bottom,
               coalesce(max(y) FILTER (WHERE black) - min(y) FILTER (WHERE black) + 1, 0) AS ink_height, coalesce(max(x) FILTER (WHERE black) - min(x) FILTER (WHERE black) + 1, 0) AS ink_width FROM inked GROUP BY vec_id, unicode),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY unicode ORDER BY vec_id) AS first FROM sized),
        long AS (SELECT unicode, vec_id, first, unnest(['ink_height', 'ink_width', 'top', 'bottom']) AS measure, unnest([ink_height, ink_width, top, bottom]) AS size FROM ordered)
        SELECT unicode, vec_id, measure, (row_number() OVER (PARTITION BY unicode, measure ORDER BY least(first, 4), CASE WHEN first > 3 THEN size ELSE 0 END, vec_id))::bigint AS rank FROM long""",
    "glyph_ink": f"""WITH px AS (SELECT vec_id, unnest(bitmap) AS v, unnest(range(64)) AS i FROM {GLYPHS_SQL}), inked AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v <= 10 AS black FROM px)
        SELECT vec_id, coalesce(min(y) FILTER (WHERE black), -1)::int AS top, coalesce(max(y) FILTER (WHERE black), -1)::int AS bottom,
               coalesce(max(y) FILTER (WHERE black) - min(y) FILTER (WHERE black) + 1, 0)::int AS ink_height, coalesce(max(x) FILTER (WHERE black) - min(x) FILTER (WHERE black) + 1, 0)::int AS ink_width,
               bool_or(black AND (x IN (0, 7) OR y IN (0, 7))) AS clipped, NOT bool_or(black) AS blank FROM inked GROUP BY vec_id""",
    "glyph_quartiles": f"""SELECT vec_id, s[floor(n * 0.25)::int + 1] AS q1, s[floor(n * 0.5)::int + 1] AS q2, s[floor(n * 0.75)::int + 1] AS q3, (255 * len(list_filter(s, lambda v: v > 0)))::int AS white
        FROM (SELECT vec_id, list_sort(bitmap) AS s, len(list_filter(bitmap, lambda v: v < list_max(bitmap))) AS n FROM {GLYPHS_SQL})""",
    "glyph_folds": f"SELECT unicode, fold, count(*)::bigint AS n, sum(vec_id)::bigint AS ids FROM (SELECT unicode, vec_id, ((row_number() OVER (PARTITION BY unicode ORDER BY md5(vec_id::varchar)) - 1) % 5)::int AS fold FROM {GLYPHS_SQL}) GROUP BY unicode, fold",
    "glyph_covariance": f"""SELECT unicode, i, j, round((sum(bitmap[i + 1]::double * bitmap[j + 1]) - sum(bitmap[i + 1]::double) * sum(bitmap[j + 1]::double) / count(*)) / (count(*) - 1), 4) AS covariance
        FROM {GLYPHS_SQL}, (SELECT unnest(range(64))::int AS i) a, (SELECT unnest(range(64))::int AS j) b GROUP BY unicode, i, j""",
    "glyph_counters": f"""SELECT count(*) FILTER (WHERE k = 1)::bigint AS single, count(*) FILTER (WHERE k > 1)::bigint AS multiple, sum(private)::bigint AS private, sum(control)::bigint AS control, sum(rare)::bigint AS rare, count(*) FILTER (WHERE blank)::bigint AS blank FROM (
        SELECT bitmap, count(*) AS k, count(*) FILTER (WHERE unicode IN (0, 4)) AS private, count(*) FILTER (WHERE unicode IN (1, 5)) AS control, count(*) FILTER (WHERE n < 3) AS rare, NOT contains(',' || bitmap || ',', ',0,') AS blank FROM {COARSE_MERGED} GROUP BY bitmap)""",
    "glyph_cumulative": f"SELECT unicode, md5(bitmap) AS bitmap, round(sum(n) OVER (PARTITION BY bitmap ORDER BY n DESC, unicode DESC) / sum(n) OVER (PARTITION BY bitmap), 6) AS reached FROM {COARSE_MERGED}",
    "glyph_similar": f"SELECT vec_id, distance, distance < 1.2 AS valid FROM (SELECT g.vec_id, round(sqrt(list_sum(list_transform(list_zip(g.bitmap, c.bitmap), lambda p: (p[1] - p[2]) * (p[1] - p[2]) / 65025.0::double))), 6) AS distance FROM {GLYPHS_SQL} g, (SELECT bitmap FROM {GLYPHS_SQL} WHERE vec_id = 7) c)",
    "glyph_jittered": f"""SELECT vec_id, md5(array_to_string(list_transform(range(64), lambda i: CASE WHEN i % 8 - (vec_id % 3 - 1) BETWEEN 0 AND 7 AND i // 8 - (vec_id % 5 - 2) BETWEEN 0 AND 7
        THEN bitmap[(i // 8 - (vec_id % 5 - 2)) * 8 + i % 8 - (vec_id % 3 - 1) + 1] ELSE 255 END), ',')) AS digest FROM {GLYPHS_SQL}""",
    "glyph_balanced_sample": f"SELECT vec_id, unicode FROM (SELECT *, count(*) OVER (PARTITION BY unicode) AS k FROM {GLYPHS_SQL}) WHERE ('0x' || md5(vec_id::varchar)[:8])::bigint / 4294967296.0::double < 3.0::double * pow(k, -0.5)",
    "glyph_abundance": f"SELECT unicode, n, row_number() OVER (ORDER BY n, unicode)::int AS rank FROM (SELECT unicode, sum(n)::bigint AS n FROM " + MERGED_SQL.format(of=GLYPHS_SQL) + " GROUP BY unicode)",
    "model_loss": f"SELECT label, count(*)::bigint AS n, round(avg(-ln(p[label + 1])), 6) AS loss FROM {SCORES_SQL} GROUP BY label",
    "model_weighted_class": "SELECT user_id, event_type, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type DESC) AS rn FROM (SELECT user_id, event_type, sum(round(value * 100)::bigint)::bigint AS w FROM events GROUP BY ALL)) WHERE rn = 1",
    "model_histogram": "SELECT p_type, n, CASE WHEN n = max(n) OVER () THEN 'most' WHEN n = min(n) OVER () THEN 'least' END AS extreme FROM (SELECT p_type, count(*)::bigint AS n FROM part GROUP BY p_type)",
    "model_network": f"SELECT * FROM {NETWORK_SQL}",
    "model_accuracy": f"SELECT sum(n)::bigint AS n, round(sum(k) / sum(n), 6) AS micro, round(avg(k / n), 6) AS macro FROM (SELECT label, count(*) FILTER (WHERE label = predicted) AS k, count(*) AS n FROM {NETWORK_SQL} GROUP BY label)",
    "model_confusion": f"SELECT label, predicted, count(*)::bigint AS n, round(100.0::double * count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS percent FROM {NETWORK_SQL} GROUP BY label, predicted",
    "model_forest": """SELECT vec_id, x AS predicted, round(k / 3.0::double, 6) AS share FROM (
            SELECT vec_id, x, count(*) AS k, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, x) AS rn FROM (
                SELECT vec_id, unnest([CASE WHEN embedding[1] <= 0 THEN CASE WHEN embedding[2] <= 0.5 THEN 1 ELSE 2 END ELSE 3 END,
                    CASE WHEN embedding[3] <= 0.25 THEN 2 ELSE CASE WHEN embedding[4] <= -0.25 THEN 1 ELSE 3 END END,
                    CASE WHEN embedding[6] <= 0 THEN 3 ELSE 2 END]) AS x FROM embeddings) GROUP BY vec_id, x) WHERE rn = 1""",
    "model_class_weights": "SELECT label, count(*)::bigint AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight, (dense_rank() OVER (ORDER BY label) - 1)::int AS \"index\" FROM embeddings GROUP BY label",
    "model_split_entropy": """WITH vals AS (SELECT DISTINCT p_size AS v FROM part), cuts AS (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM vals),
        sides AS (SELECT c.v, c.w, p.p_type, p.p_size <= c.v AS low, count(*)::double AS n FROM cuts c, part p WHERE c.w IS NOT NULL GROUP BY ALL),
        each AS (SELECT v, w, low, sum(n) AS s, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS e FROM sides GROUP BY v, w, low)
        SELECT (v + w) / 2.0::double AS threshold, round(sum(e) / sum(s), 6) AS entropy FROM each GROUP BY v, w""",
}
