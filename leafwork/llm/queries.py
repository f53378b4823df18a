"""The registered query of each operator: production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.decontaminate import contamination
from leafwork.llm.embedding_dedup import near_vectors
from leafwork.llm.line_dedup import dedup_lines
from leafwork.llm.mixing import mix
from leafwork.llm.packing import pack
from leafwork.llm.prefix_trie import Trie
from leafwork.llm.quality import classify
from leafwork.llm.secrets import secret_spans
from leafwork.llm.sharding import shard
from leafwork.llm.simhash import near_duplicates
from leafwork.llm.suffix_dedup import dedup_strings
from leafwork.llm.token_counts import token_counts
from leafwork.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, digest, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "n_near_items")


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "phase", "slot", "place", "release", "deadline")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trie(table(spark, sf_dir, "conversations")).nodes()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ring_sharding": op2_ring_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_packing": op13_packing,
}


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    turn = "list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda u, i: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda a, b: {turn}), 4294967295)"


def codes_sql() -> str:
    """Rounds of assignment and means, a few common tables each; k numbers parts, i and j rows and positions from 1."""
    width = f"(len(embedding) // {PARTS})"
    out = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS e, {width} AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k, e[(k - 1) * w + 1:k * w] AS x FROM v, (SELECT unnest(generate_series(1, {PARTS})) AS k))",
        f"book0 AS MATERIALIZED (SELECT k, i, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v) USING (vec_id) WHERE i < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"near{r} AS MATERIALIZED (SELECT vec_id, k, min((d, i)) AS best FROM (SELECT vec_id, k, i, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM p JOIN book{r} USING (k)) GROUP BY vec_id, k)")
        if r < ROUNDS:
            mean = f"SELECT k, i, list(m ORDER BY j) AS y FROM (SELECT k, best[2] AS i, j, floor(sum(x[j])::double / count(*))::bigint AS m FROM (SELECT n.k, n.best, p.x, unnest(generate_series(1, len(p.x))) AS j FROM near{r} n JOIN p USING (vec_id, k)) GROUP BY k, best[2], j) GROUP BY k, i"
            out.append(f"book{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN ({mean}) m USING (k, i))")
    coded = f"SELECT vec_id, string_agg(lower(printf('%02x', best[2]::bigint)), '' ORDER BY k) AS code, sum(best[1])::bigint AS error FROM near{ROUNDS} GROUP BY vec_id"
    books = f"SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM book{ROUNDS}"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM ({coded}) JOIN v USING (vec_id), ({books})"


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": codes_sql(),
    "op11_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        ), h AS (
            SELECT c, c - c % 100 AS base, {crc32_sql("c::varchar")} % 6 AS h FROM (SELECT DISTINCT c FROM own)
        ), turns AS (
            SELECT h.c, o.p, o.r, o.t FROM h JOIN own o ON o.c = h.base AND o.p <= h.h
            UNION ALL SELECT h.c, o.p + 6, o.r, o.t FROM h JOIN own o ON o.c = h.c AND o.p > h.h
        ), placed AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, r, t FROM turns
        ), paths AS (
            SELECT c, d, md5(list((r, t)) OVER (PARTITION BY c ORDER BY d)::varchar) AS k, len(t) AS size FROM placed
            UNION ALL SELECT c, 0, '', 0 FROM h
        ), linked AS (
            SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM paths
        ), nodes AS (
            SELECT k, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
                   sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends
            FROM linked GROUP BY k
        ), kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up
        ), sums AS (
            SELECT a.k, count(*) FILTER (WHERE s.n IS NULL) AS leaves, sum(v.saved) AS saved
            FROM nodes v LEFT JOIN kids s ON s.up = v.k JOIN paths a ON a.c = v.c AND a.d <= v.d GROUP BY a.k
        )
        SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.n AS n_convs, coalesce(s.n, 0)::bigint AS n_children,
               sums.leaves AS n_leaves, sums.saved::bigint AS saved_tokens, v.ends AS ends_sha256
        FROM nodes v JOIN sums USING (k) LEFT JOIN kids s ON s.up = v.k LEFT JOIN nodes u ON u.k = v.up
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::double[] AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
            SELECT vec_id AS x, vec_id AS y FROM v
            UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
        ), counted AS (SELECT x, count(*)::bigint AS n FROM links GROUP BY x)
        SELECT r.x AS vec_id, coalesce(max(n), 0)::bigint AS n_links, min(y) AS component_id, r.x = min(y) AS kept
        FROM reach r LEFT JOIN counted c ON c.x = r.x GROUP BY r.x
    """,
    "op6_line_dedup": """
        WITH lines AS (
            SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), windows AS (
            SELECT doc_id, g - 1 AS pos, l[g] || chr(10) || l[g + 1] || chr(10) || l[g + 2] AS w
            FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS g FROM lines)
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM windows
        ), gone AS (
            SELECT DISTINCT doc_id, pos + o AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE rn > 1
        ), each_line AS (
            SELECT doc_id, g - 1 AS pos, l[g] AS line FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS g FROM lines)
        ), kept AS (
            SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
                   count(g.pos) AS n_removed
            FROM each_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) END::bigint AS n_lines,
               k.n_removed::bigint AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.text) END AS kept_sha256
        FROM lines d JOIN kept k ON d.doc_id = k.doc_id
    """,
}
