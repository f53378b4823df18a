"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong parts count by themselves: assigned secrets, access identifiers and hexadecimal runs. Weak candidates (user
identifiers, long mixed strings, endpoints) are everywhere in ordinary text and count only if an interval join finds
a complementary part within the same scope, a stretch of SCOPE code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut, text_key

#: Code points that may lie between parts of one credential.
SCOPE = 300
#: Fixed: kind, pattern, group whose length counts, least length. Matches are leftmost and do not overlap.
STRONG = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 is found whether or not shorter runs are looked at
]
WEAK = [
    ("ident", r"""(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("blob", r"(?<![A-Za-z0-9+/])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40,}", 0, 40),
    ("endpoint", r"""https?://[^\x00-\x20"'<>]+""", 0, 11),
]
KINDS = [x[0] for x in STRONG + WEAK]
#: What makes each weak kind count.
COMPLEMENTS = [("ident", "assign"), ("ident", "hex"), ("ident", "blob"), ("blob", "access"), ("blob", "ident"), ("endpoint", "assign"), ("endpoint", "hex"), ("endpoint", "access")]
#: A cheap necessary condition for each pattern; a text without it isn't searched further.
HINTS = {"access": lambda t: t.contains("AKIA"), "endpoint": lambda t: t.contains("://")}


def found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (kind, at, before, length, value): the matches in order, each with the length of the gap before it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    parts = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("before"), F.length(x["whole"]).alias("n"), F.length(x["value"]).alias("value")))
    hint = HINTS.get(kind, lambda t: t.rlike(pattern))(text)
    return F.when(hint, F.filter(parts, lambda x: x["n"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,at:int,before:int,n:int,value:int>>"))


def parts_of(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, kind, start, end) of every match of every distinct text, in code points, end exclusive."""
    arrays = F.concat(*[found(F.col("text"), kind, pattern, group) for kind, pattern, group, _ in STRONG + WEAK])
    rows = docs.select(*text_key(F.col(text)), F.col(text).alias("text")).select("k1", "k2", F.inline(arrays))
    # equal texts have equal matches: one of each is enough
    rows = rows.groupBy("k1", "k2", "kind", "at").agg(F.min("before").alias("before"), F.min("n").alias("n"), F.min("value").alias("value"))
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("n")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    least = F.create_map(*[F.lit(x) for kind, _, _, n in STRONG + WEAK for x in (kind, n)])
    return rows.where(F.col("value") >= least[F.col("kind")]).select("k1", "k2", "kind", "start", "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with a complementary part at most `scope` code points away.

    An interval join: both sides are cut into cells of `scope` code points and meet by text and cell; left semi, so
    that a part with many partners is one row.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    weak = parts.where(F.col("kind").isin([x[0] for x in WEAK])).withColumn("cell", cells(F.col("start"), F.col("end")))
    needs = F.explode(F.array(*[F.struct(F.lit(w).alias("need"), F.lit(p).alias("by")) for w, p in COMPLEMENTS]))
    other = parts.select("k1", "k2", F.col("kind").alias("other"), F.col("start").alias("low"), F.col("end").alias("high"), needs.alias("x")).where("x.by = other").select("k1", "k2", F.col("x.need").alias("kind"), "low", "high")
    other = other.withColumn("cell", cells(F.greatest(F.col("low") - scope, F.lit(0)), F.col("high") + scope))
    near = (F.col("w.start") <= F.col("o.high") + scope) & (F.col("o.low") <= F.col("w.end") + scope)
    on = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in ("k1", "k2", "kind", "cell")]
    return weak.alias("w").join(other.alias("o"), [*on, near], "left_semi").select(*parts.columns).distinct()


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: (key, n_assign, n_access, n_hex, n_linked, base_sha256, spans).

    spans lists kind:start:end of the strong and the linked weak parts by start, then kind in the order of KINDS;
    base_sha256 digests the strong ones alone. Null and empty texts have no spans (and the digest of the empty
    string). Repeated rows give repeated results; a text is linked once however often it occurs, so copies make no
    hot group. Only matches are shuffled, never texts. Other columns are ignored.
    """
    parts = cut(parts_of(docs, text))  # three readers; the texts are searched once
    strong = parts.where(F.col("kind").isin([x[0] for x in STRONG]))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = strong.unionByName(linked(parts, scope)).withColumn("span", F.struct("start", rank.alias("rank"), "kind", "end"))
    written = lambda of: F.array_join(F.transform(F.array_sort(of), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["rank"] <= len(STRONG))
    each = spans.groupBy("k1", "k2").agg(F.collect_list("span").alias("all"), *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in STRONG], F.count_if(F.col("span.rank") > len(STRONG)).alias("n_linked"))
    each = each.select("k1", "k2", "n_assign", "n_access", "n_hex", "n_linked", F.sha2(written(base), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
    rows = docs.select(F.col(key), *text_key(F.col(text)))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_linked")]
    return rows.join(each, ["k1", "k2"], "left").select(F.col(key), *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
