"""Steps that took too long or sent too much to the driver at size, against plain ones."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from leafwork.functions import numbering
from leafwork.functions.text import counted_codes
from leafwork.operators import documents
from leafwork.plans import registry


def test_inherited_collects_no_nodes_for_a_broadcast(spark):
    """Over 1,200,000 roles the joins' sides, 242 MB, were sent to the driver."""
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, None), (3, 2, None), (4, 5, None), (5, 4, None)], "node long, up long, v string")
    found = documents.inherited(nodes, "node", "up", "v")
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown and "SortMergeJoin" in shown
    assert {r.node: r.effective for r in found.collect()} == {1: "a", 2: "a", 3: "a", 4: None, 5: None}


def test_code_points_are_counted_in_batches(spark, tmp_path):
    """Arrays of single characters were sorted row by row."""
    rows = [("en", "aab\n"), ("en", "é😀b"), (None, "a\0"), ("de", ""), ("de", None), ("fr", "ß" * 3)] * 200
    df = spark.createDataFrame(rows, "lang string, text string")
    want = Counter((lang, ord(c)) for lang, t in rows for c in t or "")
    got = df.mapInArrow(counted_codes, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).collect()
    assert {(r.lang, r.code): r.n for r in got} == want
    df.write.parquet(str(tmp_path / "documents.parquet"))
    query = registry.QUERIES["text_code_point_counts"](spark, str(tmp_path))
    assert "array_sort" not in query._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.lang, r.code, r.char): r.n for r in query.collect()} == {(k, c, chr(c)): n for (k, c), n in want.items()}


def test_absent_parts_of_dates_are_not_cast(spark):
    """Each failed cast of an empty part raised and caught an error, so short dates took 124 microseconds."""
    df = spark.createDataFrame([("",), ("07",), ("x1",), (None,)], "t string")
    assert [r[0] for r in df.select(numbering.whole(F.col("t"))).collect()] == [None, 7, None, None]
    plan = df.select(numbering.whole(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan
    dates = spark.createDataFrame([("2004",), ("D:200402",), ("20040203Z",), ("",), ("D:",), ("20041301",)], "d string")
    assert [r[0] for r in dates.select(F.date_format(numbering.parse_date(F.col("d")), "yyyy-MM-dd")).collect()] == ["2004-01-01", "2004-02-01", "2004-02-03", None, None, None]
