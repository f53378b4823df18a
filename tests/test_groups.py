"""Groups handed on many at a time, and columns of tables by bisection, against plain ones."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from leafwork.operators import groups, layout, rendering


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_groups_are_whole_in_batches_of_any_size(spark, batch):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, l int, v long")

    def joined(table, starts):
        at = starts.tolist()
        v = table["v"].to_pylist()
        return pa.table({"k": table["k"].take(pa.array(at[:-1])), "l": table["l"].take(pa.array(at[:-1])), "vs": pa.array([v[i:j] for i, j in zip(at, at[1:], strict=False)], pa.list_(pa.int64()))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.k, r.l): list(r.vs) for r in groups.by_groups(df, ["k", "l"], ["v"], joined, "k string, l int, vs array<long>").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for k, l, v in rows:
        want.setdefault((k, l), []).append(v)
    assert got == want


def test_no_pandas_frame_for_each_group(spark):
    """A frame for each page or paragraph took 25 to 134 seconds over sf0.1."""
    words = spark.createDataFrame([(1, 0, 1, 1, 0.0, 1.0, 0.0, 1.0, 0.0, "a", 1.0, 0.0)], "doc_id long, page int, cluster_id int, word_id long, x1 double, x2 double, y1 double, y2 double, baseline double, text string, font_size double, row double")
    boxes = spark.createDataFrame([(1, 0, 1, "UNKNOWN", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, box_id long, category string, x1 double, y1 double, x2 double, y2 double")
    near = spark.createDataFrame([(1, 0, 1, 2, 0.5)], "doc_id long, page int, script_id long, target_id long, distance double")
    for df in (rendering.rendered_tables(words), layout.align_baselines(words), layout.cluster_words(words), layout.data_regions(boxes), layout.attach_scripts(near)):
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 1


def test_shadows_travel_without_their_texts(spark):
    rows = [(1, 1, "ab", 0.0, 0.0, 9.0, 8.0), (1, 2, "ab", 0.3, 0.2, 9.3, 8.2), (1, 3, "ac", 0.3, 0.2, 9.3, 8.2), (1, 4, None, 0.0, 0.0, 9.0, 8.0), (1, 5, None, 0.3, 0.2, 9.3, 8.2), (2, 6, "ab", 0.3, 0.2, 9.3, 8.2)]
    df = spark.createDataFrame(rows, "page long, id long, text string, x1 double, y1 double, x2 double, y2 double")
    kept = rendering.without_shadows(df, "page")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 6]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    copies = [line for line in plan.splitlines() if "Generate explode" in line]
    assert copies and not any("text" in line for line in copies)


def test_columns_against_all_known_positions():
    rng = random.Random(8)
    for _ in range(300):
        known, columns = [], rendering.Columns()
        for _ in range(rng.randrange(12)):
            at, column = rng.randrange(20) / 2, rng.randrange(40)
            known.append((at, column))
            columns.add(at, column)
        x, most = rng.randrange(44) / 4 - 1, rng.choice([0.3, 0.9, 3.0])
        first = min(known, key=lambda k: abs(k[0] - x), default=None)
        assert columns.nearest(x, most) == (first[1] if first and abs(first[0] - x) <= most else None)
        low = max((k for k in known if k[0] <= x), key=lambda k: k[0], default=None)
        high = min((k for k in known if k[0] >= x), key=lambda k: k[0], default=None)
        want = None if low is None or high is None else low[1] if low[0] == high[0] else int(low[1] + (x - low[0]) * (high[1] - low[1]) / (high[0] - low[0]))
        assert columns.between(x) == want
