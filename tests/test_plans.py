"""Sides of joins that grow with the input aren't sent to all tasks, however small Spark takes them for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions.group_stats import norm01
from tellurion.operators import acquisitions, focus, graph, objects, payloads
from tellurion.operators import windows2d as w2
from tellurion.operators.shifts import moved, quads
from tellurion.plans import evidence
from tellurion.sources.views import pix, valued, whole_grid


def broadcasts(df):
    """Joins of the final plan that send a whole side to all tasks."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_whole_grid_is_merged_when_a_filter_makes_its_join_inner(spark):
    cells = spark.range(500).select((F.col("id") % 5).cast("int").alias("run_id"), (F.col("id") % 64).cast("int").alias("row"), (F.col("id") % 63).cast("int").alias("col"), F.col("id").alias("b1"))
    d = whole_grid(cells.groupBy("run_id", "row", "col").agg(F.sum("b1").alias("b1")))
    assert d.count() == 5 * 64 * 64
    assert broadcasts(d.where("b1 is not null")) == 0


def test_points_of_candidate_shifts_are_merged(spark):
    grid = spark.range(400).select(F.lit(1).alias("run_id"), (F.col("id") % 20).cast("int").alias("row"), F.floor(F.col("id") / 20).cast("int").alias("col"), F.col("id").alias("z"))
    points = grid.select("run_id", "row", "col", F.col("z").alias("a"), F.lit(0.25).alias("dx"), F.lit(-1.0).alias("dy"))
    d = moved(points, quads(grid, "z"))
    assert d.count() > 0 and broadcasts(d) == 0


def test_levels_of_payloads_are_merged(spark):
    d = spark.range(50).select("id", F.to_json(F.struct(F.struct(F.col("id").alias("lat"), F.array("id", "id").alias("at")).alias("location"))).alias("payload"))
    for out in (payloads.redacted(d, "payload"), payloads.canonical(d, "payload"), payloads.violations(d, "payload")):
        assert out.count() > 0 and broadcasts(out) == 0


def test_joins_of_component_rounds_are_merged_and_a_mask_is_written_once(spark, monkeypatch):
    seen, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda d, name: seen.append(broadcasts(d)) or write(d, name))
    at = lambda k: (F.col("id") % k).cast("int")
    mask = spark.range(4000).select(at(3).alias("run_id"), at(64).alias("row"), at(61).alias("col"), F.col("id").alias("b")).dropDuplicates(["run_id", "row", "col"])
    d = objects.connected(mask)
    assert d.count() > 0 and broadcasts(d) == 0
    assert any("stretches-" in f for f in d.inputFiles())
    o = objects.summarize(d, "b")
    assert broadcasts(objects.clusters(o)) == 0
    assert len(seen) > 4 and not any(seen)


def test_boxes_of_objects_are_merged_and_targets_are_written_once(spark):
    px = spark.range(4096).select(F.lit(1).alias("run_id"), (F.col("id") % 64).cast("int").alias("row"), F.floor(F.col("id") / 64).cast("int").alias("col"), F.col("id").cast("double").alias("b"))
    o = spark.range(9).select(F.lit(1).alias("run_id"), F.col("id").alias("object_id"), F.col("id").cast("int").alias("row_min"), (F.col("id") + 9).cast("int").alias("row_max"), F.lit(2).alias("col_min"), F.lit(7).alias("col_max"))
    f = focus.box_features(o, px, ["b"], "b", F.lit(True))
    assert f.count() == 9 and broadcasts(f) == 0
    at = px.select("run_id", F.col("row").alias("y"), F.col("col").alias("x"), F.col("b").alias("id"))
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: made.add(1) or v, "double").asNondeterministic()
    n = focus.nearest(at.withColumnRenamed("id", "point_id"), at.where("x = 63 and y = 63").select("run_id", counted("id").alias("target_id"), "y", "x"), 64)
    assert n.count() == 4096 and made.value == 1


def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    """A small file is one task's by its bytes; long work on its rows is dealt over all tasks."""
    path = str(tmp_path / "customer.parquet")
    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), F.lit("y").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).coalesce(1).write.parquet(path)
    for q in (evidence.redaction_violations, evidence.redact_text):
        assert q(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    plan = evidence.redaction_violations(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[REDACTED_HASH]") == 1  # a line is redacted once


def test_pixels_with_values_need_no_frame(spark):
    sf = "/root/testdata/sf0.001"
    inside = (F.col("row") - 32) ** 2 + (F.col("col") - 32) ** 2 <= 100
    p, v = pix(spark, sf).where(inside & F.col("b1").isNotNull()), valued(spark, sf).where(inside)
    assert p.count() > 0 and p.exceptAll(v.select(p.columns)).count() == 0 and v.count() == p.count()
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Aggregate") < plan.index("POWER")  # the filter is below the aggregation


def test_medians_sort_numbers(spark):
    """Sorted arrays hold no NULL by their type, and nothing compares values one by one in a lambda."""
    d = spark.createDataFrame([([3.0, None, 1.0, 2.0],), ([None, None],), ([4.0, 1.0],)], "a array<double>")
    m = d.select(w2.array_median(F.col("a")).alias("m"))
    assert [r.m for r in m.collect()] == [2.0, None, 2.5]
    assert "array_sort" not in m._jdf.queryExecution().optimizedPlan().toString()
    px = spark.range(64).select(F.lit(1).alias("run_id"), (F.col("id") % 8).cast("int").alias("row"), F.floor(F.col("id") / 8).cast("int").alias("col"), F.when(F.col("id") != 9, F.col("id").cast("double")).alias("z"))
    types = []
    keep = type(px).withColumn
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(px), "withColumn", lambda d, n, c: (lambda o: types.append(o.schema["_b"].dataType.containsNull) or o if n == "_b" else o)(keep(d, n, c)))
        assert w2.median_filter(px, "z", 5, "med").count() == 64
    assert types == [False]


def test_tracks_are_matched_by_all_tasks(spark):
    c = spark.range(4000).select((F.col("id") % 2000).alias("track"), F.col("id").alias("asc_id"), (F.col("id") + 9000).alias("desc_id"), F.col("id").alias("asc_ms"), (F.col("id") + 3).alias("desc_ms"), F.lit(3).cast("long").alias("dt_ms"))
    d = acquisitions.select_pairs(c)
    assert d.count() == 4000 and d.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_median_filters_hold_no_box_and_no_grid(spark, monkeypatch):
    """Boxes are made in blocks that do not grow with the grid, with the same medians over their borders; a row never holds a box."""
    monkeypatch.setattr(w2, "BLOCK", 16)
    a = np.random.default_rng(3).normal(size=(50, 37))
    a[np.random.default_rng(4).random(a.shape) < 0.1] = np.nan
    px = spark.createDataFrame([(run, y + 3, x - 20, None if np.isnan(v) else float(v), y) for run in (1, 2) for (y, x), v in np.ndenumerate(a)], "run_id int, row int, col int, z double, note int")
    d = w2.median_filters(px, {"big": ("z", 11), "small": ("z", 3)})
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "flatten" not in plan
    f = np.where(np.isnan(a), np.nanmedian(a), a)
    rows = d.where("run_id = 2").toPandas().sort_values(["row", "col"])
    assert d.count() == 2 * a.size and rows.note.tolist() == [y for y in range(50) for _ in range(37)]
    for name, size in (("big", 11), ("small", 3)):
        boxes = np.lib.stride_tricks.sliding_window_view(np.pad(f, size // 2, mode="edge"), (size, size)).reshape(*a.shape, -1)
        assert np.array_equal(rows[name].to_numpy().reshape(a.shape), np.median(boxes, axis=2))


def test_statistics_that_are_written_leave_pixels_where_they_are(spark):
    """Rows meet the written statistics of their grid without a shuffle of their own; missing pixels, flat bands and bands of few pixels give 0."""
    px = spark.range(4096).select((F.col("id") % 4).cast("int").alias("run_id"), F.when(F.col("id") % 7 > 0, F.col("id") * 0.37).alias("a"), F.lit(2.5).alias("flat"), F.when(F.col("id") < 36, F.col("id") * 1.0).alias("few"))
    d = norm01(px, {"n": "a", "f": "flat", "s": "few"}, written=True)
    rows = d.toPandas()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    for _, g in rows.groupby("run_id"):
        lo, hi = np.nanpercentile(g.a, [2, 98])
        assert np.allclose(g.n, np.where(g.a.isna(), 0, np.clip((g.a - lo) / (hi - lo), 0, 1)), atol=1e-12)
    assert set(rows.f) == set(rows.s) == {0.0}
    assert norm01(px, {"n": "a", "f": "flat", "s": "few"}).exceptAll(d).isEmpty()
