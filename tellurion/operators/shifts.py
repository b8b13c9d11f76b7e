"""Co-registration of grid pairs: a shift search with a plane taken off at every shift, and the change that is left.

A pair's search is one group: its sampled points (at most ``most``, every n-th in scan
order) and the second grid's pixels in the small cells around them.  There every
candidate shift takes its values by bilinear weights and fits its own plane, first whole
pixels, then quarter pixels around the best one.  Points are never exploded by candidates,
so what is sent grows with the pixels, and a group is bounded by ``most``, whatever the grid's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.group_stats import quantile
from tellurion.operators.evidence import robust_plane
from tellurion.sources.scratch import materialise
from tellurion.sources.views import spread

REACH = 3
#: Pixels from a point to the last source of a candidate: whole and quarter shifts, and the next pixel.
FAR = REACH + 1
#: Side of the cells in which pixels are looked for; at least 2 * FAR, so a point reaches four of them at most.
CELL = 8
# What residuals on stable ground may be at most, in metres.
GATES = (("stable_rmse", 0.15), ("stable_abs_median", 0.05), ("stable_p95_abs", 0.30), ("plane_drift", 0.10))
#: Quantiles of the change in the target, from one pass over its values.
CHANGES = {"median_change": 0.5, "p05_change": 0.05, "p10_change": 0.1, "p90_change": 0.9, "p95_change": 0.95}


def quads(grid: DataFrame, z: str) -> DataFrame:
    """run_id, row, col and the values q00, q10 (next column), q01 (next row), q11 of every pixel of whole grids that has all four."""
    across, down = Window.partitionBy("run_id", "row").orderBy("col"), Window.partitionBy("run_id", "col").orderBy("row")
    d = grid.select("run_id", "row", "col", F.col(z).cast("double").alias("q00")).withColumn("q10", F.lead("q00").over(across))
    return d.withColumns({"q01": F.lead("q00").over(down), "q11": F.lead("q10").over(down)}).dropna(subset=["q00", "q10", "q01", "q11"])


def moved(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` (run_id, row, col, dx, dy and others) with b, the value of the grid moved by (dx, dy) pixels; points without four sources go."""
    low = lambda d: F.floor(-F.col(d)).cast("int")
    p = points.withColumns({"_r": F.col("row") + low("dy"), "_c": F.col("col") + low("dx"), "_fx": -F.col("dx") - low("dx"), "_fy": -F.col("dy") - low("dy")})
    # Points of many candidates, and written quads, are larger than Spark takes them for: merged, as all joins by pixel here.
    j = p.hint("merge").join(cells.withColumnsRenamed({"row": "_r", "col": "_c"}), ["run_id", "_r", "_c"])
    fx, fy = F.col("_fx"), F.col("_fy")
    b = F.col("q00") * (1 - fx) * (1 - fy) + F.col("q10") * fx * (1 - fy) + F.col("q01") * (1 - fx) * fy + F.col("q11") * fx * fy
    return j.withColumn("b", b).drop("_r", "_c", "_fx", "_fy", "q00", "q10", "q01", "q11")


def stable_points(pre: DataFrame, post: DataFrame, z: str, stable: str | None, least_stable: int, most: int) -> DataFrame:
    """run_id, row, col, a: every n-th stable pixel in scan order that both grids have, at most ``most`` of a pair; pairs with fewer than ``least_stable`` give none."""
    a = pre.where(F.col(stable)) if stable else pre
    both = a.select("run_id", "row", "col", F.col(z).cast("double").alias("a")).hint("merge").join(post.select("run_id", "row", "col", F.col(z).alias("_b")), ["run_id", "row", "col"]).dropna(subset=["a", "_b"]).drop("_b")
    # Place in scan order by counts of rows, so that no window holds a grid.
    lines = both.groupBy("run_id", "row").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("run_id")
    lines = lines.withColumns({"_before": F.sum("_n").over(w.orderBy("row")) - F.col("_n"), "_all": F.sum("_n").over(w)}).where(F.col("_all") >= least_stable)
    at = F.col("_before") + F.row_number().over(Window.partitionBy("run_id", "row").orderBy("col")) - 1
    d = both.join(lines, ["run_id", "row"]).withColumn("_at", at)
    return d.where(F.col("_at") % F.greatest(F.ceil(F.col("_all") / most), F.lit(1)) == 0).select("run_id", "row", "col", "a")


def plane_spread(x: np.ndarray, y: np.ndarray, z: np.ndarray, rounds: int, clip: float, least: int) -> float:
    """Median absolute deviation of ``z`` off its robust plane over the points that the clipping leaves; infinite with fewer than ``least``."""
    basis, left = np.column_stack([np.ones(len(z)), x, y]), np.ones(len(z), bool)
    off, sigma = z, np.inf
    for _ in range(rounds):
        if left.sum() < least:
            return np.inf
        off = z - basis @ np.linalg.lstsq(basis[left], z[left], rcond=None)[0]
        centre = np.median(off[left])
        sigma = 1.4826 * np.median(np.abs(off[left] - centre))
        if sigma <= 1e-8:
            break
        left &= np.abs(off - centre) <= clip * sigma
    v = off[left]
    return float(np.median(np.abs(v - np.median(v)))) if len(v) >= least else np.inf


def near_points(post: DataFrame, z: str, points: DataFrame) -> DataFrame:
    """run_id, row, col, z of the second grids' pixels in the cells of ``CELL`` pixels a side that a point's candidates may reach."""
    cell = lambda c, by=0: F.floor((F.col(c) + by) / CELL).cast("int")
    ends = F.array(*[F.struct(cell("row", y).alias("_r"), cell("col", x).alias("_c")) for y in (-FAR, FAR) for x in (-FAR, FAR)])
    reached = points.select("run_id", F.explode(F.array_distinct(ends)).alias("_e")).select("run_id", "_e.*").distinct()
    pixels = post.select("run_id", "row", "col", F.col(z).cast("double").alias("z")).dropna(subset=["z"]).withColumns({"_r": cell("row"), "_c": cell("col")})
    return pixels.hint("merge").join(reached, ["run_id", "_r", "_c"], "left_semi").drop("_r", "_c")


def reached_values(rows: np.ndarray, cols: np.ndarray, pixels: pd.DataFrame) -> Callable[[int, int], np.ndarray]:
    """A function of (down, across): the value of the pixel that far from every point, NaN where there is none; the points are among the pixels."""
    r, c, v = (pixels[k].to_numpy() for k in ("row", "col", "z"))
    top, left, width = r.min() - FAR, c.min() - FAR, int(c.max()) - int(c.min()) + 2 * FAR + 1
    place = lambda r, c: (r.astype(np.int64) - top) * width + (c - left)
    at = place(r, c)
    order = np.argsort(at)
    at, v, known = at[order], v[order], {}

    def value(down: int, across: int) -> np.ndarray:
        if (down, across) not in known:
            k = place(rows + down, cols + across)
            i = np.minimum(np.searchsorted(at, k), len(at) - 1)
            known[down, across] = np.where(at[i] == k, v[i], np.nan)
        return known[down, across]

    return value


def searched(points: pd.DataFrame, pixels: pd.DataFrame, rounds: int, clip: float, least: int) -> tuple[float, float, float | None]:
    """dx, dy and score of the best shift of one pair."""
    points = points.sort_values(["row", "col"])
    rows, cols, a = (points[k].to_numpy() for k in ("row", "col", "a"))
    value = reached_values(rows, cols, pixels)

    def score(dy: float, dx: float) -> float:
        y, x = math.floor(-dy), math.floor(-dx)
        fy, fx = -dy - y, -dx - x
        q00, q10, q01, q11 = value(y, x), value(y, x + 1), value(y + 1, x), value(y + 1, x + 1)
        b = q00 * (1 - fx) * (1 - fy) + q10 * fx * (1 - fy) + q01 * (1 - fx) * fy + q11 * fx * fy
        ok = ~(np.isnan(q00) | np.isnan(q10) | np.isnan(q01) | np.isnan(q11))
        at = lambda v: v[ok] / v[ok].max(initial=1)
        return plane_spread(at(cols), at(rows), (b - a)[ok], rounds, clip, least)

    def best(cy: float, cx: float, by: float) -> tuple[float, float, float] | None:
        shifts = [(cy + y * by, cx + x * by) for y in range(-REACH, REACH + 1) for x in range(-REACH, REACH + 1)]
        return min((t for t in ((score(*s), *s) for s in shifts) if t[0] < np.inf), default=None)

    whole = best(0.0, 0.0, 1.0)
    fine = best(*(whole[1:] if whole else (0.0, 0.0)), 0.25)
    s, dy, dx = fine if fine and (whole is None or fine[0] < whole[0]) else whole or (None, 0.0, 0.0)
    return dx, dy, s


def best_shifts(pre: DataFrame, post: DataFrame, z: str, stable: str | None = None, least_stable: int = 5000, least: int = 1000, most: int = 30_000, rounds: int = 3, clip: float = 3.5) -> DataFrame:
    """run_id, dx, dy, score: how far the second grid of each pair moves for the least spread off a plane, in quarter pixels.

    A quarter shift wins only if it beats the best whole one; ties go to the smaller dy
    and then dx.  A pair no candidate of which has ``least`` points stays where it is,
    with a NULL score; one without ``least_stable`` stable pixels has no row.
    """
    points = materialise(stable_points(pre, post, z, stable, least_stable, most), "stable-points")
    kind = points.schema["run_id"].dataType

    def one(key: tuple, points: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *searched(points, pixels, rounds, clip, least))], columns=["run_id", "dx", "dy", "score"])

    groups = [spread(d, "run_id").groupBy("run_id") for d in (points, near_points(post, z, points))]
    return groups[0].cogroup(groups[1]).applyInPandas(one, f"run_id {kind.simpleString()}, dx double, dy double, score double")


def elevation_change(pre: DataFrame, post: DataFrame, z: str, stable: str, target: str, least_stable: int = 5000, least_target: int = 500, least: int = 1000, cover: float = 0.0, most: int = 30_000) -> DataFrame:
    """One row a pair: the shift, the plane, residuals on stable ground with their gates, and the change inside the target.

    ``pre`` has the boolean columns ``stable`` and ``target``.  ``status``: ``ok``,
    ``gates_failed`` (the change is descriptive only either way), ``no_plane``, or
    ``few_target_pixels``; pairs without ``least_stable`` stable pixels have no row.
    """
    shift = materialise(best_shifts(pre, post, z, stable, least_stable, least, most), "best-shifts")
    grid = pre.select("run_id", "row", "col", F.col(z).cast("double").alias("a"), F.coalesce(F.col(stable), F.lit(False)).alias("_s"), F.coalesce(F.col(target), F.lit(False)).alias("_t")).join(shift, "run_id")
    met = moved(grid.where("a is not null"), quads(post, z)).select("run_id", "row", "col", (F.col("b") - F.col("a")).alias("_d"))
    d = materialise(grid.hint("merge").join(met, ["run_id", "row", "col"], "left"), "differences")
    fitted = materialise(robust_plane(d.withColumn("_z", F.when(F.col("_s"), F.col("_d"))), "_z", least=least), "planes")
    size = d.groupBy("run_id").agg(F.greatest(F.max("row"), F.lit(1)).alias("_h"), F.greatest(F.max("col"), F.lit(1)).alias("_w"))
    e = d.join(fitted.join(size, "run_id"), "run_id")
    plane = F.col("offset") + F.col("x_edge_delta") * F.col("col") / F.col("_w") + F.col("y_edge_delta") * F.col("row") / F.col("_h")
    e = e.withColumn("_p", plane).withColumn("_v", F.col("_d") - F.col("_p"))
    on, to = F.when(F.col("_s"), F.col("_v")), F.when(F.col("_t"), F.col("_v"))
    at = F.when(F.col("_t"), F.col("_p"))
    e = e.withColumns({"_on": on, "_abs": F.abs(on), "_to": to, "_at": at})
    r = e.groupBy("run_id").agg(
        *[F.first(c).alias(c) for c in ("dx", "dy", "score", "offset", "x_edge_delta", "y_edge_delta", "fit_points")],
        F.count("_on").alias("stable_pixels"), F.sqrt(F.avg(F.col("_on") * F.col("_on"))).alias("stable_rmse"), F.abs(F.median("_on")).alias("stable_abs_median"), quantile("_abs", 0.95).alias("stable_p95_abs"),
        (F.max("_at") - F.min("_at")).alias("plane_drift"), F.count("_to").alias("target_pixels"), F.avg("_to").alias("mean_change"),
        F.percentile("_to", F.array(*[F.lit(q) for q in CHANGES.values()])).alias("_q"))
    r = r.withColumns({c: F.get("_q", F.lit(i)) for i, c in enumerate(CHANGES)}).drop("_q")
    r = r.withColumn("median_minus_cover", F.col("median_change") - cover).withColumns({f"{n}_pass": F.col(n) <= limit for n, limit in GATES})
    passed = F.col("stable_rmse_pass")
    for n, _ in GATES[1:]:
        passed = passed & F.col(f"{n}_pass")
    status = F.when(F.col("offset").isNull(), "no_plane").when(F.col("target_pixels") < least_target, "few_target_pixels").when(passed, "ok").otherwise("gates_failed")
    return r.withColumn("status", status)
