"""Candidate focuses, object features, labels, sampling, nearest rows, peaks, shifts, tiles and anchors.

Every spatial join is an equi-join: a box or circle is exploded into its grid rows
and met on (run_id, row); nearest rows are met on cells of growing size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import clamp01, clip, number
from tellurion.functions.group_stats import quantile, with_stats
from tellurion.operators.objects import connected
from tellurion.operators.windows2d import box_max
from tellurion.sources.scratch import materialise

# How many focuses a run may have.
DEFAULT_FOCUSES, MOST_FOCUSES = 3, 10
# Review grades by the least confidence of detection and of interpretation.
GRADES = ((0.75, 0.60, "A_HIGH_CONFIDENCE_REVIEW"), (0.60, 0.45, "B_MEDIUM_CONFIDENCE_REVIEW"), (0.45, None, "C_LOW_CONFIDENCE_REVIEW"))
WEAKEST_GRADE = "D_WEAK_OR_UNRESOLVED"
# The layers behind the short names of bands, and the fields behind those of the axes.
LAYERS = {
    "gold": "Secret_Gold_Halo", "silver": "Secret_Silver_Oxide", "tunnel": "Secret_Tunnel_Ceiling", "thermal": "Secret_Thermal_Inertia", "chemical": "Secret_Chemical_Protector",
    "doors": "Secret_Hidden_Doors", "zero": "REPORT_640_FINAL_Zero_Point_Targets", "mass": "REPORT_640_Mass_Report", "pottery": "REPORT_640_Pottery_Report",
    "metal": "محور_معدني", "void": "محور_فراغ", "structure": "محور_بنيوي",
}
# Labels of a target by the bands that reach their medians, the first that holds.
PRIORITIES = (
    (("gold", "mass"), "Priority A ? Metallic/High-density focus"),
    (("doors", "tunnel"), "Priority B ? Structural/void-related focus"),
    (("pottery",), "Priority C ? Pottery/material concentration"),
    (("thermal",), "Priority D ? Thermal contrast focus"),
)
NO_PRIORITY = "Priority E ? Comparative anomaly inside 17m"
# Weights of the three axes and of the composite.
AXES = {
    "metal": {"gold": 1.30, "silver": 1.10, "mass": 0.90, "chemical": 0.40},
    "void": {"tunnel": 1.20, "thermal": 1.00, "doors": 0.70, "zero": 0.30},
    "structure": {"doors": 1.25, "tunnel": 1.00, "mass": 0.85, "thermal": 0.35},
}
COMPOSITE = {"metal": 1.00, "void": 0.90, "structure": 0.95, "pottery": 0.40}


# ---- focuses ------------------------------------------------------------------


def select_focuses(classified: DataFrame, top_n: int = DEFAULT_FOCUSES) -> DataFrame:
    """The ``top_n`` (1 to 10) objects of each run with the highest score, then the earliest review, then the least id; adds rank, candidate_id and the box's centre."""
    best = Window.partitionBy("run_id").orderBy(F.desc("class_score"), "review_order", "object_id")
    ranked = classified.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, min(MOST_FOCUSES, top_n)))
    middle = lambda a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2.0
    return ranked.withColumns({"candidate_id": F.concat(F.lit("object_"), "object_id"), "center_row": middle("row"), "center_col": middle("col")})


def _rows(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first.cast("int"), last.cast("int")))


def circle_pixels(focuses: DataFrame, pixels: DataFrame, radius: float) -> DataFrame:
    """Pixels within ``radius`` pixels of each focus's centre, with the focus's rank and candidate_id."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    c = focuses.select("run_id", "rank", "candidate_id", "center_row", "center_col", _rows(F.ceil(F.col("center_row") - radius), F.floor(F.col("center_row") + radius)).alias("row"))
    near = (F.col("row") - F.col("center_row")) ** 2 + (F.col("col") - F.col("center_col")) ** 2 <= radius * radius
    return c.join(pixels, ["run_id", "row"]).where(near)


def focus_windows(focuses: DataFrame, pixels: DataFrame, radius: float, bands: Sequence[str]) -> DataFrame:
    """One row a focus: pixels in its circle, the circle's window on the grid, and each band's mean there."""
    return circle_pixels(focuses, pixels, radius).groupBy("run_id", "rank", "candidate_id").agg(
        F.count(F.lit(1)).alias("mask_pixels"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
        *[F.avg(b).alias(f"{b}_mean") for b in bands])


def focus_axes(pixels: DataFrame) -> DataFrame:
    """Adds the axes metal, void, structure and their composite from standardised bands (z scores by plain name)."""
    total = lambda terms: sum((F.col(n) * w for n, w in terms.items()), number(0))
    return pixels.withColumns({axis: total(terms) for axis, terms in AXES.items()}).withColumn("composite", total(COMPOSITE))


def target_priority(df: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """Adds priority: the first label whose bands all reach their medians over the group."""
    bands = sorted({b for need, _ in PRIORITIES for b in need})
    d = with_stats(df, {f"_m_{b}": F.median(b) for b in bands}, list(key))
    label = None
    for need, name in PRIORITIES:
        holds = F.lit(True)
        for b in need:
            holds = holds & (F.col(b) >= F.col(f"_m_{b}"))
        label = F.when(holds, name) if label is None else label.when(holds, name)
    return d.withColumn("priority", label.otherwise(NO_PRIORITY)).drop(*[f"_m_{b}" for b in bands])


def logistic(x: Column, bias: float = 0.0, gain: float = 1.0) -> Column:
    """Logistic of gain * (x - bias), its argument held within 60 of 0."""
    return 1.0 / (1.0 + F.exp(-clip(gain * (x - bias), -60.0, 60.0)))


def decision_grade(detection: Column, interpretation: Column) -> Column:
    grade = None
    for least, least_read, name in GRADES:
        holds = (detection >= least) & (F.lit(True) if least_read is None else interpretation >= least_read)
        grade = F.when(holds, name) if grade is None else grade.when(holds, name)
    return grade.otherwise(WEAKEST_GRADE)


# ---- objects ------------------------------------------------------------------------


def within_grid(objects: DataFrame, height: int, width: int) -> DataFrame:
    """Adds bounds_status: ok, inverted, or outside the grid."""
    inverted = (F.col("row_min") > F.col("row_max")) | (F.col("col_min") > F.col("col_max"))
    outside = (F.col("row_min") < 0) | (F.col("col_min") < 0) | (F.col("row_max") >= height) | (F.col("col_max") >= width)
    return objects.withColumn("bounds_status", F.when(inverted, "inverted").when(outside, "outside").otherwise("ok"))


def box_features(objects: DataFrame, pixels: DataFrame, bands: Sequence[str], anomaly: str, valid: Column) -> DataFrame:
    """Mean and spread of all band values, and peak anomaly, over the pixels of each object's box; 0 without any.

    A pixel counts for mean and spread if it is ``valid`` and has every band.
    """
    whole = valid
    for b in bands:
        whole = whole & F.col(b).isNotNull()
    px = pixels.select("run_id", "row", "col", F.col(anomaly).alias("_peak"), F.when(whole, F.array(*bands)).alias("_v"))
    box = objects.select("run_id", "object_id", "col_min", "col_max", _rows(F.col("row_min"), F.col("row_max")).alias("row"))
    inside = box.hint("merge").join(px, ["run_id", "row"]).where(F.col("col").between(F.col("col_min"), F.col("col_max")))
    f = inside.select("run_id", "object_id", "_peak", F.explode_outer("_v").alias("v")).groupBy("run_id", "object_id").agg(F.avg("v").alias("m"), F.max("_peak").alias("p"), F.stddev_pop("v").alias("s"))
    unit = lambda c: clamp01(F.round(F.coalesce(c, number(0)), 6))
    got = objects.select("run_id", "object_id").join(f.hint("merge"), ["run_id", "object_id"], "left")
    return got.select("run_id", "object_id", unit(F.col("m")).alias("signal_mean"), unit(F.col("p")).alias("signal_peak"), unit(F.col("s")).alias("signal_spread"))


def neutral_labels(classified: DataFrame) -> DataFrame:
    """One row a cluster: its most frequent class (the first by name on ties), its objects, and each class with its count."""
    n = classified.groupBy("run_id", "cluster_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    counted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "n"))), lambda c: F.concat_ws(":", c["class_id"], c["n"].cast("string"))), ",")  # at most ten classes
    return n.groupBy("run_id", "cluster_id").agg(F.min_by("class_id", F.struct(-F.col("n"), F.col("class_id"))).alias("dominant_class_id"), F.sum("n").alias("object_count"), counted.alias("class_counts"))


def three_digits(x: Column) -> Column:
    """A number from 0 to some thousands at three digits by its exact binary value, a tie to the even digit; Java's own format rounds its shortest decimal.

    The upper 26 bits behind the point and the rest are multiplied apart, so that the sign of the distance to the middle is exact.
    """
    upper = F.floor(x * 2.0**26) / 2.0**26
    low = F.floor(x * 1000.0)
    off = (upper * 2000.0 - (low * 2 + 1)) + (x - upper) * 2000.0
    up = (off > 0) | (off == 0) & (low % 2 == 1)
    return F.format_string("%.3f", (low + up.cast("int")) / 1000.0)


def finding_reason(score: Column, height: Column, width: Column) -> Column:
    """Text of a finding: its score, and its shape or the context it asks for."""
    long_, short = F.greatest(height, width), F.least(height, width)
    kind = F.when(long_ / short >= 3.0, "elongated").when((score >= 0.7) & (long_ <= 3), "compact").otherwise("area-like")
    said = F.concat(F.lit("app_score="), three_digits(score))
    shape = F.concat(F.lit("; shape="), height.cast("string"), F.lit("x"), width.cast("string"), F.lit("; "), kind)
    return F.concat(said, F.when(score >= 0.6, shape).when(score >= 0.5, "; compare cluster context").when(score >= 0.4, "; use only near stronger objects").otherwise(""))


def sample_points(objects: DataFrame, pixels: DataFrame, bands: Sequence[str], height: int, width: int) -> DataFrame:
    """Bands at each object's centre, rounded half to even and held inside the grid."""
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(c).cast("int")))
    o = objects.select("run_id", "object_id", at("row_center", height).alias("row"), at("col_center", width).alias("col"))
    return o.join(pixels.select("run_id", "row", "col", *bands), ["run_id", "row", "col"], "left")


def nearest(points: DataFrame, targets: DataFrame, reach: float, start: float = 4.0) -> DataFrame:
    """For each point (run_id, point_id, y, x) the nearest target (run_id, target_id, y, x) of its run and its distance; the least target_id on ties.

    Points meet the targets of the nine cells around them.  A target within one side
    of a cell is the nearest of all; points without such a one go on to cells twice
    as wide, until a cell is wider than ``reach`` (the extent of a run).  Runs without
    targets give no row.  Points and targets are written once for all rounds.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left, out, side = materialise(points.select("run_id", "point_id", "y", "x"), "nearest-points"), None, start
    targets = materialise(targets.select("run_id", "target_id", "y", "x"), "nearest-targets")
    while True:
        cell = lambda d: d.withColumns({"_y": F.floor(F.col("y") / side), "_x": F.floor(F.col("x") / side)})  # noqa: B023, E731
        p = cell(left).withColumn("_s", F.explode(steps)).withColumns({"_y": F.col("_y") + F.col("_s.a"), "_x": F.col("_x") + F.col("_s.b")})
        t = cell(targets).select("run_id", "_y", "_x", "target_id", F.col("y").alias("ty"), F.col("x").alias("tx"))
        met = p.hint("merge").join(t, ["run_id", "_y", "_x"]).withColumn("d2", (F.col("y") - F.col("ty")) ** 2 + (F.col("x") - F.col("tx")) ** 2)
        best = met.groupBy("run_id", "point_id").agg(F.min(F.struct("d2", "target_id")).alias("b"))
        last = side > reach
        best = materialise(best.where(F.lit(last) | (F.col("b.d2") <= side * side)).select("run_id", "point_id", F.col("b.target_id").alias("target_id"), F.sqrt("b.d2").alias("distance")), "nearest")
        out = best if out is None else out.unionByName(best)
        if last:
            return out
        left = materialise(left.join(best.hint("merge"), ["run_id", "point_id"], "left_anti"), "nearest-left")
        side *= 2


# ---- masks ------------------------------------------------------------------------------


def robust_norm(df: DataFrame, x: str, name: str, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """Adds ``x`` stretched from its 2nd to its 98th percentile into 0..1; 0 for a flat group."""
    d = with_stats(df, {"_lo": quantile(x, 0.02), "_hi": quantile(x, 0.98)}, list(key))
    span = F.col("_hi") - F.col("_lo")
    return d.withColumn(name, F.when(F.abs(span) < 1e-9, number(0)).otherwise(clamp01((F.col(x) - F.col("_lo")) / (span + 1e-9)))).drop("_lo", "_hi")


def count_above(df: DataFrame, x: str, mask: Column, q: float, peaks: bool = False) -> DataFrame:
    """Per run, the 4-connected groups of pixels inside the mask at or above its percentile ``q``; with ``peaks`` only pixels that equal the largest of their 3 x 3 box."""
    d = box_max(df, x, 1, "_top") if peaks else df.withColumn("_top", F.col(x))
    d = with_stats(d.where(mask & F.col(x).isNotNull()), {"_t": quantile(x, q)})
    high = d.where((F.col(x) >= F.col("_t")) & (F.col(x) == F.col("_top"))).select("run_id", "row", "col")
    return connected(high, 1, diagonal=False).groupBy("run_id").agg(F.countDistinct("object_id").alias("groups"))


def mask_axes(pixels: DataFrame) -> DataFrame:
    """Elongation and orientation of each object from the sample covariance of its pixels.

    The eigenvalues of a 2 x 2 matrix have a closed form; both are at least 1e-9.
    An axis is a line without a direction; a slanting one is NW_SE where columns
    spread more than rows and rise with them, else NE_SW, which is what the usual
    eigenvector routine's choice of direction comes to.
    """
    m = pixels.groupBy("run_id", "object_id").agg(F.count(F.lit(1)).alias("n"), F.var_samp("col").alias("a"), F.var_samp("row").alias("b"), F.covar_samp("col", "row").alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    slant, wide = F.round("c", 9) + 0.0, F.round(F.col("a") - F.col("b"), 9) + 0.0  # without the last digits: round objects lie E_W
    angle = F.round(F.pmod(F.degrees(F.atan2(2 * slant, wide)) / 2 + 180.0, number(180)), 6)
    side = F.when((angle <= 22.5) | (angle >= 157.5), "E_W").when(angle.between(67.5, 112.5), "N_S").when((wide > 0) & (slant > 0), "NW_SE").otherwise("NE_SW")
    few = F.col("n") < 2
    return m.select(
        "run_id", "object_id", F.when(few, number(1)).otherwise(F.sqrt(F.greatest(half + root, number(1e-9)) / F.greatest(half - root, number(1e-9)))).alias("elongation"),
        F.when(few, "UNRESOLVED").otherwise(side).alias("orientation"))


# ---- grids ------------------------------------------------------------------------------------


def bilinear_shift(df: DataFrame, x: str, dx: float, dy: float, name: str) -> DataFrame:
    """Adds ``x`` moved by (dx, dy) pixels with bilinear weights; NULL where one of the four sources is missing or beyond the grid.

    The grid must be whole; a shift is a lag along rows, then along columns.
    """
    import math

    def moved(c: str, fixed: str, along: str, d: float) -> Column:
        low = math.floor(-d)  # the nearer source lies this many places on
        part = -d - low
        w = Window.partitionBy("run_id", fixed).orderBy(along)
        return (1 - part) * F.lead(c, low).over(w) + part * F.lead(c, low + 1).over(w)

    return df.withColumn("_h", moved(x, "row", "col", dx)).withColumn(name, moved("_h", "col", "row", dy)).drop("_h")


def focal_mean(df: DataFrame, x: str, radius: int, name: str) -> DataFrame:
    """Adds the mean of the valid pixels within ``radius`` pixels; the grid must be whole.

    A circle is a stack of row stretches: one running sum a width along the row,
    then one lag a line along the column.
    """
    import math

    widths = {k: math.isqrt(radius * radius - k * k) for k in range(-radius, radius + 1)}
    along, down = Window.partitionBy("run_id", "row").orderBy("col"), Window.partitionBy("run_id", "col").orderBy("row")
    v = {"s": F.coalesce(F.col(x).cast("double"), number(0)), "n": F.col(x).isNotNull().cast("double")}
    d = df.withColumns({f"_{p}{k}": F.sum(c).over(along.rowsBetween(-k, k)) for p, c in v.items() for k in set(widths.values())})
    total = {p: sum((F.coalesce(F.lag(f"_{p}{n}", k).over(down), number(0)) for k, n in widths.items()), number(0)) for p in v}
    d = d.withColumn(name, F.try_divide(total["s"], total["n"]))
    return d.drop(*[f"_{p}{k}" for p in v for k in set(widths.values())])


def tile_requests(grids: DataFrame, size: int, tile: int) -> DataFrame:
    """One row a tile of each grid (run_id, xmin, ymax, scale_x, scale_y): its place and its bounds."""
    if size % tile:
        raise ValueError(f"grid size {size} must be divisible by tile size {tile}")
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(size // tile - 1)))
    t = grids.withColumn("tile_row", axis()).withColumn("tile_col", axis())
    x0, y1 = F.col("xmin") + F.col("tile_col") * tile * F.col("scale_x"), F.col("ymax") + F.col("tile_row") * tile * F.col("scale_y")
    return t.withColumns({"tile_xmin": x0, "tile_xmax": x0 + tile * F.col("scale_x"), "tile_ymax": y1, "tile_ymin": y1 + tile * F.col("scale_y")})


def synthetic_elevation(tiles: DataFrame, tile: int) -> DataFrame:
    """Pixels of all tiles put together: run_id, row, col, dem, a plane that rises with the zone, the hemisphere, row and column."""
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(tile - 1)))
    p = tiles.withColumn("_r", axis()).withColumn("_c", axis())
    row, column = F.col("tile_row") * tile + F.col("_r"), F.col("tile_col") * tile + F.col("_c")
    dem = 1000.0 + F.col("zone") * 3.0 + F.when(F.col("hemisphere") == "north", 25.0).otherwise(-25.0) + row * 0.5 + column * 0.25
    return p.select("run_id", row.alias("row"), column.alias("col"), dem.alias("dem"))


# ---- anchors ----------------------------------------------------------------------------------------


def anchor_status(anchors: DataFrame) -> DataFrame:
    """Per package (package, anchor_id, signal_value, best): anchors, and ok or the first rule that is broken.

    Rules: two anchors, no id twice, no signal twice, depths strictly rising or
    strictly falling with the signal (steps over 1e-12).  A package has a few anchors.
    """
    step = F.col("best") - F.lag("best").over(Window.partitionBy("package").orderBy("signal_value", "anchor_id"))
    g = anchors.withColumn("_d", step).groupBy("package").agg(
        F.count(F.lit(1)).alias("anchors"), F.countDistinct("anchor_id").alias("ids"), F.countDistinct("signal_value").alias("signals"),
        F.min("_d").alias("least"), F.max("_d").alias("most"), F.min(F.abs("_d")).alias("small"))
    status = (
        F.when(F.col("anchors") < 2, "too_few_anchors").when(F.col("ids") < F.col("anchors"), "duplicate_anchor_id").when(F.col("signals") < F.col("anchors"), "duplicate_signal")
        .when(F.col("small") <= 1e-12, "flat_depth").when((F.col("least") < 0) & (F.col("most") > 0), "not_monotonic").otherwise("ok"))
    return g.select("package", "anchors", status.alias("status"))
