"""Thresholds, connected objects, clusters, labels and findings of an anomaly band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import clamp01, number
from tellurion.functions.group_stats import quantile, with_stats
from tellurion.operators.graph import components
from tellurion.sources.scratch import materialise

MIN_PIXELS = 4
EPS = 6.0
# Finding labels and review orders by score and shape.
LABELS = (
    (0.7, "elongated", "ENTRANCE_SHAFT_TRACE", "01_CORE_REVIEW"),
    (0.7, "compact", "COMPACT_CHAMBER_POINT", "01_CORE_REVIEW"),
    (0.7, None, "CHAMBER_VOID_AREA", "01_CORE_REVIEW"),
    (0.6, "elongated", "POSSIBLE_ENTRANCE_SHAFT", "02_SECOND_REVIEW"),
    (0.6, None, "POSSIBLE_CHAMBER_STRUCTURE_AREA", "02_SECOND_REVIEW"),
    (0.5, None, "RING_CONTEXT_AREA", "03_CONTEXT_REVIEW"),
    (0.4, None, "WEAK_CONTEXT_AREA", "04_LATE_REVIEW"),
    (-1.0, None, "BACKGROUND_AREA", "05_BACKGROUND"),
)


def robust_threshold(df: DataFrame, x: str) -> DataFrame:
    """One row a run: the 99th percentile or median + 6 robust deviations, whichever is more, unless the latter is out of reach."""
    d = with_stats(df.where(F.col(x).isNotNull()), {"_m": F.median(x)})
    a = d.groupBy("run_id").agg(F.first("_m").alias("median"), F.max(x).alias("top"), F.median(F.abs(F.col(x) - F.col("_m"))).alias("mad"), quantile(x, 0.99).alias("p99"))
    limit = F.col("median") + 6.0 * 1.4826 * F.col("mad")
    value = (
        F.when((F.col("mad") > 0) & (limit >= F.col("top")), F.col("p99")).when(F.col("mad") > 0, F.greatest("p99", limit))
        .when(F.col("top") > F.col("median"), F.col("median") + 0.5 * (F.col("top") - F.col("median"))).otherwise(F.col("top") + 1e-6))
    return a.select("run_id", "median", "mad", "p99", value.alias("threshold"))


def candidate_pixels(df: DataFrame, x: str, q: float, floor: float | None = None) -> DataFrame:
    """Pixels at or above the percentile (and the floor) of their run."""
    d = with_stats(df, {"_t": quantile(x, q)})
    t = F.col("_t") if floor is None else F.greatest("_t", number(floor))
    return d.where(F.col(x) >= t).drop("_t")


def connected(mask: DataFrame, min_pixels: int = MIN_PIXELS, diagonal: bool = True) -> DataFrame:
    """8-connected (4-connected without ``diagonal``) objects of the mask's pixels, smaller ones dropped, numbered from 1 in scan order within each run.

    Pixels side by side in a row are one stretch, by a window; only stretches of
    neighbouring rows that touch are edges of the graph.  A stretch is named by run,
    row and first column in 23, 20 and 20 bits, whatever the grid's size.  The mask is
    written once; edges and objects read it instead of working the band again.
    """
    w = Window.partitionBy("run_id", "row").orderBy("col")
    begins = F.col("col") != F.coalesce(F.lag("col").over(w) + 1, F.lit(-1))
    m = mask.withColumn("_start", F.when(begins, F.col("col"))).withColumn("_start", F.last("_start", ignorenulls=True).over(w))
    fits = (F.col("run_id") >= 0) & (F.col("run_id") < 1 << 23) & (F.col("row") < 1 << 20) & (F.col("col") < 1 << 20)
    run = F.when(fits, F.col("run_id").cast("long")).otherwise(F.raise_error(F.lit("a run, row or column is too large for a stretch's name")).cast("long"))
    name = F.shiftleft(run, 40).bitwiseOR(F.shiftleft(F.col("row").cast("long"), 20)).bitwiseOR(F.col("_start").cast("long"))
    m = materialise(m.withColumn("_id", name).drop("_start"), "stretches")
    below = m.select(F.col("_id").alias("u"), "run_id", (F.col("row") + 1).alias("row"), F.explode(F.array(*[F.col("col") + k for k in ((-1, 0, 1) if diagonal else (0,))])).alias("col"))
    edges = below.join(m.select("run_id", "row", "col", F.col("_id").alias("v")).hint("merge"), ["run_id", "row", "col"]).select("u", "v").distinct()
    roots = components(edges, join="merge")
    lab = m.join(roots.hint("merge"), m["_id"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_id")).drop("node", "root")
    kept = lab.groupBy("run_id", "_root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pixels)
    kept = kept.withColumn("object_id", F.row_number().over(Window.partitionBy("run_id").orderBy("_root")))
    return lab.join(kept.hint("merge"), ["run_id", "_root"]).drop("_id", "_root", "_n")


def summarize(pixels: DataFrame, x: str) -> DataFrame:
    """One row an object: bounds, centre, area, mean, peak and spread."""
    return pixels.groupBy("run_id", "object_id").agg(
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
        F.round(F.avg("row"), 3).alias("row_center"), F.round(F.avg("col"), 3).alias("col_center"), F.count(F.lit(1)).alias("area_px"),
        F.round(F.avg(x), 6).alias("mean_anomaly"), F.round(F.max(x), 6).alias("max_anomaly"), F.round(F.stddev_pop(x), 6).alias("spread"))


def clusters(objects: DataFrame, eps: float = EPS) -> DataFrame:
    """Adds cluster_id (from 0): objects within ``eps`` of each other, over others too.

    The neighbour join is an equi-join over cells of side ``eps``, each object
    meeting the nine cells around it.  The objects are written once.
    """
    o = materialise(objects, "objects").withColumns({"_id": F.shiftleft(F.col("run_id").cast("long"), 32) + F.col("object_id"), "_y": F.floor(F.col("row_center") / eps), "_x": F.floor(F.col("col_center") / eps)})
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = o.select("run_id", F.col("_id").alias("u"), F.col("row_center").alias("r1"), F.col("col_center").alias("c1"), "_y", "_x", F.explode(steps).alias("s"))
    left = left.select("run_id", "u", "r1", "c1", (F.col("_y") + F.col("s.a")).alias("_y"), (F.col("_x") + F.col("s.b")).alias("_x"))
    pairs = left.join(o.select("run_id", F.col("_id").alias("v"), F.col("row_center").alias("r2"), F.col("col_center").alias("c2"), "_y", "_x").hint("merge"), ["run_id", "_y", "_x"])
    near = pairs.where((F.col("u") < F.col("v")) & (F.sqrt((F.col("r1") - F.col("r2")) ** 2 + (F.col("c1") - F.col("c2")) ** 2) <= eps))
    roots = components(near.select("u", "v"), join="merge")
    o = o.join(roots.hint("merge"), o["_id"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_id"))
    rank = F.dense_rank().over(Window.partitionBy("run_id").orderBy("_root")) - 1
    return o.withColumn("cluster_id", rank).drop("_id", "_root", "_y", "_x", "node", "root")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("run_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("area_px").alias("total_area_px"), F.round(F.avg("area_px"), 3).alias("mean_object_area_px"), F.max("max_anomaly").alias("max_object_anomaly"))


def score(mean: Column, peak: Column, spread: Column) -> Column:
    return clamp01(F.round(mean * 0.45 + peak * 0.4 + spread * 0.15, 6))


def classify(objects: DataFrame) -> DataFrame:
    """class_score, class_id (ten bands of a tenth, A the highest), finding_label and review_order."""
    d = objects.withColumn("class_score", score(F.col("mean_anomaly"), F.col("max_anomaly"), F.col("spread")))
    s = F.col("class_score")
    h, w = F.col("row_max") - F.col("row_min") + 1, F.col("col_max") - F.col("col_min") + 1
    long_, short = F.greatest(h, w), F.least(h, w)
    shape = {"elongated": long_ / short >= 3.0, "compact": long_ <= 3, None: F.lit(True)}
    label = order = cls = None
    for low, kind, name, review in LABELS:
        cond = (s >= low) & shape[kind]
        label = F.when(cond, name) if label is None else label.when(cond, name)
        order = F.when(cond, review) if order is None else order.when(cond, review)
    for i in range(9):
        name = f"Class_{'ABCDEFGHI'[i]}"
        cls = F.when(s >= (9 - i) / 10, name) if cls is None else cls.when(s >= (9 - i) / 10, name)
    return d.withColumns({"class_id": cls.otherwise("Class_J"), "finding_label": label, "review_order": order})


def findings(classified: DataFrame) -> DataFrame:
    """Labels ranked by top score, support and name, with the run's result status."""
    g = classified.groupBy("run_id", "finding_label").agg(F.max("class_score").alias("finding_score"), F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("run_id")
    g = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("finding_score"), F.desc("support"), "finding_label")))
    top = F.max("finding_score").over(w)
    ties = F.sum((F.abs(F.col("finding_score") - top) <= 1e-9).cast("int")).over(w)
    status = F.when(top < 0.4, "no_strong_result").when(top < 0.6, "unclear_result").when(ties > 1, "tied_top_result").otherwise("result_available")
    return g.withColumn("result_status", status)


def zones(classified: DataFrame) -> DataFrame:
    """Clusters with area-weighted mean, area share, peak and a review level by rank percentile."""
    z = classified.groupBy("run_id", "cluster_id").agg(
        F.sum(F.col("mean_anomaly") * F.col("area_px")).alias("_w"), F.sum("area_px").alias("area"), F.max("max_anomaly").alias("peak"))
    w = Window.partitionBy("run_id")
    z = z.withColumns({"weighted_mean": F.col("_w") / F.col("area"), "area_share": F.col("area") / F.sum("area").over(w)}).drop("_w")
    p = F.percent_rank().over(w.orderBy(F.desc("peak"), F.desc("area"), "cluster_id"))
    return z.withColumn("level", F.when(p <= 1 / 3, "higher").when(p <= 2 / 3, "medium").otherwise("lower"))


def pca_scores(df: DataFrame, bands: list[str], k: int = 3) -> DataFrame:
    """Whitened distance in the top ``k`` principal components of each run, and its 1..99 stretch.

    The Gram matrix is one aggregation (bands^2 sums a run), solved by a vectorised
    function, one row a run.  Components under 1e-10 of the variance are left out.
    ``pca.pca_anomaly`` also chooses channels, fills and clips.
    """
    ok = df.dropna(subset=bands)
    n = len(bands)
    sums = ok.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(b) for b in bands]).alias("s"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in bands for b in bands]).alias("g"))

    def solve(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mean = np.array(r.s, float) / r.n
                cov = (np.array(r.g, float).reshape(n, n) - r.n * np.outer(mean, mean)) / max(r.n - 1, 1)
                val, vec = np.linalg.eigh((cov + cov.T) / 2)
                val, vec = val[::-1][:k], vec[:, ::-1][:, :k]
                use = val > max(val[0], 0) * 1e-10
                out.append((r.run_id, mean.tolist(), (vec[:, use] / np.sqrt(val[use])).T.tolist()))
            yield pd.DataFrame(out, columns=["run_id", "mean", "w"])

    model = sums.mapInPandas(solve, f"run_id {df.schema['run_id'].dataType.simpleString()}, mean array<double>, w array<array<double>>")
    d = ok.join(model, "run_id").withColumn("_x", F.zip_with(F.array(*bands), "mean", lambda a, b: a - b))
    dot = lambda v: F.aggregate(F.zip_with(v, F.col("_x"), lambda a, b: a * b), number(0), lambda s, x: s + x)
    d = d.withColumn("score", F.sqrt(F.aggregate(F.transform("w", dot), number(0), lambda s, x: s + x * x))).drop("_x", "mean", "w")
    d = with_stats(d, {"_lo": quantile("score", 0.01), "_hi": quantile("score", 0.99)})
    return d.withColumn("display", clamp01(F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
