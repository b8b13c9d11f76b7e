"""Anomaly of pixels by principal components: channel choice, filling and clipping, whitened distance, stretch.

Channels without a finite value on the supported pixels, or nearly constant there, are
left out, run by run.  The others are filled with their median and clipped to their
1st and 99th percentiles.  The components are those of all valid pixels (supported, and
with every chosen channel): their sums of products are one aggregation, whose one row a
run is solved by a vectorised function on the executors; nothing is collected.

Defined results: a run with no channel left, without valid pixels, or with fewer than
``least_valid`` of its pixels valid has a status and no scores; pixels that aren't valid
have none either; components of (nearly) no variance are scaled as if it were 1e-12.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions.columns import clamp01, number
from tellurion.functions.group_stats import filled_and_clipped, filled_quantiles, quantile, with_stats
from tellurion.sources.scratch import materialise

# Components, the deviation of a channel that counts, and the share of valid pixels.
COMPONENTS = 3
LEAST_DEVIATION = 1e-9
LEAST_VALID = 0.05
_MODEL = "run_id {kind}, status string, included array<string>, excluded array<struct<band:string,reason:string>>, pixel_count long, valid_count long, mean array<double>, w array<array<double>>, variance array<double>, share array<double>"


def _finite(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def pca_anomaly(df: DataFrame, bands: list[str], support: str | None = None, k: int = COMPONENTS, least_valid: float = LEAST_VALID) -> tuple[DataFrame, DataFrame]:
    """(pixels, report): run_id, row, col, raw_score and anomaly (0 to 1), and one row a run with its status, channels and variances.

    ``support`` names a band of zeros and ones that tells supported pixels; None: all are.
    """
    n, kind = len(bands), df.schema["run_id"].dataType.simpleString()
    names = [f"_c{i}" for i in range(n)]
    on = F.coalesce(F.col(support) > 0.5, F.lit(False)) if support else F.lit(True)
    d = materialise(df.select("run_id", "row", "col", on.alias("_on"), *[_finite(b).alias(c) for b, c in zip(bands, names)]), "pca-channels")
    inside = lambda c: F.when(F.col("_on"), F.col(c))
    flags = {"_use": F.array(*[F.coalesce(F.stddev_pop(inside(c)) > LEAST_DEVIATION, F.lit(False)) for c in names]), "_some": F.array(*[F.count(inside(c)) > 0 for c in names])}
    stats = materialise(filled_quantiles(d, names, 0.01, 0.99, also=flags), "pca-stats")
    use = [F.get("_use", F.lit(i)) for i in range(n)]
    valid = F.col("_on")
    for c, u in zip(names, use):
        valid = valid & (~u | F.col(c).isNotNull())
    filled = {f"_x{i}": F.when(u, F.coalesce(filled_and_clipped(c), number(0))).otherwise(number(0)) for i, (c, u) in enumerate(zip(names, use))}
    ready = lambda of: d.join(of, "run_id").select("*", valid.alias("_valid")).withColumns(filled)
    at = [F.when(F.col("_valid"), F.col(f"_x{i}")) for i in range(n)]
    sums = ready(stats).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("_valid").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(at)],
        *[F.sum(at[i] * at[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)])
    sums = sums.join(stats, "run_id").select(
        "run_id", "pixels", "n", F.col("_use").alias("use"), F.col("_some").alias("some"), F.array(*[f"s{i}" for i in range(n)]).alias("s"),
        F.array(*[f"g{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n)]).alias("g"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                use = np.flatnonzero(np.array(r.use, bool))
                left_out = [{"band": bands[i], "reason": "near_constant" if r.some[i] else "no_finite_values"} for i in range(n) if not r.use[i]]
                status = "no_channels" if not len(use) else "no_valid_pixels" if not r.n else "few_valid_pixels" if r.n < least_valid * r.pixels else "ok"
                mean, w, variance, share = [], [], [], []
                if status == "ok":
                    s, g = np.array(r.s, float)[use], np.array(r.g, float).reshape(n, n)[np.ix_(use, use)]
                    centre = s / r.n
                    cov = (g - r.n * np.outer(centre, centre)) / max(r.n - 1, 1)
                    value, vector = np.linalg.eigh((cov + cov.T) / 2)
                    top = np.argsort(-value, kind="stable")[: min(k, len(use), r.n)]
                    variance = np.maximum(value[top], 0.0)
                    share = variance / max(np.trace(cov), 1e-12)
                    whole = np.zeros((len(top), n))
                    whole[:, use] = (vector[:, top] / np.sqrt(np.maximum(variance, 1e-12))).T
                    mean = np.zeros(n)
                    mean[use] = centre
                    mean, w, variance, share = mean.tolist(), whole.tolist(), variance.tolist(), share.tolist()
                out.append((r.run_id, status, [bands[i] for i in use], left_out, r.pixels, r.n, mean, w, variance, share))
            yield pd.DataFrame(out, columns=["run_id", "status", "included", "excluded", "pixel_count", "valid_count", "mean", "w", "variance", "share"])

    model = materialise(sums.mapInPandas(solve, _MODEL.format(kind=kind)), "pca-model")
    p = ready(stats.join(model.where("status = 'ok'").select("run_id", "mean", "w"), "run_id", "left"))
    centred = F.zip_with(F.array(*[f"_x{i}" for i in range(n)]), "mean", lambda a, b: a - b)
    p = p.select("run_id", "row", "col", F.when(F.col("_valid"), centred).alias("_y"), "w")
    dot = lambda v: F.aggregate(F.zip_with(v, F.col("_y"), lambda a, b: a * b), number(0), lambda s, t: s + t)
    p = p.withColumn("raw_score", F.sqrt(F.aggregate(F.transform("w", dot), number(0), lambda s, t: s + t * t))).drop("_y", "w")
    p = with_stats(p, {"_p01": quantile("raw_score", 0.01), "_p99": quantile("raw_score", 0.99), "_lo": F.min("raw_score"), "_hi": F.max("raw_score")})
    flat = ~(F.col("_p99") > F.col("_p01"))
    lo, hi = F.when(flat, F.col("_lo")).otherwise(F.col("_p01")), F.when(flat, F.col("_hi")).otherwise(F.col("_p99"))
    pixels = p.withColumn("anomaly", clamp01((F.col("raw_score") - lo) / (hi - lo + 1e-12))).drop("_p01", "_p99", "_lo", "_hi")
    report = model.withColumn("valid_fraction", F.col("valid_count") / F.col("pixel_count")).drop("mean", "w")
    return pixels, report
