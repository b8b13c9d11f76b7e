"""Depth lookups, dataset chain, comparison, quality gates, redaction, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import number
from tellurion.functions.group_stats import quantile


# ---- depth ------------------------------------------------------------------


def interpolate_depth(candidates: DataFrame, anchors: DataFrame, uncertainty: float = 0.0) -> DataFrame:
    """Piecewise-linear depth of candidates (candidate_id, signal) between anchors (anchor_id, signal_value, lo, best, hi).

    The range covers [signal - u, signal + u] with the anchors inside it; outside
    the anchors' support there is no estimate.  Anchors are a calibration table of
    a few rows; candidates are only joined to the intervals they touch.
    """
    w = Window.orderBy("signal_value")
    a = anchors.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("anchor_id", "signal_value", "lo", "best", "hi")})
    ext = anchors.agg(F.min("signal_value").alias("_s0"), F.max("signal_value").alias("_s1"))
    c = candidates.join(F.broadcast(ext)).withColumns({"_a": F.col("signal") - uncertainty, "_b": F.col("signal") + uncertainty})
    inside = (F.col("_a") >= F.col("_s0") - 1e-12) & (F.col("_b") <= F.col("_s1") + 1e-12)
    seg = a.where("n_signal_value is not null")
    j = c.where(inside).join(F.broadcast(seg), (F.col("_a") <= F.col("n_signal_value")) & (F.col("_b") >= F.col("signal_value")))
    at = lambda x, v: F.col(v) + (x - F.col("signal_value")) / (F.col("n_signal_value") - F.col("signal_value")) * (F.col(f"n_{v}") - F.col(v))
    low, high = F.greatest("_a", "signal_value"), F.least("_b", "n_signal_value")
    here = (F.col("signal") >= F.col("signal_value")) & ((F.col("signal") < F.col("n_signal_value")) | (F.col("n_signal_value") == F.col("_s1")))
    support = (
        F.when(F.abs(F.col("signal") - F.col("signal_value")) <= 1e-12, F.concat(F.lit("anchor:"), "anchor_id"))
        .when(F.abs(F.col("signal") - F.col("n_signal_value")) <= 1e-12, F.concat(F.lit("anchor:"), "n_anchor_id"))
        .otherwise(F.concat_ws(":", F.lit("interval"), "anchor_id", "n_anchor_id")))
    est = j.groupBy("candidate_id").agg(
        F.min(F.least(at(low, "lo"), at(high, "lo"))).alias("minimum"), F.max(F.greatest(at(low, "hi"), at(high, "hi"))).alias("maximum"),
        F.max(F.when(here, at(F.col("signal"), "best"))).alias("best"), F.max(F.when(here, support)).alias("zone"))
    out = candidates.join(est, "candidate_id", "left")
    return out.select(
        "candidate_id", F.least("minimum", "best").alias("minimum"), "best", F.greatest("maximum", "best").alias("maximum"), "zone",
        F.when(F.col("best").isNull(), "insufficient_data").otherwise("calibrated_range").alias("status"))


# ---- dataset chain -------------------------------------------------------------


def hash_order(key: Column) -> Column:
    return F.sha2(F.encode(key.cast("string"), "UTF-8"), 256)


def hash_feature(salt: str, key: Column, digits: int = 8) -> Column:
    """First 12 hex digits of sha256(salt:key) over 16^12 - 1."""
    h = F.sha2(F.encode(F.concat(F.lit(salt + ":"), key.cast("string")), "UTF-8"), 256)
    return F.round(F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12 - 1), digits)


def assign_splits(groups: DataFrame, targets: dict[str, float], source: str = "source", group: str = "grp", n: str = "n") -> DataFrame:
    """Whole groups to splits by hash order: a split takes groups until its share of the source's rows is reached.

    ``groups`` has one row a group; the running sum is over groups, not rows.
    """
    h = hash_order(F.concat_ws("|", source, group))
    w = Window.partitionBy(source).orderBy(h, group)
    before = F.sum(n).over(w) - F.col(n)
    total = F.sum(n).over(Window.partitionBy(source))
    out, edge = None, 0.0
    for name, share in targets.items():
        edge += share
        cond = before < F.round(total * edge)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return groups.withColumn("split", out.otherwise(list(targets)[-1]))


# Edges of score bands.
BANDS = ((0.0, 0.1), (0.1, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.0))


def score_band(x: Column) -> Column:
    """Half-open bands, the last one closed."""
    out = None
    for lo, hi in BANDS:
        name = f"{lo:.2f}-{hi:.2f}"
        cond = (x >= lo) & ((x <= hi) if hi == 1.0 else (x < hi))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def train_metrics(rows: DataFrame, features: list[str], label: str, split: str) -> DataFrame:
    """Scaled logistic regression on the training split; confusion counts and rates by split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
        LogisticRegression(featuresCol="_s", labelCol=label, maxIter=50, regParam=0.01)])
    model = pipe.fit(rows.where(F.col(split) == "train"))
    p = model.transform(rows).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))
    hit, yes = F.col("_p") >= 0.5, F.col(label) == 1
    m = p.groupBy(split).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), number(0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return m.select(split, "tp", "fp", "fn", "tn", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


# ---- comparison -----------------------------------------------------------------


def compare_pixels(left: DataFrame, right: DataFrame, key: list[str], x: str, atol: float, rtol: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer comparison of a band, a row for each ``by`` (of the key; none: one row): counts, differences, share within tolerance."""
    j = left.select(*key, F.col(x).alias("a")).join(right.select(*key, F.col(x).alias("b")), key, "full")
    d = F.abs(F.col("a") - F.col("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    close = both & (d <= atol + rtol * F.abs(F.col("b")))
    return j.groupBy(*by).agg(
        F.count_if(both).alias("both"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("right_only"),
        F.round(F.max(d), 6).alias("max_diff"), F.round(F.avg(d), 6).alias("mean_diff"), F.count_if(close).alias("close"))


def signed_stats(left: DataFrame, right: DataFrame, key: list[str], x: str, by: tuple[str, ...] = ()) -> DataFrame:
    j = left.select(*key, F.col(x).alias("a")).join(right.select(*key, F.col(x).alias("b")), key).withColumn("d", F.col("a") - F.col("b")).where("d is not null")
    return j.groupBy(*by).agg(
        F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("zero"),
        F.round(F.median("d"), 6).alias("median"), F.round(quantile(F.abs("d"), 0.9), 6).alias("p90"), F.round(quantile(F.abs("d"), 0.99), 6).alias("p99"))


def linear_fit(left: DataFrame, right: DataFrame, key: list[str], x: str, by: tuple[str, ...] = ()) -> DataFrame:
    j = left.select(*key, F.col(x).alias("a")).join(right.select(*key, F.col(x).alias("b")), key).where("a is not null and b is not null")
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("r"), F.round(F.regr_slope("b", "a"), 6).alias("slope"), F.round(F.regr_intercept("b", "a"), 5).alias("intercept"))


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, repeats counted."""
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("left_only"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("right_only"))
    return a.join(F.broadcast(b)).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


# ---- quality ------------------------------------------------------------------------


# Severities of a check, in rising order.
SEVERITY = ("PASS", "WARNING", "BLOCKED")


def gate(value: Column, block: float, warn: float) -> Column:
    """0 pass, 1 warning, 2 blocked; unknown values count as blocked."""
    return F.when(value.isNull() | (value < block), 2).when(value < warn, 1).otherwise(0)


def fold(checks: DataFrame, key: str) -> DataFrame:
    """The worst severity of each key's checks and the names of those that are not passed."""
    return checks.groupBy(key).agg(F.max("severity").alias("s"), F.sort_array(F.collect_set(F.when(F.col("severity") > 0, F.col("check")))).alias("names")).select(
        key, F.element_at(F.array(*[F.lit(x) for x in SEVERITY]), (F.col("s") + 1).cast("int")).alias("status"), F.array_join("names", ",").alias("open_checks"))


# ---- text ----------------------------------------------------------------------------

# Patterns and their stand-ins.
REDACT = (
    (r"(?i)([A-Z]:\\(?:[^\\/:*?\"<>|\s]+\\)*[^\\/:*?\"<>|\s]*)|(/(?:Users|home|mnt)/\S+)", "[REDACTED_PATH]"),
    (r"\b[a-fA-F0-9]{32,64}\b", "[REDACTED_HASH]"),
    (r"(?i)\b(POINT|LINESTRING|POLYGON|MULTIPOLYGON|MULTILINESTRING|MULTIPOINT|GEOMETRYCOLLECTION)\s*\(", "[REDACTED_GEOMETRY]"),
    (r"(?i)(\"type\"\s*:\s*\"(?:Feature|FeatureCollection|Point|Polygon|MultiPolygon|LineString|MultiLineString|MultiPoint)\")|(<kml\b)|(<Placemark\b)", "[REDACTED_GEOMETRY]"),
)
PAIR = r"-?[0-9]{1,3}(?:\.[0-9]+)?\s*,\s*-?[0-9]{1,3}(?:\.[0-9]+)?"
PAIR_NAME = "[REDACTED_COORDS]"


def _plausible(pair: Column) -> Column:
    """A latitude within 90 and a longitude within 180 degrees of 0."""
    side = lambda i: F.abs(F.trim(F.get(F.split(pair, ","), F.lit(i))).cast("double"))
    return (side(0) <= 90) & (side(1) <= 180)


def redact(text: Column) -> Column:
    """A log line without paths, digests, geometry and plausible coordinate pairs; other pairs of numbers stay.

    Both uses of the replaced text are behind one lambda variable, so it is made once.
    """
    for pattern, name in REDACT:
        text = F.regexp_replace(text, pattern, name)

    def without_pairs(t: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(t, F.lit(f"({PAIR})"), F.lit(1)), lambda p: F.when(_plausible(p), F.lit(PAIR_NAME)).otherwise(p))
        return F.array_join(F.zip_with(F.split(t, PAIR), pairs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.get(F.transform(F.array(text), without_pairs), F.lit(0))


def violates(text: Column) -> Column:
    """Whether a text still holds what ``redact`` takes out."""
    pairs = F.regexp_extract_all(text, F.lit(f"({PAIR})"), F.lit(1))
    out = F.exists(pairs, _plausible)
    for pattern, _ in REDACT:
        out = out | text.rlike(pattern)
    return out


# ---- projection ------------------------------------------------------------------------


def utm(lon: Column, lat: Column) -> dict[str, Column]:
    """Zone, EPSG code, easting and northing on WGS 84: the transverse Mercator series in the third flattening, to its third power."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    dl = F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    atanh = lambda x: 0.5 * F.ln((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k0 = 0.9996
    return {
        "zone": zone.cast("int"), "epsg": (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int"),
        "easting": 500000.0 + k0 * radius * east, "northing": k0 * radius * north + F.when(lat < 0, 10000000.0).otherwise(0.0)}


# ---- elevation differencing ----------------------------------------------------------------


def robust_plane(points: DataFrame, z: str, rounds: int = 4, clip: float = 3.5, least: int = 1000) -> DataFrame:
    """Least-squares plane of each grid (run_id): offset, rise over its width and over its height, and the points that stay.

    Axes run from 0 to 1 over the grid.  Each round fits the points that are left and
    takes out those further than ``clip`` robust deviations from the median error; a
    point that is out stays out.  A grid with fewer than ``least`` points, at first or
    after a clip, has no plane.  Rounds are written, so a round reads the one before.
    """
    from tellurion.functions.group_stats import with_stats
    from tellurion.operators.acquisitions import residualize
    from tellurion.sources.scratch import materialise

    whole = with_stats(points, {"_h": F.greatest(F.max("row"), F.lit(1)), "_w": F.greatest(F.max("col"), F.lit(1))})
    kept = whole.where(F.col(z).isNotNull()).select("run_id", (F.col("col") / F.col("_w")).alias("_x"), (F.col("row") / F.col("_h")).alias("_y"), F.col(z).cast("double").alias("_z"))
    kept = with_stats(kept, {"_n": F.count(F.lit(1))}).withColumn("_least", F.col("_n"))
    for _ in range(rounds):
        fit = residualize(kept.drop("_beta"), "_z", ["_x", "_y"], "run_id", "_beta")
        fit = with_stats(materialise(fit, "plane"), {"_m": F.median("residual")})
        error = F.abs(F.col("residual") - F.col("_m"))
        fit = with_stats(fit.withColumn("_e", error), {"_mad": F.median("_e")})
        sigma = 1.4826 * F.col("_mad")
        stays = fit.where((sigma <= 1e-8) | (F.col("_e") <= clip * sigma)).select("run_id", "_x", "_y", "_z", "_least", "_beta")
        kept = with_stats(stays, {"_n": F.count(F.lit(1))}).withColumn("_least", F.least("_least", "_n"))
    g = kept.groupBy("run_id").agg(F.first("_beta").alias("b"), F.first("_n").alias("fit_points"), F.first("_least").alias("_least"))
    at = lambda i: F.when(F.col("_least") >= least, F.get("b", F.lit(i)))
    status = F.when(F.col("_least") >= least, "ok").otherwise("too_few_points")
    return g.select("run_id", at(0).alias("offset"), at(1).alias("x_edge_delta"), at(2).alias("y_edge_delta"), "fit_points", status.alias("status"))


def best_shift(pre: DataFrame, post: DataFrame, z: str, reach: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """MAD of the difference for every whole-pixel shift within ``reach``, for each ``by``; ``shifts.best_shifts`` goes on to quarter pixels and takes planes off."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    a = pre.select(*by, "row", "col", F.col(z).alias("a"), F.explode(steps).alias("s"))
    a = a.select(*by, (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), "a", "s.dy", "s.dx")
    d = a.join(post.select(*by, "row", "col", F.col(z).alias("b")), [*by, "row", "col"]).withColumn("d", F.col("b") - F.col("a")).where("d is not null")
    m = d.groupBy(*by, "dy", "dx").agg(F.median("d").alias("m"))
    return d.join(m, [*by, "dy", "dx"]).groupBy(*by, "dy", "dx").agg(F.median(F.abs(F.col("d") - F.col("m"))).alias("mad"), F.count(F.lit(1)).alias("n")).orderBy(*by, "mad", "dy", "dx")


# ---- areas and completeness -------------------------------------------------------------------


def aoi_status(aois: DataFrame) -> DataFrame:
    """Adds aoi_status to west, south, east, north: ok or the first rule that is broken."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    finite = F.lit(True)
    for c in (w, s, e, n):
        finite = finite & c.isNotNull() & ~F.isnan(c)
    return aois.withColumn("aoi_status", F.when(~finite, "not_finite").when(~(w.between(-180, 180) & e.between(-180, 180)), "longitude_range")
                           .when(~(s.between(-90, 90) & n.between(-90, 90)), "latitude_range").when(w >= e, "west_not_less").when(s >= n, "south_not_less").otherwise("ok"))


def cell_grid(aois: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row a cell of each area, rows from the south, with its id and bounds."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = aois.withColumns({"_w": (F.col("east") - F.col("west")) / cols, "_h": (F.col("north") - F.col("south")) / rows}).withColumn("_r", axis(rows)).withColumn("_c", axis(cols))
    bounds = {"east": F.col("west") + (F.col("_c") + 1) * F.col("_w"), "north": F.col("south") + (F.col("_r") + 1) * F.col("_h"), "west": F.col("west") + F.col("_c") * F.col("_w"), "south": F.col("south") + F.col("_r") * F.col("_h")}
    return g.withColumns({"cell_id": F.format_string("V6_CELL_R%03d_C%03d", F.col("_r") + 1, F.col("_c") + 1), **bounds}).drop("_w", "_h", "_r", "_c")


def completeness(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Rows, missing values and zeros of each feature within each key."""
    u = df.unpivot(key, features, "feature", "v")
    return u.groupBy(*key, "feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("v") == 0).alias("zeros"))
