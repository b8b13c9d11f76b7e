"""Candidate cells: scoring, ranking, request zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import clamp01, clip, number
from tellurion.functions.group_stats import quantile

# Warning thresholds (share of a cell) and weights.
WARN = {"builtup": 0.02, "builtup_near": 0.05, "cropland": 0.65, "water_edge": 0.05, "strong_built": 0.01, "building_near": 0.03, "road_like": 0.08, "corridor": 0.025}
MAX_ZONES = 25


def score(cells: DataFrame) -> DataFrame:
    """Contrast, warnings, penalty and review priority of every cell.

    Global thresholds (upper spectral quartile, terrain median) and the extremes
    for min-max norms are two one-row aggregates joined back.
    """
    c = cells.withColumns({
        "contrast": clamp01(0.7 * F.col("spectral") + 0.3 * F.coalesce("sar", "spectral")), "s2_confidence": clamp01(F.col("s2_count") / 8)})
    c = c.withColumn("candidate_score", clamp01(0.35 * clamp01("visibility") + 0.35 * F.col("contrast") + 0.2 * clamp01("terrain") + 0.1 * F.col("s2_confidence")))
    one = c.agg(quantile("spectral", 0.75).alias("_q75"), quantile(clamp01("terrain"), 0.5).alias("_med"))
    c = c.join(F.broadcast(one))  # one row
    over = lambda *names: sum(((F.col(n) >= WARN[n]).cast("int") for n in names[1:]), (F.col(names[0]) >= WARN[names[0]]).cast("int")) > 0
    c = c.withColumns({"w_built": over("builtup", "builtup_near").cast("int"), "w_crop": over("cropland").cast("int"), "w_water": over("water_edge").cast("int"), "w_building": over("strong_built", "building_near").cast("int"), "w_road": over("road_like", "corridor").cast("int")})
    modern = (F.col("spectral") >= F.col("_q75")) & (clamp01("terrain") <= F.col("_med")) & (F.col("w_built") + F.col("w_crop") + F.col("w_water") > 0)
    c = c.withColumn("w_linear", modern.cast("int"))
    c = c.withColumns({"warnings": F.col("w_building") + F.col("w_road") + F.col("w_crop") + F.col("w_water"), "context_warnings": F.col("w_built") + F.col("w_crop") + F.col("w_water") + F.col("w_linear")})
    c = c.withColumns({"penalty": clip(F.col("warnings") * 0.07, 0.0, 0.28), "bonus": clamp01(1 - F.least(F.col("warnings"), F.lit(4)) / 4.0)})
    c = c.withColumn("adjusted", F.col("candidate_score") * (1 - F.col("penalty")))
    ext = c.agg(F.min("adjusted").alias("_a0"), F.max("adjusted").alias("_a1"), F.min("gap").alias("_g0"), F.max("gap").alias("_g1"))
    c = c.join(F.broadcast(ext))  # one row
    norm = lambda x, lo, hi: F.when(F.col(hi) == F.col(lo), number(1)).otherwise((F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    priority = clamp01(0.35 * norm("adjusted", "_a0", "_a1") + 0.25 * clamp01("confidence") + 0.2 * clamp01("stability") + 0.1 * clamp01("season") + 0.05 * norm("gap", "_g0", "_g1") + 0.05 * F.col("bonus"))
    return c.withColumn("priority", priority).drop("_q75", "_med", "_a0", "_a1", "_g0", "_g1")


ORDER = ("warnings", "-top10", "-season_top10", "-top25", "-season_top25", "-priority", "cell_id")


def _order():
    return [F.col(k[1:]).desc() if k[0] == "-" else F.col(k).asc() for k in ORDER]


def rank(scored: DataFrame) -> DataFrame:
    """Position in the seven-key order.

    Cells are first ranked inside their warning count (0..4), then moved up by the
    number of cells with fewer warnings, so no single task sorts all of them.
    """
    inner = F.row_number().over(Window.partitionBy("warnings").orderBy(*_order()))
    n = scored.groupBy("warnings").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(Window.orderBy("warnings")) - F.col("_n")).drop("_n")  # at most five rows
    return scored.join(F.broadcast(n), "warnings").withColumn("rank", (inner + F.col("_before")).cast("int")).drop("_before")


def request_zones(scored: DataFrame, most: int = MAX_ZONES) -> DataFrame:
    """The first ``most`` cells with zone and quote ids and their bounds; a top-k, not a sort."""
    top = scored.orderBy(*_order()).limit(most)
    z = top.withColumn("k", F.row_number().over(Window.orderBy(*_order())))
    return z.select(
        F.format_string("zone_%03d", "k").alias("zone_id"), F.format_string("quote_%03d", "k").alias("quote_id"), "cell_id", F.col("k").cast("int").alias("rank"), "priority", "warnings", "west", "south", "east", "north")


def zone_geojson(zones: DataFrame) -> DataFrame:
    """A polygon feature as JSON for each zone."""
    ring = F.concat(F.lit("[["), F.array_join(F.array(*[F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]")) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))]), ","), F.lit("]]"))
    body = F.concat(F.lit('{"type":"Feature","properties":{"zone_id":"'), "zone_id", F.lit('"},"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    return zones.select("zone_id", body.alias("feature"))
