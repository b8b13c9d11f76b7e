"""Proxy layers of stretched bands, and point signatures: weighted scores that abstain where an input is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions import group_stats as g
from tellurion.functions.columns import all_valid, clamp01, clip, first_greatest, number, weighted
from tellurion.operators import windows2d as w2

# Weights of the layers and signatures, and the names of targets.
QUARTZ = {"gold_c": 0.35, "thermal_c": 0.25, "clay_thermal_n": 0.20, "rough_n": 0.20}
LIME = {"clay_thermal_n": 0.30, "rough_n": 0.25, "curv_n": 0.20, "tpi_n": 0.15, "thermal_c": 0.10, "vh_n": -0.20}
MOIST = {"vegroot_n": 0.35, "cool": 0.25, "vh_n": 0.20, "ratio_c": 0.20}
OXID = {"silver_n": 0.50, "clay_thermal_n": 0.25, "gold_c": 0.25}
SAR_ENERGY = {"vv_n": 0.45, "vh_n": 0.35, "ratio_n": 0.20}
SAR_COMP = {"sar_energy": 0.55, "vv_c": 0.25, "vh_c": 0.20}
THERMAL_RISK = {"thermal_c": 0.50, "thermal_delta_n": 0.30, "thermal_inertia_n": 0.20}
RISK = {"quartz": 0.28, "lime": 0.22, "moist": 0.20, "oxid": 0.18, "thermal_risk": 0.12}
METAL = {"gold": 0.40, "silver": 0.25, "mass": 0.25, "sar_comp": 0.10}
VOID = {"tunnel": 0.45, "door": 0.25, "tpi": 0.15, "rough": 0.15}
CERAMIC = {"pottery": 0.60, "lime": 0.20, "curv": 0.20}
FALSE_SIGNATURE = {"risk": 0.35, "quartz": 0.20, "lime": 0.20, "moist": 0.15, "oxid": 0.10}
SARCOPHAGUS = {"_void": 0.35, "mass": 0.30, "door": 0.20, "rough": 0.15}
RAN = {"mass": 0.35, "door": 0.30, "tunnel": 0.20, "sar_comp": 0.15}
STATUE = {"mass": 0.35, "gold": 0.25, "silver": 0.20, "ascdesc": 0.20}
DEPTH = {"_void": 1.2, "sar_comp": 0.9, "thermal": 0.7, "delta": 0.5, "rough": 0.4}
TARGETS = ("jar_جرة", "chest_صندوق", "sarcophagus_تابوت", "ran_ران", "statue_تمثال", "void_فراغ", "false_signature_وهم")
POINT_COLUMNS = (
    "nb_metal_signature", "nb_void_signature", "nb_ceramic_signature", "nb_mass_signature", "nb_false_signature_score", "nb_best_object_interpretation", "nb_best_object_score", "nano_depth_penetration", "nb_depth_m", "nb_depth_available")


def proxy_layers(df: DataFrame) -> DataFrame:
    """quartz, lime, moist, oxid, sar_comp and risk of each grid's pixels, stretched to 0..1, beside what they are made of.

    Needs vv, vh, ratio, gold, silver, thermal_day, thermal_inertia, rough, curv, tpi,
    vegroot, clay_thermal and thermal_delta.
    """
    normed = ("vv", "vh", "ratio", "silver", "thermal_inertia", "thermal_day", "rough", "curv", "tpi", "vegroot", "clay_thermal", "thermal_delta")
    df = g.norm01(df, {f"{n}_n": n for n in normed}, written=True)
    df = df.select(*w2.GRID, "row", "col", "gold", "thermal_day", *[f"{n}_n" for n in normed])  # the bands themselves are done with
    df = w2.local_contrast(df, {"gold_c": ("gold", 11), "thermal_c": ("thermal_day", 11), "ratio_c": ("ratio_n", 11), "vv_c": ("vv_n", 7), "vh_c": ("vh_n", 7)})
    df = df.withColumn("cool", 1.0 - F.col("thermal_day_n"))
    df = g.norm01(df, {"quartz": weighted(QUARTZ), "lime": weighted(LIME), "moist": weighted(MOIST), "oxid": weighted(OXID), "sar_energy": weighted(SAR_ENERGY), "thermal_risk": weighted(THERMAL_RISK)}, written=True)
    return g.norm01(df, {"sar_comp": weighted(SAR_COMP), "risk": weighted(RISK)}, written=True)


def point_signature(df: DataFrame) -> DataFrame:
    """Adds POINT_COLUMNS to rows of the signatures' inputs; NULL is a missing input."""
    df = df.withColumns({"_metal": clamp01(weighted(METAL)), "_void": clamp01(weighted(VOID)), "_ceramic": clamp01(weighted(CERAMIC)), "_false": clamp01(weighted(FALSE_SIGNATURE))})
    metal, void, ceramic, false_ = (F.col(n) for n in ("_metal", "_void", "_ceramic", "_false"))
    scores = dict(zip(TARGETS, (
        ceramic * clamp01(0.7 + 0.3 * void) * (1.0 - 0.35 * false_), metal * clamp01(0.6 + 0.4 * F.col("mass")) * (1.0 - 0.30 * false_), clamp01(weighted(SARCOPHAGUS)) * (1.0 - 0.25 * false_),
        clamp01(weighted(RAN)) * (1.0 - 0.25 * false_), clamp01(weighted(STATUE)) * (1.0 - 0.30 * false_), void * (1.0 - 0.20 * F.col("moist")), false_)))
    whole = all_valid("_metal", "_void", "_ceramic", "_false", "mass", "door", "rough", "tunnel", "sar_comp", "gold", "silver", "ascdesc", "moist")
    df = df.withColumns({f"_s{i}": F.when(whole, s) for i, s in enumerate(scores.values())})
    places = [F.col(f"_s{i}") for i in range(len(TARGETS))]
    depth = number(0.6) + weighted(DEPTH)
    return df.withColumns({
        "nb_metal_signature": F.round(metal, 4), "nb_void_signature": F.round(void, 4), "nb_ceramic_signature": F.round(ceramic, 4), "nb_mass_signature": F.round(clamp01("mass"), 4),
        "nb_false_signature_score": F.round(false_, 4), "nb_best_object_interpretation": first_greatest(dict(zip(TARGETS, places))), "nb_best_object_score": F.round(F.greatest(*places), 4),
        "nano_depth_penetration": F.round("nano_depth_penetration", 6), "nb_depth_m": F.round(clip(depth, 0.4, 5.0), 2), "nb_depth_available": depth.isNotNull(),
    }).drop("_metal", "_void", "_ceramic", "_false", *[f"_s{i}" for i in range(len(TARGETS))])
