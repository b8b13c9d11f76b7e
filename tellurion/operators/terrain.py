"""Terrain derivatives of an elevation band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions.columns import clamp01, number
from tellurion.operators import windows2d as w2


def gradient(df: DataFrame, scale: float = 10.0, z: str = "dem") -> DataFrame:
    """dzdx, dzdy, slope and aspect in degrees."""
    df = w2.central(w2.central(df, z, "dzdx", "col", scale), z, "dzdy", "row", scale)
    x, y = F.col("dzdx"), F.col("dzdy")
    ok = F.col(z).isNotNull()
    return df.withColumns({
        "slope": F.when(ok, F.degrees(F.atan(F.sqrt(x * x + y * y)))),
        "aspect": F.when(ok, F.pmod(F.degrees(F.atan2(-x, y)) + 360.0, number(360)))})


def curvatures(df: DataFrame, scale: float = 10.0, z: str = "dem") -> DataFrame:
    """Laplacian, profile and plan curvature from second differences of the gradient."""
    df = gradient(df, scale, z)
    df = w2.central(df, "dzdx", "_r", "col", scale)
    df = w2.central(df, "dzdx", "_s", "row", scale)
    df = w2.central(df, "dzdy", "_t", "row", scale)
    p, q, r, s, t = (F.col(c) for c in ("dzdx", "dzdy", "_r", "_s", "_t"))
    g = p * p + q * q
    root = F.sqrt(g + 1.0)
    ok = F.col(z).isNotNull()
    return df.withColumns({
        "curv_laplacian": F.when(ok, r + t),
        "curv_profile": F.when(ok, -(r * p * p + s * p * q * 2.0 + t * q * q) / ((g + 1.0) * root + 1e-12)),
        "curv_plan": F.when(ok, (r * q * q - s * p * q * 2.0 + t * p * p) / ((g + 1e-12) * (root + 1e-12)))}).drop("_r", "_s", "_t")


def relief(df: DataFrame, r: int, scale: float = 10.0, z: str = "dem") -> DataFrame:
    """TPI, roughness, TRI and TWI in a box of radius ``r``."""
    df = w2.box_stats(gradient(df, scale, z), z, r, "_b")
    mean, ok = F.col("_b_mean"), F.col(z).isNotNull()
    df = df.withColumn("_d", F.abs(F.col(z) - mean))
    df = w2.box_stats(df, "_d", r, "_t")
    tangent = F.greatest(F.tan(F.radians("slope")), number(1e-6))
    return df.withColumns({
        "tpi": F.col(z) - mean, "roughness": F.when(ok, F.col("_b_std")), "tri": F.when(ok, F.col("_t_mean")),
        "twi": F.when(ok, F.ln((F.greatest(mean - F.col(z), number(0)) + 1.0) / tangent))}).drop("_b_mean", "_b_std", "_t_mean", "_t_std", "_d")


def hillshade(df: DataFrame, azimuth: float = 45.0, altitude: float = 45.0, scale: float = 10.0, z: str = "dem") -> DataFrame:
    df = gradient(df, scale, z)
    slope, aspect = F.radians("slope"), F.atan2(-F.col("dzdx"), F.col("dzdy"))
    az, alt = F.radians(number(azimuth)), F.radians(number(altitude))
    return df.withColumn("hillshade", clamp01(F.sin(alt) * F.cos(slope) + F.cos(alt) * F.sin(slope) * F.cos(az - aspect)))
