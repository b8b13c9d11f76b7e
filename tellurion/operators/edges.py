"""Edges of a band: smoothing, ridges of the gradient, and linking of weak to strong pixels.

Smoothing and gradients are windows along rows and columns with the border pixel
repeated.  A pixel is a ridge if its gradient is over that of the neighbour behind and
not under that of the one ahead, in the gradient's direction (to the nearest of four);
beyond the border there is no gradient.  Ridges of at least ``low`` are kept where their
8-connected group, found over stretches of a row, holds one of at least ``high``.
A missing pixel and those next to it have no gradient.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import number
from tellurion.operators.objects import connected
from tellurion.operators.windows2d import _axis, _neighbour

#: Tangent of half a sector.
HALF = math.tan(math.pi / 8)


def weights(sigma: float) -> list[float]:
    """The normal kernel's weights from the centre on, up to two and a half deviations."""
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(math.ceil(2.5 * sigma) + 1)]
    return [w / (raw[0] + 2 * sum(raw[1:])) for w in raw]


def smoothed(df: DataFrame, x: str, sigma: float, name: str = "_s") -> DataFrame:
    """Adds the band smoothed along rows and then along columns; NULL where a pixel of the kernel is missing."""
    w = weights(sigma)
    for source, fixed, along in ((x, "row", "col"), (name, "col", "row")):
        axis = _axis(fixed, along)
        out = number(w[0]) * F.col(source)
        for k in range(1, len(w)):
            out = out + number(w[k]) * (_neighbour(source, axis, -k) + _neighbour(source, axis, k))
        df = df.withColumn(name, out)
    return df


def ridges(df: DataFrame, x: str) -> DataFrame:
    """Adds magnitude (NULL where the band is missing around) and ridge."""
    across, down = _axis("row", "col"), _axis("col", "row")
    gx, gy = ((_neighbour(x, w, 1) - _neighbour(x, w, -1)) / 2.0 for w in (across, down))
    d = df.withColumns({"_gx": gx, "_gy": gy}).withColumn("magnitude", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    m = F.coalesce("magnitude", number(0))
    d = d.withColumn("_row", F.struct(F.coalesce(F.lag(m).over(across), number(0)).alias("a"), m.alias("b"), F.coalesce(F.lead(m).over(across), number(0)).alias("c")))
    d = d.withColumns({"_up": F.lag("_row").over(down), "_down": F.lead("_row").over(down)})
    side = lambda at, f: F.coalesce(F.col(at)[f], number(0))
    ax, ay = F.abs("_gx"), F.abs("_gy")
    pick = lambda level, steep, falling, rising: F.when(ay <= ax * HALF, level).when(ax <= ay * HALF, steep).when((F.col("_gx") > 0) == (F.col("_gy") > 0), falling).otherwise(rising)
    behind = pick(F.col("_row.a"), side("_up", "b"), side("_up", "a"), side("_up", "c"))
    ahead = pick(F.col("_row.c"), side("_down", "b"), side("_down", "c"), side("_down", "a"))
    ridge = (F.col("magnitude") > behind) & (F.col("magnitude") >= ahead)
    return d.withColumn("ridge", F.coalesce(ridge, F.lit(False))).drop("_gx", "_gy", "_row", "_up", "_down")


def linked(marked: DataFrame, low: float, high: float) -> DataFrame:
    """The ridges of at least ``low`` in groups with one of at least ``high``: run_id, row, col, magnitude, strong and edge_id (in scan order from 1)."""
    weak = marked.where(F.col("ridge") & (F.col("magnitude") >= low)).select("run_id", "row", "col", "magnitude", (F.col("magnitude") >= high).alias("strong"))
    groups = connected(weak, min_pixels=1)
    held = groups.groupBy("run_id", "object_id").agg(F.bool_or("strong").alias("_any")).where("_any")
    held = held.withColumn("edge_id", F.row_number().over(Window.partitionBy("run_id").orderBy("object_id"))).drop("_any")
    return groups.join(held, ["run_id", "object_id"]).drop("object_id")


def edges(df: DataFrame, x: str, low: float, high: float, sigma: float = 1.0) -> DataFrame:
    """Edge pixels of a band of whole grids (run_id, row, col)."""
    return linked(ridges(smoothed(df.select("run_id", "row", "col", F.col(x).cast("double").alias("_x")), "_x", sigma), "_s"), low, high)
