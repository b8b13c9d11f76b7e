"""Statistics of whole grids, joined back to their pixels.

A statistic is one aggregation for all bands of a grid (one small row a grid) and
one equi-join back; Spark broadcasts the small side where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import clip, col, number
from tellurion.sources.scratch import materialise
from tellurion.sources.views import spread

KEY = ["run_id"]


def with_stats(df: DataFrame, stats: dict[str, Column], key: list[str] = KEY, written: bool = False) -> DataFrame:
    """``df`` with the aggregates ``stats`` of its group.

    ``written`` statistics have a size that Spark knows before the join, so the rows of
    ``df`` are shuffled for it only where there are too many groups to broadcast.
    """
    small = df.groupBy(*key).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(materialise(small, "statistics") if written else small, key)


def quantile(x, q: float) -> Column:
    """Exact quantile, linear between neighbours."""
    return F.percentile(col(x), F.lit(float(q)))


def norm01(df: DataFrame, columns: dict[str, Column | str], key: list[str] = KEY, minimum: int = 10, written: bool = False) -> DataFrame:
    """Adds each column stretched from its 2nd..98th percentile to 0..1.

    Missing pixels give 0; so does the whole band with fewer than ``minimum`` valid
    pixels or a range under 1e-6.
    """
    df = df.withColumns({f"_v_{n}": col(c) for n, c in columns.items()})
    stats = {}
    for n in columns:
        ends = F.percentile(f"_v_{n}", F.array(F.lit(0.02), F.lit(0.98)))
        low, range_ = F.get(ends, F.lit(0)), F.get(ends, F.lit(1)) - F.get(ends, F.lit(0))
        stats |= {f"_lo_{n}": low, f"_w_{n}": F.when((F.count(f"_v_{n}") >= minimum) & (F.abs(range_) >= 1e-6), range_)}
    df = with_stats(df, stats, key, written)
    # A missing pixel or range makes the quotient NULL, which the greatest passes over; short, as all bands' formulas are one generated method.
    place = lambda n: F.try_divide(F.col(f"_v_{n}") - F.col(f"_lo_{n}"), F.col(f"_w_{n}"))
    return df.withColumns({n: F.least(F.greatest(place(n), number(0)), number(1)) for n in columns}).drop(*[f"_{k}_{n}" for n in columns for k in ("v", "lo", "w")])


def robust_z(df: DataFrame, columns: list[str], key: list[str] = KEY, suffix: str = "_z") -> DataFrame:
    """(x - median) / (1.4826 MAD); mean and deviation where MAD is 0; 0 where the band is constant."""
    df = with_stats(df, {f"_m_{c}": F.median(c) for c in columns} | {f"_a_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}, key)
    df = with_stats(df, {f"_d_{c}": F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))) for c in columns}, key)
    out = {}
    for c in columns:
        mad = F.col(f"_d_{c}") * 1.4826
        out[c + suffix] = (
            F.when(F.col(c).isNull(), F.lit(None).cast("double"))
            .when(mad > 1e-9, F.try_divide(F.col(c) - F.col(f"_m_{c}"), mad))
            .when(F.col(f"_s_{c}") > 1e-9, F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")))
            .otherwise(number(0)))
    return df.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "masd"])


def hypercube(df: DataFrame, columns: list[str], key: list[str] = KEY, minimum: int = 100, limit: float = 8.0) -> DataFrame:
    """(x - median) / IQR clipped to +-8, with IQR at least 1e-6 and (0, 1) below ``minimum`` valid pixels; plus mask_any and mask_all."""
    stats = {}
    for c in columns:
        enough = F.count(c) >= minimum
        stats[f"_m_{c}"] = F.when(enough, F.median(c)).otherwise(number(0))
        stats[f"_i_{c}"] = F.when(enough, F.greatest(quantile(c, 0.75) - quantile(c, 0.25), number(1e-6))).otherwise(number(1))
    df = with_stats(df, stats, key)
    out = {f"{c}_n": clip((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_i_{c}"), -limit, limit) for c in columns}
    from tellurion.functions.columns import all_valid, any_valid

    out |= {"mask_any": any_valid(*columns).cast("int"), "mask_all": all_valid(*columns).cast("int")}
    return df.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "mi"])


def filled_quantiles(df: DataFrame, columns: list[str], low: float, high: float, key: list[str] = KEY, also: dict[str, Column] | None = None) -> DataFrame:
    """One row a group: by column c a struct ``_s_c`` (middle, low, high) of its median and of the exact percentiles of the band whose missing values are that median; plus the aggregates ``also``.

    One sort serves all: the copies of the median lie in the middle of the sorted values, so
    places in the filled band are places among the values. No band is held whole.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"), F.array(*[F.count(c) for c in columns]).alias("_n"), *[c.alias(n) for n, c in (also or {}).items()])
    values = df.select(*key, F.posexplode(F.array(*[col(c).cast("double") for c in columns])).alias("_b", "_v")).where("_v is not null")
    ranked = spread(values, *key).withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_b").orderBy("_v")) - 1)
    n = F.get("_n", F.col("_b"))
    former, copies = F.floor((n + 1) / 2), F.col("_all") - n  # values before the copies of the median
    spots = {"m": number(0.5) * (n - 1)} | {k: number(q) * (F.col("_all") - 1) for k, q in (("l", low), ("h", high))}
    place = lambda k, i: i if k == "m" else F.when(i < former, i).when(i >= former + copies, i - copies)
    ends = {f"{k}{e}": place(k, f(x)) for k, x in spots.items() for e, f in (("0", F.floor), ("1", F.ceil))}
    picked = ranked.join(counts.select(*key, "_all", "_n"), key).where(F.greatest(*[F.coalesce(F.col("_r") == i, F.lit(False)) for i in ends.values()]))
    picked = picked.groupBy(*key, "_b").agg(F.max(spots["l"]).alias("l"), F.max(spots["h"]).alias("h"), F.max(spots["m"]).alias("m"), *[F.max(F.when(F.col("_r") == i, F.col("_v"))).alias(f"_{k}") for k, i in ends.items()])
    between = lambda k: F.when(F.col(f"_{k}0") == F.col(f"_{k}1"), F.col(f"_{k}0")).otherwise((F.ceil(k) - F.col(k)) * F.col(f"_{k}0") + (F.col(k) - F.floor(k)) * F.col(f"_{k}1"))
    picked = picked.withColumn("_mid", between("m")).withColumns({f"_{k}{e}": F.coalesce(f"_{k}{e}", "_mid") for k in "lh" for e in "01"})
    made = picked.select(*key, "_b", F.struct(F.col("_mid").alias("middle"), between("l").alias("low"), between("h").alias("high")).alias("_s"))
    made = made.groupBy(*key).agg(*[F.first(F.when(F.col("_b") == i, F.col("_s")), ignorenulls=True).alias(f"_s_{c}") for i, c in enumerate(columns)])
    return counts.drop("_all", "_n").join(made, key, "left")


def filled_and_clipped(c: str) -> Column:
    """Column ``c`` filled and clipped by its struct of ``filled_quantiles``."""
    s = F.col(f"_s_{c}")
    return F.least(F.greatest(F.coalesce(F.col(c), s["middle"]), s["low"]), s["high"])


def fill_and_clip(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, key: list[str] = KEY) -> DataFrame:
    """Missing values become the median; then values are clipped to the percentiles of the filled band."""
    df = df.join(filled_quantiles(df, columns, low, high, key), key)
    return df.withColumns({f"{c}_f": filled_and_clipped(c) for c in columns}).drop(*[f"_s_{c}" for c in columns])
