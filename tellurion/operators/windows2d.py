"""Neighbourhoods on grids with edge-replicated borders, by two one-dimensional windows.

A box of (2r+1)^2 pixels is a window over a row's columns and then one over a
column's rows; the border adds the first or last pixel as often as the box leaves
the grid.  A partition of a window is one row or column of one grid.  Where a grid
ends is read from the window itself, so grids of any height and width, and of
different ones in one table, are worked alike; they must be whole (a missing pixel
is a row with NULL values).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tellurion.functions.columns import col, number

GRID = ["run_id"]
#: Side of the blocks in which median filters work, in pixels.
BLOCK = 128


def _axis(fixed: str, along: str):
    return Window.partitionBy(*GRID, fixed).orderBy(along)


def _beyond(w, r: int) -> tuple[Column, Column]:
    """How far a box of radius ``r`` reaches over the grid's first and last pixel."""
    missing = lambda a, b: F.lit(r) - F.count(F.lit(1)).over(w.rowsBetween(a, b))
    return missing(-r, -1), missing(1, r)


def _padded_sum(x: Column, fixed: str, along: str, r: int) -> Column:
    w = _axis(fixed, along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = _beyond(w, r)
    return F.sum(x).over(w.rowsBetween(-r, r)) + before * F.first(x).over(whole) + after * F.last(x).over(whole)


def _neighbour(x: str, w, k: int) -> Column:
    """The value ``k`` places on, that of the last pixel beyond the border; the value may be NULL."""
    if not k:
        return F.col(x)
    step = 1 if k > 0 else -1
    at = [(F.lead if k > 0 else F.lag)(F.struct(x), abs(i)).over(w) for i in range(k, 0, -step)]
    return F.coalesce(*at, F.struct(x)).getField(x)


def box_sums(df: DataFrame, values: dict[str, Column], r: int) -> DataFrame:
    """Adds the padded box sum of each value (which must not be NULL)."""
    df = df.withColumns({f"_h_{n}": c for n, c in values.items()})
    df = df.withColumns({f"_h_{n}": _padded_sum(F.col(f"_h_{n}"), "row", "col", r) for n in values})
    return df.withColumns({n: _padded_sum(F.col(f"_h_{n}"), "col", "row", r) for n in values}).drop(*[f"_h_{n}" for n in values])


def box_stats(df: DataFrame, x, r: int, name: str) -> DataFrame:
    """Adds {name}_mean and {name}_std (population) over the valid pixels of the box."""
    x = col(x)
    v = F.coalesce(x.cast("double"), number(0))
    df = box_sums(df, {"_s": v, "_q": v * v, "_c": x.isNotNull().cast("double")}, r)
    mean = F.try_divide("_s", "_c")
    var = F.try_divide("_q", "_c") - mean * mean
    return df.withColumns({f"{name}_mean": mean, f"{name}_std": F.when(F.col("_c") > 0, F.sqrt(F.greatest(var, number(0))))}).drop("_s", "_q", "_c")


def box_max(df: DataFrame, x, r: int, name: str) -> DataFrame:
    """Adds the largest value of the box (the border adds nothing new)."""
    df = df.withColumn("_m", F.max(col(x)).over(_axis("row", "col").rowsBetween(-r, r)))
    return df.withColumn(name, F.max("_m").over(_axis("col", "row").rowsBetween(-r, r))).drop("_m")


def erode(df: DataFrame, mask: str, name: str, r: int = 1) -> DataFrame:
    """Adds 1 where the whole box of radius ``r`` lies inside the grid and has ``mask`` = 1, else 0."""
    full = lambda fixed, along: sum(_beyond(_axis(fixed, along), r), F.lit(0)) == 0
    inside = df.withColumns({"_hole": 1 - F.col(mask), "_y": full("row", "col"), "_x": full("col", "row")})
    return box_max(inside, "_hole", r, "_any").withColumn(name, (F.col("_y") & F.col("_x") & (F.col("_any") == 0)).cast("int")).drop("_hole", "_any", "_y", "_x")


def gather(df: DataFrame, x, r: int, name: str) -> DataFrame:
    """Adds the values of the box of radius ``r``, row by row, as an array (NULLs included)."""
    df = df.withColumn("_x", col(x))
    steps = range(-r, r + 1)
    df = df.withColumn("_t", F.array(*[_neighbour("_x", _axis("row", "col"), k) for k in steps]))
    return df.withColumn(name, F.concat(*[_neighbour("_t", _axis("col", "row"), k) for k in steps])).drop("_x", "_t")


def gather3(df: DataFrame, x, name: str) -> DataFrame:
    return gather(df, x, 1, name)


def gather5(df: DataFrame, x, name: str) -> DataFrame:
    return gather(df, x, 2, name)


def median_filter(df: DataFrame, x: str, size: int, name: str) -> DataFrame:
    """Adds the median of the size x size box with missing pixels at the grid's median (0 without any)."""
    return median_filters(df, {name: (x, size)})


def median_filters(df: DataFrame, bands: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds for each name the median filter of a band; bands: name to (band, size).

    The grid's medians are one aggregation for all bands.  A grid is cut into blocks of
    ``BLOCK`` pixels a side; a block and the pixels around it that its boxes reach are one
    group, in which all bands are filtered, so no box is ever a row's array and no group
    grows with the grid.  Borders repeat their end pixels.
    """
    from tellurion.functions.group_stats import with_stats

    reach = max(size for _, size in bands.values()) // 2
    ends = {f"_{e}_{k}": f(k) for k in ("row", "col") for e, f in (("min", F.min), ("max", F.max))}
    d = with_stats(df, {f"_med_{n}": F.median(x) for n, (x, _) in bands.items()} | ends, written=True)
    # The bands' values with missing pixels filled: by its type the array holds no NULL, so a group takes it as numbers.
    d = d.withColumn("_b", F.array(*[F.coalesce(F.col(x), f"_med_{n}", number(0)) for n, (x, _) in bands.items()]))

    def blocks(k: str) -> Column:
        """The blocks of a grid that need this row or column."""
        at = lambda c: F.floor(c / BLOCK).cast("int")
        return F.explode(F.sequence(at(F.greatest(F.col(k) - reach, F.col(f"_min_{k}"))), at(F.least(F.col(k) + reach, F.col(f"_max_{k}")))))

    d = d.withColumn("_by", blocks("row")).withColumn("_bx", blocks("col")).select(*df.columns, "_b", "_by", "_bx")
    kept = df.columns

    def filtered(t: pa.Table) -> pa.Table:
        row, col, by, bx = (t[k].to_numpy().astype(np.int64) for k in ("row", "col", "_by", "_bx"))
        own = (row // BLOCK == by) & (col // BLOCK == bx)
        y, x = row - row.min(), col - col.min()
        oy, ox = y[own], x[own]
        out = t.filter(pa.array(own)).select(kept)
        values = t["_b"].combine_chunks().flatten().to_numpy().reshape(-1, len(bands))
        for i, (name, (_, size)) in enumerate(bands.items()):
            grid = np.zeros((y.max() + 1, x.max() + 1))
            grid[y, x] = values[:, i]
            medians = _block_medians(grid, (oy.min(), oy.max()), (ox.min(), ox.max()), size)
            out = out.append_column(pa.field(name, pa.float64()), pa.array(medians[oy - oy.min(), ox - ox.min()]))
        return out

    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in bands]])
    return d.groupBy(*GRID, "_by", "_bx").applyInArrow(filtered, schema)


def _block_medians(grid: np.ndarray, rows: tuple[int, int], cols: tuple[int, int], size: int) -> np.ndarray:
    """Medians of the boxes around the pixels from the first to the last of ``rows`` and ``cols``; places beyond the grid have its end pixels' values."""
    r = size // 2
    cut, pad = [], []
    for (first, last), n in zip((rows, cols), grid.shape):
        cut.append(slice(max(first - r, 0), min(last + r, n - 1) + 1))
        pad.append((max(r - first, 0), max(last + r - (n - 1), 0)))
    boxes = np.lib.stride_tricks.sliding_window_view(np.pad(grid[tuple(cut)], pad, mode="edge"), (size, size))
    middle = size * size // 2
    return np.stack([np.partition(line.reshape(len(line), -1), middle, axis=1)[:, middle] for line in boxes])


def local_contrast(df: DataFrame, bands: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds for each name the stretched distance of a band from its median filter; bands: name to (band, size).

    The filtered bands are written, so that the statistics that follow read them
    instead of filtering again.
    """
    from tellurion.functions.group_stats import norm01
    from tellurion.sources.scratch import materialise

    df = materialise(median_filters(df, {f"_m_{n}": b for n, b in bands.items()}), "contrast")
    df = norm01(df, {name: F.abs(F.col(band) - F.col(f"_m_{name}")) for name, (band, _) in bands.items()}, written=True)
    return df.drop(*[f"_m_{name}" for name in bands])


def valid_values(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def array_mean(a: Column) -> Column:
    a = valid_values(a)
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a).cast("double"))


def array_median(a: Column) -> Column:
    """Median of the values that are there.  The sorted values are behind one lambda variable, so they are made once, and hold no NULL, so they are sorted as numbers."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: F.get(s, i.cast("int"))
        return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    return F.get(F.transform(F.array(F.sort_array(F.array_compact(a))), middle), F.lit(0))


def array_std(a: Column, mean: Column) -> Column:
    """Population deviation in two passes."""
    a = valid_values(a)
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(a)))


def entropy3(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the Shannon entropy (bits) of the 3 x 3 box in 16 equal bins between its extremes; ``x`` must not be NULL."""
    df = gather3(df, x, "_g").withColumn("_lo", F.array_min("_g")).withColumn("_span", F.array_max("_g") - F.col("_lo"))
    edge = lambda k: F.col("_lo") + F.col("_span") * (k / 16.0)

    def bin_of(v):
        k = F.floor((v - F.col("_lo")) * 16.0 / F.col("_span"))
        return F.least(k + (v >= edge(k + 1)).cast("int") - (v < edge(k)).cast("int"), F.lit(15))

    df = df.withColumn("_bins", F.when(F.col("_span") > 1e-12, F.transform("_g", bin_of)))
    ones = F.transform(F.array_distinct("_bins"), lambda b: F.size(F.filter("_bins", lambda y: y == b)) / 9.0)
    bits = F.aggregate(ones, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return df.withColumn(name, F.coalesce(bits, F.lit(0.0))).drop("_g", "_lo", "_span", "_bins")


def central(df: DataFrame, x: str, name: str, along: str, scale: float) -> DataFrame:
    """Adds the derivative: central inside, one-sided at the border; NULL where a value that it needs is missing."""
    w = _axis("row" if along == "col" else "col", along)
    here, back, ahead = F.struct(x), F.lag(F.struct(x)).over(w), F.lead(F.struct(x)).over(w)
    last, first = F.coalesce(ahead, here).getField(x), F.coalesce(back, here).getField(x)
    steps = back.isNotNull().cast("int") + ahead.isNotNull().cast("int")
    return df.withColumn(name, F.try_divide(last - first, steps * scale))
