"""Polygons on grids and rectangles of any size.

A polygon is a set of column stretches, one table row for each (grid row, stretch):
edges are exploded into the grid rows whose centre line they cross, the crossings of a
row are sorted and paired even-odd.  Holes, parts and touching outlines need no rule of
their own.  Erosion, overlaps and statistics work on stretches with windows and
equi-joins; no pixel is compared with a polygon's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import number

EARTH_RADIUS = 6378137.0
#: Columns to a cell when stretches of different polygons are joined.
CELL = 64
#: Rectangles narrower than 2**LEAST_LEVEL meet in cells of that side.
LEAST_LEVEL = -20
_KEYS = ["run_id", "feature_id"]
_ROW = [*_KEYS, "row"]
# Directions of background rectangles, in sizes and gaps to the north and east.
DIRECTIONS = (("north", 1, 0), ("east", 0, 1), ("south", -1, 0), ("west", 0, -1), ("northeast", 1, 1), ("southeast", -1, 1), ("southwest", -1, -1), ("northwest", 1, -1))


def _merged(s: DataFrame) -> DataFrame:
    """Stretches (c0, c1; apart from each other) with those side by side made one."""
    w = Window.partitionBy(*_ROW).orderBy("c0")
    new = F.coalesce(F.col("c0") > F.lag("c1").over(w) + 1, F.lit(True))
    s = s.withColumn("_new", new.cast("int")).withColumn("_part", F.sum("_new").over(w))
    return s.groupBy(*_ROW, "_part").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_part")


def stretches(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """run_id, feature_id, row, c0, c1: the pixels of a height x width grid whose centres lie inside, even-odd over all rings.

    ``polygons`` has run_id, feature_id and rings, an array of rings of (x, y) in pixels
    from the grid's corner; a ring need not be closed.  A centre on an edge is inside if
    the edge is the polygon's left one or, of level ones, never.  A polygon with a
    missing or non-finite vertex has no pixels, nor has one outside the grid.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = F.forall("rings", lambda ring: F.forall(ring, lambda p: ~(bad(p["x"]) | bad(p["y"]))))
    rings = polygons.where(sound).select(*_KEYS, F.explode("rings").alias("_r")).where(F.size("_r") > 1)
    closed = F.expr("concat(slice(_r, 2, size(_r)), slice(_r, 1, 1))")
    edge = F.explode(F.zip_with("_r", closed, lambda a, b: F.struct(F.least(F.struct(a["y"], a["x"]), F.struct(b["y"], b["x"])).alias("low"), F.greatest(F.struct(a["y"], a["x"]), F.struct(b["y"], b["x"])).alias("high"))))
    edges = rings.select(*_KEYS, edge.alias("e")).select(*_KEYS, *[F.col(f"e.{p}.{a}").alias(f"_{p[0]}{a}") for p in ("low", "high") for a in "xy"])
    first, last = F.greatest(F.ceil(F.col("_ly") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("_hy") - 0.5) - 1, F.lit(height - 1)).cast("int")
    crossed = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    x = F.col("_lx") + (F.col("row") + 0.5 - F.col("_ly")) * (F.col("_hx") - F.col("_lx")) / (F.col("_hy") - F.col("_ly"))
    w = Window.partitionBy(*_ROW).orderBy("_x")
    paired = crossed.select(*_ROW, x.alias("_x")).select(*_ROW, "_x", F.lead("_x").over(w).alias("_to"), F.row_number().over(w).alias("_k")).where("_k % 2 = 1")
    c0, c1 = F.greatest(F.ceil(F.col("_x") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("_to") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return _merged(paired.select(*_ROW, c0.alias("c0"), c1.alias("c1")).where("c0 <= c1"))


def eroded(s: DataFrame, pixels: int) -> DataFrame:
    """The stretches that are left when ``pixels`` rounds of a 3 x 3 erosion take the border off (outside the grid nothing is inside).

    A stretch gives up its ends; what is left in 2 * pixels + 1 rows at once stays, found
    by a running count of beginnings and ends along a row.
    """
    if not pixels:
        return s
    narrow = s.select(*_KEYS, F.explode(F.sequence(F.col("row") - pixels, F.col("row") + pixels)).alias("row"), (F.col("c0") + pixels).alias("c0"), (F.col("c1") - pixels + 1).alias("c1")).where("c0 < c1")
    events = narrow.select(*_ROW, F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("by")), F.struct(F.col("c1").alias("at"), F.lit(-1).alias("by")))).alias("e"))
    net = events.groupBy(*_ROW, F.col("e.at").alias("c0")).agg(F.sum("e.by").alias("by")).where("by <> 0")
    w = Window.partitionBy(*_ROW).orderBy("c0")
    return net.select(*_ROW, "c0", (F.lead("c0").over(w) - 1).alias("c1"), F.sum("by").over(w).alias("_n")).where(F.col("_n") == 2 * pixels + 1).drop("_n")


def region_statistics(polygons: DataFrame, raw: DataFrame, mask: DataFrame, px: DataFrame, x: str, least: int) -> DataFrame:
    """One row a polygon: pixels inside, after erosion and with a value, mean, deviation (one degree of freedom less; 0 for one pixel), median, extremes and a status.

    ``raw`` and ``mask`` are the polygons' stretches before and after erosion.  Status:
    ``outside`` without pixels, ``small`` with fewer than ``least`` after erosion,
    ``unsupported`` with fewer than ``least`` values, else ``ok``; statistics only then.
    """
    size = lambda s, name: s.groupBy(*_KEYS).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias(name))
    cells = mask.select(*_ROW, F.explode(F.sequence("c0", "c1")).alias("col")).join(px.select("run_id", "row", "col", F.col(x).cast("double").alias("_x")).where("_x is not null"), ["run_id", "row", "col"])
    stats = cells.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("valid_pixels"), F.avg("_x").alias("mean"), F.coalesce(F.stddev_samp("_x"), number(0)).alias("deviation"), F.median("_x").alias("median"), F.min("_x").alias("least"), F.max("_x").alias("most"))
    d = polygons.select(*_KEYS).join(size(raw, "raw_pixels"), _KEYS, "left").join(size(mask, "mask_pixels"), _KEYS, "left").join(stats, _KEYS, "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("raw_pixels", "mask_pixels", "valid_pixels")})
    status = F.when(F.col("raw_pixels") == 0, "outside").when(F.col("mask_pixels") < least, "small").when(F.col("valid_pixels") < least, "unsupported").otherwise("ok")
    d = d.withColumn("status", status)
    return d.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("mean", "deviation", "median", "least", "most")})


def region_overlaps(s: DataFrame) -> DataFrame:
    """run_id, left_id, right_id, pixels for every two polygons of a grid that share pixels: an equi-join on (grid, row, cell of ``CELL`` columns)."""
    cells = s.select("run_id", "feature_id", "row", F.explode(F.sequence(F.floor(F.col("c0") / CELL), F.floor(F.col("c1") / CELL))).alias("_cell"), "c0", "c1")
    cells = cells.select("run_id", "feature_id", "row", "_cell", F.greatest("c0", F.col("_cell") * CELL).alias("c0"), F.least("c1", F.col("_cell") * CELL + CELL - 1).alias("c1"))
    right = cells.withColumnsRenamed({"feature_id": "right_id", "c0": "d0", "c1": "d1"})
    both = cells.withColumnRenamed("feature_id", "left_id").join(right, ["run_id", "row", "_cell"]).where("left_id < right_id and c0 <= d1 and d0 <= c1")
    return both.groupBy("run_id", "left_id", "right_id").agg(F.sum(F.least("c1", "d1") - F.greatest("c0", "d0") + 1).alias("pixels"))


# ---- rectangles ------------------------------------------------------------------------


def _levelled(rects: DataFrame, key: str) -> DataFrame:
    """_k, bounds w, s, e, n and the level _own: a power of two over the longer side (with room for the rounding of side and logarithm)."""
    r = rects.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(c[0]) for c in ("west", "south", "east", "north")]).where("w <= e and s <= n")
    side = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")) * (1 + 1e-9)
    return r.withColumn("_own", F.when(side > 2.0**LEAST_LEVEL, F.ceil(F.log2(side))).otherwise(LEAST_LEVEL).cast("int"))


def _levels_from(r: DataFrame) -> Column:
    """An array of the levels in use in ``r`` that are at least a row's _own."""
    levels = sorted(x[0] for x in r.select("_own").distinct().collect())  # exponents of doubles: some 1,000 at most
    return F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("_own"))


def overlapped(rects: DataFrame, others: DataFrame, key: str = "rect_id") -> DataFrame:
    """The keys of ``rects`` whose insides meet the inside of one of ``others``, once each; bounds as in ``rectangle_overlaps``.

    Two rectangles meet in cells as wide as the larger one's level.  There ``rects`` go
    to the one cell of their lower left corner, and ``others``, reaching a cell further
    to the west and south, to the three by three cells in which such corners can lie;
    a larger one of the others is met at its own level, a smaller one at that of
    ``rects``.  Rows of both sides so grow with the tables, by the levels in use.
    """
    a, b = _levelled(rects, key), _levelled(others, key)
    levels = lambda there: F.explode(F.array_union(F.array("_own"), there))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    a_levels, b_levels = _levels_from(b), _levels_from(a)
    a = a.withColumn("_level", levels(a_levels)).withColumns({"_x": at("w"), "_y": at("s")})
    b = b.withColumn("_level", levels(b_levels)).withColumn("_x", F.explode(F.sequence(at("w") - 1, at("e"))))
    b = b.withColumn("_y", F.explode(F.sequence(at("s") - 1, at("n")))).select("_level", "_x", "_y", *[F.col(c).alias(f"o{c}") for c in ("w", "s", "e", "n", "_own")])
    met = a.hint("merge").join(b, ["_level", "_x", "_y"]).where("_level = greatest(_own, o_own) and w < oe and ow < e and s < on and os < n")
    return met.select(F.col("_k").alias(key)).distinct()


def rectangle_overlaps(rects: DataFrame, key: str = "rect_id") -> DataFrame:
    """left_id, right_id (left < right) of all pairs of rectangles (west, south, east, north) whose insides meet; touching is no overlap.

    A rectangle's own level is the power of two over its longer side, so it lies in at
    most four cells of that side.  It waits there for rectangles of its own and of
    smaller levels, which come to the cells of every larger level that is in use.  A pair
    is reported in the cell of the lower left corner of what they share.  Rectangles
    with a missing bound, or with bounds in the wrong order, meet nothing.
    """
    r = _levelled(rects, key)
    every = _levels_from(r)

    def cells(d: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
        d = d.withColumn("_x", F.explode(F.sequence(at("w"), at("e"))))
        return d.withColumn("_y", F.explode(F.sequence(at("s"), at("n"))))

    own = cells(r.withColumn("_level", F.col("_own"))).hint("merge")
    come = cells(r.withColumn("_level", F.explode(every)))
    come = come.select("_level", "_x", "_y", *[F.col(c).alias(f"o{c}") for c in ("_k", "w", "s", "e", "n", "_own")])
    both = own.join(come, ["_level", "_x", "_y"]).where("(o_own < _own or o_own = _own and o_k > _k) and w < oe and ow < e and s < on and os < n")
    corner = lambda a, b: F.floor(F.greatest(a, b) / F.pow(F.lit(2.0), F.col("_level")))
    once = both.where((corner("w", "ow") == F.col("_x")) & (corner("s", "os") == F.col("_y")))
    return once.select(F.least("_k", "o_k").alias("left_id"), F.greatest("_k", "o_k").alias("right_id"))


def box(lat: Column, lon: Column, width: Column, height: Column) -> dict[str, Column]:
    """Bounds in degrees of a rectangle given in metres around a point, on a sphere."""
    dy = F.degrees(height / 2.0 / EARTH_RADIUS)
    dx = F.degrees(width / 2.0 / (EARTH_RADIUS * F.cos(F.radians(lat))))
    return {"west": lon - dx, "south": lat - dy, "east": lon + dx, "north": lat + dy}


def background_rectangles(sites: DataFrame, gap: float, diagonals: bool = True) -> DataFrame:
    """site_id, direction, lat, lon and bounds of the rectangles around each site (site_id, lat, lon, width, height in metres), ``gap`` metres off its edges, and whether each lies clear of all sites.

    Rectangles beyond 85 degrees of latitude or over the antimeridian are left out.
    """
    ways = F.array(*[F.struct(F.lit(n).alias("direction"), F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for n, y, x in DIRECTIONS[: 8 if diagonals else 4]])
    d = sites.withColumn("_d", F.explode(ways)).withColumn("direction", F.col("_d.direction"))
    lat = F.col("lat") + F.degrees(F.col("_d.y") * (F.col("height") + gap) / EARTH_RADIUS)
    lon = F.col("lon") + F.degrees(F.col("_d.x") * (F.col("width") + gap) / (EARTH_RADIUS * F.cos(F.radians("lat"))))
    d = d.withColumns({"lat": lat, "lon": lon}).withColumns(box(F.col("lat"), F.col("lon"), F.col("width"), F.col("height")))
    d = d.where("abs(lat) <= 85 and west >= -180 and east <= 180")
    bounds = ["west", "south", "east", "north"]
    own = sites.withColumns(box(F.col("lat"), F.col("lon"), F.col("width"), F.col("height"))).select(F.col("site_id").alias("rect_id"), *bounds)
    # A rectangle's direction goes as its number.
    names = F.array(*[F.lit(n) for n, _, _ in DIRECTIONS])
    hit = overlapped(d.select(F.struct("site_id", F.array_position(names, F.col("direction")).cast("byte").alias("way")).alias("rect_id"), *bounds), own)
    hit = hit.select("rect_id.site_id", F.element_at(names, F.col("rect_id.way").cast("int")).alias("direction"), F.lit(False).alias("_hit"))
    return d.hint("merge").join(hit, ["site_id", "direction"], "left").select("site_id", "direction", "lat", "lon", *bounds, F.coalesce("_hit", F.lit(True)).alias("clear"))
