"""Queries over polygons, rectangles, edges, shifts and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.columns import rounded
from tellurion.operators import edges as ed
from tellurion.operators import focus as fo
from tellurion.operators import projection as pj
from tellurion.operators import regions as rg
from tellurion.operators import shifts as sh
from tellurion.sources.scratch import materialise
from tellurion.sources.views import PIX, SIZE, pix, spread, table

QUERIES, ORACLES = {}, {}
ERODE, LEAST = 1, 12
#: Vertices of an outline and of its hole, in radii.
OUTER = ((-1, -0.4), (-0.4, -1), (0.4, -1), (1, -0.4), (1, 0.4), (0.4, 1), (-0.4, 1), (-1, 0.4))
HOLE = ((-0.3, 0), (0, 0.3), (0.3, 0), (0, -0.3))


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def polygons(spark, sf):
    """A polygon with a hole around the dearest order of each tile and priority, its radius from the order's price."""
    o = table(spark, sf, "orders").where("o_orderpriority is not null")
    tile, at = F.floor(F.col("o_orderkey") / (SIZE * SIZE)), (F.col("o_orderkey") + 20 * SIZE) % (SIZE * SIZE)
    best = o.groupBy((tile * 2).cast("int").alias("run_id"), F.col("o_orderpriority").alias("feature_id")).agg(F.max_by(F.struct(at.alias("at"), F.col("o_totalprice").alias("p")), F.struct("o_totalprice", "o_orderkey")).alias("b"))
    radius = F.lit(5.0) + F.round(F.col("b.p") * 100).cast("long") % 97 / 11.0
    d = best.select("run_id", "feature_id", (F.floor(F.col("b.at") / SIZE) + 0.513).alias("y"), (F.col("b.at") % SIZE + 0.487).alias("x"), radius.alias("r"))
    ring = lambda corners: F.array(*[F.struct((F.col("x") + F.lit(float(a)) * F.col("r")).alias("x"), (F.col("y") + F.lit(float(b)) * F.col("r")).alias("y")) for a, b in corners])
    return d.select("run_id", "feature_id", F.array(ring(OUTER), ring(HOLE)).alias("rings"))


_CORNERS = ", ".join(f"({i}, {j}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, ring in enumerate((OUTER, HOLE)) for j, ((a, b), (c, d)) in enumerate(zip(ring, ring[1:] + ring[:1])))
_INSIDE = f"""{PIX}, po AS (
    SELECT (o_orderkey // {SIZE * SIZE} * 2)::INT AS run_id, o_orderpriority AS feature_id, arg_max({{'at': (o_orderkey + {20 * SIZE}) % {SIZE * SIZE}, 'p': o_totalprice}}, (o_totalprice, o_orderkey)) AS b FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
  pg AS (SELECT run_id, feature_id, b.at // {SIZE} + 0.513::DOUBLE AS y, b.at % {SIZE} + 0.487::DOUBLE AS x, 5.0::DOUBLE + round(b.p * 100)::BIGINT % 97 / 11.0::DOUBLE AS r FROM po),
  ed AS (SELECT run_id, feature_id, x + ax * r AS ax, y + ay * r AS ay, x + bx * r AS bx, y + by_ * r AS by_ FROM pg, (VALUES {_CORNERS}) v(ring, i, ax, ay, bx, by_)),
  el AS (SELECT run_id, feature_id, CASE WHEN ay < by_ THEN ax ELSE bx END AS lx, least(ay, by_) AS ly, CASE WHEN ay < by_ THEN bx ELSE ax END AS hx, greatest(ay, by_) AS hy FROM ed WHERE ay <> by_),
  ins AS (SELECT e.run_id, feature_id, g."row", g.col FROM el e, (SELECT r.range::INT AS "row", c.range::INT AS col FROM range({SIZE}) r, range({SIZE}) c) g
          WHERE g."row" + 0.5::DOUBLE >= ly AND g."row" + 0.5::DOUBLE < hy AND lx + (g."row" + 0.5::DOUBLE - ly) * (hx - lx) / (hy - ly) > g.col + 0.5::DOUBLE GROUP BY ALL HAVING count(*) % 2 = 1),
  er AS (SELECT i.* FROM ins i JOIN ins n ON n.run_id = i.run_id AND n.feature_id = i.feature_id AND abs(n."row" - i."row") <= {ERODE} AND abs(n.col - i.col) <= {ERODE} GROUP BY ALL HAVING count(*) = {(2 * ERODE + 1) ** 2})"""


@add("polygon_statistics", f"""WITH {_INSIDE},
  st AS (SELECT run_id, feature_id, count(*) AS m, count(b1) AS v, avg(b1) AS mean, coalesce(stddev_samp(b1), 0) AS dev, median(b1) AS med, min(b1) AS lo, max(b1) AS hi FROM er LEFT JOIN pix USING (run_id, "row", col) GROUP BY ALL),
  ra AS (SELECT run_id, feature_id, count(*) AS raw FROM ins GROUP BY ALL),
  al AS (SELECT run_id, feature_id, coalesce(raw, 0) AS raw_pixels, coalesce(m, 0) AS mask_pixels, coalesce(v, 0) AS valid_pixels, mean, dev, med, lo, hi,
           CASE WHEN coalesce(raw, 0) = 0 THEN 'outside' WHEN coalesce(m, 0) < {LEAST} THEN 'small' WHEN coalesce(v, 0) < {LEAST} THEN 'unsupported' ELSE 'ok' END AS status FROM pg LEFT JOIN ra USING (run_id, feature_id) LEFT JOIN st USING (run_id, feature_id))
  SELECT run_id, feature_id, raw_pixels, mask_pixels, valid_pixels, status, CASE WHEN status = 'ok' THEN round(mean, 6) END AS mean, CASE WHEN status = 'ok' THEN round(dev, 6) END AS deviation, CASE WHEN status = 'ok' THEN round(med, 6) END AS median, CASE WHEN status = 'ok' THEN round(lo, 6) END AS least, CASE WHEN status = 'ok' THEN round(hi, 6) END AS most FROM al""")
def polygon_statistics(spark, sf):
    """Pixels, statistics and status of every polygon after erosion."""
    p = polygons(spark, sf)
    raw = rg.stretches(p, SIZE, SIZE)
    d = rg.region_statistics(p, raw, rg.eroded(raw, ERODE), pix(spark, sf), "b1", LEAST)
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "median", "least", "most")})


@add("polygon_overlaps", f'WITH {_INSIDE} SELECT a.run_id, a.feature_id AS left_id, b.feature_id AS right_id, count(*) AS pixels FROM er a JOIN er b ON a.run_id = b.run_id AND a."row" = b."row" AND a.col = b.col AND a.feature_id < b.feature_id GROUP BY ALL')
def polygon_overlaps(spark, sf):
    """Pixels that two eroded polygons of a tile share."""
    return rg.region_overlaps(rg.eroded(rg.stretches(polygons(spark, sf), SIZE, SIZE), ERODE))


_RECT = """r AS (SELECT o_orderkey AS rect_id, (o_custkey % 1000)::DOUBLE * 0.731::DOUBLE AS west, (o_orderkey % 997)::DOUBLE * 0.577::DOUBLE AS south, round(o_totalprice * 100)::BIGINT % 10007 AS h FROM orders),
  q AS (SELECT rect_id, west, south, west + (1 + h % 7) ** 3 / 60.0::DOUBLE AS east, south + (1 + h % 5) ** 3 / 50.0::DOUBLE AS north FROM r)"""


def rectangles(spark, sf):
    """A rectangle for every order, sides from a hundredth to some six units."""
    h = F.round(F.col("o_totalprice") * 100).cast("long") % 10007
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).select(F.col("o_orderkey").alias("rect_id"), (F.col("o_custkey") % 1000 * 0.731).alias("west"), (F.col("o_orderkey") % 997 * 0.577).alias("south"), h.alias("h"))
    cube = lambda k, by: (1 + F.col("h") % k) * (1 + F.col("h") % k) * (1 + F.col("h") % k) / by
    return o.select("rect_id", "west", "south", (F.col("west") + cube(7, 60.0)).alias("east"), (F.col("south") + cube(5, 50.0)).alias("north"))


@add("rectangle_overlaps", f"WITH {_RECT} SELECT a.rect_id AS left_id, b.rect_id AS right_id FROM q a JOIN q b ON a.rect_id < b.rect_id AND a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north")
def rectangle_overlaps(spark, sf):
    """All overlapping rectangles of orders."""
    return rg.rectangle_overlaps(rectangles(spark, sf))


_SITE = f"""s AS (SELECT c_custkey AS site_id, (c_custkey * 7919 % 170001)::DOUBLE / 2000 - 42.5::DOUBLE AS lat, (c_custkey * 6841 % 180001)::DOUBLE / 600 - 150.0::DOUBLE AS lon, 3000.0::DOUBLE + c_nationkey * 400 AS width, 2500.0::DOUBLE + c_nationkey % 7 * 700 AS height FROM customer),
  d AS (SELECT site_id, direction, lat + degrees(dy * (height + 900) / {rg.EARTH_RADIUS}::DOUBLE) AS lat, lon + degrees(dx * (width + 900) / ({rg.EARTH_RADIUS}::DOUBLE * cos(radians(lat)))) AS lon, width, height
        FROM s, (VALUES {", ".join(f"('{n}', {y}::DOUBLE, {x}::DOUBLE)" for n, y, x in rg.DIRECTIONS)}) v(direction, dy, dx)),
  f AS (SELECT *, degrees(height / 2 / {rg.EARTH_RADIUS}::DOUBLE) AS hy, degrees(width / 2 / ({rg.EARTH_RADIUS}::DOUBLE * cos(radians(lat)))) AS hx FROM (SELECT site_id, '' AS direction, lat, lon, width, height FROM s UNION ALL BY NAME SELECT * FROM d)),
  b AS (SELECT site_id, direction, lat, lon, lon - hx AS west, lat - hy AS south, lon + hx AS east, lat + hy AS north FROM f)"""


@add("background_rectangles", f"""WITH {_SITE} SELECT site_id, direction, round(lat, 9) + 0.0::DOUBLE AS lat, round(lon, 9) + 0.0::DOUBLE AS lon, round(west, 9) + 0.0::DOUBLE AS west, round(south, 9) + 0.0::DOUBLE AS south, round(east, 9) + 0.0::DOUBLE AS east, round(north, 9) + 0.0::DOUBLE AS north,
    NOT EXISTS (SELECT 1 FROM b o WHERE o.direction = '' AND o.west < b.east AND b.west < o.east AND o.south < b.north AND b.south < o.north) AS clear
  FROM b WHERE direction <> '' AND abs(lat) <= 85 AND west >= -180 AND east <= 180""")
def background_rectangles(spark, sf):
    """Eight rectangles around the site of every customer, and which of them no site overlaps."""
    k = F.col("c_custkey")
    sites = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(
        k.alias("site_id"), ((k * 7919 % 170001).cast("double") / 2000 - 42.5).alias("lat"), ((k * 6841 % 180001).cast("double") / 600 - 150.0).alias("lon"),
        (3000.0 + F.col("c_nationkey") * 400).alias("width"), (2500.0 + F.col("c_nationkey") % 7 * 700).alias("height"))
    d = rg.background_rectangles(sites, 900.0)
    return d.withColumns({c: rounded(c, 9) for c in ("lat", "lon", "west", "south", "east", "north")})


# ---- edges --------------------------------------------------------------------------------

SIGMA, LOW, HIGH = 0.8, 0.09, 0.16
_W = [f"{w!r}::DOUBLE" for w in ed.weights(SIGMA)]


def _smooth(source, name, fixed, along):
    """SQL of one direction: the line as a list, read with its places held inside."""
    at = lambda k: f"a[greatest(1, least({SIZE}, p.{along} + 1 + {k}))]"
    total = " + ".join([f"{_W[0]} * {at(0)}", *(f"{_W[k]} * ({at(-k)} + {at(k)})" for k in range(1, len(_W)))])
    return f"""{name}l AS (SELECT run_id, {fixed}, list(x ORDER BY {along}) AS a FROM {source} GROUP BY ALL), {name} AS (SELECT p.run_id, p."row", p.col, {total} AS x FROM {source} p JOIN {name}l l ON l.run_id = p.run_id AND l.{fixed} = p.{fixed})"""


_RIDGES = f"""{PIX}, e0 AS (SELECT run_id, "row", col, coalesce(b1, 0) / 60 AS x FROM pix), {_smooth("e0", "e1", '"row"', "col")}, {_smooth("e1", "e2", "col", '"row"')},
  gr AS (SELECT run_id, "row", col, (coalesce(lead(x) OVER h, x) - coalesce(lag(x) OVER h, x)) / 2 AS gx, (coalesce(lead(x) OVER v, x) - coalesce(lag(x) OVER v, x)) / 2 AS gy FROM e2
         WINDOW h AS (PARTITION BY run_id, "row" ORDER BY col), v AS (PARTITION BY run_id, col ORDER BY "row")),
  mg AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM gr),
  di AS (SELECT *, CASE WHEN abs(gy) <= abs(gx) * {ed.HALF!r}::DOUBLE THEN [0, 1] WHEN abs(gx) <= abs(gy) * {ed.HALF!r}::DOUBLE THEN [1, 0] WHEN (gx > 0) = (gy > 0) THEN [1, 1] ELSE [1, -1] END AS d FROM mg),
  rg AS (SELECT d.run_id, d."row", d.col, d.m FROM di d LEFT JOIN mg b ON b.run_id = d.run_id AND b."row" = d."row" - d.d[1] AND b.col = d.col - d.d[2] LEFT JOIN mg a ON a.run_id = d.run_id AND a."row" = d."row" + d.d[1] AND a.col = d.col + d.d[2]
         WHERE d.m > coalesce(b.m, 0) AND d.m >= coalesce(a.m, 0))"""


def _marked(spark, sf):
    px = pix(spark, sf).select("run_id", "row", "col", (F.coalesce("b1", F.lit(0.0)) / 60).alias("_x"))
    return ed.ridges(ed.smoothed(px, "_x", SIGMA), "_s")


@add("edge_ridges", f'WITH {_RIDGES} SELECT run_id, "row", col, round(m, 9) AS magnitude FROM rg')
def edge_ridges(spark, sf):
    """Pixels whose gradient is the largest along its own direction."""
    return _marked(spark, sf).where("ridge").select("run_id", "row", "col", F.round("magnitude", 9).alias("magnitude"))


@add("edge_pixels", f"""WITH RECURSIVE {_RIDGES}, wk AS (SELECT * FROM rg WHERE m >= {LOW}),
  rc AS (SELECT run_id, "row", col FROM wk WHERE m >= {HIGH} UNION SELECT w.run_id, w."row", w.col FROM rc r JOIN wk w ON w.run_id = r.run_id AND abs(w."row" - r."row") <= 1 AND abs(w.col - r.col) <= 1)
  SELECT run_id, "row", col, round(m, 9) AS magnitude, m >= {HIGH} AS strong FROM rc JOIN wk USING (run_id, "row", col)""")
def edge_pixels(spark, sf):
    """Weak ridges that strong ones reach."""
    return ed.linked(_marked(spark, sf), LOW, HIGH).select("run_id", "row", "col", F.round("magnitude", 9).alias("magnitude"), "strong")


# ---- shifts -------------------------------------------------------------------------------


def _passes(spark, sf):
    """The two passes of every tile: run_id is the tile, z the mean elevation within five pixels, stable outside a square target."""
    d = fo.focal_mean(pix(spark, sf).select("run_id", "row", "col", "dem"), "dem", 5, "z")
    inner = lambda c: F.abs(F.col(c) - SIZE / 2) < 12
    d = d.select(F.floor(F.col("run_id") / 2).cast("int").alias("run_id"), "row", "col", "z", (F.col("run_id") % 2).alias("_pass"), (inner("row") & inner("col")).alias("target"))
    d = materialise(d.withColumn("stable", ~F.col("target")), "passes")
    return d.where("_pass = 0").drop("_pass"), d.where("_pass = 1").drop("_pass")


@add("shift_search")
def shift_search(spark, sf):
    """The shift of the second pass against the first of every tile, a plane taken off at every candidate."""
    pre, post = _passes(spark, sf)
    return sh.best_shifts(pre, post, "z", "stable", least_stable=1000).withColumn("score", rounded("score"))


@add("elevation_change")
def elevation_change(spark, sf):
    """Shift, plane, gates on stable ground and change in the target of every tile."""
    pre, post = _passes(spark, sf)
    d = sh.elevation_change(pre, post, "z", "stable", "target", least_stable=1000, least_target=200, cover=0.9144)
    return d.withColumns({c: rounded(c) for c, t in d.dtypes if t == "double"})


# ---- places -------------------------------------------------------------------------------

_N = "(1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE))"


def _back(source, x, y, name):
    """SQL: ``source`` with lon and lat of (x, y) in the zone of epsg, as the table ``name``."""
    return f"""{name}0 AS (SELECT *, {_N} AS n, ({y} - CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END) AS yy, ({x} - 500000) AS xx FROM {source}),
  {name}1 AS (SELECT *, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS k FROM {name}0),
  {name}2 AS (SELECT *, yy / k AS xi, xx / k AS eta, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3 FROM {name}1),
  {name}3 AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS u, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS v FROM {name}2),
  {name}4 AS (SELECT *, asin(sin(u) / cosh(v)) AS c FROM {name}3),
  {name} AS (SELECT * EXCLUDE (n, yy, xx, k, xi, eta, b1, b2, b3, u, v, c), degrees(atan2(sinh(v), cos(u))) + (epsg % 100 * 6 - 183) AS lon, degrees(c + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45) * sin(2 * c) + (7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45) * sin(4 * c)
    + (56 * n ** 3 / 15 - 136 * n ** 4 / 35) * sin(6 * c) + 4279 * n ** 4 / 630 * sin(8 * c)) AS lat FROM {name}4)"""


_PLACE = f"""o AS (SELECT o_orderkey, (32600 + o_orderkey % 2 * 100 + o_custkey % 60 + 1)::INT AS epsg, 300000.0::DOUBLE + round(o_totalprice * 100)::BIGINT % 400000 AS x0, CASE WHEN o_orderkey % 2 = 0 THEN 200000.0::DOUBLE ELSE 1500000.0::DOUBLE END + round(o_totalprice * 100)::BIGINT % 8300000 AS y0 FROM orders)"""


def _places(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", (32600 + k % 2 * 100 + F.col("o_custkey") % 60 + 1).cast("int").alias("epsg"), (300000.0 + cents % 400000).alias("x0"), (F.when(k % 2 == 0, 200000.0).otherwise(1500000.0) + cents % 8300000).alias("y0"))


@add("pixel_locations", f"""WITH {_PLACE}, p AS (SELECT *, 10.0::DOUBLE * (o_orderkey % 640 + 0.5::DOUBLE) + x0 AS x, -10.0::DOUBLE * (o_orderkey // 640 % 640 + 0.5::DOUBLE) + y0 AS y FROM o), {_back("p", "x", "y", "b")}
  SELECT o_orderkey, x, y, round(lon, 9) + 0.0::DOUBLE AS lon, round(lat, 9) + 0.0::DOUBLE AS lat FROM b""")
def pixel_locations(spark, sf):
    """Centres of pixels by their grid's transform, and back to longitude and latitude."""
    p = _places(spark, sf)
    step = F.array(F.lit(10.0), F.lit(0.0), F.col("x0"), F.lit(0.0), F.lit(-10.0), F.col("y0"))
    p = p.withColumns(pj.pixel_centers(step, F.floor(F.col("o_orderkey") / 640) % 640, F.col("o_orderkey") % 640))
    p = p.withColumns(pj.inverse_utm(F.col("x"), F.col("y"), F.col("epsg")))
    return p.select("o_orderkey", "x", "y", rounded("lon", 9).alias("lon"), rounded("lat", 9).alias("lat"))


#: SQL: nine digits of a number's shortest decimal, as the query rounds; DuckDB's own round multiplies first, which makes ties of numbers just below them.
_NINE = "{0}::VARCHAR::DECIMAL(20, 9)"
_COORD = f"'[' || {_NINE.format('{lon}')} || ',' || {_NINE.format('{lat}')} || ']'"


@add("site_exports", f"""WITH {_PLACE}, g AS (SELECT o_orderkey, epsg, q, x0 + 320 + dx AS x, y0 + 320 + dy AS y FROM o, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, -8.5, -8.5), (2, 8.5, -8.5), (3, 8.5, 8.5), (4, -8.5, 8.5), (5, -8.5, -8.5)) v(q, dx, dy)), {_back("g", "x", "y", "b")}
  SELECT o_orderkey, max({_NINE.format("lon")}) FILTER (q = 0)::DOUBLE AS lon, max({_NINE.format("lat")}) FILTER (q = 0)::DOUBLE AS lat, '{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"export_role":"site_point"}},"geometry":{{"type":"Point","coordinates":' || max({_COORD.format(lon="lon", lat="lat")}) FILTER (q = 0) ||
    '}}}},{{"type":"Feature","properties":{{"export_role":"focus_zone_17m"}},"geometry":{{"type":"Polygon","coordinates":[[' || string_agg({_COORD.format(lon="lon", lat="lat")}, ',' ORDER BY q) FILTER (q > 0) || ']]}}}}]}}' AS geojson FROM b GROUP BY o_orderkey""")
def site_exports(spark, sf):
    """A point and a square around the centre of every order's grid."""
    g = _places(spark, sf).select("o_orderkey", "epsg", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + 640).alias("xmax"), (F.col("y0") + 640).alias("ymax"))
    return pj.site_exports(g).select("o_orderkey", rounded("lon", 9).alias("lon"), rounded("lat", 9).alias("lat"), "geojson")


@add("point_offsets")
def point_offsets(spark, sf):
    """How far the centre of a grid that is snapped to ten metres is off the point it was made for."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", ((k * 37 % 3599) / 10.0 - 179.95).alias("lon"), ((k * 53 % 1600) / 10.0 - 79.95).alias("lat"))
    u = pj.utm(F.col("lon"), F.col("lat"))
    snap = lambda c: F.round(u[c] / 10.0) * 10.0
    p = p.withColumns({"xmin": snap("easting") - 3200, "ymin": snap("northing") - 3200, "xmax": snap("easting") + 3200, "ymax": snap("northing") + 3200})
    return pj.point_offsets(p).select("p_partkey", "epsg", *[rounded(c, 6).alias(c) for c in ("delta_x", "delta_y", "planar_offset", "center_lon", "center_lat")])
