"""Queries over scenes, acquisitions and before/after screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions.columns import rounded
from tellurion.functions.group_stats import quantile
from tellurion.operators import acquisitions as aq
from tellurion.sources.views import ACQ, SCENES, acquisitions, scene_pixels, table

QUERIES, ORACLES = {}, {}


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@add("median_composite", f'WITH {SCENES} SELECT "row", col, round(median(b1), 6) AS b1, round(median(b3), 6) AS b3 FROM scene_pixels GROUP BY "row", col')
def median_composite(spark, sf):
    d = aq.median_composite(scene_pixels(spark, sf), ["b1", "b3"])
    return d.select("row", "col", F.round("b1", 6).alias("b1"), F.round("b3", 6).alias("b3"))


@add("month_composite", f"""WITH {SCENES} SELECT "row", col, round(median(b1), 6) AS b1, count(*) AS scenes FROM scene_pixels WHERE scene_id LIKE '%-06' AND scene_id BETWEEN '1995' AND '1999-99' GROUP BY "row", col""")
def month_composite(spark, sf):
    """One calendar month over five years."""
    px = scene_pixels(spark, sf).where("scene_id like '%-06' and scene_id between '1995' and '1999-99'")
    return px.groupBy("row", "col").agg(F.round(F.median("b1"), 6).alias("b1"), F.count(F.lit(1)).alias("scenes"))


@add("newest_scene", f"""WITH {SCENES}, r AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY scene_id DESC) AS k FROM scene_pixels) SELECT "row", col, scene_id, round(b1, 6) AS b1 FROM r WHERE k = 1""")
def newest_scene(spark, sf):
    return aq.newest(scene_pixels(spark, sf), ["b1"]).select("row", "col", "scene_id", F.round("b1", 6).alias("b1"))


@add("lowest_cloud", f"WITH {SCENES} SELECT scene_id, round(avg(b3), 6) AS cloud, count(*) AS pixels FROM scene_pixels GROUP BY scene_id ORDER BY avg(b3), scene_id LIMIT 1")
def lowest_cloud(spark, sf):
    return aq.lowest(scene_pixels(spark, sf), "b3").withColumn("cloud", F.round("cloud", 6))


@add("sensor_union", """SELECT part, count(*) AS scenes, round(avg(v), 6) AS mean FROM (SELECT 'L8' AS part, l_quantity * 0.00341802 + 149 AS v FROM lineitem WHERE l_returnflag = 'A' AND (l_quantity::BIGINT & 28) = 0
  UNION ALL SELECT 'L9', l_quantity * 0.00341802 + 149 FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity::BIGINT & 28) = 0) GROUP BY part""")
def sensor_union(spark, sf):
    """Two sensors with clear quality bits (of the quantity), scaled and united."""
    t = table(spark, sf, "lineitem").where(F.col("l_quantity").cast("long").bitwiseAND(F.lit(28).cast("long")) == 0).withColumn("v", F.col("l_quantity") * 0.00341802 + 149)
    u = t.where("l_returnflag = 'A'").select(F.lit("L8").alias("part"), "v").unionByName(t.where("l_returnflag = 'R'").select(F.lit("L9").alias("part"), "v"))
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("scenes"), F.round(F.avg("v"), 6).alias("mean"))


@add("best_track", f"WITH {ACQ}, n AS (SELECT pass, track, count(*) AS n FROM acq GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY n DESC, track) AS k FROM n) SELECT pass, track, n FROM r WHERE k = 1")
def best_track(spark, sf):
    return aq.best_track(acquisitions(spark, sf))


@add("orbit_window", f"""WITH {ACQ}, m AS (SELECT pass, quantile_disc(ms, 0.5 ORDER BY ms DESC) AS mid FROM acq GROUP BY pass)
  SELECT pass, count(*) AS items, min(ms) AS first_ms, max(ms) AS last_ms FROM acq JOIN m USING (pass) WHERE abs(ms - mid) <= 9 * 86400000::BIGINT GROUP BY pass""")
def orbit_window(spark, sf):
    w = aq.orbit_window(acquisitions(spark, sf), 9)
    return w.groupBy("pass").agg(F.count(F.lit(1)).alias("items"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


_PAIRS = f"{ACQ}, pairs AS (SELECT a.track, a.event_id AS asc_id, d.event_id AS desc_id, abs(a.ms - d.ms) AS dt_ms FROM acq a JOIN acq d ON a.track = d.track AND a.pass = 'A' AND d.pass = 'D' AND abs(a.ms - d.ms) <= 36 * 3600000)"


@add("pair_candidates", f"WITH {_PAIRS} SELECT track, asc_id, desc_id, round(dt_ms / 3600000.0::DOUBLE, 9) AS hours FROM pairs")
def pair_candidates(spark, sf):
    p = aq.pair_candidates(acquisitions(spark, sf), 36)
    return p.select("track", "asc_id", "desc_id", F.round(F.col("dt_ms") / 3600000.0, 9).alias("hours"))


@add("pair_nearest", f"""WITH {_PAIRS}, n AS (SELECT p.track, asc_id, desc_id, dt_ms, row_number() OVER (PARTITION BY p.track, asc_id ORDER BY dt_ms, d.ms, desc_id) AS k FROM pairs p JOIN acq d ON d.event_id = desc_id)
  SELECT track, asc_id, desc_id, dt_ms FROM n WHERE k <= 4""")
def pair_nearest(spark, sf):
    """The four nearest partners of every ascending acquisition, found by their places along the track."""
    return aq.nearest_candidates(acquisitions(spark, sf), 36).select("track", "asc_id", "desc_id", "dt_ms")


@add("pair_selection")
def pair_selection(spark, sf):
    """Two to four pairs of every track, of acquisitions within nine days of its passes' middle."""
    w = aq.orbit_window(acquisitions(spark, sf), 9, ("track", "pass"))
    return aq.select_pairs(aq.nearest_candidates(w, 36), least=2).drop("asc_ms", "desc_ms")


_CHANGE = f"""{SCENES}, b AS (SELECT "row", col, median(b1) / 3 AS lr, median(b4) AS inc FROM scene_pixels WHERE scene_id LIKE '1995%' GROUP BY ALL), a AS (SELECT "row", col, median(b1) / 3 AS lr, median(b4) AS inc FROM scene_pixels WHERE scene_id LIKE '1996%' GROUP BY ALL),
  j AS (SELECT a."row", a.col, a.lr - b.lr AS delta FROM a JOIN b ON a."row" = b."row" AND a.col = b.col AND abs(a.inc - b.inc) <= 1.5), m AS (SELECT median(delta) AS med, count(*) AS n FROM j),
  c AS (SELECT *, abs(delta - med) AS centred FROM j, m), s AS (SELECT greatest(median(centred) * 1.4826, 0.25) AS scale, quantile_cont(centred, 0.95) AS p95 FROM c), t AS (SELECT scale, p95, greatest(1, scale * 3) AS threshold FROM s)"""


def _change(spark, sf):
    px = scene_pixels(spark, sf)
    view = lambda y: px.where(F.col("scene_id").like(f"{y}%")).groupBy("row", "col").agg((F.median("b1") / 3).alias("lr"), F.median("b4").alias("inc"))
    return aq.surface_change(view(1995), view(1996))


@add("surface_change", f'WITH {_CHANGE} SELECT "row", col, round(delta, 6) + 0.0::DOUBLE AS delta, round(CASE WHEN n >= 64 THEN centred / threshold END, 6) AS indicator, n >= 64 AND centred >= threshold AS flagged FROM c, t')
def surface_change(spark, sf):
    return _change(spark, sf).select("row", "col", rounded("delta").alias("delta"), F.round("indicator", 6).alias("indicator"), "flagged")


@add("surface_change_summary", f"WITH {_CHANGE} SELECT count(*) AS valid, sum((n >= 64 AND centred >= threshold)::INT)::BIGINT AS flagged, round(any_value(med), 6) AS median_delta, round(any_value(p95), 6) AS p95, round(any_value(scale), 6) AS scale, round(any_value(threshold), 6) AS threshold FROM c, t")
def surface_change_summary(spark, sf):
    return aq.change_summary(_change(spark, sf))


@add("coverage_summary", """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, grouping(event_type, strftime(ts, '%Y-%m-%d'))::BIGINT AS level, count(*) AS n, count(DISTINCT user_id) AS users
  FROM events GROUP BY GROUPING SETS ((event_type), (strftime(ts, '%Y-%m-%d')), (event_type, strftime(ts, '%Y-%m-%d')), ())""")
def coverage_summary(spark, sf):
    """Counts by type, by month, by both and overall."""
    e = table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return e.groupingSets([[F.col("event_type")], [F.col("day")], [F.col("event_type"), F.col("day")], []], F.col("event_type"), F.col("day")).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


_SITES = """s AS (SELECT DISTINCT user_id % 500 AS image, strftime(ts, '%Y-%m-%d') AS period FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id % 500 AS image, strftime(ts, '%Y-%m-%d') AS period FROM events WHERE event_type = 'purchase')"""


@add("site_background_match", f"""WITH {_SITES}, j AS (SELECT coalesce(s.period, b.period) AS period, s.image AS si, b.image AS bi FROM s FULL JOIN b ON s.period = b.period AND s.image = b.image)
  SELECT period, count(*) FILTER (si IS NOT NULL AND bi IS NOT NULL) AS matched, count(*) FILTER (bi IS NULL) AS site_only, count(*) FILTER (si IS NULL) AS background_only FROM j GROUP BY period""")
def site_background_match(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 500).alias("image"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "event_type")
    s = e.where("event_type = 'view'").select("period", "image").distinct().withColumn("s", F.lit(1))
    b = e.where("event_type = 'purchase'").select("period", "image").distinct().withColumn("b", F.lit(1))
    return s.join(b, ["period", "image"], "full").groupBy("period").agg(
        F.count_if(F.col("s").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("site_only"), F.count_if(F.col("s").isNull()).alias("background_only"))


@add("matched_rows", """WITH b AS (SELECT user_id, count(*) AS n, quantile_cont(value, 0.25) AS p25, median(value) AS p50, quantile_cont(value, 0.75) AS p75 FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75 FROM customer LEFT JOIN b ON c_custkey = user_id""")
def matched_rows(spark, sf):
    """Every manifest row with its statistics; missing ones stay NULL."""
    b = table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), quantile("value", 0.25).alias("p25"), F.median("value").alias("p50"), quantile("value", 0.75).alias("p75"))
    j = table(spark, sf, "customer").join(b, F.col("c_custkey") == F.col("user_id"), "left")
    return j.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


_SCREEN = """screen AS (SELECT c_mktsegment AS feature, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'pre' WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'transition' ELSE 'post' END AS period, month(o_orderdate)::INT AS month,
  o_totalprice / 1003.0::DOUBLE AS x FROM orders JOIN customer ON o_custkey = c_custkey)"""


def screen(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = F.col("o_orderdate")
    period = F.when(d < F.lit("1998-01-01").cast("timestamp"), "pre").when(d < F.lit("1998-07-01").cast("timestamp"), "transition").otherwise("post")
    return o.select(F.col("c_mktsegment").alias("feature"), period.alias("period"), F.month(d).alias("month"), (F.col("o_totalprice") / 1003.0).alias("x"))


@add("descriptive_screen", f"""WITH {_SCREEN}, s AS (SELECT feature, period, count(*) AS n, quantile_cont(x, 0.25) AS p25, median(x) AS p50, quantile_cont(x, 0.75) AS p75 FROM screen WHERE period <> 'transition' GROUP BY ALL)
  SELECT a.feature, a.n AS n_pre, b.n AS n_post, round(a.p50, 6) AS pre_median, round(b.p50, 6) AS post_median, round(b.p50 - a.p50, 6) AS shift, round(a.p75 - a.p25, 6) AS pre_iqr FROM s a JOIN s b ON a.feature = b.feature AND a.period = 'pre' AND b.period = 'post'""")
def descriptive_screen(spark, sf):
    pre, post = F.col("period") == "pre", F.col("period") == "post"
    of = lambda cond: F.when(cond, F.col("x"))
    s = screen(spark, sf).groupBy("feature").agg(
        F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), F.median(of(pre)).alias("a"), F.median(of(post)).alias("b"), (quantile(of(pre), 0.75) - quantile(of(pre), 0.25)).alias("i"))
    return s.select("feature", "n_pre", "n_post", F.round("a", 6).alias("pre_median"), F.round("b", 6).alias("post_median"), F.round(F.col("b") - F.col("a"), 6).alias("shift"), F.round("i", 6).alias("pre_iqr"))


@add("cliffs_delta", f"""WITH {_SCREEN}, r AS (SELECT feature, period, rank() OVER w + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rk FROM screen WHERE period <> 'transition' WINDOW w AS (PARTITION BY feature ORDER BY x)),
  t AS (SELECT feature, count(*) FILTER (period = 'pre') AS n_pre, count(*) FILTER (period = 'post') AS n_post, sum(rk) FILTER (period = 'post') AS s FROM r GROUP BY feature)
  SELECT feature, n_pre, n_post, round(2 * (s - n_post * (n_post + 1) / 2) / (n_pre * n_post) - 1, 6) AS delta FROM t""")
def cliffs_delta(spark, sf):
    return aq.cliffs_delta(screen(spark, sf).where("period != 'transition'"), "x", "period", "feature", 10.0).withColumn("delta", F.round("delta", 6))




@add("holm", f"""WITH {_SCREEN}, p AS (SELECT feature, (count(*) % 97 + 1) / 400.0::DOUBLE AS p FROM screen GROUP BY feature), r AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, feature) + 1)) AS raw FROM p)
  SELECT feature, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, feature ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""")
def holm(spark, sf):
    p = screen(spark, sf).groupBy("feature").agg(((F.count(F.lit(1)) % 97 + 1) / 400.0).alias("p"))
    return aq.holm(p, "p", "feature").select("feature", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@add("residual_screen", f"""WITH {_SCREEN}, a AS (SELECT feature, x, sin(2 * 3.141592653589793::DOUBLE * (month - 1) / 12) AS u, cos(2 * 3.141592653589793::DOUBLE * (month - 1) / 12) AS v FROM screen),
  m AS (SELECT feature, avg(x) AS mx, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(x, u) AS xu, covar_pop(x, v) AS xv FROM a GROUP BY feature),
  b AS (SELECT *, (xu * vv - xv * uv) / (uu * vv - uv * uv) AS bu, (xv * uu - xu * uv) / (uu * vv - uv * uv) AS bv FROM m)
  SELECT feature, round(avg(x - mx - bu * (u - mu) - bv * (v - mv)), 6) + 0.0 AS mean, round(stddev_pop(x - mx - bu * (u - mu) - bv * (v - mv)), 6) AS deviation FROM a JOIN b USING (feature) GROUP BY feature""")
def residual_screen(spark, sf):
    """Residuals on 1, sin and cos of the month, and their deviation by feature."""
    s = screen(spark, sf).withColumn("_a", 2 * 3.141592653589793 * (F.col("month") - 1) / 12).withColumns({"sin": F.sin("_a"), "cos": F.cos("_a")})
    r = aq.residualize(s.select("feature", "x", "sin", "cos"), "x", ["sin", "cos"], "feature")
    return r.groupBy("feature").agg(rounded(F.avg("residual")).alias("mean"), F.round(F.stddev_pop("residual"), 6).alias("deviation"))


@add("permutation_screen")
def permutation_screen(spark, sf):
    """Month-stratified permutation test on monthly medians, with Holm's adjustment."""
    m = screen(spark, sf).where("period != 'transition'").groupBy("feature", "period", "month").agg(F.median("x").alias("x"))
    p = aq.permutation_p(m, "x", "period", "month", "feature", 499, 20260101)
    return aq.holm(p, "p_value", "feature")
