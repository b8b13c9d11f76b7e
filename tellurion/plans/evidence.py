"""Queries over cells, depth, datasets, comparison, quality, catalogue, text and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import rounded
from tellurion.functions.group_stats import quantile
from tellurion.operators import cells as ce
from tellurion.operators import evidence as ev
from tellurion.sources.views import PIX, SIZE, pix, spread, table
from tellurion.streaming import events as st

QUERIES, ORACLES = {}, {}


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- cells -----------------------------------------------------------------------

#: column: multiplier and modulus of the part key; a share is (key * m % k) / (k + 0.3).
_SHARES = {
    "visibility": (37, 101), "spectral": (53, 211), "sar": (29, 157), "terrain": (41, 131), "builtup": (7, 997), "builtup_near": (11, 499), "cropland": (13, 113), "water_edge": (17, 397),
    "strong_built": (19, 1999), "building_near": (23, 797), "road_like": (31, 199), "corridor": (43, 599), "confidence": (47, 103), "stability": (59, 107), "season": (61, 109), "gap": (67, 127)}
_COUNTS = {"s2_count": (3, 11), "top10": (5, 4), "top25": (7, 6), "season_top10": (11, 3), "season_top25": (13, 5)}
_CELLS = "c AS (SELECT 'cell_' || p_partkey AS cell_id, p_partkey AS k, " + ", ".join(f"(p_partkey * {m} % {n}) / {n + 0.3}::DOUBLE AS {c}" for c, (m, n) in _SHARES.items()) + ", " + ", ".join(f"p_partkey * {m} % {n} AS {c}" for c, (m, n) in _COUNTS.items()) + " FROM part)"
_SCORED = f"""{_CELLS}, q AS (SELECT quantile_cont(spectral, 0.75) AS q75, median(terrain) AS med FROM c),
 w AS (SELECT *, least(1, 0.7 * spectral + 0.3 * sar) AS contrast, least(1, s2_count / 8) AS s2_confidence, (builtup >= 0.02 OR builtup_near >= 0.05)::INT AS w_built, (cropland >= 0.65)::INT AS w_crop, (water_edge >= 0.05)::INT AS w_water,
   (strong_built >= 0.01 OR building_near >= 0.03)::INT AS w_building, (road_like >= 0.08 OR corridor >= 0.025)::INT AS w_road FROM c, q),
 v AS (SELECT *, 0.35 * visibility + 0.35 * contrast + 0.2 * terrain + 0.1 * s2_confidence AS candidate_score, (spectral >= q75 AND terrain <= med AND w_built + w_crop + w_water > 0)::INT AS w_linear, w_building + w_road + w_crop + w_water AS warnings FROM w),
 u AS (SELECT *, least(0.28, warnings * 0.07) AS penalty, 1 - least(warnings, 4) / 4 AS bonus, candidate_score * (1 - least(0.28::DOUBLE, warnings * 0.07::DOUBLE)) AS adjusted FROM v),
 x AS (SELECT min(adjusted) AS a0, max(adjusted) AS a1, min(gap) AS g0, max(gap) AS g1 FROM u),
 s AS (SELECT *, least(1, greatest(0, 0.35 * (adjusted - a0) / (a1 - a0) + 0.25 * confidence + 0.2 * stability + 0.1 * season + 0.05 * (gap - g0) / (g1 - g0) + 0.05 * bonus)) AS priority FROM u, x),
 r AS (SELECT *, row_number() OVER (ORDER BY warnings, top10 DESC, season_top10 DESC, top25 DESC, season_top25 DESC, round(priority, 12) DESC, cell_id) AS rank FROM s)"""


def cells(spark, sf):
    k = F.col("p_partkey")
    cols = {c: (k * m % n) / (n + 0.3) for c, (m, n) in _SHARES.items()} | {c: k * m % n for c, (m, n) in _COUNTS.items()}
    return table(spark, sf, "part").select(F.concat(F.lit("cell_"), k.cast("string")).alias("cell_id"), k.alias("k"), *[v.alias(c) for c, v in cols.items()])


def _scored(spark, sf):
    return ce.score(cells(spark, sf)).withColumn("priority", F.round("priority", 12))


@add("cell_score_rank", f"WITH {_SCORED} SELECT cell_id, round(candidate_score, 6) AS candidate_score, round(contrast, 6) AS contrast, w_built, w_crop, w_water, w_building, w_road, w_linear, warnings, round(penalty, 6) AS penalty, round(priority, 6) AS priority, rank::INT AS rank FROM r")
def cell_score_rank(spark, sf):
    r = ce.rank(_scored(spark, sf))
    f = lambda c: F.round(c, 6).alias(c)
    return r.select("cell_id", f("candidate_score"), f("contrast"), "w_built", "w_crop", "w_water", "w_building", "w_road", "w_linear", "warnings", f("penalty"), f("priority"), "rank")


_BOUNDS = "(k % 360) - 180 AS west, (k % 160) - 80 AS south, (k % 360) - 179 AS east, (k % 160) - 79 AS north"


def _zones(spark, sf):
    k = F.col("k")
    return ce.request_zones(_scored(spark, sf).withColumns({"west": k % 360 - 180, "south": k % 160 - 80, "east": k % 360 - 179, "north": k % 160 - 79}))


@add("request_zones", f"WITH {_SCORED} SELECT printf('zone_%03d', rank) AS zone_id, printf('quote_%03d', rank) AS quote_id, cell_id, rank::INT AS rank, round(priority, 6) AS priority, warnings, {_BOUNDS} FROM r WHERE rank <= 25")
def request_zones(spark, sf):
    return _zones(spark, sf).withColumn("priority", F.round("priority", 6))


@add("zone_geojson", f"""WITH {_SCORED}, z AS (SELECT printf('zone_%03d', rank) AS zone_id, {_BOUNDS} FROM r WHERE rank <= 25)
  SELECT zone_id, '{{"type":"Feature","properties":{{"zone_id":"' || zone_id || '"}},"geometry":{{"type":"Polygon","coordinates":[[[' || west || ',' || south || '],[' || east || ',' || south || '],[' || east || ',' || north || '],[' || west || ',' || north || '],[' || west || ',' || south || ']]]}}}}' AS feature FROM z""")
def zone_geojson(spark, sf):
    return ce.zone_geojson(_zones(spark, sf))


@add("zonal_mean", f"""WITH {PIX} SELECT run_id, ("row" // 8 * 8 + col // 8)::INT AS zone, count(b1) AS pixels, round(avg(b1), 6) AS b1, round(avg(b2), 6) AS b2 FROM pix GROUP BY 1, 2""")
def zonal_mean(spark, sf):
    """Means over eight by eight cells; the cell of a pixel is computed, so the range join is an equi-join."""
    z = (F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)).cast("int")
    return pix(spark, sf).groupBy("run_id", z.alias("zone")).agg(F.count("b1").alias("pixels"), F.round(F.avg("b1"), 6).alias("b1"), F.round(F.avg("b2"), 6).alias("b2"))


@add("cell_validation", f"WITH {_CELLS} SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN spectral > 0.98 THEN 'spectral_high' END, CASE WHEN s2_count = 0 THEN 'no_scenes' END, CASE WHEN terrain IS NULL THEN 'terrain_missing' END], lambda x: x IS NOT NULL)) AS issue FROM c) GROUP BY issue")
def cell_validation(spark, sf):
    """Issue lists of the rows, counted."""
    issues = F.array_compact(F.array(F.when(F.col("spectral") > 0.98, "spectral_high"), F.when(F.col("s2_count") == 0, "no_scenes"), F.when(F.col("terrain").isNull(), "terrain_missing")))
    return cells(spark, sf).select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


# ---- depth ---------------------------------------------------------------------------

# A small calibration table.
ANCHORS = (("shallow", 1.0, 0.4, 0.5, 0.6), ("middle", 3.0, 1.4, 1.5, 1.6), ("deep", 7.0, 2.2, 2.6, 3.1))
_ANCHORS = "a AS (SELECT *, lead(anchor_id) OVER w AS ni, lead(s) OVER w AS ns, lead(lo) OVER w AS nlo, lead(best) OVER w AS nbest, lead(hi) OVER w AS nhi FROM (VALUES " + ", ".join(str(x) for x in ANCHORS) + ") t(anchor_id, s, lo, best, hi) WINDOW w AS (ORDER BY s))"


def _at(x, v):
    return f"({v} + ({x} - s) / (ns - s) * (n{v} - {v}))"


@add("depth_interpolate", f"""WITH {_ANCHORS}, c AS (SELECT p_partkey AS candidate_id, (p_partkey * 37 % 811) / 101.3::DOUBLE AS signal FROM part), i AS (SELECT *, signal - 0.1 AS a0, signal + 0.1 AS b0 FROM c WHERE signal - 0.1 >= 1 - 1e-12 AND signal + 0.1 <= 7 + 1e-12),
  j AS (SELECT * FROM i JOIN a ON ns IS NOT NULL AND a0 <= ns AND b0 >= s),
  e AS (SELECT candidate_id, min(least({_at('greatest(a0, s)', 'lo')}, {_at('least(b0, ns)', 'lo')})) AS minimum, max(greatest({_at('greatest(a0, s)', 'hi')}, {_at('least(b0, ns)', 'hi')})) AS maximum,
     max(CASE WHEN signal >= s AND (signal < ns OR ns = 7) THEN {_at('signal', 'best')} END) AS best,
     max(CASE WHEN signal >= s AND (signal < ns OR ns = 7) THEN CASE WHEN abs(signal - s) <= 1e-12 THEN 'anchor:' || anchor_id WHEN abs(signal - ns) <= 1e-12 THEN 'anchor:' || ni ELSE 'interval:' || anchor_id || ':' || ni END END) AS zone FROM j GROUP BY candidate_id)
  SELECT candidate_id, round(least(minimum, best), 6) AS minimum, round(best, 6) AS best, round(greatest(maximum, best), 6) AS maximum, zone, CASE WHEN best IS NULL THEN 'insufficient_data' ELSE 'calibrated_range' END AS status FROM c LEFT JOIN e USING (candidate_id)""")
def depth_interpolate(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), ((F.col("p_partkey") * 37 % 811) / 101.3).alias("signal"))
    a = spark.createDataFrame(list(ANCHORS), "anchor_id string, signal_value double, lo double, best double, hi double")
    d = ev.interpolate_depth(c, a, 0.1)
    return d.select("candidate_id", *[F.round(x, 6).alias(x) for x in ("minimum", "best", "maximum")], "zone", "status")


@add("depth_recorded", """SELECT p_partkey AS candidate_id, m.depth, CASE WHEN m.depth IS NULL THEN 'no_measurement' ELSE 'recorded' END AS status FROM part LEFT JOIN (SELECT ps AS k, round(avg(q), 6) AS depth FROM (SELECT l_suppkey AS ps, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R') GROUP BY ps) m ON p_partkey = m.k""")
def depth_recorded(spark, sf):
    m = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_quantity"), 6).alias("depth"))
    j = table(spark, sf, "part").join(m, F.col("p_partkey") == F.col("k"), "left")
    return j.select(F.col("p_partkey").alias("candidate_id"), "depth", F.when(F.col("depth").isNull(), "no_measurement").otherwise("recorded").alias("status"))


# ---- datasets ---------------------------------------------------------------------------


def samples(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id")


@add("hash_sample", "SELECT doc_id, source FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 100")
def hash_sample(spark, sf):
    """A reproducible sample of one hundred rows, first by hash."""
    return table(spark, sf, "documents").select("doc_id", "source").orderBy(ev.hash_order(F.col("doc_id"))).limit(100)


@add("hash_features", "SELECT doc_id, " + ", ".join(f"round(('0x' || substr(sha256('{s}:' || doc_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE, 8) AS f_{s}" for s in ("a", "b")) + " FROM documents")
def hash_features(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[ev.hash_feature(s, F.col("doc_id")).alias(f"f_{s}") for s in ("a", "b")])


_SPLITS = """g AS (SELECT lang AS source, source AS grp, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY sha256(source || '|' || grp), grp) - n AS before, sum(n) OVER (PARTITION BY source) AS total FROM g),
  sp AS (SELECT source, grp, n, CASE WHEN before < round(total * 0.7::DOUBLE) THEN 'train' WHEN before < round(total * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o)"""
_TARGETS = {"train": 0.7, "val": 0.15, "test": 0.15}


def _splits(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.col("lang").alias("source"), F.col("source").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return ev.assign_splits(g, _TARGETS)


@add("split_assign", f"WITH {_SPLITS} SELECT * FROM sp")
def split_assign(spark, sf):
    return _splits(spark, sf)


@add("leakage", f"WITH {_SPLITS} SELECT grp, count(DISTINCT split) AS splits, sum(n)::BIGINT AS n FROM sp GROUP BY grp HAVING count(DISTINCT split) > 1")
def leakage(spark, sf):
    """Groups that are in more than one split."""
    return _splits(spark, sf).groupBy("grp").agg(F.countDistinct("split").alias("splits"), F.sum("n").alias("n")).where("splits > 1")


@add("score_bands", """WITH s AS (SELECT ('0x' || substr(sha256('p:' || doc_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS p FROM documents)
  SELECT CASE WHEN p < 0.1 THEN '0.00-0.10' WHEN p < 0.25 THEN '0.10-0.25' WHEN p < 0.5 THEN '0.25-0.50' WHEN p < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS band, count(*) AS n, round(min(p), 6) AS low, round(max(p), 6) AS high, round(avg(p), 6) AS mean FROM s GROUP BY 1""")
def score_bands(spark, sf):
    s = table(spark, sf, "documents").select(ev.hash_feature("p", F.col("doc_id"), 15).alias("p"))
    return s.groupBy(ev.score_band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"), F.round(F.avg("p"), 6).alias("mean"))


@add("count_cube", """SELECT source, lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), (quality), (source, lang), (quality, lang))""")
def count_cube(spark, sf):
    s, l, q = F.col("source"), F.col("lang"), F.col("quality")
    return samples(spark, sf).groupingSets([[s], [l], [q], [s, l], [q, l]], s, l, q).agg(F.count(F.lit(1)).alias("n"))


@add("train_metrics")
def train_metrics(spark, sf):
    """Quality labels from text lengths and line statistics: logistic regression by split."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    x = d.select("doc_id", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("a"), F.length(F.regexp_replace("text", r"[^!%$*&#|]", "")).cast("double").alias("b"),
                 F.when(ev.hash_feature("s", F.col("doc_id")) < 0.7, "train").otherwise("test").alias("split"))
    return ev.train_metrics(x.withColumn("b", F.col("b") / (F.col("a") + 1)), ["a", "b"], "label", "split")


# ---- comparison ----------------------------------------------------------------------------

_AB = f'{PIX}, j AS (SELECT coalesce(l.run_id, r.run_id - 1) // 2 AS tile, l.b1 AS a, r.b1 AS b FROM (SELECT * FROM pix WHERE run_id % 2 = 0) l FULL JOIN (SELECT * FROM pix WHERE run_id % 2 = 1) r ON l.run_id + 1 = r.run_id AND l."row" = r."row" AND l.col = r.col)'


def _passes(spark, sf):
    """The first and the second pass of every tile."""
    p = pix(spark, sf).withColumn("tile", F.floor(F.col("run_id") / 2).cast("int"))
    return p.where("run_id % 2 = 0"), p.where("run_id % 2 = 1")


def _ab(spark, sf):
    return *_passes(spark, sf), ["tile", "row", "col"], "b1"


@add("compare_pixels", f"""WITH {_AB} SELECT tile, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (a IS NOT NULL AND b IS NULL) AS left_only, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS right_only,
  round(max(abs(a - b)), 6) AS max_diff, round(avg(abs(a - b)), 6) AS mean_diff, count(*) FILTER (abs(a - b) <= 1.03 + 0.01 * abs(b)) AS close FROM j GROUP BY tile""")
def compare_pixels(spark, sf):
    return ev.compare_pixels(*_ab(spark, sf), atol=1.03, rtol=0.01, by=("tile",))


@add("signed_delta_stats", f"WITH {_AB}, d AS (SELECT tile, a - b AS d FROM j WHERE a - b IS NOT NULL) SELECT tile, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero, round(median(d), 6) AS median, round(quantile_cont(abs(d), 0.9), 6) AS p90, round(quantile_cont(abs(d), 0.99), 6) AS p99 FROM d GROUP BY tile")
def signed_delta_stats(spark, sf):
    return ev.signed_stats(*_ab(spark, sf), by=("tile",))


@add("linear_fit", f"WITH {_AB} SELECT tile, count(*) AS n, round(corr(a, b), 6) AS r, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 5) AS intercept FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY tile")
def linear_fit(spark, sf):
    return ev.linear_fit(*_ab(spark, sf), by=("tile",))


@add("compare_tables", """WITH a AS (SELECT n_nationkey % 7 AS k, n_regionkey AS r FROM nation), b AS (SELECT n_nationkey % 7 AS k, n_regionkey AS r FROM nation WHERE n_nationkey > 2),
  l AS (SELECT count(*) AS left_only FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), r AS (SELECT count(*) AS right_only FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT left_only, right_only, left_only = 0 AND right_only = 0 AS equal FROM l, r""")
def compare_tables(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select((F.col("n_nationkey") % 7).alias("k"), F.col("n_regionkey").alias("r"))
    b = n.where("n_nationkey > 2").select((F.col("n_nationkey") % 7).alias("k"), F.col("n_regionkey").alias("r"))
    return ev.compare_tables(a, b)


@add("axis_bins", f"""WITH {PIX} SELECT run_id, ("row" * 8 // 64)::INT AS bin, count(*) AS n FROM pix WHERE b1 > 30 GROUP BY 1, 2""")
def axis_bins(spark, sf):
    """Flagged pixels in eight equal bins of the row axis."""
    return pix(spark, sf).where("b1 > 30").groupBy("run_id", F.floor(F.col("row") * 8 / SIZE).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---- quality ---------------------------------------------------------------------------------

_EDGE = "((\"row\" IN (0, 63))::INT + (col IN (0, 63))::INT)"


@add("band_coverage", f"WITH {PIX} SELECT run_id, count(*) AS pixels, count(b1) AS b1, count(b4) AS b4, count(*) FILTER (b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL) AS shared, round(count(b1) / count(*), 6) AS fraction FROM pix GROUP BY run_id")
def band_coverage(spark, sf):
    ok = F.col("b1").isNotNull() & F.col("b2").isNotNull() & F.col("b3").isNotNull() & F.col("b4").isNotNull()
    return pix(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("pixels"), F.count("b1").alias("b1"), F.count("b4").alias("b4"), F.count_if(ok).alias("shared"), F.round(F.count("b1") / F.count(F.lit(1)), 6).alias("fraction"))


@add("edge_valid", f"WITH {PIX} SELECT run_id, round(sum(CASE WHEN b1 IS NOT NULL THEN {_EDGE} ELSE 0 END) / sum({_EDGE}), 6) AS edge_fraction, arg_max(\"row\" * 64 + col, (b1, -(\"row\" * 64 + col))) FILTER (b1 IS NOT NULL) AS anchor FROM pix GROUP BY run_id")
def edge_valid(spark, sf):
    """Valid share of the four edges, corners counted twice, and the place of the largest value, the first on ties."""
    at = F.col("row") * SIZE + F.col("col")
    weight = F.col("row").isin(0, SIZE - 1).cast("int") + F.col("col").isin(0, SIZE - 1).cast("int")
    top = F.max(F.when(F.col("b1").isNotNull(), F.struct("b1", (-at).alias("k"))))
    return pix(spark, sf).groupBy("run_id").agg(F.round(F.sum(F.when(F.col("b1").isNotNull(), weight).otherwise(0)) / F.sum(weight), 6).alias("edge_fraction"), (-top.getField("k")).alias("anchor"))


@add("run_quality_fold", f"""WITH {PIX}, f AS (SELECT run_id, count(b1) / count(*) AS cover, count(*) FILTER (b1 > 30) / count(*) AS bright, avg(b4) / 8 AS tax FROM pix GROUP BY run_id),
  k AS (SELECT run_id, 'coverage' AS c, CASE WHEN cover < 0.5 THEN 2 WHEN cover < 0.99 THEN 1 ELSE 0 END AS s FROM f UNION ALL SELECT run_id, 'bright', CASE WHEN bright < 0.05 THEN 2 WHEN bright < 0.3 THEN 1 ELSE 0 END FROM f UNION ALL SELECT run_id, 'tax', CASE WHEN tax < 0.1 THEN 2 WHEN tax < 0.5 THEN 1 ELSE 0 END FROM f)
  SELECT run_id, ['PASS', 'WARNING', 'BLOCKED'][max(s) + 1] AS status, coalesce(string_agg(c, ',' ORDER BY c) FILTER (s > 0), '') AS open_checks FROM k GROUP BY run_id""")
def run_quality_fold(spark, sf):
    f = pix(spark, sf).groupBy("run_id").agg((F.count("b1") / F.count(F.lit(1))).alias("cover"), (F.count_if(F.col("b1") > 30) / F.count(F.lit(1))).alias("bright"), (F.avg("b4") / 8).alias("tax"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), ev.gate(F.col(c), lo, hi).alias("severity")) for n, c, lo, hi in (("coverage", "cover", 0.5, 0.99), ("bright", "bright", 0.05, 0.3), ("tax", "tax", 0.1, 0.5))])
    return ev.fold(f.select("run_id", F.inline(checks)), "run_id")


# ---- catalogue ----------------------------------------------------------------------------------


@add("run_list", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_name LIKE '%1%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10")
def run_list(spark, sf):
    """Name and status filters, a sort with a second key, offset and limit."""
    c = table(spark, sf, "customer").where(F.col("c_name").like("%1%") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(50).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@add("cleanup_summary", """WITH r AS (SELECT c_mktsegment AS status, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer)
  SELECT status, k::INT AS k, c_custkey, c_acctbal FROM r WHERE k <= 5""")
def cleanup_summary(spark, sf):
    """The five largest of each status."""
    w = Window.partitionBy("status").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("status"), "c_custkey", "c_acctbal").withColumn("k", F.row_number().over(w)).where("k <= 5")


@add("deletion_audit", "SELECT status, count(*) AS runs, sum(cents)::BIGINT AS cents FROM (SELECT c_mktsegment AS status, round(c_acctbal * 100)::BIGINT AS cents FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY') GROUP BY status")
def deletion_audit(spark, sf):
    """Counts and sums by status of what a retention rule takes: overdrawn or of a closed segment."""
    c = table(spark, sf, "customer").where((F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "MACHINERY"))
    return c.groupBy(F.col("c_mktsegment").alias("status")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@add("output_coverage", """SELECT CASE WHEN o.k IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' ELSE 'present' END AS state, count(*) AS n FROM customer FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o.k GROUP BY 1""")
def output_coverage(spark, sf):
    """Expected against present, both ways."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    j = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("k"), "full")
    return j.groupBy(F.when(F.col("k").isNull(), "missing").when(F.col("c_custkey").isNull(), "extra").otherwise("present").alias("state")).agg(F.count(F.lit(1)).alias("n"))


_UTM = """WITH p AS (SELECT p_partkey, (p_partkey * 37 % 3599) / 10.0::DOUBLE - 179.95::DOUBLE AS lon, (p_partkey * 53 % 1600) / 10.0::DOUBLE - 79.95::DOUBLE AS lat, 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n FROM part),
  z AS (SELECT *, least(floor((lon + 180) / 6) + 1, 60)::INT AS zone, 2 * sqrt(n) / (1 + n) AS e, sin(radians(lat)) AS s FROM p),
  t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, sinh(atanh(s) - e * atanh(e * s)) AS t FROM z),
  x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS k, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM t)
  SELECT p_partkey, zone, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone)::INT AS epsg, round(500000 + k * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
    round(k * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing FROM x"""


@add("utm_grid", _UTM)
def utm_grid(spark, sf):
    """Zone, EPSG code, easting and northing of a point for every part."""
    k = F.col("p_partkey")
    u = ev.utm((k * 37 % 3599) / 10.0 - 179.95, (k * 53 % 1600) / 10.0 - 79.95)
    return table(spark, sf, "part").select("p_partkey", u["zone"].alias("zone"), u["epsg"].alias("epsg"), F.round(u["easting"], 3).alias("easting"), F.round(u["northing"], 3).alias("northing"))


@add("utm_zone", "SELECT p_partkey, (floor(((p_partkey * 37 % 3599) / 10.0::DOUBLE - 179.95::DOUBLE + 180) / 6) + 1)::INT AS zone, (CASE WHEN (p_partkey * 53 % 1600) / 10.0::DOUBLE - 79.95::DOUBLE >= 0 THEN 32600 ELSE 32700 END + floor(((p_partkey * 37 % 3599) / 10.0::DOUBLE - 179.95::DOUBLE + 180) / 6) + 1)::INT AS epsg FROM part")
def utm_zone(spark, sf):
    return utm_grid(spark, sf).select("p_partkey", "zone", "epsg")


# ---- elevation ------------------------------------------------------------------------------------


@add("robust_plane")
def robust_plane(spark, sf):
    """The plane of every grid; the smallest table's grids are sparse, so a few points are enough."""
    r = ev.robust_plane(pix(spark, sf), "dem", least=100)
    return r.withColumns({c: rounded(c) for c in ("offset", "x_edge_delta", "y_edge_delta")})


@add("best_shift", f"""WITH {PIX}, a AS (SELECT run_id, "row" + dy AS y, col + dx AS x, dem AS a, dy, dx FROM pix, (SELECT range - 2 AS dy FROM range(5)), (SELECT range - 2 AS dx FROM range(5)) WHERE run_id % 2 = 0),
  d AS (SELECT a.run_id // 2 AS tile, dy, dx, dem - a AS d FROM a JOIN pix p ON p.run_id = a.run_id + 1 AND "row" = y AND col = x WHERE dem - a IS NOT NULL), m AS (SELECT tile, dy, dx, median(d) AS m FROM d GROUP BY ALL)
  SELECT tile, dy::INT AS dy, dx::INT AS dx, round(median(abs(d - m)), 6) AS mad, count(*) AS n FROM d JOIN m USING (tile, dy, dx) GROUP BY tile, dy, dx""")
def best_shift(spark, sf):
    """Spread of the difference of every tile's passes at each whole-pixel shift."""
    return ev.best_shift(*_passes(spark, sf), "dem", 2, ("tile",)).withColumn("mad", F.round("mad", 6))


# ---- text and streams ------------------------------------------------------------------------------


_LINE = """concat(c_name, ' /home/', c_custkey, '/x.tif ', md5(c_name), ' Point (', c_custkey % 130, '.25, ', c_custkey % 250, '.5) "type": "Feature" ', c_mktsegment)"""


def _redact_sql(x):
    for pattern, name in ev.REDACT:
        x = f"regexp_replace({x}, '{pattern}', '{name}', 'g')"
    return x


_PARTS = f"""l AS (SELECT c_custkey, {_LINE} AS line FROM customer), t AS (SELECT c_custkey, line, {_redact_sql('line')} AS t FROM l),
  s AS (SELECT c_custkey, string_split_regex(t, '{ev.PAIR}') AS texts, regexp_extract_all(t, '{ev.PAIR}') AS pairs FROM t)"""


@add("redact_text", f"""WITH {_PARTS} SELECT c_custkey, array_to_string(list_transform(texts, lambda a, i: a || CASE WHEN i > len(pairs) THEN '' WHEN abs(trim(split_part(pairs[i], ',', 1))::DOUBLE) <= 90 AND abs(trim(split_part(pairs[i], ',', 2))::DOUBLE) <= 180 THEN '{ev.PAIR_NAME}' ELSE pairs[i] END), '') AS line FROM s""")
def redact_text(spark, sf):
    """Log lines with paths, digests, geometry and coordinates."""
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", ev.redact(F.expr(_LINE)).alias("line"))


@add("redaction_violations", f"""WITH {_PARTS}, v AS (SELECT c_custkey, len(list_filter(pairs, lambda p: abs(trim(split_part(p, ',', 1))::DOUBLE) <= 90 AND abs(trim(split_part(p, ',', 2))::DOUBLE) <= 180)) AS pairs FROM s)
  SELECT c_custkey, true AS raw, false AS redacted, pairs > 0 AS had_pair FROM v""")
def redaction_violations(spark, sf):
    """Raw lines break the rules, redacted ones don't."""
    d = spread(table(spark, sf, "customer").select("c_custkey", F.expr(_LINE).alias("line")))
    d = d.withColumn("clean", ev.redact(F.col("line")))
    return d.select("c_custkey", ev.violates(F.col("line")).alias("raw"), ev.violates(F.col("clean")).alias("redacted"), F.col("clean").contains(ev.PAIR_NAME).alias("had_pair"))


@add("feature_completeness", f"""WITH {PIX}, u AS (SELECT run_id, unnest(['b1', 'b2', 'b3', 'b4']) AS feature, unnest([b1, b2, b3, b4]) AS v FROM pix)
  SELECT run_id, feature, count(*) AS n, count(*) - count(v) AS missing, count(*) FILTER (v = 0) AS zeros FROM u GROUP BY run_id, feature""")
def feature_completeness(spark, sf):
    return ev.completeness(pix(spark, sf), ["run_id"], ["b1", "b2", "b3", "b4"])


@add("json_canonical", """SELECT event_id, '{"k":' || (props->>'k') || ',"v":' || coalesce(round(value, 2)::DECIMAL(18, 2)::VARCHAR, 'null') || '}' AS doc FROM events""")
def json_canonical(spark, sf):
    """Keys in order, no spaces, numbers with two decimals."""
    v = F.coalesce(F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("null"))
    return table(spark, sf, "events").select("event_id", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"v":'), v, F.lit("}")).alias("doc"))


@add("stream_event_windows", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(round(value * 1000)::BIGINT)::BIGINT AS v FROM events GROUP BY ALL""")
def stream_event_windows(spark, sf):
    """Daily counts by type through a stream with a watermark and repeats dropped."""
    t = st.run_to_latest(st.windowed(st.read_events(spark, sf)), ["window", "event_type"])
    return t.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "v")


@add("stream_pairs", """WITH e AS (SELECT event_id, user_id AS track, epoch_us(ts) AS us, event_type FROM events) SELECT a.track, a.event_id AS asc_id, d.event_id AS desc_id, abs(a.us // 1000 - d.us // 1000) AS dt_ms
  FROM e a JOIN e d ON a.track = d.track AND a.event_type = 'view' AND d.event_type = 'click' AND abs(a.us - d.us) <= 36 * 3600000000""")
def stream_pairs(spark, sf):
    """Ascending and descending acquisitions of a track within 36 hours, as a join of two streams into files."""
    return st.run_to_files(st.paired(st.read_events(spark, sf), 36))


@add("quantile_contexts", f"""WITH {PIX}, q AS (SELECT run_id, quantile_cont(inc, 0.25) AS i1, quantile_cont(inc, 0.75) AS i3 FROM pix GROUP BY run_id)
  SELECT run_id, count(*) FILTER (inc <= i1) AS low, count(*) FILTER (inc > i1 AND inc < i3) AS middle, count(*) FILTER (inc >= i3) AS high FROM pix JOIN q USING (run_id) GROUP BY run_id""")
def quantile_contexts(spark, sf):
    """Pixels in the quartile contexts of the incidence."""
    p = pix(spark, sf)
    q = p.groupBy("run_id").agg(quantile("inc", 0.25).alias("i1"), quantile("inc", 0.75).alias("i3"))
    x = F.col("inc")
    return p.join(q, "run_id").groupBy("run_id").agg(F.count_if(x <= F.col("i1")).alias("low"), F.count_if((x > F.col("i1")) & (x < F.col("i3"))).alias("middle"), F.count_if(x >= F.col("i3")).alias("high"))


@add("cell_grid", """WITH a AS (SELECT n_nationkey AS aoi, n_nationkey * 15.0 - 176 AS west, n_regionkey * 20.0 - 60 AS south, n_nationkey * 15.0 - 176 + CASE WHEN n_nationkey % 7 = 3 THEN -4 ELSE 8 END AS east, n_regionkey * 20.0 - 56 AS north FROM nation),
  g AS (SELECT aoi, west, south, (east - west) / 4 AS w, (north - south) / 2 AS h FROM a WHERE west >= -180 AND east <= 180 AND south >= -90 AND north <= 90 AND west < east AND south < north)
  SELECT aoi, printf('V6_CELL_R%03d_C%03d', r + 1, c + 1) AS cell_id, (west + c * w)::DOUBLE AS west, (south + r * h)::DOUBLE AS south, (west + (c + 1) * w)::DOUBLE AS east, (south + (r + 1) * h)::DOUBLE AS north FROM g, (SELECT range AS r FROM range(2)), (SELECT range AS c FROM range(4))""")
def cell_grid(spark, sf):
    """Two rows of four cells in every valid area of interest."""
    n = table(spark, sf, "nation")
    west, south = F.col("n_nationkey") * 15.0 - 176, F.col("n_regionkey") * 20.0 - 60
    aois = n.select(F.col("n_nationkey").alias("aoi"), west.alias("west"), south.alias("south"), (west + F.when(F.col("n_nationkey") % 7 == 3, -4).otherwise(8)).alias("east"), (south + 4).alias("north"))
    return ev.cell_grid(ev.aoi_status(aois).where("aoi_status = 'ok'"), 2, 4).select("aoi", "cell_id", "west", "south", "east", "north")
