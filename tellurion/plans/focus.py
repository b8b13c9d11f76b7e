"""Queries over candidate focuses, object features, labels, sampling, masks, shifts, tiles and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions import group_stats as g
from tellurion.functions.columns import ratio, rounded
from tellurion.operators import focus as fo
from tellurion.operators import objects as ob
from tellurion.operators import targets as tg
from tellurion.plans.objects import CELL, CLS, COMP, Q, anomaly
from tellurion.sources.views import PIX, SIZE, pix, table, valued

QUERIES, ORACLES = {}, {}
RADIUS = 6.5


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _mask(spark, sf):
    return ob.connected(ob.candidate_pixels(anomaly(spark, sf), "b2", Q))


def _classified(spark, sf):
    return ob.classify(ob.clusters(ob.summarize(_mask(spark, sf), "b2")))


FOCUS = f"""{CLS}, ro AS (SELECT *, CASE WHEN class_score >= 0.7 THEN '01_CORE_REVIEW' WHEN class_score >= 0.6 THEN '02_SECOND_REVIEW' WHEN class_score >= 0.5 THEN '03_CONTEXT_REVIEW' WHEN class_score >= 0.4 THEN '04_LATE_REVIEW' ELSE '05_BACKGROUND' END AS review_order FROM cc),
  rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY class_score DESC, review_order, object_id) AS rank FROM ro),
  fc AS (SELECT *, 'object_' || object_id AS candidate_id, (row_min + row_max) / 2.0::DOUBLE AS center_row, (col_min + col_max) / 2.0::DOUBLE AS center_col FROM rk WHERE rank <= 3)"""


@add("candidate_focuses", f"WITH RECURSIVE {FOCUS} SELECT run_id, rank, candidate_id, cluster_id, center_row, center_col, round(class_score, 6) AS source_score, review_order, finding_label FROM fc")
def candidate_focuses(spark, sf):
    """The three best objects of every run."""
    f = fo.select_focuses(_classified(spark, sf))
    return f.select("run_id", "rank", "candidate_id", "cluster_id", "center_row", "center_col", F.round("class_score", 6).alias("source_score"), "review_order", "finding_label")


@add("focus_windows", f"""WITH RECURSIVE {FOCUS} SELECT f.run_id, rank, candidate_id, count(*) AS mask_pixels, min(p."row") AS row_min, max(p."row") AS row_max, min(p.col) AS col_min, max(p.col) AS col_max, round(avg(p.b1), 6) AS b1_mean, round(avg(p.b3), 6) AS b3_mean
  FROM fc f JOIN pix p ON p.run_id = f.run_id AND (p."row" - center_row) ** 2 + (p.col - center_col) ** 2 <= {RADIUS * RADIUS} GROUP BY ALL""")
def focus_windows(spark, sf):
    f = fo.select_focuses(_classified(spark, sf))
    return fo.focus_windows(f, pix(spark, sf), RADIUS, ["b1", "b3"]).withColumns({c: F.round(c, 6) for c in ("b1_mean", "b3_mean")})


@add("object_features", f"""WITH RECURSIVE {COMP}, v AS (SELECT o.run_id, o.object_id, p.b2 / 131 AS peak, unnest(CASE WHEN p.b4 > 0.01 AND p.b1 IS NOT NULL AND p.b3 IS NOT NULL THEN [p.b1 / 60, p.b3 / 12] ELSE [NULL] END) AS v
   FROM os o JOIN pix p ON p.run_id = o.run_id AND p."row" BETWEEN row_min AND row_max AND p.col BETWEEN col_min AND col_max)
  SELECT run_id, object_id, round(coalesce(avg(v), 0), 6) AS signal_mean, least(1, round(coalesce(max(peak), 0), 6)) AS signal_peak, round(coalesce(stddev_pop(v), 0), 6) AS signal_spread FROM v GROUP BY run_id, object_id""")
def object_features(spark, sf):
    """Box range join: features of every object over its bounding box."""
    px = anomaly(spark, sf).withColumns({"f1": F.col("b1") / 60, "f3": F.col("b3") / 12})
    return fo.box_features(ob.summarize(_mask(spark, sf), "b2"), px, ["f1", "f3"], "b2", F.col("b4") > 0.01)


@add("object_bounds", f"""WITH RECURSIVE {COMP} SELECT run_id, object_id, CASE WHEN row_max >= 60 OR col_max >= 60 THEN 'outside' ELSE 'ok' END AS bounds_status FROM os""")
def object_bounds(spark, sf):
    """Objects against a grid that is four pixels shorter and narrower."""
    return fo.within_grid(ob.summarize(_mask(spark, sf), "b2"), SIZE - 4, SIZE - 4).select("run_id", "object_id", "bounds_status")


@add("neutral_labels", f"""WITH RECURSIVE {CLS}, n AS (SELECT run_id, cluster_id, class_id, count(*) AS n FROM cc GROUP BY ALL)
  SELECT run_id, cluster_id, arg_min(class_id, lpad((100000000 - n)::VARCHAR, 12, '0') || class_id) AS dominant_class_id, sum(n)::BIGINT AS object_count, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS class_counts FROM n GROUP BY run_id, cluster_id""")
def neutral_labels(spark, sf):
    return fo.neutral_labels(_classified(spark, sf))


@add("finding_reasons", f"""WITH RECURSIVE {CLS}, h AS (SELECT *, row_max - row_min + 1 AS h, col_max - col_min + 1 AS w FROM cc)
  SELECT run_id, object_id, printf('app_score=%.3f', class_score) || CASE WHEN class_score >= 0.6 THEN '; shape=' || h || 'x' || w || '; ' || CASE WHEN l / s >= 3 THEN 'elongated' WHEN class_score >= 0.7 AND l <= 3 THEN 'compact' ELSE 'area-like' END
    WHEN class_score >= 0.5 THEN '; compare cluster context' WHEN class_score >= 0.4 THEN '; use only near stronger objects' ELSE '' END AS finding_reason FROM h""")
def finding_reasons(spark, sf):
    c = _classified(spark, sf)
    return c.select("run_id", "object_id", fo.finding_reason(F.col("class_score"), F.col("row_max") - F.col("row_min") + 1, F.col("col_max") - F.col("col_min") + 1).alias("finding_reason"))


@add("point_samples", f"""WITH RECURSIVE {COMP}, o AS (SELECT run_id, object_id, greatest(0, least(63, round_even(row_center, 0)::INT)) AS "row", greatest(0, least(63, round_even(col_center, 0)::INT)) AS col FROM os)
  SELECT o.run_id, object_id, o."row", o.col, round(b1, 6) AS b1, round(b3, 6) AS b3 FROM o LEFT JOIN pix p ON p.run_id = o.run_id AND p."row" = o."row" AND p.col = o.col""")
def point_samples(spark, sf):
    """Bands at the centre of every object."""
    s = fo.sample_points(ob.summarize(_mask(spark, sf), "b2"), pix(spark, sf), ["b1", "b3"], SIZE, SIZE)
    return s.select("run_id", "object_id", "row", "col", F.round("b1", 6).alias("b1"), F.round("b3", 6).alias("b3"))


@add("nearest_target", f"""WITH {PIX}, t AS (SELECT run_id, "row" * 64 + col AS target_id, "row", col FROM pix WHERE b1 > 40), d AS (
  SELECT p.run_id, p."row" * 64 + p.col AS point_id, target_id, sqrt((p."row" - t."row") ** 2 + (p.col - t.col) ** 2) AS distance, row_number() OVER (PARTITION BY p.run_id, p."row", p.col ORDER BY (p."row" - t."row") ** 2 + (p.col - t.col) ** 2, target_id) AS k
  FROM pix p JOIN t ON p.run_id = t.run_id WHERE p.b3 > 0.07) SELECT run_id, point_id, target_id, round(distance, 6) AS distance FROM d WHERE k = 1""")
def nearest_target(spark, sf):
    """For every pixel with a high third band the nearest pixel of its run with a high first band."""
    p = pix(spark, sf).select("run_id", (F.col("row") * SIZE + F.col("col")).alias("id"), F.col("row").alias("y"), F.col("col").alias("x"), "b1", "b3")
    n = fo.nearest(p.where("b3 > 0.07").withColumnRenamed("id", "point_id"), p.where("b1 > 40").withColumnRenamed("id", "target_id"), SIZE)
    return n.withColumn("distance", F.round("distance", 6))


@add("robust_norm_p98", f"""WITH {PIX}, q AS (SELECT run_id, quantile_cont(b2, 0.02) AS lo, quantile_cont(b2, 0.98) AS hi FROM pix GROUP BY run_id)
  SELECT run_id, "row", col, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(1, greatest(0, (b2 - lo) / (hi - lo + 1e-9))) END, 6) AS v FROM pix JOIN q USING (run_id) WHERE b2 IS NOT NULL""")
def robust_norm_p98(spark, sf):
    return fo.robust_norm(pix(spark, sf).where("b2 is not null"), "b2", "v").select(*CELL, F.round("v", 6).alias("v"))


_IN = '("row" - 32) ** 2 + (col - 32) ** 2 <= 400'


def _count_sql(peaks: bool) -> str:
    top = 'max(b2) OVER (PARTITION BY run_id, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)' if peaks else "b2"
    top2 = 'max(line) OVER (PARTITION BY run_id, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)' if peaks else "line"
    q = 0.5 if peaks else 0.7
    return f"""WITH RECURSIVE {PIX}, l AS (SELECT *, {top} AS line FROM pix), m AS (SELECT *, {top2} AS top FROM l), f AS (SELECT * FROM m WHERE {_IN} AND b2 IS NOT NULL),
  hi AS (SELECT run_id, "row", col, run_id::BIGINT * 4096 + "row" * 64 + col AS id FROM f JOIN (SELECT run_id, quantile_cont(b2, {q}) AS t FROM f GROUP BY run_id) USING (run_id) WHERE b2 >= t AND b2 = top),
  edge AS (SELECT a.id AS u, b.id AS v FROM (SELECT *, unnest([64, -64, 1, -1]) AS step FROM hi) a JOIN hi b ON b.id = a.id + a.step AND a.run_id = b.run_id AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
  reach AS (SELECT id AS u, id AS v FROM hi UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v), root AS (SELECT u, min(v) AS root FROM reach GROUP BY u)
  SELECT run_id, count(DISTINCT root) AS groups FROM hi JOIN root ON root.u = hi.id GROUP BY run_id"""


def _circle():
    return (F.col("row") - 32) ** 2 + (F.col("col") - 32) ** 2 <= 400


@add("components_above", _count_sql(False))
def components_above(spark, sf):
    """4-connected groups above the 70th percentile inside the focus circle."""
    return fo.count_above(pix(spark, sf), "b2", _circle(), 0.7)


@add("local_peaks", _count_sql(True))
def local_peaks(spark, sf):
    """Peaks above the median inside the focus circle."""
    return fo.count_above(pix(spark, sf), "b2", _circle(), 0.5, peaks=True)


@add("mask_axes", f"""WITH RECURSIVE {COMP}, m AS (SELECT run_id, object_id, var_samp(col) AS a, var_samp("row") AS b, covar_samp(col, "row") AS c FROM obj GROUP BY run_id, object_id),
  e AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2, round((degrees(atan2(2 * (round(c, 9) + 0.0), round(a - b, 9) + 0.0)) / 2 + 180) % 180, 6) AS t FROM m)
  SELECT run_id, object_id, CASE WHEN l2 < 1e-6 THEN -1 ELSE round(sqrt(l1 / l2), 4) END AS elongation, CASE WHEN t <= 22.5 OR t >= 157.5 THEN 'E_W' WHEN t BETWEEN 67.5 AND 112.5 THEN 'N_S' WHEN round(a - b, 9) > 0 AND round(c, 9) > 0 THEN 'NW_SE' ELSE 'NE_SW' END AS orientation FROM e""")
def mask_axes(spark, sf):
    """Elongation (-1 for straight lines, whose width is rounding) and orientation of every object."""
    m = fo.mask_axes(_mask(spark, sf))
    return m.withColumn("elongation", F.when(F.col("elongation") > 1000, F.lit(-1.0)).otherwise(F.round("elongation", 4)))


_BANDS = {"gold": "b1", "mass": "b2", "doors": "b3", "tunnel": "b4", "pottery": "b1 + b2", "thermal": "b3 + b4"}


@add("target_priority", f"""WITH {PIX}, f AS (SELECT run_id, "row", col, {', '.join(f'{e} AS {n}' for n, e in _BANDS.items())} FROM pix WHERE b1 IS NOT NULL AND {_IN}),
  m AS (SELECT run_id, {', '.join(f'median({n}) AS m_{n}' for n in _BANDS)} FROM f GROUP BY run_id)
  SELECT run_id, "row", col, CASE WHEN gold >= m_gold AND mass >= m_mass THEN 'Priority A ? Metallic/High-density focus' WHEN doors >= m_doors AND tunnel >= m_tunnel THEN 'Priority B ? Structural/void-related focus'
    WHEN pottery >= m_pottery THEN 'Priority C ? Pottery/material concentration' WHEN thermal >= m_thermal THEN 'Priority D ? Thermal contrast focus' ELSE 'Priority E ? Comparative anomaly inside 17m' END AS priority FROM f JOIN m USING (run_id)""")
def target_priority(spark, sf):
    p = valued(spark, sf).where(_circle()).select(*CELL, *[F.expr(e).alias(n) for n, e in _BANDS.items()])
    return fo.target_priority(p).select(*CELL, "priority")


@add("focus_axes", f"""WITH {PIX}, f AS (SELECT * FROM pix WHERE b1 IS NOT NULL AND {_IN}), m AS (SELECT run_id, median(b1) AS m1, median(b2) AS m2, median(b3) AS m3, median(b4) AS m4 FROM f GROUP BY run_id),
  d AS (SELECT run_id, 1.4826 * median(abs(b1 - m1)) AS d1, 1.4826 * median(abs(b2 - m2)) AS d2, 1.4826 * median(abs(b3 - m3)) AS d3, 1.4826 * median(abs(b4 - m4)) AS d4 FROM f JOIN m USING (run_id) GROUP BY run_id),
  z AS (SELECT run_id, "row", col, (b1 - m1) / d1 AS z1, (b2 - m2) / d2 AS z2, (b3 - m3) / d3 AS z3, (b4 - m4) / d4 AS z4 FROM f JOIN m USING (run_id) JOIN d USING (run_id)),
  a AS (SELECT *, 1.3 * z1 + 1.1 * z2 + 0.9 * z3 + 0.4 * z4 AS metal, 1.2 * z4 + z1 + 0.7 * z2 + 0.3 * z3 AS void, 1.25 * z2 + z4 + 0.85 * z3 + 0.35 * z1 AS structure FROM z)
  SELECT run_id, "row", col, round(metal, 6) AS metal, round(void, 6) AS void, round(structure, 6) AS structure, round(metal + 0.9 * void + 0.95 * structure + 0.4 * z2, 6) AS composite FROM a""")
def focus_axes(spark, sf):
    """Axes of the focus pixels; four bands stand for nine."""
    z = g.robust_z(valued(spark, sf).where(_circle()), ["b1", "b2", "b3", "b4"])
    stands = {"gold": "b1", "silver": "b2", "mass": "b3", "chemical": "b4", "tunnel": "b4", "thermal": "b1", "doors": "b2", "zero": "b3", "pottery": "b2"}
    a = fo.focus_axes(z.select(*CELL, *[F.col(f"{b}_z").alias(n) for n, b in stands.items()]))
    return a.select(*CELL, *[rounded(c).alias(c) for c in ("metal", "void", "structure", "composite")])


def _score_sql(terms):
    return " + ".join(f"{w!r}::DOUBLE" if f == "one" else f"{w!r}::DOUBLE * {f}" for f, w in terms.items())


_FAMILY_SQL = ", ".join(f"[{', '.join(_score_sql(t) for t in family.values())}] AS {name}_v" for name, family in tg.FAMILIES.items())
_NAME_SQL = {name: "[" + ", ".join(f"'{c}'" for c in family) + "]" for name, family in tg.FAMILIES.items()}


def _share_sql(k):
    """SQL: each score's part of the sum of exponentials; scores whose parts are equal are a tie, which the first class wins."""
    powers = f"list_transform({k}_v, lambda x: exp(x - list_max({k}_v)))"
    return f"list_transform({powers}, lambda y: y / list_sum({powers}))"


@add("focus_targets", f"""WITH {PIX}, f AS (SELECT * FROM pix WHERE b1 IS NOT NULL AND {_IN}), m AS (SELECT run_id, median(b1) AS m1, median(b2) AS m2, median(b3) AS m3, median(b4) AS m4 FROM f GROUP BY run_id),
  d AS (SELECT run_id, 1.4826 * median(abs(b1 - m1)) AS d1, 1.4826 * median(abs(b2 - m2)) AS d2, 1.4826 * median(abs(b3 - m3)) AS d3, 1.4826 * median(abs(b4 - m4)) AS d4 FROM f JOIN m USING (run_id) GROUP BY run_id),
  z AS (SELECT run_id, "row", col, (b1 - m1) / d1 AS z1, (b2 - m2) / d2 AS z2, (b3 - m3) / d3 AS z3, (b4 - m4) / d4 AS z4 FROM f JOIN m USING (run_id) JOIN d USING (run_id)),
  n AS (SELECT run_id, "row", col, 1.3 * z1 + 1.1 * z2 + 0.9 * z3 + 0.4 * z4 AS metal, 1.2 * z4 + z1 + 0.7 * z2 + 0.3 * z3 AS void, 1.25 * z2 + z4 + 0.85 * z3 + 0.35 * z1 AS structure,
    z1 AS gold, z2 AS silver, z4 AS tunnel, z1 AS thermal, z2 AS doors, z3 AS mass, z2 AS pottery, z4 AS chemical FROM z),
  s AS (SELECT run_id, "row", col, {_FAMILY_SQL} FROM n),
  b AS (SELECT *, {", ".join(f"list_position({_share_sql(k)}, list_max({_share_sql(k)})) AS {k}_at, 100 / list_sum(list_transform({k}_v, lambda x: exp(x - list_max({k}_v)))) AS {k}_c" for k in tg.FAMILIES)}, list_sort(form_v) AS o FROM s)
  SELECT run_id, "row", col, {", ".join(f"{_NAME_SQL[k]}[{k}_at] AS {k}, round({k}_c, 1) AS {k}_confidence" for k in tg.FAMILIES)}, round(0.55 * form_c + 0.25 * content_c + 0.2 * period_c, 1) AS confidence,
    greatest(form_v[41], form_v[42], form_v[43]) > (o[32] + o[33]) / 2 AS trap FROM b""")
def focus_targets(spark, sf):
    """Likely form, content and period of every focus pixel with confidences and warning; four bands stand for nine."""
    z = g.robust_z(valued(spark, sf).where(_circle()), ["b1", "b2", "b3", "b4"])
    stands = {"gold": "b1", "silver": "b2", "mass": "b3", "chemical": "b4", "tunnel": "b4", "thermal": "b1", "doors": "b2", "zero": "b3", "pottery": "b2"}
    a = fo.focus_axes(z.select(*CELL, *[F.col(f"{b}_z").alias(n) for n, b in stands.items()]))
    return tg.likely_targets(a).select(*CELL, "form", "form_confidence", "content", "content_confidence", "period", "period_confidence", "confidence", "trap")


@add("decision_grades", f"""WITH {PIX}, p AS (SELECT run_id, "row", col, 1 / (1 + exp(-2 * (b1 / 25 - 0.9))) AS d, 1 / (1 + exp(-3 * (b3 * 12 - 0.6))) AS i FROM pix WHERE b1 IS NOT NULL)
  SELECT run_id, "row", col, round(d, 6) AS detection, round(i, 6) AS interpretation, CASE WHEN d >= 0.75 AND i >= 0.6 THEN 'A_HIGH_CONFIDENCE_REVIEW' WHEN d >= 0.6 AND i >= 0.45 THEN 'B_MEDIUM_CONFIDENCE_REVIEW' WHEN d >= 0.45 THEN 'C_LOW_CONFIDENCE_REVIEW' ELSE 'D_WEAK_OR_UNRESOLVED' END AS grade FROM p""")
def decision_grades(spark, sf):
    p = valued(spark, sf).withColumns({"d": fo.logistic(F.col("b1") / 25, 0.9, 2.0), "i": fo.logistic(F.col("b3") * 12, 0.6, 3.0)})
    return p.select(*CELL, F.round("d", 6).alias("detection"), F.round("i", 6).alias("interpretation"), fo.decision_grade(F.col("d"), F.col("i")).alias("grade"))


@add("bilinear_shift", f"""WITH {PIX} SELECT t.run_id, t."row", t.col, round(0.75 * (0.5 * a.b1 + 0.5 * b.b1) + 0.25 * (0.5 * c.b1 + 0.5 * d.b1), 6) AS v
  FROM pix t JOIN pix a ON a.run_id = t.run_id AND a."row" = t."row" + 1 AND a.col = t.col - 2 JOIN pix b ON b.run_id = t.run_id AND b."row" = t."row" + 1 AND b.col = t.col - 1
  JOIN pix c ON c.run_id = t.run_id AND c."row" = t."row" + 2 AND c.col = t.col - 2 JOIN pix d ON d.run_id = t.run_id AND d."row" = t."row" + 2 AND d.col = t.col - 1
  WHERE a.b1 + b.b1 + c.b1 + d.b1 IS NOT NULL""")
def bilinear_shift(spark, sf):
    """The first band moved by one and a half columns and minus one and a quarter rows."""
    d = fo.bilinear_shift(pix(spark, sf), "b1", 1.5, -1.25, "v")
    return d.where("v is not null").select(*CELL, F.round("v", 6).alias("v"))


@add("thermal_inertia", f"""WITH {PIX}, m AS (SELECT a.run_id, a."row", a.col, any_value(a.b1) AS b1, avg(b.b1) AS mean FROM pix a JOIN pix b ON a.run_id = b.run_id AND b."row" BETWEEN a."row" - 3 AND a."row" + 3 AND (a."row" - b."row") ** 2 + (a.col - b.col) ** 2 <= 9 WHERE a.b1 IS NOT NULL GROUP BY ALL)
  SELECT run_id, "row", col, round(b1 / (mean + 1e-6), 6) AS v FROM m""")
def thermal_inertia(spark, sf):
    """A band over the mean of its circle of three pixels."""
    d = fo.focal_mean(pix(spark, sf), "b1", 3, "mean").where("b1 is not null")
    return d.select(*CELL, F.round(F.col("b1") / (F.col("mean") + 1e-6), 6).alias("v"))


@add("recovered_layers", f"""WITH {PIX} SELECT run_id, "row", col, round(b4 / (b3 + 1e-6), 6) AS gold_halo, round(b2 / (b1 + 1e-6), 6) AS silver_oxide, round(b3 - b2, 6) AS tunnel_ceiling, round(b1 / (b4 + 1e-6), 6) AS chemical_protector FROM pix WHERE b1 IS NOT NULL""")
def recovered_layers(spark, sf):
    """Ratio and difference layers of the recovered formulas, on stand-in bands."""
    eps = 1e-6
    return valued(spark, sf).select(
        *CELL, F.round(ratio("b4", F.col("b3") + eps), 6).alias("gold_halo"), F.round(ratio("b2", F.col("b1") + eps), 6).alias("silver_oxide"),
        rounded(F.col("b3") - F.col("b2")).alias("tunnel_ceiling"), F.round(ratio("b1", F.col("b4") + eps), 6).alias("chemical_protector"))


@add("tile_requests", """WITH g AS (SELECT n_nationkey AS run_id, 500000 + n_nationkey * 1000.0 AS xmin, 4000000 - n_regionkey * 500.0 AS ymax FROM nation)
  SELECT run_id, tile_row::INT AS tile_row, tile_col::INT AS tile_col, (xmin + tile_col * 1600)::DOUBLE AS tile_xmin, (xmin + tile_col * 1600 + 1600)::DOUBLE AS tile_xmax, (ymax - tile_row * 1600)::DOUBLE AS tile_ymax, (ymax - tile_row * 1600 - 1600)::DOUBLE AS tile_ymin
  FROM g, (SELECT range AS tile_row FROM range(4)), (SELECT range AS tile_col FROM range(4))""")
def tile_requests(spark, sf):
    """Requests of 160 x 160 pixels of 10 m for a 640-pixel grid at every nation."""
    n = table(spark, sf, "nation")
    grids = n.select(F.col("n_nationkey").alias("run_id"), (500000 + F.col("n_nationkey") * 1000.0).alias("xmin"), (4000000 - F.col("n_regionkey") * 500.0).alias("ymax"), F.lit(10.0).alias("scale_x"), F.lit(-10.0).alias("scale_y"))
    return fo.tile_requests(grids, 640, 160).select("run_id", "tile_row", "tile_col", "tile_xmin", "tile_xmax", "tile_ymax", "tile_ymin")


@add("synthetic_elevation", """SELECT r_regionkey AS run_id, "row"::INT AS "row", col::INT AS col, (1000 + (30 + r_regionkey) * 3 + CASE WHEN r_regionkey % 2 = 0 THEN 25 ELSE -25 END + "row" * 0.5 + col * 0.25)::DOUBLE AS dem
  FROM region, (SELECT range AS "row" FROM range(64)), (SELECT range AS col FROM range(64))""")
def synthetic_elevation(spark, sf):
    """A 64-pixel grid at every region, put together from tiles of 32."""
    r = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("run_id"), (30 + F.col("r_regionkey")).alias("zone"), F.when(F.col("r_regionkey") % 2 == 0, "north").otherwise("south").alias("hemisphere"),
        F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymax"), F.lit(10.0).alias("scale_x"), F.lit(-10.0).alias("scale_y"))
    return fo.synthetic_elevation(fo.tile_requests(r, 64, 32), 32)


@add("anchor_status", """WITH a AS (SELECT s_nationkey AS package, s_suppkey AS anchor_id, floor(s_acctbal / 100) AS signal_value, floor(s_acctbal / 700) * (CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE s_suppkey % 5 END) AS best FROM supplier),
  d AS (SELECT *, best - lag(best) OVER (PARTITION BY package ORDER BY signal_value, anchor_id) AS d FROM a), g AS (SELECT package, count(*) AS anchors, count(DISTINCT signal_value) AS signals, min(d) AS least, max(d) AS most, min(abs(d)) AS small FROM d GROUP BY package)
  SELECT package, anchors, CASE WHEN anchors < 2 THEN 'too_few_anchors' WHEN signals < anchors THEN 'duplicate_signal' WHEN small <= 1e-12 THEN 'flat_depth' WHEN least < 0 AND most > 0 THEN 'not_monotonic' ELSE 'ok' END AS status FROM g""")
def anchor_status(spark, sf):
    """Suppliers of a nation as the anchors of a package."""
    best = F.floor(F.col("s_acctbal") / 700) * F.when(F.col("s_nationkey") % 3 == 0, 1).otherwise(F.col("s_suppkey") % 5)
    return fo.anchor_status(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("package"), F.col("s_suppkey").alias("anchor_id"), F.floor(F.col("s_acctbal") / 100).alias("signal_value"), best.alias("best")))
