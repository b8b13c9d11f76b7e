"""Queries from the anomaly band to findings, and the focus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions import group_stats as g

from tellurion.operators import objects as ob
from tellurion.operators import pca
from tellurion.sources.views import PIX, pix, valued

QUERIES, ORACLES = {}, {}
CELL = ["run_id", "row", "col"]
Q = 0.85


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@add("raw_threshold", f"""WITH {PIX}, m AS (SELECT run_id, median(b2) AS median FROM pix GROUP BY run_id),
  a AS (SELECT run_id, any_value(median) AS median, max(b2) AS top, median(abs(b2 - median)) AS mad, quantile_cont(b2, 0.99) AS p99 FROM pix JOIN m USING (run_id) WHERE b2 IS NOT NULL GROUP BY run_id)
  SELECT run_id, round(median, 6) AS median, round(mad, 6) AS mad, round(p99, 6) AS p99, round(CASE WHEN mad > 0 AND median + 6 * 1.4826 * mad >= top THEN p99 WHEN mad > 0 THEN greatest(p99, median + 6 * 1.4826 * mad)
    WHEN top > median THEN median + 0.5 * (top - median) ELSE top + 1e-6 END, 6) AS threshold FROM a""")
def raw_threshold(spark, sf):
    t = ob.robust_threshold(pix(spark, sf), "b2")
    return t.select("run_id", *[F.round(c, 6).alias(c) for c in ("median", "mad", "p99", "threshold")])


MASK = f'{PIX}, mask AS (SELECT run_id, "row", col, b2 / 131 AS b2, run_id::BIGINT * 4096 + "row" * 64 + col AS id FROM pix JOIN (SELECT run_id, quantile_cont(b2, {Q}) AS t FROM pix GROUP BY run_id) USING (run_id) WHERE b2 >= t)'


@add("candidate_mask", f'WITH {MASK} SELECT run_id, "row", col, round(b2, 6) AS b2 FROM mask')
def candidate_mask(spark, sf):
    return ob.candidate_pixels(anomaly(spark, sf), "b2", Q).select(*CELL, F.round("b2", 6).alias("b2"))


COMP = f"""{MASK}, edge AS (SELECT a.id AS u, b.id AS v FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM mask) a JOIN mask b ON a.run_id = b.run_id AND b."row" = a."row" + a.dy AND b.col BETWEEN a.col - 1 AND a.col + 1),
 reach AS (SELECT id AS u, id AS v FROM mask UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
 root AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u),
 kept AS (SELECT run_id, root, row_number() OVER (PARTITION BY run_id ORDER BY root) AS object_id FROM (SELECT run_id, root, count(*) AS n FROM mask JOIN root USING (id) GROUP BY ALL) WHERE n >= 4),
 obj AS (SELECT mask.*, object_id FROM mask JOIN root USING (id) JOIN kept USING (run_id, root)),
 os AS (SELECT run_id, object_id, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max, round(avg("row"), 3) AS row_center, round(avg(col), 3) AS col_center,
   count(*)::BIGINT AS area_px, round(avg(b2), 6) AS mean_anomaly, round(max(b2), 6) AS max_anomaly, round(stddev_pop(b2), 6) AS spread FROM obj GROUP BY run_id, object_id)"""
DB = f"""{COMP}, ce AS (SELECT a.run_id, a.object_id AS u, b.object_id AS v FROM os a JOIN os b ON a.run_id = b.run_id AND sqrt((a.row_center - b.row_center) ** 2 + (a.col_center - b.col_center) ** 2) <= 6),
 cr AS (SELECT run_id, object_id AS u, object_id AS v FROM os UNION SELECT r.run_id, r.u, e.v FROM cr r JOIN ce e ON e.run_id = r.run_id AND e.u = r.v),
 cl AS (SELECT os.*, dense_rank() OVER (PARTITION BY os.run_id ORDER BY root) - 1 AS cluster_id FROM os JOIN (SELECT run_id, u AS object_id, min(v) AS root FROM cr GROUP BY run_id, u) USING (run_id, object_id))"""
CLS = f"""{DB}, sc AS (SELECT *, least(1, greatest(0, round(mean_anomaly * 0.45 + max_anomaly * 0.4 + spread * 0.15, 6))) AS class_score,
   greatest(row_max - row_min + 1, col_max - col_min + 1) AS l, least(row_max - row_min + 1, col_max - col_min + 1) AS s FROM cl),
 cc AS (SELECT *, 'Class_' || CASE {' '.join(f"WHEN class_score >= {(9 - i) / 10} THEN '{'ABCDEFGHI'[i]}'" for i in range(9))} ELSE 'J' END AS class_id,
   CASE WHEN class_score >= 0.7 AND l / s >= 3 THEN 'ENTRANCE_SHAFT_TRACE' WHEN class_score >= 0.7 AND l <= 3 THEN 'COMPACT_CHAMBER_POINT' WHEN class_score >= 0.7 THEN 'CHAMBER_VOID_AREA'
     WHEN class_score >= 0.6 AND l / s >= 3 THEN 'POSSIBLE_ENTRANCE_SHAFT' WHEN class_score >= 0.6 THEN 'POSSIBLE_CHAMBER_STRUCTURE_AREA' WHEN class_score >= 0.5 THEN 'RING_CONTEXT_AREA'
     WHEN class_score >= 0.4 THEN 'WEAK_CONTEXT_AREA' ELSE 'BACKGROUND_AREA' END AS finding_label FROM sc)"""


def anomaly(spark, sf):
    """The grid with b2 scaled to an anomaly score."""
    return pix(spark, sf).withColumn("b2", F.col("b2") / 131)


def _objects(spark, sf):
    return ob.summarize(ob.connected(ob.candidate_pixels(anomaly(spark, sf), "b2", Q)), "b2")


@add("components", f'WITH RECURSIVE {COMP} SELECT run_id, "row", col, object_id::INT AS object_id FROM obj')
def components(spark, sf):
    return ob.connected(ob.candidate_pixels(anomaly(spark, sf), "b2", Q)).select(*CELL, "object_id")


@add("object_table", f"WITH RECURSIVE {COMP} SELECT * FROM os")
def object_table(spark, sf):
    return _objects(spark, sf)


@add("dbscan_clusters", f"WITH RECURSIVE {DB} SELECT run_id, object_id, cluster_id FROM cl")
def dbscan_clusters(spark, sf):
    return ob.clusters(_objects(spark, sf)).select("run_id", "object_id", "cluster_id")


@add("cluster_summary", f"WITH RECURSIVE {DB} SELECT run_id, cluster_id, count(*) AS object_count, sum(area_px)::BIGINT AS total_area_px, round(avg(area_px), 3) AS mean_object_area_px, max(max_anomaly) AS max_object_anomaly FROM cl GROUP BY run_id, cluster_id")
def cluster_summary(spark, sf):
    return ob.cluster_summary(ob.clusters(_objects(spark, sf)))


@add("classify_objects", f"WITH RECURSIVE {CLS} SELECT run_id, object_id, cluster_id, round(class_score, 6) AS class_score, class_id, finding_label FROM cc")
def classify_objects(spark, sf):
    return ob.classify(ob.clusters(_objects(spark, sf))).select("run_id", "object_id", "cluster_id", F.round("class_score", 6).alias("class_score"), "class_id", "finding_label")


@add("findings_summary", f"""WITH RECURSIVE {CLS}, f AS (SELECT run_id, finding_label, max(class_score) AS finding_score, count(*) AS support FROM cc GROUP BY run_id, finding_label),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finding_score DESC, support DESC, finding_label) AS rank, max(finding_score) OVER (PARTITION BY run_id) AS top FROM f)
  SELECT run_id, finding_label, round(finding_score, 6) AS finding_score, support, rank,
    CASE WHEN top < 0.4 THEN 'no_strong_result' WHEN top < 0.6 THEN 'unclear_result' WHEN sum((abs(finding_score - top) <= 1e-9)::INT) OVER (PARTITION BY run_id) > 1 THEN 'tied_top_result' ELSE 'result_available' END AS result_status FROM r""")
def findings_summary(spark, sf):
    return ob.findings(ob.classify(ob.clusters(_objects(spark, sf)))).withColumn("finding_score", F.round("finding_score", 6))


@add("zone_review_level", f"""WITH RECURSIVE {DB}, z AS (SELECT run_id, cluster_id, sum(mean_anomaly * area_px) / sum(area_px) AS wm, sum(area_px)::BIGINT AS area, max(max_anomaly) AS peak FROM cl GROUP BY run_id, cluster_id),
  p AS (SELECT *, area / sum(area) OVER (PARTITION BY run_id) AS share, percent_rank() OVER (PARTITION BY run_id ORDER BY peak DESC, area DESC, cluster_id) AS p FROM z)
  SELECT run_id, cluster_id, area, peak, round(wm / peak, 6) AS weighted_mean, round(share, 6) AS area_share, CASE WHEN p <= 1/3 THEN 'higher' WHEN p <= 2/3 THEN 'medium' ELSE 'lower' END AS level FROM p""")
def zone_review_level(spark, sf):
    z = ob.zones(ob.clusters(_objects(spark, sf)))
    return z.select("run_id", "cluster_id", "area", "peak", F.round(F.col("weighted_mean") / F.col("peak"), 6).alias("weighted_mean"), F.round("area_share", 6).alias("area_share"), "level")


@add("pca_scores")
def pca_scores(spark, sf):
    d = ob.pca_scores(pix(spark, sf), ["b1", "b2", "b3", "b4"])
    return d.select(*CELL, F.round("score", 6).alias("score"), F.round("display", 6).alias("display"))


def _pca(spark, sf):
    px = pix(spark, sf).withColumns({"flat": F.lit(1.5), "ok": (F.coalesce("b1", F.lit(0.0)) > 5).cast("int")})
    return pca.pca_anomaly(px, ["b1", "b2", "b3", "b4", "flat"], "ok")


@add("pca_anomaly")
def pca_anomaly(spark, sf):
    """Anomaly of the pixels that a support band and all chosen channels cover, filled and clipped."""
    return _pca(spark, sf)[0].select(*CELL, F.round("raw_score", 6).alias("raw_score"), F.round("anomaly", 6).alias("anomaly"))


@add("pca_report")
def pca_report(spark, sf):
    """Status, channels, valid pixels and variances of every run."""
    r = _pca(spark, sf)[1]
    return r.withColumns({"variance": F.transform("variance", lambda v: F.round(v, 6)), "share": F.transform("share", lambda v: F.round(v, 6)), "valid_fraction": F.round("valid_fraction", 6)})


_D = "sqrt((\"row\" - 32) ** 2 + (col - 32) ** 2)"


def _distance():
    return F.sqrt((F.col("row") - 32) ** 2 + (F.col("col") - 32) ** 2)


@add("focus_mask_stats", f"""WITH {PIX}, u AS (UNPIVOT (SELECT run_id, b1, b2, b3, b4 FROM pix WHERE {_D} <= 8) ON b1, b2, b3, b4 INTO NAME band VALUE v)
  SELECT run_id, band, count(*) AS pixels, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM u GROUP BY run_id, band""")
def focus_mask_stats(spark, sf):
    p = pix(spark, sf).where(_distance() <= 8).select("run_id", "b1", "b2", "b3", "b4").unpivot(["run_id"], ["b1", "b2", "b3", "b4"], "band", "v").where("v is not null")
    return p.groupBy("run_id", "band").agg(F.count("v").alias("pixels"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


@add("focus_top5", f"""WITH {PIX}, f AS (SELECT * FROM pix WHERE {_D} <= 8 AND b1 IS NOT NULL), m AS (SELECT run_id, median(b1) AS m1, median(b2) AS m2 FROM f GROUP BY run_id),
  d AS (SELECT run_id, median(abs(b1 - m1)) * 1.4826 AS d1, median(abs(b2 - m2)) * 1.4826 AS d2 FROM f JOIN m USING (run_id) GROUP BY run_id),
  s AS (SELECT f.*, (b1 - m1) / d1 + (b2 - m2) / d2 AS score FROM f JOIN m USING (run_id) JOIN d USING (run_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, "row", col) AS rank, cume_dist() OVER (PARTITION BY run_id ORDER BY score) AS confidence FROM s)
  SELECT run_id, "row", col, rank, round(score, 6) AS score, round(confidence, 6) AS confidence FROM r WHERE rank <= 5""")
def focus_top5(spark, sf):
    """Robust scores inside the focus circle; the five highest of each run with their empirical-distribution confidence."""
    d = g.robust_z(valued(spark, sf).where(_distance() <= 8), ["b1", "b2"]).withColumn("score", F.col("b1_z") + F.col("b2_z"))
    w = Window.partitionBy("run_id")
    d = d.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "row", "col")), "confidence": F.cume_dist().over(w.orderBy("score"))})
    return d.where("rank <= 5").select(*CELL, "rank", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


RING = f"""{PIX}, ring AS (SELECT run_id, CASE WHEN d <= 6 THEN 'core' WHEN d <= 12 THEN 'near' WHEN d <= 20 THEN 'far' ELSE 'scene' END AS ring, b1, b2, b3, b4 FROM (SELECT *, {_D} AS d FROM pix)),
  u AS (UNPIVOT ring ON b1, b2, b3, b4 INTO NAME band VALUE v), m AS (SELECT run_id, ring, band, median(v) AS med FROM u GROUP BY ALL),
  s AS (SELECT run_id, ring, band, count(v)::BIGINT AS n, avg(v) AS mean, any_value(med) AS median, stddev_pop(v) AS std, median(abs(v - med)) AS mad, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, max(v) AS top
        FROM u JOIN m USING (run_id, ring, band) GROUP BY run_id, ring, band)"""


def ring_table(spark, sf):
    d = _distance()
    ring = F.when(d <= 6, "core").when(d <= 12, "near").when(d <= 20, "far").otherwise("scene")
    u = pix(spark, sf).select("run_id", ring.alias("ring"), "b1", "b2", "b3", "b4").unpivot(["run_id", "ring"], ["b1", "b2", "b3", "b4"], "band", "v").where("v is not null")
    u = g.with_stats(u, {"_m": F.median("v")}, ["run_id", "ring", "band"])
    return u.groupBy("run_id", "ring", "band").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.first("_m").alias("median"), F.stddev_pop("v").alias("std"), F.median(F.abs(F.col("v") - F.col("_m"))).alias("mad"),
        g.quantile("v", 0.1).alias("p10"), g.quantile("v", 0.9).alias("p90"), F.max("v").alias("top"))


_SEVEN = ("mean", "median", "std", "mad", "p10", "p90", "top")


@add("ring_stats", f"WITH {RING} SELECT run_id, ring, band, n, {', '.join(f'round({c}, 6) AS {c}' for c in _SEVEN)} FROM s")
def ring_stats(spark, sf):
    return ring_table(spark, sf).select("run_id", "ring", "band", "n", *[F.round(c, 6).alias(c) for c in _SEVEN])


@add("core_ring_contrast", f"""WITH {RING} SELECT c.run_id, c.band, r.ring, round(CASE WHEN r.mad > 1e-9 THEN (c.mean - r.median) / (1.4826 * r.mad) WHEN r.std > 1e-9 THEN (c.mean - r.mean) / r.std ELSE 0 END, 6) AS contrast,
  round(CASE WHEN c.std * c.std + r.std * r.std > 1e-18 THEN (c.mean - r.mean) / sqrt((c.std * c.std + r.std * r.std) / 2) ELSE 0 END, 6) AS effect
  FROM s c JOIN s r ON c.run_id = r.run_id AND c.band = r.band AND c.ring = 'core' AND r.ring <> 'core'""")
def core_ring_contrast(spark, sf):
    """Robust contrast and effect size of the core against each other ring."""
    s = ring_table(spark, sf)
    core = s.where("ring = 'core'").select("run_id", "band", F.col("mean").alias("m"), F.col("std").alias("sd"))
    j = s.where("ring != 'core'").join(core, ["run_id", "band"])
    contrast = F.when(F.col("mad") > 1e-9, (F.col("m") - F.col("median")) / (1.4826 * F.col("mad"))).when(F.col("std") > 1e-9, (F.col("m") - F.col("mean")) / F.col("std")).otherwise(0.0)
    pooled = F.col("sd") ** 2 + F.col("std") ** 2
    effect = F.when(pooled > 1e-18, (F.col("m") - F.col("mean")) / F.sqrt(pooled / 2)).otherwise(0.0)
    return j.select("run_id", "band", "ring", F.round(contrast, 6).alias("contrast"), F.round(effect, 6).alias("effect"))


@add("softmax_argmax", f"""WITH {RING}, p AS (SELECT run_id, band, exp(mean / 10) AS e FROM s WHERE ring = 'core'), q AS (SELECT *, e / sum(e) OVER (PARTITION BY run_id) AS p, row_number() OVER (PARTITION BY run_id ORDER BY e DESC, band) AS k FROM p)
  SELECT run_id, band, round(p, 6) AS probability, k = 1 AS chosen FROM q""")
def softmax_argmax(spark, sf):
    """Core means as logits: softmax over bands and the largest."""
    p = ring_table(spark, sf).where("ring = 'core'").select("run_id", "band", F.exp(F.col("mean") / 10).alias("e"))
    w = Window.partitionBy("run_id")
    k = F.row_number().over(w.orderBy(F.desc("e"), "band"))
    return p.select("run_id", "band", F.round(F.col("e") / F.sum("e").over(w), 6).alias("probability"), (k == 1).alias("chosen"))


@add("mask_shape", f"""WITH RECURSIVE {COMP}, m AS (SELECT run_id, object_id, var_pop("row") AS a, var_pop(col) AS b, covar_pop("row", col) AS c FROM obj GROUP BY ALL),
  e AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2 FROM m)
  SELECT run_id, object_id, round(l1, 6) AS l1, round(sqrt(greatest(l1, 1e-6) / greatest(l2, 0.05)), 4) AS elongation FROM e""")
def mask_shape(spark, sf):
    """Major variance and elongation of each object from the 2 x 2 covariance of its pixels."""
    m = ob.connected(ob.candidate_pixels(anomaly(spark, sf), "b2", Q)).groupBy("run_id", "object_id").agg(F.var_pop("row").alias("a"), F.var_pop("col").alias("b"), F.covar_pop("row", "col").alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    return m.select("run_id", "object_id", F.round(half + root, 6).alias("l1"), F.round(F.sqrt(F.greatest(half + root, F.lit(1e-6)) / F.greatest(half - root, F.lit(0.05))), 4).alias("elongation"))
