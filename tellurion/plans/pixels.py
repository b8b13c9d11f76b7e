"""Queries over grids: projections, neighbourhoods and whole-grid statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions import columns as c
from tellurion.functions import group_stats as g
from tellurion.operators import proxies, radar, terrain
from tellurion.operators import windows2d as w2
from tellurion.sources.scratch import materialise
from tellurion.sources.views import PIX, pix, spread

QUERIES, ORACLES = {}, {}
CELL = ["run_id", "row", "col"]
AT = 'run_id, "row", col'


def add(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def out(df, **cols):
    """Key columns and rounded results."""
    return df.select(*CELL, *[c.rounded(v).alias(n) if not isinstance(v, tuple) else v[0].alias(n) for n, v in cols.items()])


def _r(**cols) -> str:
    return ", ".join(f"round({v}, 6) + 0.0::DOUBLE AS {n}" for n, v in cols.items())


def _nd(a, b):
    return f"(({a}) - ({b})) / nullif(({a}) + ({b}), 0)"


@add("nd_indices", f"WITH {PIX} SELECT {AT}, {_r(ndvi=_nd('b1', 'b3'), ndwi=_nd('b2', 'b1'), ndmi=_nd('b1', 'b4'), bsi=_nd('b4 + b3', 'b1 + b2'), ironox='b3 / nullif(b2, 0)')} FROM pix")
def nd_indices(spark, sf):
    return out(pix(spark, sf), ndvi=c.nd("b1", "b3"), ndwi=c.nd("b2", "b1"), ndmi=c.nd("b1", "b4"), bsi=c.nd(F.col("b4") + F.col("b3"), F.col("b1") + F.col("b2")), ironox=c.ratio("b3", "b2"))


@add("ratio_masks", f"""WITH {PIX} SELECT {AT}, {_r(r1='(b3 / nullif(b2, 0) - 0) / 2', r2='(b4 / nullif(b3, 0) - 0) / 5', n1='(' + _nd('b1', 'b3') + ' + 1) / 2')},
  (b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL)::INT AS raw_valid,
  (b3 / nullif(b2, 0) IS NOT NULL AND b4 / nullif(b3, 0) IS NOT NULL)::INT AS index_valid FROM pix""")
def ratio_masks(spark, sf):
    p = pix(spark, sf)
    r1, r2 = c.ratio("b3", "b2"), c.ratio("b4", "b3")
    return out(p, r1=c.unit_scale(r1, 0, 2), r2=c.unit_scale(r2, 0, 5), n1=c.unit_scale(c.nd("b1", "b3"), -1, 1),
               raw_valid=(c.all_valid("b1", "b2", "b3", "b4").cast("int"),), index_valid=(c.all_valid(r1, r2).cast("int"),))


@add("threshold_targets", f"""WITH {PIX} SELECT {AT}, {_r(pottery='b4 / nullif(b3, 0)', mass='b4 * b2 / 1000')},
  CASE WHEN b4 / nullif(b3, 0) IS NULL OR b3 / nullif(b1, 0) IS NULL OR {_nd('b1', 'b3')} IS NULL THEN NULL
       WHEN b4 / nullif(b3, 0) > 0.9 AND b3 / nullif(b1, 0) > 0.1 AND {_nd('b1', 'b3')} > 0.35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS zero_point,
  (b1 > 20 AND b3 > 4 AND b4 > 3 AND b2 > 0.2)::INT AS fused FROM pix""")
def threshold_targets(spark, sf):
    p = pix(spark, sf)
    a, b, v = c.ratio("b4", "b3"), c.ratio("b3", "b1"), c.nd("b1", "b3")
    fused = (F.col("b1") > 20) & (F.col("b3") > 4) & (F.col("b4") > 3) & (F.col("b2") > 0.2)
    return out(p, pottery=a, mass=F.col("b4") * F.col("b2") / 1000.0, zero_point=(c.flag((a > 0.9) & (b > 0.1) & (v > 0.35), c.all_valid(a, b, v)),), fused=(fused.cast("int"),))


@add("qa_bit_mask", """SELECT l_orderkey, l_linenumber, (l_partkey & 28) = 0 AS clear, round((l_partkey * 0.00341802::DOUBLE) + 149, 6) + 0.0::DOUBLE AS kelvin
  FROM lineitem WHERE (l_partkey & 28) = 0""")
def qa_bit_mask(spark, sf):
    """Rows whose quality bits 2, 3 and 4 are clear, with the scaled value."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    clear = c.bits_clear("l_partkey", 2, 3, 4)
    return t.where(clear).select("l_orderkey", "l_linenumber", clear.alias("clear"), c.rounded(F.col("l_partkey") * 0.00341802 + 149).alias("kelvin"))


@add("db_linear_roundtrip", f"""WITH {PIX} SELECT {AT}, {_r(lin='pow(10.0::DOUBLE, vv / 10)', back='10 * log10(greatest(pow(10.0::DOUBLE, vv / 10), 1e-12::DOUBLE))')},
  (vv > -35 AND vh > -42 AND inc > 29 AND inc < 46) AS inside FROM pix WHERE vv IS NOT NULL""")
def db_linear_roundtrip(spark, sf):
    p = pix(spark, sf).where("vv is not null")
    inside = (F.col("vv") > -35) & (F.col("vh") > -42) & (F.col("inc") > 29) & (F.col("inc") < 46)
    return out(p, lin=c.db_to_linear("vv"), back=c.linear_to_db(c.db_to_linear("vv")), inside=(inside,))


LIN = f"{PIX}, lin AS (SELECT {AT}, vv, vh, inc, dem, pow(10.0::DOUBLE, vv / 10) AS a, pow(10.0::DOUBLE, vh / 10) AS b FROM pix)"


@add("nano_stack", f"WITH {LIN} SELECT {AT}, {_r(depth_penetration='a / (b + 1e-6)', geometry='vv - vh', mass='sqrt(a * b)', rvi='b * 4 / (a + b + 1e-6)')} FROM lin")
def nano_stack(spark, sf):
    return out(radar.nano_stack(pix(spark, sf)), depth_penetration="depth_penetration", geometry="geometry", mass="mass", rvi="rvi")


@add("treasure_stack", f"WITH {LIN} SELECT {AT}, {_r(pulse='a * b / (a + b + 1e-6)', cavity='ln(a) - ln(b)', entry='b / (a * a + 1e-6)')} FROM lin")
def treasure_stack(spark, sf):
    return out(radar.treasure_stack(pix(spark, sf)), pulse="pulse", cavity="cavity", entry="entry")


def neighbours(source: str, r: int, x: str, keep: str = "TRUE") -> str:
    """SQL: every pixel with its neighbours' values, border replicated (v may be NULL)."""
    return f"""nb AS (SELECT o.run_id, o."row", o.col, q.x AS v, dy, dx
      FROM (SELECT run_id, "row", col, dy, dx, greatest(0, least(63, "row" + dy)) AS y, greatest(0, least(63, col + dx)) AS x
            FROM {source}, (SELECT range - {r} AS dy FROM range({2 * r + 1})), (SELECT range - {r} AS dx FROM range({2 * r + 1})) WHERE {keep}) o
      JOIN (SELECT run_id, "row" AS y, col AS x_, {x} AS x FROM {source}) q ON q.run_id = o.run_id AND q.y = o.y AND q.x_ = o.x)"""


@add("simulated_stack", f"""WITH {LIN}, med AS (SELECT run_id, median(a) AS m FROM lin GROUP BY run_id),
  fil AS (SELECT l.run_id, "row", col, coalesce(a, m, 0) AS f, vv FROM lin l JOIN med USING (run_id)), {neighbours('fil', 1, 'f')},
  lap AS (SELECT {AT}, sum(v) AS s FROM nb GROUP BY ALL)
  SELECT run_id, "row", col, {_r(voidscan='log10(abs(a - b) + 1e-6)', emi='b / greatest(a, 1e-6)', gravity='1 / greatest((a + b) / 2, 1e-6)', magnetic='CASE WHEN lin.vv IS NOT NULL THEN abs(s - 9 * f) END')}
  FROM lin JOIN lap USING (run_id, "row", col) JOIN fil USING (run_id, "row", col)""")
def simulated_stack(spark, sf):
    return out(radar.simulated_stack(pix(spark, sf)), voidscan="voidscan", emi="emi", gravity="gravity", magnetic="magnetic")


@add("median_stack", f"""WITH {LIN}, n1 AS (WITH {neighbours('lin', 1, 'vv')} SELECT {AT}, median(v) AS m1 FROM nb GROUP BY ALL),
  n2 AS (WITH {neighbours('lin', 1, 'vh')} SELECT {AT}, median(v) AS m2 FROM nb GROUP BY ALL),
  n3 AS (WITH {neighbours('lin', 1, 'a')} SELECT {AT}, median(v) AS m3, avg(v) AS m4 FROM nb GROUP BY ALL)
  SELECT run_id, "row", col, {_r(vv_med='m1', vh_med='m2', vv_lin_med_db='10 * log10(greatest(m3, 1e-10))', vv_lin_mean_db='10 * log10(greatest(m4, 1e-10))', cross='pow(10.0::DOUBLE, (vh - vv) / 10)')}
  FROM lin JOIN n1 USING (run_id, "row", col) JOIN n2 USING (run_id, "row", col) JOIN n3 USING (run_id, "row", col)""")
def median_stack(spark, sf):
    return out(radar.median_stack(pix(spark, sf)), vv_med="vv_med", vh_med="vh_med", vv_lin_med_db="vv_lin_med_db", vv_lin_mean_db="vv_lin_mean_db", cross="cross")


@add("sigma_masked_mean", f"""WITH {LIN}, sd AS (WITH {neighbours('lin', 1, 'a')} SELECT {AT}, stddev_pop(v) AS s FROM nb GROUP BY ALL),
  mk AS (SELECT run_id, "row", col, CASE WHEN s > 1e-15 THEN a END AS k FROM lin JOIN sd USING (run_id, "row", col)), {neighbours('mk', 1, 'k')}
  SELECT {AT}, {_r(vv_sgm_db='10 * log10(greatest(avg(v), 1e-10))')} FROM nb GROUP BY {AT}""")
def sigma_masked_mean(spark, sf):
    return out(radar.sigma_masked_mean(pix(spark, sf)), vv_sgm_db="vv_sgm_db")


@add("class_map_precedence", f"""WITH {LIN}, n1 AS (WITH {neighbours('lin', 1, 'vv')} SELECT {AT}, median(v) AS ref FROM nb GROUP BY ALL)
  SELECT run_id, "row", col, CASE WHEN vv IS NULL THEN NULL WHEN vv > 0 THEN 5 WHEN vv > -3.5 AND vh > -18 THEN 4 WHEN vv > -3.5 AND vh < -18 THEN 3 WHEN abs(vv - ref) > 4.5 THEN 2
         WHEN vv > -17 AND vv < -13 THEN 1 ELSE 0 END::DOUBLE AS "TGT_ClassMap", coalesce(abs(vv - ref) > 4.5, FALSE)::INT::DOUBLE AS "TGT_CompactMetal_Contrast", coalesce(vv > -3.5 AND vh > -18, FALSE)::INT::DOUBLE AS "TGT_BrightMetallic_Mix",
         coalesce(vv > -3.5 AND vh < -18, FALSE)::INT::DOUBLE AS "TGT_HighSpecular_LowCrossPol", coalesce(vv > 0, FALSE)::INT::DOUBLE AS "TGT_StrongDoubleBounce", coalesce(vv > -17 AND vv < -13, FALSE)::INT::DOUBLE AS "TGT_MidReflectance_Band"
  FROM lin JOIN n1 USING (run_id, "row", col)""")
def class_map_precedence(spark, sf):
    return radar.target_classes(pix(spark, sf)).select(*CELL, "TGT_ClassMap", "TGT_CompactMetal_Contrast", "TGT_BrightMetallic_Mix", "TGT_HighSpecular_LowCrossPol", "TGT_StrongDoubleBounce", "TGT_MidReflectance_Band")


_SCAN = {
    "UGS_BoxVertical": "vv > 0", "UGS_BoxHorizontal": "vv > -4 AND s < 2", "UGS_UnderCover": "vh < -22 AND vv > -5", "UGS_ExposedMetal": "vh > -15 AND vv > -3", "UGS_DepotProxy": "vv > -4 AND s < 2 AND vh < -22 AND vv > -5",
    "UGS_BoxMineProxy": "s > 5 AND vv > -5", "UGS_JarDenseProxy": "vv > -2.5", "UGS_PotteryBand": "vv > -18 AND vv < -12", "UGS_GearTentProxy": "vh > -18 AND vh < -14 AND vv > -6", "UGS_ChamberMid": "s > 4.2 AND vv > -8",
    "UGS_BaseDeep": "vv > -12 AND vv < -7"}


@add("ultimate_scan", f"""WITH {PIX}, g AS (SELECT {AT}, vv * 1.45::DOUBLE AS vv, vh * 1.45::DOUBLE AS vh FROM pix), {neighbours('g', 2, 'vv', 'dy * dy + dx * dx <= 4')},
  sd AS (SELECT {AT}, stddev_pop(v) AS s FROM nb GROUP BY ALL)
  SELECT run_id, "row", col, {_r(**{'"UGS_DeepStruct_RVI"': 'vh * 4 / nullif(vv + vh + 1e-6, 0)'})}, round(s, 6) + 0.0::DOUBLE AS std_vv, {', '.join(f'coalesce({m}, FALSE)::INT::DOUBLE AS "{n}"' for n, m in _SCAN.items())},
   floor((vv + 10) / 15 * 15) AS "UGS_EstBoxCount", floor((vv - vh - 10) / 20 * 10) AS "UGS_EstJarCount"
  FROM g JOIN sd USING (run_id, "row", col)""")
def ultimate_scan(spark, sf):
    d = radar.ultimate_scan(pix(spark, sf))
    return d.select(*CELL, c.rounded("UGS_DeepStruct_RVI").alias("UGS_DeepStruct_RVI"), c.rounded("std_vv").alias("std_vv"), *radar.SCAN, "UGS_EstBoxCount", "UGS_EstJarCount")


@add("master_rtc_refined", f"""WITH {LIN} SELECT {AT}, {_r(**{'"RAD_MasterVV_dB"': 'CASE WHEN vh IS NOT NULL THEN vv END', '"RAD_MasterVH_dB"': 'CASE WHEN vv IS NOT NULL THEN vh END', '"RAD_MasterAngle_deg"': 'inc', '"RAD_MasterVH_VV_Ratio_lin"': 'b / (a + 1e-6)'})} FROM lin""")
def master_rtc_refined(spark, sf):
    return out(radar.master_rtc_refined(pix(spark, sf)), **{n: n for n in ("RAD_MasterVV_dB", "RAD_MasterVH_dB", "RAD_MasterAngle_deg", "RAD_MasterVH_VV_Ratio_lin")})


_GRAD = """gx AS (SELECT run_id, "row", col, dem, vv, vh, inc,
    CASE WHEN col = 0 THEN (lead(dem) OVER x - dem) / 10 WHEN col = 63 THEN (dem - lag(dem) OVER x) / 10 ELSE (lead(dem) OVER x - lag(dem) OVER x) / 20 END AS p,
    CASE WHEN "row" = 0 THEN (lead(dem) OVER y - dem) / 10 WHEN "row" = 63 THEN (dem - lag(dem) OVER y) / 10 ELSE (lead(dem) OVER y - lag(dem) OVER y) / 20 END AS q
  FROM pix WINDOW x AS (PARTITION BY run_id, "row" ORDER BY col), y AS (PARTITION BY run_id, col ORDER BY "row")),
 gr AS (SELECT *, CASE WHEN dem IS NOT NULL THEN degrees(atan(sqrt(p * p + q * q))) END AS slope FROM gx)"""


@add("gradient_slope_aspect", f"WITH {PIX}, {_GRAD} SELECT {AT}, {_r(dzdx='p', dzdy='q', slope='slope', aspect='CASE WHEN dem IS NOT NULL THEN fmod(degrees(atan2(-p, q)) + 360, 360) END')} FROM gr")
def gradient_slope_aspect(spark, sf):
    return out(terrain.gradient(pix(spark, sf)), dzdx="dzdx", dzdy="dzdy", slope="slope", aspect="aspect")


@add("curvatures", f"""WITH {PIX}, {_GRAD}, s AS (SELECT *,
    CASE WHEN col = 0 THEN (lead(p) OVER x - p) / 10 WHEN col = 63 THEN (p - lag(p) OVER x) / 10 ELSE (lead(p) OVER x - lag(p) OVER x) / 20 END AS r,
    CASE WHEN "row" = 0 THEN (lead(p) OVER y - p) / 10 WHEN "row" = 63 THEN (p - lag(p) OVER y) / 10 ELSE (lead(p) OVER y - lag(p) OVER y) / 20 END AS s,
    CASE WHEN "row" = 0 THEN (lead(q) OVER y - q) / 10 WHEN "row" = 63 THEN (q - lag(q) OVER y) / 10 ELSE (lead(q) OVER y - lag(q) OVER y) / 20 END AS t
   FROM gr WINDOW x AS (PARTITION BY run_id, "row" ORDER BY col), y AS (PARTITION BY run_id, col ORDER BY "row"))
  SELECT {AT}, {_r(curv_laplacian='CASE WHEN dem IS NOT NULL THEN r + t END', curv_profile='CASE WHEN dem IS NOT NULL THEN -(r*p*p + s*p*q*2 + t*q*q) / ((p*p + q*q + 1) * sqrt(p*p + q*q + 1) + 1e-12) END',
     curv_plan='CASE WHEN dem IS NOT NULL THEN (r*q*q - s*p*q*2 + t*p*p) / ((p*p + q*q + 1e-12) * (sqrt(p*p + q*q + 1) + 1e-12)) END')} FROM s""")
def curvatures(spark, sf):
    return out(terrain.curvatures(pix(spark, sf)), curv_laplacian="curv_laplacian", curv_profile="curv_profile", curv_plan="curv_plan")


@add("hillshade", f"""WITH {PIX}, {_GRAD} SELECT {AT}, {_r(hillshade="least(1, greatest(0, sin(radians(45)) * cos(radians(slope)) + cos(radians(45)) * sin(radians(slope)) * cos(radians(45) - atan2(-p, q)))) + CASE WHEN slope IS NULL OR p IS NULL OR q IS NULL THEN NULL ELSE 0 END")} FROM gr""")
def hillshade(spark, sf):
    return out(terrain.hillshade(pix(spark, sf)), hillshade="hillshade")


@add("box_mean_std", f"WITH {PIX}, {neighbours('pix', 2, 'b2')} SELECT {AT}, {_r(box_mean='avg(v)', box_std='CASE WHEN count(v) > 0 THEN sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) END')} FROM nb GROUP BY {AT}")
def box_mean_std(spark, sf):
    d = w2.box_stats(pix(spark, sf), "b2", 2, "box")
    return d.select(*CELL, c.rounded("box_mean", 6).alias("box_mean"), F.round("box_std", 3).alias("box_std"))


ORACLES["box_mean_std"] = ORACLES["box_mean_std"].replace("END, 6) + 0.0::DOUBLE AS box_std", "END, 3) AS box_std")


@add("relief", f"""WITH {PIX}, {_GRAD}, {neighbours('gr', 3, 'dem')}, b AS (SELECT {AT}, avg(v) AS m, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS sd FROM nb GROUP BY {AT}),
  d AS (SELECT run_id, "row", col, dem, slope, m, sd, abs(dem - m) AS ad FROM gr JOIN b USING (run_id, "row", col)),
  t AS (WITH {neighbours('d', 3, 'ad')} SELECT {AT}, avg(v) AS tri FROM nb GROUP BY {AT})
  SELECT run_id, "row", col, {_r(tpi='dem - m', tri='CASE WHEN dem IS NOT NULL THEN tri END', twi='CASE WHEN dem IS NOT NULL AND slope IS NOT NULL THEN ln((greatest(m - dem, 0) + 1) / greatest(tan(radians(slope)), 1e-6)) END')}, round(CASE WHEN dem IS NOT NULL AND m IS NOT NULL THEN sd END, 3) AS roughness
  FROM d JOIN t USING (run_id, "row", col)""")
def relief(spark, sf):
    d = terrain.relief(pix(spark, sf), 3)
    return d.select(*CELL, c.rounded("tpi").alias("tpi"), c.rounded("tri").alias("tri"), F.when(F.col("slope").isNotNull(), c.rounded("twi")).alias("twi"), F.round("roughness", 3).alias("roughness"))


@add("entropy3", f"""WITH {LIN}, med AS (SELECT run_id, median(a) AS m FROM lin GROUP BY run_id), fil AS (SELECT l.run_id, "row", col, coalesce(a, m, 0) AS f, vv FROM lin l JOIN med USING (run_id)),
  {neighbours('fil', 1, 'f')}, e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w - min(v) OVER w AS span FROM nb WINDOW w AS (PARTITION BY {AT})),
  k AS (SELECT {AT}, span, (SELECT count(*) FROM range(1, 16) t(i) WHERE v >= lo + span * (i / 16.0::DOUBLE)) AS bin FROM e),
  n AS (SELECT {AT}, bin, any_value(span) AS span, count(*) / 9.0::DOUBLE AS p FROM k GROUP BY {AT}, bin)
  SELECT n.run_id, n."row", n.col, {_r(entropy='CASE WHEN any_value(vv) IS NULL THEN NULL WHEN any_value(span) > 1e-12 THEN -sum(p * log2(p)) ELSE 0 END')}
  FROM n JOIN fil USING (run_id, "row", col) GROUP BY n.run_id, n."row", n.col""")
def entropy3(spark, sf):
    d = radar.linear(pix(spark, sf))
    d = g.with_stats(d, {"_med": F.median("lvv")}).withColumn("_f", F.coalesce("lvv", "_med", F.lit(0.0)))
    d = w2.entropy3(d, "_f", "_e")
    return out(d, entropy=F.when(F.col("vv").isNotNull(), F.col("_e")))


@add("lee_filters", f"""WITH {LIN}, {neighbours('lin', 1, 'b')}, s AS (SELECT {AT}, avg(v) AS m, greatest(avg(v * v) - avg(v) * avg(v), 0) AS var FROM nb GROUP BY {AT}),
  f AS (SELECT run_id, "row", col, b, m, var, m + coalesce(least(greatest((var - 0.0001) / nullif(var, 0), 0), 1), 0) * (b - m) AS l FROM lin JOIN s USING (run_id, "row", col))
  SELECT run_id, "row", col, round(l, 5) AS lee, round(CASE WHEN b IS NULL THEN NULL WHEN abs(b - m) <= 0.9 * sqrt(var) THEN l ELSE b END, 5) AS sigma_lee FROM f""")
def lee_filters(spark, sf):
    p = radar.linear(pix(spark, sf))
    a = radar.lee(p, 1, 0.0001, None, "lvh").withColumnRenamed("filtered", "lee")
    b = radar.lee(a, 1, 0.0001, 0.9, "lvh").withColumnRenamed("filtered", "sigma_lee")
    return b.select(*CELL, F.round("lee", 5).alias("lee"), F.round("sigma_lee", 5).alias("sigma_lee"))


@add("rtc_correction", f"""WITH {PIX}, {_GRAD}, k AS (SELECT *, cos(radians(inc)) * greatest(cos(atan(sqrt(p * p + q * q))), 0.25) AS d FROM gr),
  r AS (SELECT *, 10 * log10(greatest(pow(10.0::DOUBLE, vv / 10) / greatest(cos(radians(inc)), 1e-6) / greatest(cos(atan(sqrt(p * p + q * q))), 0.25), 1e-12)) AS a,
               10 * log10(greatest(pow(10.0::DOUBLE, vh / 10) / greatest(cos(radians(inc)), 1e-6) / greatest(cos(atan(sqrt(p * p + q * q))), 0.25), 1e-12)) AS b,
               vv IS NOT NULL AND vh IS NOT NULL AND inc IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL AS ok FROM k)
  SELECT {AT}, {_r(vv_rtc='CASE WHEN ok THEN a END', vh_rtc='CASE WHEN ok THEN b END', log_ratio='CASE WHEN ok THEN a - b END', incidence='inc')} FROM r""")
def rtc_correction(spark, sf):
    return out(radar.terrain_corrected(pix(spark, sf)), vv_rtc="vv_rtc", vh_rtc="vh_rtc", log_ratio="log_ratio", incidence="inc")


@add("dilate_erode", f"""WITH {PIX}, mk AS (SELECT {AT}, coalesce(b1 > 45, FALSE)::INT AS m, coalesce(b1 > 10, FALSE)::INT AS big FROM pix),
  d AS (WITH {neighbours('mk', 2, 'm')} SELECT {AT}, max(v) AS dil FROM nb GROUP BY {AT}), d1 AS (WITH {neighbours('mk', 4, 'm')} SELECT {AT}, max(v) AS dil4 FROM nb GROUP BY {AT}),
  e AS (WITH {neighbours('mk', 1, 'big')} SELECT {AT}, min(v) AS er FROM nb GROUP BY {AT})
  SELECT mk.run_id, mk."row", mk.col, m AS core, dil, (dil4 = 1 AND dil = 0)::INT AS ring, (er = 1 AND mk."row" BETWEEN 1 AND 62 AND mk.col BETWEEN 1 AND 62)::INT AS eroded
  FROM mk JOIN d USING (run_id, "row", col) JOIN d1 USING (run_id, "row", col) JOIN e USING (run_id, "row", col)""")
def dilate_erode(spark, sf):
    """Square dilation by 2, the ring between 2 and 4, and one erosion with the outside counted as unset."""
    p = pix(spark, sf).withColumns({"core": F.coalesce(F.col("b1") > 45, F.lit(False)).cast("int"), "_big": F.coalesce(F.col("b1") > 10, F.lit(False)).cast("int")})
    p = w2.erode(w2.box_max(w2.box_max(p, "core", 2, "dil"), "core", 4, "_d4"), "_big", "eroded")
    return p.select(*CELL, "core", "dil", ((F.col("_d4") == 1) & (F.col("dil") == 0)).cast("int").alias("ring"), "eroded")


def _p(q, x):
    return f"quantile_cont({x}, {q}) OVER (PARTITION BY run_id)"


def norm_sql(x: str, src: str = "pix") -> str:
    """SQL of the 2..98 stretch of an expression over a source, as a scalar per pixel."""
    return (f"CASE WHEN ({x}) IS NOT NULL AND count({x}) OVER (PARTITION BY run_id) >= 10 AND abs({_p(0.98, x)} - {_p(0.02, x)}) >= 1e-6 "
            f"THEN least(1, greatest(0, (({x}) - {_p(0.02, x)}) / nullif({_p(0.98, x)} - {_p(0.02, x)}, 0))) ELSE 0 END")


@add("norm01", f"WITH {PIX} SELECT {AT}, {_r(n1=norm_sql('b1'), n2=norm_sql('b2'), n3=norm_sql('b3'))} FROM pix")
def norm01(spark, sf):
    return out(g.norm01(pix(spark, sf), {"n1": "b1", "n2": "b2", "n3": "b3"}), n1="n1", n2="n2", n3="n3")


@add("robust_z", f"""WITH {PIX}, m AS (SELECT run_id, median(b2) AS med, avg(b2) AS mean, stddev_pop(b2) AS sd FROM pix GROUP BY run_id),
  d AS (SELECT run_id, median(abs(b2 - med)) * 1.4826 AS mad FROM pix JOIN m USING (run_id) GROUP BY run_id)
  SELECT run_id, "row", col, {_r(b2_z='CASE WHEN b2 IS NULL THEN NULL WHEN mad > 1e-9 THEN (b2 - med) / mad WHEN sd > 1e-9 THEN (b2 - mean) / sd ELSE 0 END')} FROM pix JOIN m USING (run_id) JOIN d USING (run_id)""")
def robust_z(spark, sf):
    return out(g.robust_z(pix(spark, sf), ["b2"]), b2_z="b2_z")


def _hc(b):
    return f"least(8, greatest(-8, ({b} - CASE WHEN n_{b} >= 100 THEN m_{b} ELSE 0 END) / CASE WHEN n_{b} >= 100 THEN greatest(q_{b}, 1e-6) ELSE 1 END)) + CASE WHEN {b} IS NULL THEN NULL ELSE 0 END"


@add("hypercube_norm", f"""WITH {PIX}, s AS (SELECT run_id, {', '.join(f'median({b}) AS m_{b}, quantile_cont({b}, 0.75) - quantile_cont({b}, 0.25) AS q_{b}, count({b}) AS n_{b}' for b in ('b1', 'b2', 'b3'))} FROM pix GROUP BY run_id)
  SELECT run_id, "row", col, {_r(b1_n=_hc('b1'), b2_n=_hc('b2'), b3_n=_hc('b3'))}, (b1 IS NOT NULL OR b2 IS NOT NULL OR b3 IS NOT NULL)::INT AS mask_any, (b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL)::INT AS mask_all
  FROM pix JOIN s USING (run_id)""")
def hypercube_norm(spark, sf):
    h = g.hypercube(pix(spark, sf), ["b1", "b2", "b3"])
    return out(h, b1_n="b1_n", b2_n="b2_n", b3_n="b3_n", mask_any=(F.col("mask_any"),), mask_all=(F.col("mask_all"),))


@add("hypercube_stats", f"""WITH {PIX}, u AS (UNPIVOT (SELECT run_id, b1, b2, b3, b4 FROM pix) ON b1, b2, b3, b4 INTO NAME band VALUE v)
  SELECT run_id, band, count(v)::BIGINT AS valid, {_r(median='median(v)', iqr='quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', low='min(v)', high='max(v)', mean='avg(v)')} FROM u GROUP BY run_id, band""")
def hypercube_stats(spark, sf):
    """Per band: valid pixels, median, IQR, extremes, mean."""
    u = pix(spark, sf).select("run_id", "b1", "b2", "b3", "b4").unpivot(["run_id"], ["b1", "b2", "b3", "b4"], "band", "v")
    return u.where("v is not null").groupBy("run_id", "band").agg(
        F.count("v").alias("valid"), c.rounded(F.median("v")).alias("median"), c.rounded(g.quantile("v", 0.75) - g.quantile("v", 0.25)).alias("iqr"),
        c.rounded(F.min("v")).alias("low"), c.rounded(F.max("v")).alias("high"), c.rounded(F.avg("v")).alias("mean"))


@add("fill_clip", f"""WITH {PIX}, m AS (SELECT run_id, median(b1) AS med FROM pix GROUP BY run_id), f AS (SELECT run_id, "row", col, coalesce(b1, med) AS f FROM pix JOIN m USING (run_id)),
  l AS (SELECT run_id, quantile_cont(f, 0.01) AS lo, quantile_cont(f, 0.99) AS hi FROM f GROUP BY run_id)
  SELECT run_id, "row", col, {_r(b1_f='least(greatest(f, lo), hi)')} FROM f JOIN l USING (run_id)""")
def fill_clip(spark, sf):
    return out(g.fill_and_clip(pix(spark, sf), ["b1"]), b1_f="b1_f")


@add("asc_desc_consistency", f"""WITH {PIX}, n AS (SELECT {AT}, {norm_sql('b1')} AS a1, {norm_sql('b2')} AS a2, {norm_sql('b3')} AS d1, {norm_sql('b4')} AS d2 FROM pix),
  e AS (SELECT {AT}, abs({norm_sql('(a1 + a2) / 2')} - {norm_sql('(d1 + d2) / 2')}) AS gap FROM n)
  SELECT {AT}, {_r(consistency='1 - (' + norm_sql('gap') + ')')} FROM e""")
def asc_desc_consistency(spark, sf):
    """Two passes' mean energies, stretched; 1 minus the stretched absolute difference."""
    d = g.norm01(pix(spark, sf), {"a1": "b1", "a2": "b2", "d1": "b3", "d2": "b4"})
    d = g.norm01(d, {"ea": (F.col("a1") + F.col("a2")) / 2, "ed": (F.col("d1") + F.col("d2")) / 2})
    d = g.norm01(d, {"gap": F.abs(F.col("ea") - F.col("ed"))})
    return out(d, consistency=1.0 - F.col("gap"))


@add("thermal_delta", f"WITH {PIX} SELECT {AT}, {_r(delta=norm_sql('b2 - b4'))} FROM pix")
def thermal_delta(spark, sf):
    return out(g.norm01(pix(spark, sf), {"delta": F.col("b2") - F.col("b4")}), delta="delta")


def _median_sql(name: str, x: str, r: int, src: str = "n") -> str:
    """SQL: table ``name`` with |x - median of the (2r+1)^2 box|, missing pixels at the grid's median."""
    return f"""{name}_m AS (SELECT run_id, median({x}) AS med FROM {src} GROUP BY run_id), {name}_f AS (SELECT run_id, "row", col, {x} AS x, coalesce({x}, med, 0) AS f FROM {src} JOIN {name}_m USING (run_id)),
  {name} AS (WITH {neighbours(f'{name}_f', r, 'f')} SELECT run_id, "row", col, abs(any_value(x) - median(v)) AS d FROM nb JOIN {name}_f USING (run_id, "row", col) GROUP BY run_id, "row", col)"""


#: Stand-ins of the layers' inputs over the grid's bands.
_INPUTS = {"vv": "vv", "vh": "vh", "ratio": "vv - vh", "gold": "b1", "silver": "b2", "thermal_day": "b3", "thermal_inertia": "b4", "rough": "b2 - b3", "curv": "b1 - b4", "tpi": "b3 - b4", "vegroot": "b1 - b3", "clay_thermal": "b4", "thermal_delta": "b2 - b4"}
_NORMED = ("vv", "vh", "ratio", "silver", "thermal_inertia", "thermal_day", "rough", "curv", "tpi", "vegroot", "clay_thermal", "thermal_delta")
_LAYERS = {
    "quartz": "0.35 * gold_c + 0.25 * thermal_c + 0.2 * clay_thermal_n + 0.2 * rough_n", "lime": "0.3 * clay_thermal_n + 0.25 * rough_n + 0.2 * curv_n + 0.15 * tpi_n + 0.1 * thermal_c - 0.2 * vh_n",
    "moist": "0.35 * vegroot_n + 0.25 * (1 - thermal_day_n) + 0.2 * vh_n + 0.2 * ratio_c", "oxid": "0.5 * silver_n + 0.25 * clay_thermal_n + 0.25 * gold_c",
    "sar_energy": "0.45 * vv_n + 0.35 * vh_n + 0.2 * ratio_n", "thermal_risk": "0.5 * thermal_c + 0.3 * thermal_delta_n + 0.2 * thermal_inertia_n"}


@add("proxy_layers", f"""WITH {PIX}, i AS (SELECT {AT}, {', '.join(f'{e} AS {n}_i' for n, e in _INPUTS.items())} FROM pix),
  n AS (SELECT {AT}, gold_i, thermal_day_i, {', '.join(f'{norm_sql(f"{x}_i")} AS {x}_n' for x in _NORMED)} FROM i),
  {_median_sql('cg', 'gold_i', 5)}, {_median_sql('ct', 'thermal_day_i', 5)}, {_median_sql('cr', 'ratio_n', 5)}, {_median_sql('cv', 'vv_n', 3)}, {_median_sql('ch', 'vh_n', 3)},
  j AS (SELECT n.*, cg.d AS g, ct.d AS t, cr.d AS r, cv.d AS v, ch.d AS h FROM n JOIN cg USING (run_id, "row", col) JOIN ct USING (run_id, "row", col) JOIN cr USING (run_id, "row", col) JOIN cv USING (run_id, "row", col) JOIN ch USING (run_id, "row", col)),
  k AS (SELECT *, {norm_sql('g')} AS gold_c, {norm_sql('t')} AS thermal_c, {norm_sql('r')} AS ratio_c, {norm_sql('v')} AS vv_c, {norm_sql('h')} AS vh_c FROM j),
  l AS (SELECT {AT}, vv_c, vh_c, {', '.join(f'{norm_sql(e)} AS {n}' for n, e in _LAYERS.items())} FROM k),
  m AS (SELECT *, {norm_sql('0.55 * sar_energy + 0.25 * vv_c + 0.2 * vh_c')} AS sar_comp, {norm_sql('0.28 * quartz + 0.22 * lime + 0.2 * moist + 0.18 * oxid + 0.12 * thermal_risk')} AS risk FROM l)
  SELECT {AT}, {_r(quartz='quartz', lime='lime', moist='moist', oxid='oxid', sar_comp='sar_comp', risk='risk')} FROM m""")
def proxy_layers(spark, sf):
    """The six proxy layers with local contrasts over 11 (radar: 7) pixels."""
    # Every statistic reads the bands, grid by grid; they are made once.
    p = spread(materialise(pix(spark, sf).select(*CELL, "b1", "b2", "b3", "b4", "vv", "vh"), "bands"), "run_id")
    return out(proxies.proxy_layers(p.select(*CELL, *[F.expr(e).alias(n) for n, e in _INPUTS.items()])), **{n: n for n in ("quartz", "lime", "moist", "oxid", "sar_comp", "risk")})


def _cl(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1, greatest(0, {x})) END"


_POINT = {
    "gold": "b1 / 50", "silver": "b2", "mass": "b3 / 10", "sar_comp": "b4 / 8", "tunnel": "b3 / 9", "door": "b4 / 9", "tpi": "b1 / 60", "rough": "b2 / 2", "pottery": "b1 / 55", "lime": "b3 / 12", "curv": "b4 / 10", "risk": "b2 / 3",
    "quartz": "b1 / 70", "moist": "b3 / 11", "oxid": "b4 / 12", "ascdesc": "b2 / 4", "thermal": "b1 / 80", "delta": "CASE WHEN b4 < 6 THEN b4 / 10 END", "nano_depth_penetration": "b2 * 2"}
_SCORES = {
    "jar_جرة": "ceramic * least(1, greatest(0, 0.7 + 0.3 * void)) * (1 - 0.35 * false_sig)", "chest_صندوق": "metal * least(1, greatest(0, 0.6 + 0.4 * mass)) * (1 - 0.3 * false_sig)",
    "sarcophagus_تابوت": f"({_cl('0.35 * void + 0.3 * mass + 0.2 * door + 0.15 * rough')}) * (1 - 0.25 * false_sig)", "ran_ران": f"({_cl('0.35 * mass + 0.3 * door + 0.2 * tunnel + 0.15 * sar_comp')}) * (1 - 0.25 * false_sig)",
    "statue_تمثال": f"({_cl('0.35 * mass + 0.25 * gold + 0.2 * silver + 0.2 * ascdesc')}) * (1 - 0.3 * false_sig)", "void_فراغ": "void * (1 - 0.2 * moist)", "false_signature_وهم": "false_sig"}


@add("point_signature", f"""WITH {PIX}, n AS (SELECT {AT}, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _POINT.items())} FROM pix),
  s AS (SELECT *, {_cl('0.4 * gold + 0.25 * silver + 0.25 * mass + 0.1 * sar_comp')} AS metal, {_cl('0.45 * tunnel + 0.25 * door + 0.15 * tpi + 0.15 * rough')} AS void, {_cl('0.6 * pottery + 0.2 * lime + 0.2 * curv')} AS ceramic,
    {_cl('0.35 * risk + 0.2 * quartz + 0.2 * lime + 0.15 * moist + 0.1 * oxid')} AS false_sig FROM n),
  t AS (SELECT *, {', '.join(f'{e} AS "s{i}"' for i, e in enumerate(_SCORES.values()))}, metal + void + ceramic + false_sig + mass + door + rough + tunnel + sar_comp + gold + silver + ascdesc + moist IS NOT NULL AS whole FROM s),
  u AS (SELECT *, CASE WHEN whole THEN greatest({', '.join(f's{i}' for i in range(len(_SCORES)))}) END AS top FROM t)
  SELECT {AT}, round(metal, 4) AS nb_metal_signature, round(void, 4) AS nb_void_signature, round(ceramic, 4) AS nb_ceramic_signature, round({_cl('mass')}, 4) AS nb_mass_signature, round(false_sig, 4) AS nb_false_signature_score,
    CASE {' '.join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(_SCORES))} END AS nb_best_object_interpretation, round(top, 4) AS nb_best_object_score, round(nano_depth_penetration, 6) AS nano_depth_penetration,
    round(least(5.0, greatest(0.4, 0.6 + 1.2 * void + 0.9 * sar_comp + 0.7 * thermal + 0.5 * delta + 0.4 * rough)) + 0 * (void + sar_comp + thermal + delta + rough), 2) AS nb_depth_m,
    (void + sar_comp + thermal + delta + rough) IS NOT NULL AS nb_depth_available FROM u""")
def point_signature(spark, sf):
    """Signatures, compound targets, the best of them and depth at every pixel; each abstains where an input is missing."""
    return proxies.point_signature(pix(spark, sf).select(*CELL, *[F.expr(f"double({e})").alias(n) for n, e in _POINT.items()])).select(*CELL, *proxies.POINT_COLUMNS)
