"""Operators against small NumPy versions and hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import columns as c
from tellurion.functions import group_stats as g
from tellurion.operators import acquisitions as aq
from tellurion.operators import evidence as ev
from tellurion.operators import focus as fo
from tellurion.operators import objects as ob
from tellurion.operators import proxies, radar, terrain
from tellurion.operators import windows2d as w2
from tellurion.operators.graph import components
from tellurion.sources.views import SIZE


def grid(spark, a, name="x", run=0):
    rows = [(run, i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, f"run_id int, row int, col int, {name} double")


def back(df, name):
    out = np.full((SIZE, SIZE), np.nan)
    for r in df.select("row", "col", name).collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def holes():
    a = np.random.default_rng(5).normal(100, 10, (SIZE, SIZE))
    a[np.random.default_rng(6).random((SIZE, SIZE)) < 0.05] = np.nan
    return a


def windows(a, r):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (2 * r + 1, 2 * r + 1))


def test_box_statistics(spark, holes):
    d = w2.box_stats(grid(spark, holes), "x", 3, "b")
    win = windows(holes, 3)
    np.testing.assert_allclose(back(d, "b_mean"), np.nanmean(win, axis=(2, 3)), atol=1e-9)
    np.testing.assert_allclose(back(d, "b_std"), np.nanstd(win, axis=(2, 3)), atol=1e-6)


def test_median_and_disc(spark, holes):
    d = w2.gather3(grid(spark, holes), "x", "a").withColumn("m", w2.array_median(F.col("a")))
    np.testing.assert_allclose(back(d, "m"), np.nanmedian(windows(holes, 1), axis=(2, 3)), atol=1e-12)
    d = w2.gather5(grid(spark, holes), "x", "a").withColumn("c", F.get("a", F.lit(12)))
    np.testing.assert_allclose(back(d, "c"), holes)


def test_entropy(spark):
    a = np.random.default_rng(1).random((SIZE, SIZE))
    got = back(w2.entropy3(grid(spark, a), "x", "e"), "e")
    win = windows(a, 1).reshape(SIZE, SIZE, 9)
    for i, j in ((0, 0), (5, 9), (63, 63), (30, 0)):
        v = win[i, j]
        lo, span = v.min(), v.max() - v.min()
        k = np.array([sum(x >= lo + span * (b / 16) for b in range(1, 16)) for x in v])
        p = np.bincount(k)[np.bincount(k) > 0] / 9
        assert got[i, j] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)


def test_gradient_is_central_inside_and_one_sided_at_borders(spark):
    y, x = np.mgrid[0:SIZE, 0:SIZE]
    z = 3.0 * x + 0.02 * y * y
    d = terrain.gradient(grid(spark, z, "dem"), 10.0)
    dy, dx = np.gradient(z, 10.0, 10.0)
    np.testing.assert_allclose(back(d, "dzdx"), dx, atol=1e-9)
    np.testing.assert_allclose(back(d, "dzdy"), dy, atol=1e-9)
    np.testing.assert_allclose(back(d, "slope"), np.degrees(np.arctan(np.hypot(dx, dy))), atol=1e-9)


def test_plane_slope_and_aspect(spark):
    _, x = np.mgrid[0:SIZE, 0:SIZE]
    d = terrain.curvatures(grid(spark, 10.0 * x, "dem"), 10.0).where("row = 5 and col = 5").first()
    assert d.slope == pytest.approx(45) and d.aspect == pytest.approx(270) and d.curv_laplacian == pytest.approx(0)


def test_norms(spark, holes):
    d = g.norm01(grid(spark, holes), {"n": "x"})
    lo, hi = np.nanpercentile(holes, [2, 98])
    np.testing.assert_allclose(back(d, "n"), np.nan_to_num(np.clip((holes - lo) / (hi - lo), 0, 1)), atol=1e-9)
    few = grid(spark, np.where(np.arange(SIZE * SIZE).reshape(SIZE, SIZE) < 5, 1.0, np.nan))
    assert back(g.norm01(few, {"n": "x"}), "n").max() == 0
    cube = g.hypercube(few, ["x"])
    assert cube.where("mask_any = 1").count() == 5 and cube.where("x_n = 1").count() == 5


def test_objects_of_two_blobs(spark):
    a = np.zeros((SIZE, SIZE))
    a[1:4, 1:4] = 0.95
    a[7:10, 7:11] = 0.99
    a[40, 40] = 0.97
    px = ob.connected(grid(spark, a, "s").where("s > 0.9"))
    o = {r.object_id: r for r in ob.classify(ob.clusters(ob.summarize(px, "s"))).collect()}
    assert {k: (r.row_min, r.row_max, r.col_min, r.col_max, r.area_px) for k, r in o.items()} == {1: (1, 3, 1, 3, 9), 2: (7, 9, 7, 10, 12)}
    assert [o[k].cluster_id for k in (1, 2)] == [0, 1]
    assert o[1].finding_label == "COMPACT_CHAMBER_POINT"


def test_raw_threshold_rules(spark):
    flat = spark.createDataFrame([(0, 2.0)] * 20, "run_id int, x double")
    assert ob.robust_threshold(flat, "x").first().threshold == pytest.approx(2.0 + 1e-6)
    spike = spark.createDataFrame([(0, 2.0)] * 20 + [(0, 10.0)], "run_id int, x double")
    assert ob.robust_threshold(spike, "x").first().threshold == pytest.approx(6.0)


def test_components_of_a_long_chain(spark):
    got = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(0, i, 0, *map(float, r)) for i, r in enumerate(x)], "run_id int, row int, col int, a double, b double, c double")
    got = np.array([r.score for r in ob.pca_scores(df, ["a", "b", "c"]).orderBy("row").collect()])
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(got, np.sqrt((u**2).sum(axis=1) * (len(x) - 1)), rtol=1e-8)


def test_pairs(spark):
    h = aq.HOUR
    acq = spark.createDataFrame([(1, 7, 0, "A"), (2, 7, 100 * h, "A"), (3, 7, 30 * h, "D"), (4, 7, 120 * h, "D"), (5, 7, 137 * h, "D")], "event_id long, track long, ms long, pass string")
    p = aq.pair_candidates(acq, 36)
    assert {(r.asc_id, r.desc_id) for r in p.collect()} == {(1, 3), (2, 4)}
    assert {(r.asc_id, r.desc_id) for r in aq.select_pairs(p).collect()} == {(1, 3), (2, 4)}


def test_surface_change_flags_a_block(spark):
    b = spark.range(4096).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.lit(0.0).alias("lr"), F.lit(38.0).alias("inc"))
    a = b.withColumn("lr", F.when((F.col("row") < 10) & (F.col("col") < 10), 2.0).otherwise(0.0))
    d = aq.surface_change(b, a)
    assert d.where("flagged").count() == 100 and d.agg(F.min("threshold")).first()[0] == 1.0
    assert aq.surface_change(b, a.withColumn("inc", F.lit(45.0))).count() == 0


def test_cliffs_and_holm_and_permutation(spark):
    rows = [("f", "pre", x) for x in (1.0, 2.0, 2.0, 5.0)] + [("f", "post", x) for x in (2.0, 6.0, 7.0)]
    d = aq.cliffs_delta(spark.createDataFrame(rows, "k string, side string, x double"), "x", "side", "k", 3.0).first()
    pre, post = [1, 2, 2, 5], [2, 6, 7]
    assert d.delta == pytest.approx(sum(np.sign(b - a) for a in pre for b in post) / 12)
    h = aq.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", "k")
    assert {r.k: round(r.adjusted, 6) for r in h.collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    m = spark.createDataFrame([("k", s, i, float(i + 10 * (s == "post"))) for s in ("pre", "post") for i in range(6)], "key string, side string, month int, x double")
    one = aq.permutation_p(m, "x", "side", "month", "key", 199, 1).first()
    assert one.observed == 10.0 and one.p_value < 0.1


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 2 + x @ [1.5, -0.5]
    df = spark.createDataFrame([("g", float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "k string, a double, b double, y double")
    assert max(abs(r.residual) for r in aq.residualize(df, "y", ["a", "b"], "k").collect()) < 1e-9


def test_depth_lookup(spark):
    a = spark.createDataFrame([("shallow", 1.0, 0.4, 0.5, 0.6), ("deep", 3.0, 1.4, 1.5, 1.6)], "anchor_id string, signal_value double, lo double, best double, hi double")
    q = spark.createDataFrame([(1, 2.0), (2, 9.0), (3, 1.0), (4, 3.0)], "candidate_id int, signal double")
    r = {x.candidate_id: x for x in ev.interpolate_depth(q, a).collect()}
    assert (r[1].minimum, r[1].best, r[1].maximum) == pytest.approx((0.9, 1.0, 1.1)) and r[1].zone == "interval:shallow:deep"
    assert r[2].status == "insufficient_data" and r[2].best is None
    assert r[3].zone == "anchor:shallow" and r[4].zone == "anchor:deep"


def test_utm_known_points(spark):
    p = spark.createDataFrame([(3.0, 0.0), (3.0, 45.0), (-105.0, 40.0), (151.2, -33.87)], "lon double, lat double")
    u = ev.utm(F.col("lon"), F.col("lat"))
    r = p.select(*[v.alias(k) for k, v in u.items()]).collect()
    assert (r[0].zone, r[0].epsg) == (31, 32631) and r[0].easting == pytest.approx(500000) and r[0].northing == pytest.approx(0, abs=1e-6)
    assert r[1].northing == pytest.approx(4982950.4, abs=0.5)
    assert r[2].zone == 13 and r[2].easting == pytest.approx(500000, abs=1e-3)
    assert r[3].epsg == 32756 and r[3].northing < 10000000


def test_plane_and_shift(spark):
    y, x = np.mgrid[0:SIZE, 0:SIZE]
    z = 2.0 * x - 1.0 * y + 5
    z[3, 3] = 900.0
    z = z + np.random.default_rng(1).normal(0, 0.1, z.shape)
    r = ev.robust_plane(grid(spark, z, "z"), "z").first()
    m, v, keep = np.column_stack([np.ones(SIZE * SIZE), x.ravel() / (SIZE - 1), y.ravel() / (SIZE - 1)]), z.ravel(), np.ones(SIZE * SIZE, bool)
    for _ in range(4):
        coef = np.linalg.lstsq(m[keep], v[keep], rcond=None)[0]
        error = v - m @ coef
        error -= np.median(error[keep])
        keep = keep & (np.abs(error) <= 3.5 * 1.4826 * np.median(np.abs(error[keep])))
    assert (r.offset, r.x_edge_delta, r.y_edge_delta) == pytest.approx(tuple(coef), abs=1e-6)
    assert (r.fit_points, r.status) == (keep.sum(), "ok")
    few = ev.robust_plane(grid(spark, z, "z").where("row < 4"), "z").first()
    assert few.offset is None and few.status == "too_few_points"
    a = np.random.default_rng(7).normal(size=(SIZE, SIZE))
    best = ev.best_shift(grid(spark, a, "z"), grid(spark, np.roll(a, (1, -2), axis=(0, 1)), "z"), "z", 2).first()
    assert (best.dy, best.dx) == (1, -2)


def test_radar_guards(spark):
    d = spark.createDataFrame([(0, 0, 0, -10.0, None), (0, 0, 1, -10.0, -15.0)], "run_id int, row int, col int, vv double, vh double")
    r = {x.col: x for x in radar.nano_stack(d).collect()}
    assert r[0].mass is None and r[1].geometry == pytest.approx(5.0)
    assert r[1].mass == pytest.approx(math.sqrt(10**-1.0 * 10**-1.5))
    one = spark.range(1).select(c.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), c.clamp01(F.lit(2.0)).alias("b"), c.first_greatest({"x": F.lit(1.0), "y": F.lit(1.0)}).alias("d")).first()
    assert (one.a, one.b, one.d) == (None, 1.0, "x")


def test_reduced_candidates_give_the_same_pairs(spark):
    rng, rows = np.random.default_rng(3), []
    for track in range(60):
        n, m = int(rng.integers(1, 30)), int(rng.integers(1, 9))
        for a, d in {(int(a), int(d)) for a, d in zip(rng.integers(0, n, 90), rng.integers(0, m, 90))}:
            rows.append((track, a, d, a // 2, 3 * d, abs(a // 2 - 3 * d)))
    rows += [(99, a, d, a, d, abs(a - d)) for a in range(1500) for d in range(2)]  # a dead end for four pairs

    def first_pairs(own):  # the same rule over all candidates, without recursion over items that are left out
        own = sorted(own, key=lambda r: (r[3], r[1], r[5], r[2]))

        def search(i, items, used, want):
            if not want:
                return []
            for k in range(i, len(own)):
                if own[k][1] not in items and own[k][2] not in used:
                    rest = search(k + 1, items | {own[k][1]}, used | {own[k][2]}, want - 1)
                    if rest is not None:
                        return [own[k], *rest]
            return None

        return next(s for s in (search(0, set(), set(), w) for w in range(min(4, len({r[2] for r in own}), len({r[1] for r in own})), 0, -1)) if s)

    df = spark.createDataFrame(rows, "track long, asc_id long, desc_id long, asc_ms long, desc_ms long, dt_ms long")
    want = {r for t in {r[0] for r in rows} for r in first_pairs([r for r in rows if r[0] == t])}
    assert set(map(tuple, aq.select_pairs(df).collect())) == want


@pytest.mark.parametrize("shape", [(100, 130), (7, 3)])
def test_grids_of_any_size(spark, shape):
    """Boxes, gathers, derivatives, erosion and median filters against NumPy on oblong grids."""
    a = np.random.default_rng(11).normal(100, 10, shape)
    p = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(shape[0]) for x in range(shape[1])], "run_id int, row int, col int, z double")
    p = p.withColumn("m", (F.col("z") > 95).cast("int"))
    d = w2.box_stats(p, "z", 2, "b")
    d = w2.median_filter(d, "z", 5, "med")
    d = w2.erode(d, "m", "er")
    d = w2.central(w2.central(d, "z", "dx", "col", 10.0), "z", "dy", "row", 10.0)
    d = w2.gather3(d, "z", "g").orderBy("row", "col").toPandas()
    pad = np.lib.stride_tricks.sliding_window_view(np.pad(a, 2, mode="edge"), (5, 5)).reshape(*shape, 25)
    back = lambda c: d[c].to_numpy(float).reshape(shape)
    assert np.allclose(back("b_mean"), pad.mean(2)) and np.allclose(back("b_std"), pad.std(2), atol=1e-5)
    assert np.allclose(back("med"), np.median(pad, axis=2))
    dy, dx = np.gradient(a, 10.0)
    assert np.allclose(back("dx"), dx) and np.allclose(back("dy"), dy)
    nine = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, mode="edge"), (3, 3)).reshape(-1, 9)
    assert np.allclose(np.array(d["g"].tolist()), nine)
    hole = np.pad(a > 95, 1, constant_values=False)
    assert (back("er") == np.lib.stride_tricks.sliding_window_view(hole, (3, 3)).all((2, 3))).all()


def test_objects_on_a_large_oblong_grid(spark):
    """640 x 900 pixels: objects against a flood fill, two of them 64 apart in both axes."""
    rng = np.random.default_rng(4)
    m = np.zeros((640, 900), bool)
    for y, x in [(10, 10), (10, 74), (74, 10), (11, 138), *rng.integers(0, 630, (60, 2)).tolist()]:
        m[y : y + rng.integers(1, 9), x : x + rng.integers(1, 9)] = True
    ys, xs = np.nonzero(m)
    df = spark.createDataFrame([(3, int(y), int(x)) for y, x in zip(ys, xs)], "run_id int, row int, col int")
    got = {(r.row, r.col): r.object_id for r in ob.connected(df).collect()}
    left, want = set(zip(ys.tolist(), xs.tolist())), []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        seen = set(todo)
        while todo:
            y, x = todo.pop()
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    seen.add(q)
                    todo.append(q)
        if len(seen) >= ob.MIN_PIXELS:
            want.append(seen)
    groups = {}
    for k, o in got.items():
        groups.setdefault(o, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_point_signature_values(spark):
    """The published example: metal 0.695, void 0.36, ceramic 0.46, depth 2.03; no delta, no depth; nothing, nothing."""
    v = dict(gold=0.8, silver=0.6, mass=0.7, sar_comp=0.5, tunnel=0.4, door=0.3, tpi=0.2, rough=0.5, pottery=0.6, lime=0.2, curv=0.3, risk=0.2, quartz=0.3, moist=0.4, oxid=0.2, ascdesc=0.0, thermal=0.5, delta=0.0, nano_depth_penetration=2.25)
    rows = [tuple(v.values()), tuple(None if k == "delta" else x for k, x in v.items()), tuple(None for _ in v)]
    a, b, c = proxies.point_signature(spark.createDataFrame(rows, ", ".join(f"{k} double" for k in v))).orderBy(F.col("delta").desc_nulls_last(), F.col("gold").desc_nulls_last()).collect()
    assert (a.nb_metal_signature, a.nb_void_signature, a.nb_ceramic_signature, a.nb_mass_signature, a.nano_depth_penetration) == (0.695, 0.36, 0.46, 0.7, 2.25)
    assert a.nb_depth_m == pytest.approx(2.03, abs=0.01) and a.nb_depth_available and a.nb_best_object_interpretation
    assert b.nb_void_signature == 0.36 and b.nb_depth_m is None and not b.nb_depth_available
    assert c.nb_metal_signature is None and c.nb_best_object_interpretation is None and c.nb_depth_m is None


def test_redaction(spark):
    lines = ["C:\\data\\run 7 and /home/u/x.tif", "MultiPoint (1 2", "at 45.5, -120.25 not 123.4, 9", "f" * 40, '{"type": "Feature"} <kml >', "plain 1 2"]
    d = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = [r.t for r in d.select("i", ev.redact(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == ["[REDACTED_PATH] 7 and [REDACTED_PATH]", "[REDACTED_GEOMETRY]1 2", "at [REDACTED_COORDS] not 123.4, 9", "[REDACTED_HASH]", "{[REDACTED_GEOMETRY]} [REDACTED_GEOMETRY] >", "plain 1 2"]
    assert [r.v for r in d.select("i", ev.violates(F.col("t")).alias("v")).orderBy("i").collect()] == [True] * 5 + [False]


def test_areas(spark):
    rows = [(1, -10.0, 0.0, 10.0, 5.0), (2, 10.0, 0.0, -10.0, 5.0), (3, -10.0, 5.0, 10.0, 5.0), (4, -181.0, 0.0, 0.0, 5.0), (5, 0.0, -91.0, 1.0, 5.0), (6, None, 0.0, 1.0, 5.0), (7, float("nan"), 0.0, 1.0, 5.0)]
    d = ev.aoi_status(spark.createDataFrame(rows, "k int, west double, south double, east double, north double"))
    assert [r.aoi_status for r in d.orderBy("k").collect()] == ["ok", "west_not_less", "south_not_less", "longitude_range", "latitude_range", "not_finite", "not_finite"]


def test_anchor_rules(spark):
    packs = {"one": [("a", 1, 1)], "id": [("a", 1, 1), ("a", 2, 2)], "signal": [("a", 1, 1), ("b", 1, 2)], "flat": [("a", 1, 1), ("b", 2, 1)], "bent": [("a", 1, 1), ("b", 2, 3), ("c", 3, 2)], "falling": [("a", 1, 3), ("b", 2, 1)]}
    d = spark.createDataFrame([(p, i, float(s), float(b)) for p, rows in packs.items() for i, s, b in rows], "package string, anchor_id string, signal_value double, best double")
    got = {r.package: r.status for r in fo.anchor_status(d).collect()}
    assert got == {"one": "too_few_anchors", "id": "duplicate_anchor_id", "signal": "duplicate_signal", "flat": "flat_depth", "bent": "not_monotonic", "falling": "ok"}


def test_nearest_over_far_cells(spark):
    rng = np.random.default_rng(3)
    p, t = rng.integers(0, 200, (60, 2)), rng.integers(0, 1000, (25, 2))
    d = lambda a, n: spark.createDataFrame([(0, i, int(y), int(x)) for i, (y, x) in enumerate(a)], f"run_id int, {n} int, y int, x int")
    got = {r.point_id: (r.target_id, r.distance) for r in fo.nearest(d(p, "point_id"), d(t, "target_id"), 1000).collect()}
    for i, at in enumerate(p):
        far = ((t - at) ** 2).sum(axis=1)
        assert got[i] == (far.argmin(), pytest.approx(far.min() ** 0.5))


def test_mask_orientation(spark):
    shapes = {1: [(0, c) for c in range(5)], 2: [(r, 0) for r in range(5)], 3: [(r, r * 2) for r in range(5)], 4: [(r * 2, r) for r in range(5)], 5: [(r, -r) for r in range(5)], 6: [(0, 0)]}
    d = spark.createDataFrame([(0, k, r, c) for k, px in shapes.items() for r, c in px], "run_id int, object_id int, row int, col int")
    got = {r.object_id: r.orientation for r in fo.mask_axes(d).collect()}
    assert got == {1: "E_W", 2: "N_S", 3: "NW_SE", 4: "NE_SW", 5: "NE_SW", 6: "UNRESOLVED"}


def first_solution(own, most, least):
    """The first set of pairs in order, by trying all."""
    order = sorted({(r[3], r[1]) for r in own})

    def tries(i, used, want):
        if not want:
            return []
        if i == len(order):
            return None
        for r in sorted((r for r in own if r[1] == order[i][1] and r[2] not in used), key=lambda r: (r[5], r[4], r[2])):
            rest = tries(i + 1, used | {r[2]}, want - 1)
            if rest is not None:
                return [r, *rest]
        return tries(i + 1, used, want)

    return next((s for k in range(most, least - 1, -1) if (s := tries(0, frozenset(), k)) is not None), [])


def test_pairs_equal_the_first_solution_of_all(spark):
    import random

    rng, rows, acq = random.Random(2), [], []
    for track in range(60):
        events = [(track, 1000 * track + i, rng.randrange(0, 40) * aq.HOUR, rng.choice("AD")) for i in range(rng.randint(1, 12))]
        acq += events
        rows += [(track, a[1], d[1], a[2], d[2], abs(a[2] - d[2])) for a in events for d in events if a[3] == "A" and d[3] == "D" and abs(a[2] - d[2]) <= 6 * aq.HOUR]
    near = aq.nearest_candidates(spark.createDataFrame(acq, "track long, event_id long, ms long, pass string"), 6, 4)
    want = {r[:3] for r in rows if sum((o[5], o[4], o[2]) < (r[5], r[4], r[2]) for o in rows if o[:2] == r[:2]) < 4}
    assert {(r.track, r.asc_id, r.desc_id) for r in near.collect()} == want
    got = sorted((r.track, r.asc_id, r.desc_id) for r in aq.select_pairs(near, 4, 2).collect())
    assert got == sorted(r[:3] for t in range(60) for r in first_solution([r for r in rows if r[0] == t], 4, 2))
