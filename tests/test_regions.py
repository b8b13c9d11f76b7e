"""Polygons against a point-in-polygon test of every pixel, rectangles against all pairs."""

import random

import numpy as np
import pytest

from tellurion.operators import regions

POLY = "run_id int, feature_id string, rings array<array<struct<x: double, y: double>>>"


def inside(rings, height, width):
    out = np.zeros((height, width), bool)
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            (y0, x0), (y1, x1) = sorted([(a[1], a[0]), (b[1], b[0])])
            for r in range(height):
                if y0 <= r + 0.5 < y1:
                    out[r] ^= np.arange(width) + 0.5 < x0 + (r + 0.5 - y0) * (x1 - x0) / (y1 - y0)
    return out


def shrink(mask, n):
    for _ in range(n):
        p = np.pad(mask, 1)
        mask = np.logical_and.reduce([p[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)])
    return mask


def as_masks(s, height, width):
    out = {}
    for r in s.collect():
        m = out.setdefault((r.run_id, r.feature_id), np.zeros((height, width), int))
        m[r.row, r.c0 : r.c1 + 1] += 1
    return out


def shapes():
    rng = random.Random(4)
    star = lambda x, y, r, n: [(x + r * rng.uniform(0.3, 1) * np.cos(t), y + r * rng.uniform(0.3, 1) * np.sin(t)) for t in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    p = {(1, "star"): [star(20, 20, 18, 13)], (1, "hole"): [star(30, 15, 14, 9), star(30, 15, 4, 5)], (2, "parts"): [star(8, 8, 7, 6), star(35, 30, 9, 7)], (2, "out"): [star(-50, 9, 4, 5)], (2, "edge"): [star(0, 0, 12, 8)],
         (3, "left"): [[(0.0, 0.0), (20.5, 0.0), (13.3, 40.0), (0.0, 40.0)]], (3, "right"): [[(13.3, 40.0), (20.5, 0.0), (48.0, 0.0), (48.0, 40.0)]], (3, "flat"): [[(1.0, 5.0), (9.0, 5.0)]], (3, "dot"): [[(1.0, 1.0)]], (3, "none"): [],
         (4, "bow"): [[(5.0, 5.0), (40.0, 30.0), (40.0, 5.0), (5.0, 30.0)]], (4, "level"): [[(2.5, 2.5), (6.5, 2.5), (6.5, 4.5), (2.5, 4.5)]], (5, "twice"): [[(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0)], [(9.0, 3.0), (15.0, 3.0), (15.0, 9.0), (9.0, 9.0)]]}
    return {k: [[(float(x), float(y)) for x, y in ring] for ring in rings] for k, rings in p.items()}


@pytest.mark.parametrize("pixels", [0, 1, 2])
def test_stretches_and_erosion(spark, pixels):
    h, w, p = 40, 48, shapes()
    df = spark.createDataFrame([(*k, rings) for k, rings in p.items()] + [(9, "bad", [[(1.0, 1.0), (float("nan"), 3.0), (4.0, 4.0)]]), (9, "null", [[(1.0, 1.0), (None, 3.0), (4.0, 4.0)]])], POLY)
    raw = regions.stretches(df, h, w)
    got = as_masks(regions.eroded(raw, pixels), h, w)
    for k, rings in p.items():
        assert np.array_equal(got.get(k, np.zeros((h, w), int)), shrink(inside(rings, h, w), pixels).astype(int)), k
    assert not [k for k in got if k[0] == 9]
    if not pixels:
        assert np.array_equal(got[3, "left"] + got[3, "right"], np.ones((h, w), int))  # neighbours share an edge: no pixel twice, none lost


def test_statistics_and_overlaps(spark):
    h, w, p = 40, 48, shapes()
    rng = np.random.default_rng(2)
    values = {run: np.where(rng.random((h, w)) < 0.1, np.nan, rng.normal(size=(h, w))) for run in range(1, 6)}
    px = spark.createDataFrame([(run, r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for run, v in values.items() for r in range(h) for c in range(w)], "run_id int, row int, col int, v double")
    df = spark.createDataFrame([(*k, rings) for k, rings in p.items()], POLY)
    raw = regions.stretches(df, h, w)
    mask = regions.eroded(raw, 1)
    rows = {(r.run_id, r.feature_id): r for r in regions.region_statistics(df, raw, mask, px, "v", 20).collect()}
    assert rows.keys() == p.keys()
    small = {}
    for k, r in rows.items():
        m = inside(p[k], h, w)
        e = shrink(m, 1)
        v = values[k[0]][e]
        v = v[~np.isnan(v)]
        small[k] = e
        assert (r.raw_pixels, r.mask_pixels, r.valid_pixels) == (m.sum(), e.sum(), len(v))
        want = "outside" if not m.any() else "small" if e.sum() < 20 else "unsupported" if len(v) < 20 else "ok"
        assert r.status == want
        if want == "ok":
            assert (r["mean"], r.deviation, r.median, r.least, r.most) == pytest.approx((v.mean(), v.std(ddof=1), np.median(v), v.min(), v.max()))
        else:
            assert r["mean"] is None
    want = {(a[0], a[1], b[1]): int((small[a] & small[b]).sum()) for a in p for b in p if a[0] == b[0] and a[1] < b[1] and (small[a] & small[b]).any()}
    assert {(r.run_id, r.left_id, r.right_id): r.pixels for r in regions.region_overlaps(mask).collect()} == want


def test_rectangles_of_any_size(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        rows.append((i, x, y, x + 2 ** rng.uniform(-8, 6), y + 2 ** rng.uniform(-8, 6)))
    rows += [(1000 + i, float(i % 4 * 8), float(i // 4 * 8), float(i % 4 * 8 + 8), float(i // 4 * 8 + 8)) for i in range(16)]  # a mosaic that only touches
    rows += [(2000, 0.0, 0.0, 0.0, 0.0), (2001, 1.0, 1.0, 1.0, 1.0), (2002, 1.0, 1.0, 1.0, 1.0), (2003, -1e6, -1e6, 1e6, 1e6), (2004, None, 0.0, 1.0, 1.0), (2005, 5.0, 0.0, 1.0, 1.0), rows[0], (2006, *rows[1][1:])]
    df = spark.createDataFrame(rows, "rect_id int, west double, south double, east double, north double")
    live = [r for r in rows if None not in r and r[1] <= r[3] and r[2] <= r[4]]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for n, a in enumerate(live) for b in live[n + 1 :] if a[0] != b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    assert sorted((r.left_id, r.right_id) for r in regions.rectangle_overlaps(df).collect()) == want


def test_background_ring(spark):
    sites = spark.createDataFrame([(1, 10.0, 20.0, 1000.0, 800.0), (2, 10.01, 20.0, 1000.0, 800.0), (3, 84.999, 0.0, 500.0, 500.0), (4, 0.0, 179.999, 500.0, 500.0)], "site_id int, lat double, lon double, width double, height double")
    rows = {(r.site_id, r.direction): r for r in regions.background_rectangles(sites, 100.0).collect()}
    assert len([k for k in rows if k[0] == 1]) == 8 and len([k for k in rows if k[0] == 3]) < 8 and {k[1] for k in rows if k[0] == 4} == {"west", "northwest", "southwest"}
    assert not rows[1, "north"].clear and rows[1, "south"].clear and rows[2, "north"].clear
    assert len([r for r in regions.background_rectangles(sites, 100.0, False).collect() if r.site_id == 1]) == 4


def test_overlapped_finds_every_size_once(spark):
    """Rectangles against others of all sizes, touching ones and copies included, against brute force; no side is sent whole."""
    rng = random.Random(11)

    def some(n):
        out = []
        for i in range(n):
            w, s, side = rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.uniform(-6, 6)
            out.append((i, w, s, w + side * rng.uniform(0.1, 1), s + side * rng.uniform(0.1, 1)))
        return out + [(n, 0.0, 0.0, 4.0, 4.0), (n + 1, 4.0, 0.0, 8.0, 4.0), (n + 2, -8.0, -8.0, 0.0, 0.0), (n + 3, 0.0, 0.0, 4.0, 4.0), (n + 4, None, 0.0, 1.0, 1.0)]

    a, b, schema = some(300), some(60)[:-1], "rect_id int, west double, south double, east double, north double"
    met = regions.overlapped(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = {i for i, w, s, e, n in a if w is not None and any(w < oe and ow < e and s < on and os < n for _, ow, os, oe, on in b)}
    got = [r.rect_id for r in met.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
