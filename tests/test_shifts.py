"""Shift search against planted shifts and tilts, and against the same search on one grid in NumPy; edges against a flood fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import edges, shifts


def surface(y, x):
    return 3 * np.sin(x / 3.1) + 2 * np.cos(y / 2.3) + 1.5 * np.sin((x + 2 * y) / 5.0)


def pair(run, dx, dy, tilt, noise, h=96, w=110):
    rng = np.random.default_rng(run)
    y, x = np.indices((h, w)).astype(float)
    pre = surface(y, x)
    post = surface(y + dy, x + dx) + tilt[0] + tilt[1] * x / (w - 1) + tilt[2] * y / (h - 1) + noise * rng.normal(size=(h, w))
    target = (np.abs(y - 60) < 13) & (np.abs(x - 40) < 13)
    post[target] += 0.9
    pre[rng.random((h, w)) < 0.02] = np.nan
    post[rng.random((h, w)) < 0.02] = np.nan
    return pre, post, target


def frames(spark, pairs):
    rows = {k: [] for k in ("pre", "post")}
    for run, (pre, post, target) in pairs.items():
        for r in range(pre.shape[0]):
            for c in range(pre.shape[1]):
                rows["pre"].append((run, r, c, None if np.isnan(pre[r, c]) else float(pre[r, c]), bool(not target[r, c]), bool(target[r, c])))
                rows["post"].append((run, r, c, None if np.isnan(post[r, c]) else float(post[r, c])))
    return spark.createDataFrame(rows["pre"], "run_id int, row int, col int, z double, s boolean, t boolean"), spark.createDataFrame(rows["post"], "run_id int, row int, col int, z double")


def search(pre, post, stable, most):
    """The same search over one pair: sampled points, every candidate's own plane."""
    rows, cols = np.nonzero(stable & np.isfinite(pre) & np.isfinite(post))
    step = max(1, -(-len(rows) // most))
    rows, cols = rows[::step], cols[::step]
    h, w = pre.shape

    def score(dx, dy):
        sy, sx = rows - dy, cols - dx
        y, x = np.floor(sy).astype(int), np.floor(sx).astype(int)
        ok = (y >= 0) & (x >= 0) & (y + 1 < h) & (x + 1 < w)
        fy, fx, y, x, r, c = (sy - y)[ok], (sx - x)[ok], y[ok], x[ok], rows[ok], cols[ok]
        b = post[y, x] * (1 - fx) * (1 - fy) + post[y, x + 1] * fx * (1 - fy) + post[y + 1, x] * (1 - fx) * fy + post[y + 1, x + 1] * fx * fy
        z = b - pre[r, c]
        ok = np.isfinite(post[y, x] + post[y, x + 1] + post[y + 1, x] + post[y + 1, x + 1])
        return shifts.plane_spread(c[ok] / w, r[ok] / h, z[ok], 3, 3.5, 1000)

    best = min((score(x, y), y, x) for y in range(-3, 4) for x in range(-3, 4))
    fine = min((score(best[2] + x / 4, best[1] + y / 4), best[1] + y / 4, best[2] + x / 4) for y in range(-3, 4) for x in range(-3, 4))
    return fine if fine[0] < best[0] else best


def test_planted_shifts_and_tilts(spark):
    planted = {1: (1.25, -0.5, (0.4, 0.2, -0.3)), 2: (-2.0, 0.75, (-1.0, 0.0, 0.05)), 3: (0.0, 0.0, (0.0, 0.0, 0.0))}
    pairs = {run: pair(run, dx, dy, tilt, 0.01) for run, (dx, dy, tilt) in planted.items()}
    pairs[4] = tuple(a[:20, :20] for a in pairs[1])
    pre, post = frames(spark, pairs)
    got = {r.run_id: r for r in shifts.best_shifts(pre, post, "z", "s", most=4000).collect()}
    assert got.keys() == planted.keys()
    for run, (dx, dy, _) in planted.items():
        want = search(pairs[run][0], pairs[run][1], ~pairs[run][2], 4000)
        assert (got[run].dx, got[run].dy) == (dx, dy) == (want[2], want[1])
        assert got[run].score == pytest.approx(want[0])
    change = {r.run_id: r for r in shifts.elevation_change(pre, post, "z", "s", "t", most=4000).collect()}
    for run, (dx, dy, tilt) in planted.items():
        r = change[run]
        assert (r.dx, r.dy) == (dx, dy) and r.median_change == pytest.approx(0.9, abs=0.03)
        assert (r.x_edge_delta, r.y_edge_delta) == (pytest.approx(tilt[1], abs=0.02), pytest.approx(tilt[2], abs=0.02))
        assert r.stable_rmse_pass == (r.stable_rmse <= 0.15) and r.target_pixels > 500 and r.status in ("ok", "gates_failed")


def test_too_few_points_stay(spark):
    a = pair(1, 1.0, 0.0, (0, 0, 0), 0.0, 40, 40)
    pre, post = frames(spark, {1: a})
    got = shifts.best_shifts(pre, post, "z", "s", least_stable=10, least=5000).collect()
    assert [(r.dx, r.dy, r.score) for r in got] == [(0.0, 0.0, None)]


# ---- edges -------------------------------------------------------------------------------------


def naive_edges(x, low, high, sigma):
    h, w = x.shape
    k = edges.weights(sigma)
    at = lambda a, r, c: a[min(max(r, 0), h - 1), min(max(c, 0), w - 1)]
    for dy, dx in ((0, 1), (1, 0)):
        x = np.array([[k[0] * x[r, c] + sum(k[i] * (at(x, r - i * dy, c - i * dx) + at(x, r + i * dy, c + i * dx)) for i in range(1, len(k))) for c in range(w)] for r in range(h)])
    m, ridge, g = np.zeros((h + 2, w + 2)), np.zeros((h, w), bool), {}
    for r in range(h):
        for c in range(w):
            gx, gy = (at(x, r, c + 1) - at(x, r, c - 1)) / 2, (at(x, r + 1, c) - at(x, r - 1, c)) / 2
            g[r, c] = gx, gy
            m[r + 1, c + 1] = 0 if np.isnan(gx + gy) else np.sqrt(gx * gx + gy * gy)
    for (r, c), (gx, gy) in g.items():
        if np.isnan(gx + gy):
            continue
        dy, dx = (0, 1) if abs(gy) <= abs(gx) * edges.HALF else (1, 0) if abs(gx) <= abs(gy) * edges.HALF else (1, 1) if (gx > 0) == (gy > 0) else (1, -1)
        ridge[r, c] = m[r + 1, c + 1] > m[r + 1 - dy, c + 1 - dx] and m[r + 1, c + 1] >= m[r + 1 + dy, c + 1 + dx]
    m = m[1:-1, 1:-1]
    weak, kept = ridge & (m >= low), ridge & (m >= high)
    stack = list(zip(*np.nonzero(kept)))
    while stack:
        r, c = stack.pop()
        for a in range(max(r - 1, 0), min(r + 2, h)):
            for b in range(max(c - 1, 0), min(c + 2, w)):
                if weak[a, b] and not kept[a, b]:
                    kept[a, b] = True
                    stack.append((a, b))
    return kept, m


def test_edges_equal_flood_fill(spark):
    grids = {}
    for run, (h, w) in {1: (100, 130), 2: (30, 45)}.items():
        rng = np.random.default_rng(run)
        y, x = np.indices((h, w))
        a = ((y - h / 2) ** 2 + (x - w / 3) ** 2 < (h / 4) ** 2) * 1.0 + (x > 0.7 * w) * 0.6 + 0.15 * rng.normal(size=(h, w))
        a[rng.random((h, w)) < 0.01] = np.nan
        grids[run] = a
    rows = [(run, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for run, a in grids.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    got = edges.edges(spark.createDataFrame(rows, "run_id int, row int, col int, x double"), "x", 0.08, 0.2, 0.9).collect()
    for run, a in grids.items():
        kept, m = naive_edges(a, 0.08, 0.2, 0.9)
        mine = np.zeros(a.shape, bool)
        for e in got:
            if e.run_id == run:
                mine[e.row, e.col] = True
                assert e.magnitude == pytest.approx(m[e.row, e.col]) and e.strong == (e.magnitude >= 0.2)
        assert kept.sum() > 40 and np.array_equal(mine, kept)
        groups = {e.edge_id for e in got if e.run_id == run}
        assert groups == set(range(1, len(groups) + 1))


# ---- what is sent ------------------------------------------------------------------------------


def test_points_are_not_sent_once_a_candidate(spark):
    """What a search shuffles grows with the pixels, not with its 98 candidates; sparse points reach the pixels around them alone."""
    pre, post = frames(spark, {run: pair(run, 0.5, 0.25, (0.0, 0.0, 0.0), 0.01) for run in (1, 2)})
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    pixels, before = post.count(), sent()
    assert len(shifts.best_shifts(pre, post, "z", "s").collect()) == 2
    assert sent() - before < 300 * pixels
    few = spark.createDataFrame([(1, 5, 5), (1, 80, 100), (9, 5, 5)], "run_id int, row int, col int")
    near = {(r.row, r.col) for r in shifts.near_points(post, "z", few).collect()}
    there = {(r.row, r.col) for r in post.where("run_id = 1 and z is not null").collect()}
    box = {(r + y, c + x) for r, c in ((5, 5), (80, 100)) for y in range(-4, 5) for x in range(-4, 5)}
    assert box & there <= near <= there and len(near) <= 2 * 4 * 64
