"""Anomaly scores against a singular value decomposition, run by run."""

import numpy as np
import pytest

from tellurion.functions import group_stats as g
from tellurion.operators import pca


def plain(cube, support, k=3):
    """Raw score and stretch of one cube (h x w x bands, NaN for missing)."""
    v = cube[support]
    use = [i for i in range(cube.shape[2]) if np.isfinite(v[:, i]).any() and np.nanstd(v[:, i]) > 1e-6]
    x = cube[:, :, use].copy()
    valid = support & np.isfinite(x).all(axis=2)
    for i in range(len(use)):
        c = x[:, :, i]
        c[np.isnan(c)] = np.nanmedian(c)
        lo, hi = np.percentile(c, [1, 99])
        x[:, :, i] = np.clip(c, lo, hi) if hi > lo else c
    m = x[valid]
    u, s, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    k = min(k, len(use), len(m))
    y = (x - m.mean(axis=0)) @ vt[:k].T / np.sqrt(np.maximum(s[:k] ** 2 / (len(m) - 1), 1e-12))
    raw = np.where(valid, np.sqrt((y**2).sum(axis=2)), np.nan)
    a, b = np.nanpercentile(raw, [1, 99])
    return use, valid, raw, np.clip((raw - a) / (b - a + 1e-12), 0, 1), s[:k] ** 2 / (len(m) - 1)


def test_runs_of_several_sizes(spark):
    rng, cubes, rows = np.random.default_rng(4), {}, []
    for run, (h, w) in {1: (24, 31), 2: (9, 12), 3: (10, 10), 4: (6, 6), 5: (5, 5)}.items():
        cube = rng.normal(size=(h, w, 5)) @ rng.normal(size=(5, 5)) + 10
        cube[:, :, 3] = 4.25 if run == 1 else cube[:, :, 3]
        cube[rng.random((h, w, 5)) < 0.05] = np.nan
        cube[:, :, 1] = np.nan if run == 2 else cube[:, :, 1]
        support = rng.random((h, w)) < {3: 0.0, 4: 0.02}.get(run, 0.8)
        support[0, 0] = run == 4 or support[0, 0]
        if run == 5:
            cube[:] = 1.0
        cubes[run] = cube, support
        rows += [(run, r, c, *[None if np.isnan(x) else float(x) for x in cube[r, c]], float(support[r, c])) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "run_id int, row int, col int, a double, b double, c double, d double, e double, ok double")
    pixels, report = pca.pca_anomaly(df, list("abcde"), "ok", least_valid=0.3)
    got = {}
    for r in pixels.collect():
        got.setdefault(r.run_id, {})[r.row, r.col] = (r.raw_score, r.anomaly)
    rep = {r.run_id: r for r in report.collect()}
    assert {k: r.status for k, r in rep.items()} == {1: "ok", 2: "ok", 3: "no_channels", 4: rep[4].status, 5: "no_channels"} and rep[4].status != "ok"
    assert [(x.band, x.reason) for x in rep[1].excluded] == [("d", "near_constant")] and [(x.band, x.reason) for x in rep[2].excluded] == [("b", "no_finite_values")]
    for run in (1, 2):
        use, valid, raw, shown, variance = plain(*cubes[run])
        assert rep[run].included == ["abcde"[i] for i in use] and rep[run].valid_count == valid.sum() and rep[run].variance == pytest.approx(variance)
        for (r, c), (a, b) in got[run].items():
            assert (a is None) == (not valid[r, c])
            if a is not None:
                assert (a, b) == (pytest.approx(raw[r, c], rel=1e-6), pytest.approx(shown[r, c], abs=1e-6))
    assert all(v == (None, None) for run in (3, 4, 5) for v in got[run].values())


def test_one_ramp_has_one_component(spark):
    rows = [(0, r, c, float(r * 4 + c), 2.0 * (r * 4 + c), 0.5 * (r * 4 + c)) for r in range(4) for c in range(4)]
    pixels, report = pca.pca_anomaly(spark.createDataFrame(rows, "run_id int, row int, col int, a double, b double, c double"), list("abc"))
    r = report.first()
    assert r.status == "ok" and r.share[0] == pytest.approx(1.0) and r.valid_fraction == 1.0
    assert all(0 <= p.anomaly <= 1 and np.isfinite(p.raw_score) for p in pixels.collect())


def test_quantiles_of_the_filled_band_come_from_places_among_its_values(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for run, (size, missing) in enumerate([(1, 0), (1, 1), (2, 1), (7, 0), (7, 3), (8, 4), (40, 39), (300, 5), (301, 150), (302, 301)]):
        for name in "ab":
            v = np.round(rng.normal(size=size), 1 if name == "a" else 6)
            v[rng.permutation(size)[:missing]] = np.nan
            want[run, name] = v
        rows += [(run, *[None if np.isnan(want[run, c][i]) else float(want[run, c][i]) for c in "ab"]) for i in range(size)]
    df = spark.createDataFrame(rows, "run_id int, a double, b double")
    got = {r.run_id: r for r in g.filled_quantiles(df, ["a", "b"], 0.01, 0.8).collect()}
    assert len(got) == 10
    for (run, name), v in want.items():
        s = got[run][f"_s_{name}"]
        if np.isnan(v).all():
            assert s is None
        else:
            full = np.where(np.isnan(v), np.nanmedian(v), v)
            assert (s.middle, s.low, s.high) == pytest.approx((np.nanmedian(v), *np.percentile(full, [1, 80])), rel=1e-12, abs=1e-15)
