"""Scenes and acquisitions: composites, tracks, pairing, before/after review."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.functions.columns import number
from tellurion.functions.group_stats import quantile, with_stats
from tellurion.sources.views import spread

HOUR = 3_600_000
DAY = 24 * HOUR


def median_composite(px: DataFrame, bands: list[str]) -> DataFrame:
    """Per pixel, the exact median over scenes."""
    return px.groupBy("row", "col").agg(*[F.median(b).alias(b) for b in bands])


def newest(px: DataFrame, bands: list[str]) -> DataFrame:
    """Per pixel, the bands of the latest scene that covers it (a mosaic, latest first)."""
    return px.groupBy("row", "col").agg(F.max_by(F.struct("scene_id", *bands), F.struct("scene_id")).alias("s")).select("row", "col", "s.*")


def lowest(px: DataFrame, cloud: str) -> DataFrame:
    """The scene with the least mean of ``cloud``, the smallest id on ties."""
    return px.groupBy("scene_id").agg(F.avg(cloud).alias("cloud"), F.count(F.lit(1)).alias("pixels")).orderBy("cloud", "scene_id").limit(1)


def best_track(acq: DataFrame) -> DataFrame:
    """Per pass, the track with the most acquisitions, the smallest track on ties."""
    n = acq.groupBy("pass", "track").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("pass").agg(F.min(F.struct((-F.col("n")).alias("k"), "track")).alias("s")).select("pass", "s.track", (-F.col("s.k")).alias("n"))


def orbit_window(acq: DataFrame, days: float, by: tuple[str, ...] = ("pass",)) -> DataFrame:
    """Acquisitions within ``days`` of the upper median time of their ``by``."""
    mid = acq.groupBy(*by).agg(F.expr("percentile_disc(0.5) within group (order by ms desc)").alias("_mid"))
    return acq.join(mid, list(by)).where(F.abs(F.col("ms") - F.col("_mid")) <= int(days * DAY)).drop("_mid")


def pair_candidates(acq: DataFrame, hours: float) -> DataFrame:
    """Ascending x descending acquisitions of a track at most ``hours`` apart.

    The interval join is an equi-join on (track, time bin): a bin is as long as the
    bound, and each ascending acquisition meets its own and the two next to it.
    """
    bound = int(hours * HOUR)
    a = acq.where("pass = 'A'").select("track", F.col("event_id").alias("asc_id"), F.col("ms").alias("asc_ms"))
    d = acq.where("pass = 'D'").select("track", F.col("event_id").alias("desc_id"), F.col("ms").alias("desc_ms"), F.floor(F.col("ms") / bound).alias("_bin"))
    a = a.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("asc_ms") / bound) + k for k in (-1, 0, 1)])))
    return a.join(d, ["track", "_bin"]).withColumn("dt_ms", F.abs(F.col("asc_ms") - F.col("desc_ms"))).where(F.col("dt_ms") <= bound).drop("_bin")


def nearest_candidates(acq: DataFrame, hours: float, most: int = 4) -> DataFrame:
    """The ``most`` nearest descending acquisitions of every ascending one of a track at most ``hours`` apart; ties go to the earlier, then to the smaller id.

    They are among the ``most`` before and the ``most`` after it.  Descending ones are
    numbered along their track, by counts of time bins and places inside a bin, so a
    track of any length is no window of its own, and its pairs are never all made.
    """
    bound = int(hours * HOUR)
    e = acq.where("pass in ('A', 'D')").select("track", "event_id", "ms", "pass", (F.col("pass") == "D").cast("long").alias("_d"), F.floor(F.col("ms") / bound).alias("_bin"))
    bins = e.groupBy("track", "_bin").agg(F.sum("_d").alias("_n"))
    bins = bins.select("track", "_bin", (F.sum("_n").over(Window.partitionBy("track").orderBy("_bin")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("track", "_bin")
    place = lambda *order: F.col("_before") + F.sum("_d").over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.col("_before") + F.coalesce(F.sum("_d").over(inside.orderBy("ms").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.join(bins, ["track", "_bin"]).withColumns({"_up": place("ms", "event_id"), "_down": place("ms", F.desc("event_id")), "_k": earlier})
    a = e.where("pass = 'A'").select("track", F.col("event_id").alias("asc_id"), F.col("ms").alias("asc_ms"), "_k")
    d = e.where("pass = 'D'").select("track", F.col("event_id").alias("desc_id"), F.col("ms").alias("desc_ms"), F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("_up").alias("n")), F.struct(F.lit("down").alias("side"), F.col("_down").alias("n")))).alias("_at"))
    wanted = F.array(*[F.struct(F.lit("up").alias("side"), (F.col("_k") + i).alias("n")) for i in range(1, most + 1)], *[F.struct(F.lit("down").alias("side"), (F.col("_k") - i).alias("n")) for i in range(most)])
    met = a.withColumn("_at", F.explode(wanted)).join(d, ["track", "_at"]).withColumn("dt_ms", F.abs(F.col("asc_ms") - F.col("desc_ms"))).where(F.col("dt_ms") <= bound)
    near = F.row_number().over(Window.partitionBy("track", "asc_id").orderBy("dt_ms", "desc_ms", "desc_id"))
    return met.withColumn("_near", near).where(F.col("_near") <= most).select("track", "asc_id", "asc_ms", "desc_id", "desc_ms", "dt_ms")


def matching_size(options: dict, taken: set) -> int:
    """The most items of ``options`` (item -> partners) that can have a partner of their own outside ``taken``: augmenting paths."""
    holder: dict = {}

    def place(item, seen: set) -> bool:
        for p in options[item]:
            if p not in taken and p not in seen:
                seen.add(p)
                if p not in holder or place(holder[p], seen):
                    holder[p] = item
                    return True
        return False

    return sum(place(item, set()) for item in options)


def select_pairs(candidates: DataFrame, most: int = 4, least: int = 1) -> DataFrame:
    """As many pairs of each track as can be had without a shared acquisition, up to ``most``; none if fewer than ``least``.

    Of all such sets the first one: ascending acquisitions in order of time, each with
    its nearest partner that leaves enough for the rest (ties: earlier, smaller id),
    left out only if none does.  Whether enough is left is the size of a maximum
    matching of the later ones.

    A track comes to Python as at most 2 * most**2 + most candidates, which give the
    same pairs as all of them.  The others of a result hold at most most - 1 partners
    and items, so one of an item's ``most`` nearest partners and one of a partner's
    ``most`` first items is left for it.  What remains has no node with over ``most``
    candidates, so the first 2 * most**2 of them hold 2 * most pairs without a shared
    acquisition, one of which could take the place of any pair further on.
    """
    first = lambda by, *order: F.dense_rank().over(Window.partitionBy("track", by).orderBy(*order)) <= most
    near = candidates.withColumn("_near", first("asc_id", "dt_ms", "desc_ms", "desc_id")).where("_near").drop("_near")
    near = near.withColumn("_early", first("desc_id", "asc_ms", "asc_id")).where("_early").drop("_early").dropDuplicates(["track", "asc_id", "desc_id"])
    place = F.row_number().over(Window.partitionBy("track").orderBy("asc_ms", "asc_id", "dt_ms", "desc_ms", "desc_id"))
    near = near.withColumn("_place", place).where(F.col("_place") <= 2 * most * most + most).drop("_place")
    order = ["asc_ms", "asc_id", "dt_ms", "desc_ms", "desc_id"]
    columns = ["track", "asc_id", "desc_id", "asc_ms", "desc_ms", "dt_ms"]
    schema = "track long, asc_id long, desc_id long, asc_ms long, desc_ms long, dt_ms long"

    def match(rows: list[dict]) -> list[dict]:
        later: dict = {}
        for r in rows:
            later.setdefault(r["asc_id"], []).append(r["desc_id"])
        want = min(most, matching_size(later, set()))
        chosen, taken = set(), set()
        for item in list(later) if want >= least else []:
            partners = later.pop(item)
            missing = want - len(chosen)
            if not missing:
                break
            fit = next((p for p in partners if p not in taken and matching_size(later, taken | {p}) >= missing - 1), None)
            if fit is not None:
                chosen.add((item, fit))
                taken.add(fit)
        return [r for r in rows if (r["asc_id"], r["desc_id"]) in chosen]

    def run(batches):
        for batch in batches:
            kept = [(track, r) for track, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in match(rows)]
            ids = {"track": [track for track, _ in kept]} | {c: [r[c] for _, r in kept] for c in columns[1:]}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in ids.items()})

    # A track is one short row, and rows are dealt over all tasks: by their bytes many tracks would be one task's.
    tracks = near.groupBy("track").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_rows"))
    return spread(tracks).mapInArrow(run, schema)


def surface_change(before: DataFrame, after: DataFrame, minimum: int = 64, angle: float = 1.5) -> DataFrame:
    """Pixels of both composites (log ratio lr, incidence inc): centred difference over the review threshold.

    Valid where all four values are there and incidences differ by at most
    ``angle``; with fewer than ``minimum`` valid pixels nothing is flagged.
    """
    b = before.select("row", "col", F.col("lr").alias("lr0"), F.col("inc").alias("inc0"))
    j = after.join(b, ["row", "col"]).where(F.abs(F.col("inc") - F.col("inc0")) <= angle)
    j = j.withColumn("delta", F.col("lr") - F.col("lr0")).where("delta is not null").withColumn("_all", F.lit(1))
    j = with_stats(j, {"_m": F.median("delta"), "_n": F.count("delta")}, ["_all"])
    j = j.withColumn("centred", F.abs(F.col("delta") - F.col("_m")))
    j = with_stats(j, {"_mad": F.median("centred"), "_p95": quantile("centred", 0.95)}, ["_all"])
    scale = F.greatest(F.col("_mad") * 1.4826, number(0.25))
    j = j.withColumns({"scale": scale, "threshold": F.greatest(number(1.0), scale * 3.0)})
    enough = F.col("_n") >= minimum
    return j.withColumns({
        "available": enough, "indicator": F.when(enough, F.col("centred") / F.col("threshold")), "flagged": enough & (F.col("centred") >= F.col("threshold"))}).drop("_all")


def change_summary(change: DataFrame) -> DataFrame:
    return change.agg(
        F.count(F.lit(1)).alias("valid"), F.sum(F.col("flagged").cast("int")).alias("flagged"), F.round(F.first("_m"), 6).alias("median_delta"),
        F.round(F.first("_p95"), 6).alias("p95"), F.round(F.first("scale"), 6).alias("scale"), F.round(F.first("threshold"), 6).alias("threshold"))


def residualize(df: DataFrame, y: str, design: list[str], key: str, coefficients: str | None = None) -> DataFrame:
    """Adds the least-squares residual of ``y`` on 1 and ``design`` within each ``key``, and the coefficients as an array if they have a name.

    The normal equations are sums; the system of one group is a small matrix that
    a vectorised function solves, one row a group.
    """
    cols = ["_one", *design]
    d = df.withColumn("_one", number(1))
    n = len(cols)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col(c) * F.col(y)).alias(f"r{i}") for i, c in enumerate(cols)]
    normal = d.groupBy(key).agg(*sums)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, beta array<double>"

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                out.append((r[key], np.linalg.lstsq(a, np.array([r[f"r{i}"] for i in range(n)], float), rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=[key, "beta"])

    fit = d.join(normal.mapInPandas(solve, schema), key)
    pred = sum((F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(cols)), number(0))
    fit = fit.withColumn("residual", F.col(y) - pred).drop("_one")
    return fit.withColumnRenamed("beta", coefficients) if coefficients else fit.drop("beta")


def cliffs_delta(df: DataFrame, x: str, side: str, key: str, width: float) -> DataFrame:
    """P(post > pre) - P(post < pre) of each key, from counts by value and two-level running sums (bins of ``width``, then values inside a bin)."""
    v = df.groupBy(key, F.col(x).alias("x")).agg(F.sum((F.col(side) == "pre").cast("long")).alias("pre"), F.sum((F.col(side) == "post").cast("long")).alias("post"))
    v = v.withColumn("_bin", F.floor(F.col("x") / width))
    bins = v.groupBy(key, "_bin").agg(F.sum("pre").alias("_pre"))
    bins = bins.withColumn("_before", F.sum("_pre").over(Window.partitionBy(key).orderBy("_bin")) - F.col("_pre"))
    v = v.join(bins.select(key, "_bin", "_before"), [key, "_bin"])
    below = F.col("_before") + F.sum("pre").over(Window.partitionBy(key, "_bin").orderBy("x")) - F.col("pre")
    v = v.withColumn("_below", below)
    t = v.groupBy(key).agg(F.sum("pre").alias("n_pre"), F.sum("post").alias("n_post"), F.sum(F.col("post") * F.col("_below")).alias("wins"), F.sum(F.col("post") * F.col("pre")).alias("ties"))
    all_ = F.col("n_pre") * F.col("n_post")
    return t.select(key, "n_pre", "n_post", F.try_divide((2 * F.col("wins") + F.col("ties") - all_).cast("double"), all_.cast("double")).alias("delta"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p values over all rows (one row a hypothesis)."""
    w = Window.orderBy(p, key)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    raw = F.least(number(1), F.col(p) * (n - F.row_number().over(w) + 1))
    return df.withColumn("_raw", raw).withColumn("adjusted", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def permutation_p(df: DataFrame, x: str, side: str, strata: str, key: str, permutations: int, seed: int) -> DataFrame:
    """Share (k + 1) / (n + 1) of label shuffles within strata whose absolute median shift reaches the observed one, by key.

    A key's rows are its monthly medians, a bounded series, handled in one group.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, observed double, p_value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([strata, side, x])
        v, post, group = pdf[x].to_numpy(float), (pdf[side] == "post").to_numpy(), pdf[strata].to_numpy()
        shift = lambda m: abs(np.median(v[m]) - np.median(v[~m])) if m.any() and (~m).any() else 0.0
        rng, seen = np.random.default_rng(seed), shift(post)
        rows = [np.flatnonzero(group == g) for g in np.unique(group)]
        hits = 0
        for _ in range(permutations):
            m = post.copy()
            for r in rows:
                m[r] = rng.permutation(m[r])
            hits += shift(m) >= seen - 1e-12
        return pd.DataFrame({key: [pdf[key].iloc[0]], "observed": [seen], "p_value": [(hits + 1) / (permutations + 1)]})

    return df.groupBy(key).applyInPandas(run, schema)
