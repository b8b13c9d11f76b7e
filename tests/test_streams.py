"""Streams file by file: late and repeated rows, and equality with the batch."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tellurion.streaming import events as st

START = datetime(2024, 1, 1)


def files(spark, folder, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(k, START + timedelta(hours=h), track, kind, 1.5, "{}") for k, h, track, kind in rows], st.SCHEMA)
        df.toPandas().assign(ts=lambda d: d.ts.astype("datetime64[us]")).to_parquet(f"{folder}/part{i}.parquet")
        os.utime(f"{folder}/part{i}.parquet", (1_700_000_000 + 60 * i,) * 2)


def test_windows_drop_repeats_and_late_rows(spark, tmp_path):
    files(spark, tmp_path, [[(1, 1, 7, "view"), (2, 2, 7, "view"), (2, 2, 7, "view")], [(2, 2, 7, "view"), (3, 30, 7, "click"), (4, 20, 7, "view")], [(6, 31, 7, "click")], [(5, 3, 7, "view")]])
    stream = st.windowed(st.read_events(spark, str(tmp_path), "*.parquet", 1))
    got = {(r.window.start, r.event_type): (r.n, r.v) for r in st.run_to_latest(stream, ["window", "event_type"]).collect()}
    # 5 comes when the watermark (that of the batch before) is at hour 28: its day is over.
    assert got == {(START, "view"): (3, 4500), (START + timedelta(days=1), "click"): (2, 3000)}


def test_pairs_equal_the_batch(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, i * 0.7 + rng.uniform(-0.5, 0.5), rng.randrange(4), rng.choice(["view", "click", "buy"])) for i in range(240)]
    files(spark, tmp_path, [rows[i : i + 60] for i in range(0, 240, 60)])
    pairs = st.run_to_files(st.paired(st.read_events(spark, str(tmp_path), "*.parquet", 1), 12))
    got = sorted((r.track, r.asc_id, r.desc_id) for r in pairs.collect())
    want = sorted((a[2], a[0], d[0]) for a in rows for d in rows if a[3] == "view" and d[3] == "click" and a[2] == d[2] and abs(a[1] - d[1]) <= 12)
    assert got == want and len(got) > 100


def test_no_files(spark, tmp_path):
    stream = st.windowed(st.read_events(spark, str(tmp_path), "*.parquet"))
    assert st.run_to_latest(stream, ["window", "event_type"]).agg(F.count(F.lit(1))).first()[0] == 0
