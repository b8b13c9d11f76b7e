"""Exact splits against the splits filled one after the other."""

import hashlib
import random

from pyspark.sql import functions as F

from tellurion.operators import splits


def one_by_one(groups, targets, seed):
    out = {}
    for source in {s for s, _, _ in groups}:
        own = sorted((hashlib.sha256(f"{seed}|{source or ''}|{g}".encode()).hexdigest(), g, n) for s, g, n in groups if s == source and g is not None)
        for split, room in zip(splits.SPLITS, targets.get(source, (0, 0, 0))):
            for _, g, n in own:
                if (source, g) not in out and n <= (room or 0):
                    out[source, g] = split
                    room -= n
    return out


def test_filled_exactly_as_one_split_after_the_other(spark):
    rng = random.Random(1)
    groups = [(s, f"g{i}", rng.choice([1, 1, 2, 3, 5, 40])) for s in ("a", "b", "c", None, "none") for i in range(rng.randint(30, 120))] + [("a", None, 7), ("a", "late", 10**6)]
    targets = {"a": (150, 40, 30), "b": (60, 60, 10**7), "c": (1, 0, None), None: (25, 25, 25)}
    frame = spark.createDataFrame(groups, "source string, grp string, n long").withColumn("_want", F.lit(1)).repartition(5)
    want = spark.createDataFrame([(s, *t) for s, t in targets.items()], "source string, train long, val long, test long")
    rows = splits.exact_splits(frame.drop("_want"), want, 17)
    got = {(r.source, r.grp): r.split for r in rows.collect()}
    plain = one_by_one(groups, targets, 17)
    assert {k: v for k, v in got.items() if v} == plain and len(got) == len(groups)
    report = {(r.source, r.split): r for r in splits.split_report(rows, want).collect()}
    for s, t in targets.items():
        for split, target in zip(splits.SPLITS, t):
            n = sum(x for a, g, x in groups if a == s and plain.get((a, g)) == split)
            r = report[s, split]
            assert (r.target, r["rows"], r.short, r.exact) == (target or 0, n, (target or 0) - n, n == (target or 0))
    assert report["a", "train"].exact and not report["b", "test"].exact and report["a", None]["rows"] >= 10**6


def test_leakage(spark):
    rows = [("g1", "train", "s1", "c1"), ("g1", "val", "s2", ""), ("g2", "train", "s1", None), ("g2", "train", "s1", "c2"), ("", "test", None, ""), ("g3", None, "s9", "c9")]
    r = splits.leakage_report(spark.createDataFrame(rows, "grp string, split string, sample string, chip string"), "split", "grp", ["sample", "chip"]).first()
    assert (r.rows_checked, r.unassigned, r.leaking_groups, r.repeated_sample, r.leaking_sample, r.repeated_chip, r.leaks) == (6, 1, 1, 2, 0, 0, True)
