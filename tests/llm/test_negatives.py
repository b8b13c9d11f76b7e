"""Hard negatives against all products, with blocks and slices so small that every bound is used."""

from collections import Counter

import numpy as np
import pytest

from tellurion.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, q string, rid int"


def brute(rows):
    live = []
    for n, (v, label, x, *_) in enumerate(rows):
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        q = [int(np.floor(256 * float(np.float32(c)))) for c in x]
        live.append((n, v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, q))
    out = Counter()
    for n, v, label, q in live:
        if v is None or v % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r[3])), r[1] is None, r[1] or 0, r[0], r[2]) for r in live if r[0] != n)
        for s, unknown, p, *_ in [r for r in scored if r[4] == label][:5]:
            fits = [r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            for rank, r in enumerate(fits, 1):
                out[(v, None if unknown else p, rank, None if r[1] else r[2], -s, -r[0])] += 1
    return out


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def cases():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 24))
    close = [(i, int(rng.integers(0, 12)), [*map(float, (centre[i % 6] + 0.4 * rng.normal(size=24)))], "x", 1) for i in range(0, 900)]
    hot = [(1000 + i, i % 3, [0.5, -0.25, *[0.125] * 22], "x", 1) for i in range(400)]
    odd = [(None, 1, close[3][2], "x", 1), (100, 1, close[3][2], None, 1), (100, 1, close[3][2], None, 1), (200, None, close[1][2], "", 1), (300, 2, None, "", 1), (400, 2, [1.0, None], "", 1), (500, 2, [float("nan")], "", 1),
           (600, 2, [float("inf")], "", 1), (701, 2, [1.0, 2.0], "", 1), (800, 3, [], "", 1), (900, 2, [0.0] * 24, "", 1), (-700, 3, close[5][2], "", 1)]
    return {"close": close, "hot": close[:300] + hot, "odd": close[:150] + odd, "one": close[:1], "few": close[:4]}


@pytest.mark.parametrize("name", ["close", "hot", "odd", "one", "few"])
def test_equals_all_products(spark, tmp_path, monkeypatch, name):
    for k, v in {"ANCHORS": 3, "FIRST": 8, "MOST": 64, "PAIRS": 50}.items():
        monkeypatch.setattr(negatives, k, v)
    rows = cases()[name]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert found(negatives.op12_hard_negatives(spark, str(tmp_path))) == brute(rows)


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(5)
    rows, anchors = (np.floor(256 * rng.normal(size=(n, 32)) * 0.9 ** np.arange(32)).astype(np.int32) for n in (2000, 20))
    x = rows.astype(float)
    block = negatives.Block(anchors, np.linalg.eigh(x.T @ x)[1][:, ::-1])
    score = rows.astype(np.int64) @ anchors.T.astype(np.int64)
    low, high = np.sort(score, axis=0)[-5].astype(float), np.full(20, np.inf)
    y, rest = block.rotate(rows)
    i, j, s = block.survivors(rows, y, rest, np.arange(2000), np.arange(20), low, high)
    got = {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), s.tolist())}
    assert all(got[a, b] == score[a, b] for a, b in zip(*np.nonzero(score >= low)))
    assert len(got) < 300


def test_norms_too_large_take_no_part(spark):
    rows = [(0, 1, [1.0], "", 1), (1, 1, [3e38], "", 1), (2, 1, [1.0], "", 1), (3, 2, [0.9], "", 1)]
    got = found(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), negatives.F.col("vec_id") == 0))
    assert got == {(0, 2, 1, 3, 65536, 58880): 1}
