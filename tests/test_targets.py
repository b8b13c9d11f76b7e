"""The score matrix against its own text evaluated by Python, on three kinds of pixels and odd ones."""

import math
import random

import numpy as np
import pytest

from tellurion.operators import targets

FEATURES = "metal void structure gold silver tunnel thermal doors mass pottery chemical".split()


def brute(row):
    env = dict(zip(FEATURES, row)) | {"one": 1.0}
    out, parts, forms = {}, {}, None
    for name, table in (("form", targets.FORM), ("content", targets.CONTENT), ("period", targets.PERIOD)):
        s = {}
        for line in table.strip().split("\n"):
            c, terms = line.split(":")
            s[c] = sum(float(t.split()[0]) * env[t.split()[1]] for t in terms.split(","))
        forms = forms or s
        e = {c: math.exp(v - max(s.values())) for c, v in s.items()}
        out[name] = max(e, key=e.get)
        parts[name] = 100 * e[out[name]] / sum(e.values())
    out["trap"] = max(forms[t] for t in targets.TRAPS) > np.percentile(list(forms.values()), 75)
    return out, parts, 0.55 * parts["form"] + 0.25 * parts["content"] + 0.2 * parts["period"]


def test_scores_of_all_classes(spark):
    rng = random.Random(7)
    rows = [[0.0] * 11, [3.0, 0, 0, 2.5, 1, 0, 0, 0, 2, 0, 0], [0, 3.0, 1, 0, 0, 2.5, 1, 1.5, 0, 0, 0], [0.1, 0, 3.0, 0, 0, 1, 0, 2, 1.5, 0, 0]] + [[rng.gauss(0, 1.5) for _ in FEATURES] for _ in range(300)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    assert {k: len(v) for k, v in targets.FAMILIES.items()} == {"form": 43, "content": 13, "period": 8}
    for r in targets.likely_targets(df).collect():
        want, parts, whole = brute(rows[r.id])
        assert (r.form, r.content, r.period, r.trap) == (want["form"], want["content"], want["period"], want["trap"])
        for k, v in parts.items():
            assert r[f"{k}_confidence"] == pytest.approx(v, abs=0.051)
        assert r.confidence == pytest.approx(whole, abs=0.051)


def test_missing_features(spark):
    df = spark.createDataFrame([(1, *[None] * 11), (2, None, *[1.0] * 10)], "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    a, b = targets.likely_targets(df).orderBy("id").collect()
    assert (a.content, a.content_confidence, a.period, a.trap) == ("محتوى غير محسوم", 100.0, "غير محسوم", False)
    assert a.form_confidence == round(100 / 43, 1) and b.form is not None and "metal" not in targets.FAMILIES["form"][b.form]
