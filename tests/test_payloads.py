"""Payload walks against recursive Python versions on nested random payloads."""

import json
import os
import random
import re

from tellurion.operators import evidence, payloads

PATTERNS = [(re.compile(p), n) for p, n in evidence.REDACT]
PAIR = re.compile(evidence.PAIR)


def place(keys):
    return any(p in k for k in keys for p in payloads.PLACES)


def plausible(a, b):
    return abs(float(a)) <= 90 and abs(float(b)) <= 180


def clean(text, keys):
    for p, n in PATTERNS[:2]:
        text = p.sub(lambda m, n=n: n, text)
    if any(p.search(text) for p, _ in PATTERNS[2:]):
        return "[REDACTED_GEOMETRY]"
    return PAIR.sub(lambda m: evidence.PAIR_NAME if plausible(*m[0].split(",")) else m[0], text) if place(keys) else text


def walk(v, keys=(), found=None, path=""):
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            if k.lower() in payloads.FORBIDDEN or place(keys) and k.lower() in payloads.FORBIDDEN_IN_PLACES:
                found is not None and found.append((f"{path}.{k}", "key"))
            else:
                out[k] = walk(x, (*keys, k.lower()), found, f"{path}.{k}")
        return out
    if isinstance(v, list):
        if len(v) == 2 and place(keys) and all(isinstance(x, (int, float)) for x in v) and plausible(*v):
            found is not None and found.append((path, "coordinates"))
            return evidence.PAIR_NAME
        return [walk(x, keys, found, f"{path}#{i}") for i, x in enumerate(v)]
    if isinstance(v, str):
        t = clean(v, keys)
        t != v and found is not None and found.append((path, "text"))
        return t
    return v


def canon(v):
    if isinstance(v, dict):
        out = {k: canon(v[k]) for k in sorted(v) if not any(p in k.lower() for p in payloads.UNSTABLE)}
        if isinstance(out.get("features"), list):
            def role(f):
                p = f.get("properties", {}) if isinstance(f, dict) else {}
                for k in ("export_role", "name", "id"):
                    if isinstance(p, dict) and p.get(k) is not None:
                        return str(p[k])
                g = f.get("geometry", {}) if isinstance(f, dict) else {}
                return str(g.get("type") or "") if isinstance(g, dict) else ""
            out["features"].sort(key=role)
        return out
    if isinstance(v, list):
        return [canon(x) for x in v]
    return round(v, 8) if isinstance(v, float) else v


KEYS = ["name", "Location", "x", "y", "input", "path", "LAT", "geometry", "items", "run_id", "note", "center_point", "é\"\\", "a.b", "features", "properties", "type", "id", "updated_at_utc", "", "value"]
TEXTS = ["plain", "see /home/me/x.tif now", "C:\\data\\a.bin", "0123456789abcdef0123456789abcdef", "POINT (1 2)", "at 45.5, -120.25 and 95, 3", "45,190", "tab\t\"q\" \\ é 😀", "", "<Placemark>"]


def node(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {k: node(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 5))}
    if depth and kind < 0.6:
        return [node(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 7, -3, 45.5, 120.123456789123, 1e-9, 3.5e20, 2**40, [45.5, 100], [12, 300.5], [True, 2], [45.5, "x"], *TEXTS])


def docs():
    rng = random.Random(3)
    rows = [node(rng, 6) for _ in range(150)] + [{"features": [{"properties": {"name": n}, "v": 1.123456789} for n in "cab"] + [{"geometry": {"type": "Z"}}, {"properties": {"id": 5}}, 3]}, [], {}, 5, None, {"location": [[1, 2], [45.5, 100, 3]]}]
    return [json.dumps(r) for r in rows] + ["{bad", "", None, '{"a": 1, "a": 2}']


def frame(spark):
    return spark.createDataFrame([(i, d, "clash") for i, d in enumerate(docs())], "k int, doc string, text string").repartition(3)


def loaded(text):
    if not text or text == "{bad" or text == '{"a": 1, "a": 2}':
        return ...
    return json.loads(text)


def test_redaction_and_canonical_text(spark):
    for f, out, plain in ((payloads.redacted, "redacted", walk), (payloads.canonical, "canonical", canon)):
        rows = f(frame(spark), "doc").collect()
        assert len(rows) == len(docs())
        for r in rows:
            v = loaded(r.doc)
            if v is ...:
                assert r[out] is None
                continue
            want = canon(v) if plain is canon else plain(v)
            got = json.loads(r[out])
            assert near(got) == near(want), r.doc
            assert text_keys(r[out]) == sorted_keys(got)


def near(v):
    """Numbers with a fraction at eight digits, kinds told apart."""
    if isinstance(v, dict):
        return {k: near(x) for k, x in v.items()}
    if isinstance(v, list):
        return [near(x) for x in v]
    return ("f", round(v, 8)) if isinstance(v, float) else (type(v).__name__, v)


def text_keys(text):
    out = []
    json.loads(text, object_pairs_hook=lambda pairs: out.append([k for k, _ in pairs]) or dict(pairs))
    return out


def sorted_keys(v):
    out = []
    json.loads(json.dumps(v, sort_keys=True), object_pairs_hook=lambda pairs: out.append([k for k, _ in pairs]) or dict(pairs))
    return out


def test_violations(spark):
    got = sorted((r.k, r.path, r.rule) for r in payloads.violations(frame(spark), "doc").collect())
    want = []
    for i, d in enumerate(docs()):
        if loaded(d) is not ...:
            found = []
            walk(loaded(d), (), found)
            want += [(i, *f) for f in found]
    assert got == sorted(want) and len(want) > 100
    assert payloads.violations(payloads.redacted(frame(spark), "doc").drop("doc"), "redacted").count() == 0


def test_payloads_stay_where_they_lie(spark):
    """A payload is one row all the way: no exchange, and nothing written below the shared folder."""
    d = spark.range(20).selectExpr("id", """concat('{"location": {"at": [1, ', id, '], "note": "/home/u', id, '"}}') AS doc""")
    folder = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(folder))
    for f in (payloads.redacted, payloads.canonical, payloads.violations):
        out = f(d, "doc")
        assert out.count() > 0 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(folder)) == there


def test_numbers_and_texts_that_spark_fills_in(spark):
    cases = {
        '{"b": 1.50, "a": [12345678901234567890, 1e-9, -0.0, 9223372036854775807, 1e22]}': '{"a":[1.2345678901234567E19,0.0,0.0,9223372036854775807,1.0E22],"b":1.5}',
        r'["\ud800", "😀", "\u0001\u001f/"]': '["?","😀","\\u0001\\u001F/"]', "[" * 300 + "]" * 300: "[" * 300 + "]" * 300, '{"a": 1} x': '{"a":1}', "[NaN]": None, "01": None,
        '{"features": [{"properties": {"id": 2.5}}, {"properties": {"id": 10.0}}, {"properties": {"id": 1e999, "name": "z"}}, {"id": "z"}]}':
            '{"features":[{"properties":{"id":Infinity,"name":"z"}},{"id":"z"},{"properties":{"id":10.0}},{"properties":{"id":2.5}}]}'}
    d = spark.createDataFrame([(k,) for k in cases], "doc string")
    assert {r.doc: r.canonical for r in payloads.canonical(d, "doc").collect()} == cases
    odd = '{"ROI": {"n": "é 12, 99 /home/x", "m": "45, 99"}, "é": "ſ0123456789abcdef0123456789abcdef"}'
    r = payloads.redacted(spark.createDataFrame([(odd,)], "doc string"), "doc").first()
    assert r.redacted == '{"ROI":{"m":"[REDACTED_COORDS]","n":"é [REDACTED_COORDS] [REDACTED_PATH]"},"é":"ſ0123456789abcdef0123456789abcdef"}'
    found = payloads.violations(spark.createDataFrame([(odd,)], "doc string"), "doc").collect()
    assert {(v.path, v.rule) for v in found} == {(".ROI.m", "text"), (".ROI.n", "text")}
