"""Nested JSON payloads: redaction, its verification, and canonical text.

Spark parses a payload once, as a variant, to say whether it is JSON; a walk over its
members, however deep, is one vectorised function of the batch, as SQL has no recursion over
payloads of any form.  Rules drop members by key or change leaves; members are written in
order of their keys.  What Spark's own functions define stays theirs: the walk leaves holes
for numbers with a fraction and for texts beyond ASCII (whose words and cases Java takes
otherwise), and an expression fills them.  A payload is a row of its own all the way:
nothing is shuffled or written for it.

Defined results: a text that isn't JSON, or repeats a key of an object, has the result
NULL; JSON null, empty objects and empty lists stay; numbers with a fraction are doubles
of at most eight digits behind the point.
"""

from __future__ import annotations

import json
import math
import operator
import re
import sys
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.evidence import PAIR, PAIR_NAME, REDACT, _plausible

# Keys that never stay, keys that don't stay below a place, what speaks of a place, and parts of keys that change from run to run.
FORBIDDEN = (
    "lat latitude lon lng long longitude coords coordinates geometry geom bounds bbox extent crs epsg projection spatial_ref crs_transform crstransform transform origin "
    "ul_x ul_y lr_x lr_y pixel_size gsd hash sha sha256 md5 checksum fingerprint filesystem_path abs_path full_path path request_body raw_input traceback stacktrace exception_repr").split()
FORBIDDEN_IN_PLACES = ("x", "y", "input")
PLACES = "coord point center vertex bbox bounds geometry geom location roi lat lon utm crs transform origin".split()
UNSTABLE = "timestamp created_at updated_at captured_at run_id sha hash checksum fingerprint path drive".split()
DIGITS = 8
#: Stands in a walk's text for what Spark fills in; JSON text holds no control characters.
HOLE = "\x01"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions)


def clean_text(text: Column, place: Column) -> Column:
    """A text without paths and digests, as a whole replaced if it holds geometry, and without plausible coordinate pairs below a place."""
    for pattern, name in REDACT[:2]:
        text = F.regexp_replace(text, pattern, name)
    pairs = F.transform(F.regexp_extract_all(text, F.lit(f"({PAIR})"), F.lit(1)), lambda p: F.when(_plausible(p), F.lit(PAIR_NAME)).otherwise(p))
    without = F.array_join(F.zip_with(F.split(text, PAIR), pairs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    geometry = any_of(text.rlike(p) for p, _ in REDACT[2:])
    return F.when(geometry, REDACT[2][1]).when(place, without).otherwise(text)


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


# ---- the walk ---------------------------------------------------------------------------------

_PATHS, _HASHES, _SHAPES, _TYPES = (re.compile(p, re.ASCII) for p, _ in REDACT)
_PAIRS = re.compile(PAIR, re.ASCII)
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('\b\t\n\f\r"\\', 'btnfr"\\')}


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


class About(NamedTuple):
    """What a key says."""

    forbidden: bool
    forbidden_in_places: bool
    place: bool
    unstable: bool
    quoted: str


@lru_cache(1 << 12)
def _about(key: str) -> About:
    k = key.lower()
    return About(k in FORBIDDEN, k in FORBIDDEN_IN_PLACES, any(p in k for p in PLACES), any(p in k for p in UNSTABLE), _quoted(key))


def forbidden(key: About, place: bool) -> bool:
    """Whether a member with this key goes; ``place``: an ancestor's key speaks of a place."""
    return key.forbidden or place and key.forbidden_in_places


def unstable(key: About, place: bool) -> bool:
    return key.unstable


class Form(NamedTuple):
    """How a payload is written anew: the members that go, whether leaves are redacted, and whether features are put in order."""

    drop: Callable[[About, bool], bool]
    redact: bool
    features: bool


REDACTED, CANONICAL = Form(forbidden, True, False), Form(unstable, False, True)


def _integer(text: str) -> int | float:
    """Integers of 64 bits; others are doubles, as Spark has it."""
    n = int(text)
    return n if -(2**63) <= n < 2**63 else float(text)


_DECODER = json.JSONDecoder(parse_int=_integer)


def _parsed(payload: str):
    """The value at the start of a text that Spark takes for JSON; halves of characters become question marks, as in Java's UTF-8."""
    value, _ = _DECODER.raw_decode(payload.lstrip(" \t\n\r"))
    if _SURROGATE.search(payload):
        value = _DECODER.decode(json.dumps(value, ensure_ascii=False).encode("utf-8", "replace").decode())
    return value


def _is_pair(v: list) -> bool:
    return len(v) == 2 and isinstance(v[0], (int, float)) and isinstance(v[1], (int, float)) and abs(v[0]) <= 90 and abs(v[1]) <= 180


def _pair_name(m: re.Match) -> str:
    a, b = m[0].split(",")
    return PAIR_NAME if abs(float(a)) <= 90 and abs(float(b)) <= 180 else m[0]


def _clean(text: str, place: bool) -> str:
    """``clean_text`` of an ASCII text; a pattern is tried where a character that it needs is there."""
    if "/" in text or ":\\" in text:
        text = _PATHS.sub(REDACT[0][1], text)
    if len(text) >= 32:
        text = _HASHES.sub(REDACT[1][1], text)
    if "(" in text and _SHAPES.search(text) or ('"' in text or "<" in text) and _TYPES.search(text):
        return REDACT[2][1]
    return _PAIRS.sub(_pair_name, text) if place and "," in text else text


def _number_name(x: float) -> str:
    """A number with a fraction as the text of a name: at most eight digits, no zeros at the end, powers of ten as Java's."""
    x = float(Decimal(repr(x)).quantize(Decimal(10) ** -DIGITS, ROUND_HALF_UP, Context(prec=400))) if abs(x) < 1e300 else x
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return f"{Decimal(repr(x)).normalize():f}"
    sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
    digits = "".join(map(str, digits))
    return f"{'-' * sign}{digits[0]}.{digits[1:] or '0'}E{power + len(digits) - 1}"


def _name(v) -> str | None:
    """A member's value as the text by which features are ordered."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return _number_name(v)
    holes = []
    text = _written(v, False, None, CANONICAL, holes).split(HOLE)
    return "".join(t + n for t, n in zip(text, [*(_number_name(h[0]) for h in holes), ""]))


def _role(feature) -> str:
    """A feature's role, name or id, or its geometry's type."""
    of = lambda k: v if isinstance(feature, dict) and isinstance(v := feature.get(k), dict) else {}
    p = of("properties")
    for k in ("export_role", "name", "id"):
        if p.get(k) is not None:
            return _name(p[k])
    return _name(of("geometry").get("type")) or ""


def _written(v, place: bool, key: str | None, form: Form, holes: list) -> str:
    """JSON text of a value; ``place``: its key or an ancestor's speaks of a place. What Spark fills in is added to ``holes``: a number, or a text and its place."""
    kind = type(v)
    if kind is str:
        if form.redact and not v.isascii():
            holes.append((None, v, place))
            return HOLE
        return _quoted(_clean(v, place) if form.redact else v)
    if kind is float:
        holes.append((v, None, None))
        return HOLE
    if kind is dict:
        members = []
        for k in sorted(v):
            about = _about(k)
            if not form.drop(about, place):
                members.append(f"{about.quoted}:{_written(v[k], place or about.place, k, form, holes)}")
        return "{" + ",".join(members) + "}"
    if kind is list:
        if form.redact and place and _is_pair(v):
            return _quoted(PAIR_NAME)
        if form.features and key == "features":
            members = []
            for x in v:
                own = []
                text = _written(x, place, None, form, own)
                members.append((_role(x) if all(math.isfinite(h[0]) for h in own) else "", len(members), text, own))  # no JSON holds an infinite number
            members.sort()
            holes += [h for m in members for h in m[3]]
            return "[" + ",".join([m[2] for m in members]) + "]"
        return "[" + ",".join([_written(x, place, None, form, holes) for x in v]) + "]"
    return "null" if v is None else str(v).lower()


def _found(v, place: bool, path: str, out: list) -> None:
    """Adds to ``out`` path and rule of what redaction takes or changes, or path, text and place of a text beyond ASCII."""
    if isinstance(v, str):
        if not v.isascii():
            out.append((path, None, v, place))
        elif _clean(v, place) != v:
            out.append((path, "text", None, None))
    elif isinstance(v, dict):
        for k, x in v.items():
            about = _about(k)
            if forbidden(about, place):
                out.append((f"{path}.{k}", "key", None, None))
            else:
                _found(x, place or about.place, f"{path}.{k}", out)
    elif isinstance(v, list):
        if place and _is_pair(v):
            out.append((path, "coordinates", None, None))
        else:
            for i, x in enumerate(v):
                _found(x, place, f"{path}#{i}", out)


def _lists(rows: list[list[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """A list of structs for every row."""
    flat = list(zip(*[r for row in rows for r in row])) or [()] * len(names)
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types)], names))


def _deep() -> None:
    """Spark's parser goes 1,000 levels deep, with three frames of a walk each at most."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))


def _walked(form: Form):
    def walk(payloads: pa.Array) -> pa.Array:
        _deep()
        texts, holes = [], []
        for p in payloads.to_pylist():
            own = []
            texts.append(None if p is None else _written(_parsed(p), False, None, form, own))
            holes.append(own)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), _lists(holes, ["number", "raw", "place"], [pa.float64(), pa.string(), pa.bool_()])], ["text", "holes"])

    walk.__annotations__ = {"payloads": pa.Array, "return": pa.Array}
    return F.arrow_udf(walk, "text string, holes array<struct<number:double,raw:string,place:boolean>>")


def _searched():
    def search(payloads: pa.Array) -> pa.Array:
        _deep()
        rows = []
        for p in payloads.to_pylist():
            rows.append([])
            if p is not None:
                _found(_parsed(p), False, "", rows[-1])
        return _lists(rows, ["path", "rule", "raw", "place"], [pa.string(), pa.string(), pa.string(), pa.bool_()])

    search.__annotations__ = {"payloads": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "array<struct<path:string,rule:string,raw:string,place:boolean>>")


# ---- queries' functions -----------------------------------------------------------------------


def _json(payload: str) -> Column:
    """The payload where Spark takes it for JSON, else NULL."""
    return F.when(F.try_parse_json(payload).isNotNull(), F.col(payload))


def _rewritten(df: DataFrame, payload: str, out: str, form: Form) -> DataFrame:
    def filled(h: Column) -> Column:
        number = F.round(h["number"], DIGITS).cast("string")
        return F.when(h["raw"].isNotNull(), quoted(clean_text(h["raw"], h["place"]))).otherwise(number) if form.redact else number

    w = df.withColumn("_w", _walked(form)(_json(payload)))
    pieces = F.zip_with(F.split(F.col("_w.text"), HOLE), F.col("_w.holes"), lambda t, h: F.concat(t, F.coalesce(filled(h), F.lit(""))))
    return w.withColumn(out, F.array_join(pieces, "")).drop("_w")


def redacted(df: DataFrame, payload: str, out: str = "redacted") -> DataFrame:
    """Adds the payload without forbidden members, coordinate pairs, paths, digests and geometry, keys in order."""
    return _rewritten(df, payload, out, REDACTED)


def canonical(df: DataFrame, payload: str, out: str = "canonical") -> DataFrame:
    """Adds the payload's canonical text: keys in order, members that change from run to run left out, numbers at eight digits, features in their order."""
    return _rewritten(df, payload, out, CANONICAL)


def violations(df: DataFrame, payload: str) -> DataFrame:
    """The columns of ``df`` with path and rule (``key``, ``coordinates`` or ``text``) of everything that redaction would take or change; members below a forbidden key are not looked at."""
    f = df.withColumn("_f", F.explode(_searched()(_json(payload))))
    changed = F.when(clean_text(F.col("_f.raw"), F.col("_f.place")) != F.col("_f.raw"), "text")
    return f.withColumns({"path": F.col("_f.path"), "rule": F.coalesce("_f.rule", changed)}).where("rule is not null").drop("_f")
