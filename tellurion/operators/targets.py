"""Likely targets of focus pixels: a matrix of scores, shares within families, and a warning.

The table of weights (class x feature) is a constant of the plan: a row's scores are one
projection, so nothing is shuffled.  Within a family the classes share one by the
exponentials of their scores; the first class of the largest share wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.columns import number

# Classes of each family in order, with their weights; ``one`` is the constant.
FORM = """
ناووس: 1.35 structure, 1.10 mass, 0.25 metal, -0.15 void
تابوت: 1.20 structure, 0.95 mass, 0.35 metal
ران: 1.30 metal, 1.00 mass, 0.30 structure
صندوق: 1.35 metal, 0.95 mass, 0.20 doors
صناديق متراكبة عمودية: 1.20 metal, 1.10 mass, 0.65 structure
صناديق متراكبة أفقية: 1.15 metal, 1.05 mass, 0.60 structure
جرة فخارية: 1.20 pottery, 0.55 metal, 0.20 thermal
جرار فخارية: 1.25 pottery, 0.65 mass, 0.20 structure
غرفة: 1.20 void, 1.10 structure, 0.55 mass
غرفة تكنيزية: 1.10 void, 1.15 structure, 0.95 metal, 0.75 mass
غرفة بقايا عضوية: 1.00 void, 0.75 thermal, 0.55 pottery, 0.35 chemical
سرداب: 1.35 void, 1.10 tunnel, 0.55 structure
ممر: 1.20 void, 1.15 tunnel, 0.45 doors
مدخل: 1.30 structure, 1.15 doors, 0.55 void
باب: 1.25 structure, 1.20 doors, 0.35 mass
باب سري: 1.35 doors, 1.10 structure, 0.40 void
جب: 1.30 void, 0.85 thermal, 0.35 doors
بئر جانبي سفلي: 1.35 void, 0.90 thermal, 0.45 tunnel
درج مستقيم: 1.20 structure, 0.95 void, 0.40 thermal
درج لولبي: 1.30 structure, 1.00 void, 0.55 thermal, 0.20 doors
قبر شمسي: 1.10 structure, 0.95 mass, 0.45 thermal
قبر ملكي: 1.25 structure, 1.05 mass, 0.75 metal, 0.35 void
قبر روماني: 1.15 structure, 0.95 mass, 0.40 pottery
قبر بيزنطي: 1.10 structure, 0.90 mass, 0.45 thermal, 0.30 pottery
دفين يوناني: 1.10 metal, 0.85 mass, 0.35 pottery
دفين عثماني: 1.20 metal, 0.80 silver, 0.35 mass
دفين غرفة: 1.05 void, 1.00 structure, 0.90 metal, 0.70 mass
تمثال: 1.10 mass, 0.85 metal, 0.30 structure
سبائك: 1.35 metal, 1.05 gold, 0.65 mass
عملات: 1.15 metal, 1.00 silver, 0.35 pottery
زجاج: 0.95 pottery, 0.35 thermal, 0.15 metal
أحجار كريمة: 1.05 gold, 0.65 chemical, 0.25 metal
زئبق أحمر: 1.15 chemical, 0.85 thermal, 0.35 metal
زئبق أسود: 1.20 chemical, 0.95 void, 0.20 thermal
أسلحة أثرية: 1.15 metal, 0.95 mass, 0.30 structure
سيف: 1.10 metal, 0.85 mass, 0.20 structure
درع: 1.05 metal, 0.95 mass, 0.25 structure
خوذة: 1.00 metal, 0.85 mass, 0.20 thermal
ترس: 1.00 metal, 0.90 mass, 0.20 structure
مسدس عثماني: 1.20 metal, 0.80 silver, 0.45 mass
فخ سلك معدني: 1.10 metal, 0.95 structure, 0.25 doors
بلاطة منزلقة: 1.25 structure, 0.85 doors, 0.35 mass
فخ غير محدد: 1.00 structure, 0.90 void, 0.35 doors
"""
CONTENT = """
ذهب: 1.35 gold, 0.55 metal
فضة: 1.25 silver, 0.45 metal
نحاس: 0.95 metal, 0.35 silver, 0.15 mass
معادن مختلطة: 1.00 metal, 0.45 silver, 0.35 mass
فخار: 1.30 pottery, 0.20 thermal
زجاج: 1.10 pottery, 0.30 thermal
أحجار كريمة: 1.10 chemical, 0.55 gold
زئبق أحمر: 1.25 chemical, 0.85 thermal
زئبق أسود: 1.20 chemical, 0.90 void
كتلة حجرية: 1.15 mass, 0.75 structure
بقايا عضوية: 0.95 thermal, 0.75 pottery, 0.35 chemical
فراغ صرف: 1.30 void, 0.25 tunnel
محتوى غير محسوم: 0.20 one
"""
PERIOD = """
دفن روماني: 1.10 structure, 0.85 mass, 0.35 pottery
دفن بيزنطي: 1.05 structure, 0.80 mass, 0.35 thermal
دفن عثماني: 1.00 metal, 0.75 silver, 0.30 mass
دفن يوناني: 0.95 metal, 0.70 pottery, 0.30 mass
دفن أيّوبي: 0.95 structure, 0.70 mass, 0.25 thermal
دفن آشوري: 1.05 structure, 0.85 mass, 0.20 metal
دفن يهودي: 0.90 structure, 0.70 mass, 0.20 thermal
غير محسوم: 0.25 one
"""
# Classes that warn, the share of forms they must be over, and the weights of the confidences.
TRAPS = ("فخ سلك معدني", "بلاطة منزلقة", "فخ غير محدد")
TRAP_QUANTILE = 0.75
CONFIDENCE = {"form": 0.55, "content": 0.25, "period": 0.20}


def parsed(table: str) -> dict[str, dict[str, float]]:
    """Class -> feature -> weight."""
    out = {}
    for line in table.strip().splitlines():
        name, terms = line.split(": ")
        out[name] = {f: float(w) for w, f in (t.split(" ") for t in terms.split(", "))}
    return out


FAMILIES = {"form": parsed(FORM), "content": parsed(CONTENT), "period": parsed(PERIOD)}


def scores(family: dict[str, dict[str, float]]) -> Column:
    """The array of a family's scores, from columns named like the features."""
    value = lambda w, f: number(w) if f == "one" else number(w) * F.col(f)
    return F.array(*[reduce(lambda a, b: a + b, (value(w, f) for f, w in terms.items())) for terms in family.values()])


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shares(of: Column) -> Column:
    """Each score's part of the sum of exponentials; scores that aren't finite count as very low, and all parts are equal if none is."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    safe = F.transform(of, lambda x: F.when(finite(x), x).otherwise(number(-9999)))
    powers = let(safe, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(powers, lambda v: let(F.aggregate(v, number(0), lambda s, y: s + y), lambda t: F.transform(v, lambda x: x / t)))


def quantile_of(values: Column, n: int, q: float) -> Column:
    """The interpolated quantile of an array of ``n`` numbers."""
    at = q * (n - 1)
    low = int(at)
    ordered = F.array_sort(values)
    a, b = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(min(low + 1, n - 1)))
    return a + (b - a) * (at - low)


def likely_targets(rows: DataFrame) -> DataFrame:
    """Adds form, content and period, the first class with the largest share of its family, their confidences and the whole one in percent, and trap.

    ``rows`` has the columns metal, void, structure, gold, silver, tunnel, thermal,
    doors, mass, pottery and chemical; with a NULL among them the classes it weighs in
    have the lowest score.  trap: a warning class scores over three quarters of the
    forms' scores.
    """
    d = rows
    for name, family in FAMILIES.items():
        d = d.withColumn(f"_{name}", scores(family)).withColumn(f"_{name}_s", shares(F.col(f"_{name}")))
        top = F.array_max(f"_{name}_s")
        label = F.element_at(F.array(*[F.lit(c) for c in family]), F.array_position(F.col(f"_{name}_s"), top).cast("int"))
        d = d.withColumns({name: label, f"{name}_confidence": 100.0 * top})
    places = list(FAMILIES["form"])
    warns = F.greatest(*[F.get("_form", F.lit(places.index(t))) for t in TRAPS])
    total = reduce(lambda a, b: a + b, (number(w) * F.col(f"{n}_confidence") for n, w in CONFIDENCE.items()))
    d = d.withColumns({"trap": F.coalesce(warns > quantile_of(F.col("_form"), len(places), TRAP_QUANTILE), F.lit(False)), "confidence": F.round(total, 1)})
    d = d.withColumns({f"{n}_confidence": F.round(f"{n}_confidence", 1) for n in FAMILIES})
    return d.drop(*[f"_{n}{s}" for n in FAMILIES for s in ("", "_s")])
