"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Measures are column expressions over the whole text; ``RULES`` names a measure, a
bound and its direction, and the verdict is the conjunction of the rows.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows are judged each; an empty table gives an empty result; very long
texts are measured whole (time n log n in the words); other columns of the table
are kept by ``judge`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the corpus' four languages.
STOP_WORDS = (
    "the of and to in a is that it on for was as with be by this are at from or an not but have he she they we you his her "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "el los las y una por con no para su al lo como más o pero sus le ha me si sin sobre este ya entre"
).split()

#: measure, direction, bound: a text is kept while every measure is on the right side.
#: Ratios are in percent of words unless said otherwise; the bounds leave a wide margin
#: to ordinary prose and are far from symbol soup, shouting, tables and boilerplate.
RULES: tuple[tuple[str, str, float], ...] = (
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 14.0),
    ("symbol_percent", "<=", 20.0),
    ("stop_percent", ">=", 2.0),
    ("dup_line_percent", "<=", 50.0),
    ("shout_percent", "<=", 50.0),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for name, direction, bound in rules:
        out = out & (F.col(name) >= bound if direction == ">=" else F.col(name) <= bound)
    return out


def covered_words(hashes: Column, n_words: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order.

    Equal hashes are found by sorting (hash, place); the places, in order, then
    cover min(8, distance to the next) words each.
    """
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    in_order = F.array_sort(placed)

    def twice(x, i):
        same = lambda k: F.coalesce(F.get(in_order_col, k).getField("h") == x["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    in_order_col = F.col("_sorted")
    places = F.array_sort(F.transform(F.filter(in_order_col, twice), lambda x: x["i"]))
    ends = F.concat(F.slice(F.col("_places"), 2, F.greatest(F.size("_places") - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    cover = F.aggregate(F.zip_with(F.col("_places"), ends, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    return in_order, places, cover


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of every whole text, prefixed columns dropped again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.col("_text"), SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    length = lambda x: F.length(x).cast("long")
    n = F.size("_words").cast("long")
    pair = lambda a, step: F.zip_with(
        F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    df = docs.withColumn("_text", text).withColumn("_words", words).withColumn("_lines", lines)
    df = df.select(
        *docs.columns,
        n.alias("n_words"),
        length(F.translate(F.col("_text"), " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (length(F.col("_text")) - length(F.translate(F.col("_text"), SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    df = df.withColumn("_h2", pair(F.col("_h1"), 1)).drop("_h1").withColumn("_h4", pair(F.col("_h2"), 2)).drop("_h2").withColumn("_h8", pair(F.col("_h4"), 4)).drop("_h4")
    repeats = F.size("_h8") > F.size(F.array_distinct("_h8"))
    df = df.withColumn("_h8", F.when(repeats, F.col("_h8")))  # null where every window is unlike the others
    in_order, places, cover = covered_words(F.col("_h8"), F.col("n_words"))
    df = df.withColumn("_sorted", in_order).drop("_h8").withColumn("_places", places).drop("_sorted")
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("_places")
    return df.withColumns({
        "mean_word_chars": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0)),
        "symbol_percent": _percent(F.col("n_symbols"), F.col("n_words")),
        "stop_percent": _percent(F.col("n_stop"), F.col("n_words")),
        "dup_line_percent": _percent(F.col("n_dup_lines"), F.col("n_lines")),
        "shout_percent": _percent(F.col("n_upper"), F.col("word_chars")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def _kept(rules) -> Column:
    """The verdict.

    A filter on it would be pushed below the measures with their expressions copied
    into it, one into the next; a column that also reads a row number keeps filters
    above itself, and every measure is computed once.
    """
    return ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the counts, base_failed and kept; columns of those names are replaced."""
    names = {*COUNTS, "base_failed", "kept", "n_lines", "n_stop", "n_upper", *(r[0] for r in rules)}
    own = [c for c in docs.columns if c not in names]
    m = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "text"))
    return m.select("_row.*", *COUNTS, "base_failed", _kept(rules).alias("kept"))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    m = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    return m.select("_row", _kept(rules).alias("_ok")).where("_ok").select("_row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The verdict on every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")
