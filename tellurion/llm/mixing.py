"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a 48-bit hash.  A source that is to give t words out of s gives
``t // s`` whole passes and, for the rest, the documents below a hash threshold.
The threshold is found from histograms: words by source and the hash's first 12
bits, then only the boundary bucket by the next 12 bits, and so on; no document
is sorted, and one scan of narrow rows follows each level.

Defined results: null text has size 0; null sources form one source, last in
order; documents with equal hash (same id and same text) are taken together; the
boundary group is taken if that comes nearer the target; a source without words
takes nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.sources.scratch import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEVEL_BITS = 12
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of an MD5 over the id and the text's MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit(":"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row a source (``source``, ``source_size``).

    The shares stop at the level where every source is at its weight times the
    level or at its cap; resharing again and again ends at the same level.  The
    table has one row a source, so its sort is small by nature.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    w = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(MOST)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_ratio", "_rank")
    before = F.sum("_cap").over(by) - F.col("_cap")
    left = F.sum("_w").over(Window.partitionBy()) - F.sum("_w").over(by) + F.col("_w")
    total = F.sum("source_size").over(Window.partitionBy())
    level = w.withColumn("_level", (total * F.lit(SHARE) - before) / left)
    water = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(Window.partitionBy())
    return level.withColumn("_water", water.getField("_level")).select(
        "source", "source_size",
        F.when(F.col("_water").isNull() | (F.col("_ratio") <= F.col("_water")), F.col("_cap")).otherwise(F.col("_w") * F.col("_water")).alias("target"),
    )


def thresholds(narrow: DataFrame) -> DataFrame:
    """source, source_size, target, passes, below: a document is taken ``passes`` times, once more if its hash is under ``below``.

    ``narrow`` has source, size, h.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = source_targets(sizes).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    plan = materialise(plan, "mix-targets")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = narrow if level == 0 else narrow.join(
            plan.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("_p")),
        )
        bins = inside.groupBy("source", F.shiftright("h", shift).alias("_bin")).agg(F.sum("size").alias("_size"))
        cum = bins.withColumn("_to", F.sum("_size").over(Window.partitionBy("source").orderBy("_bin")))
        hist = cum.select(F.col("source").alias("_s"), "_bin", (F.col("_to") - F.col("_size")).alias("_from"), "_to")
        at = plan.join(hist, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_from") <= F.col("rest")) & (F.col("rest") < F.col("_to")), "left")
        found = [
            F.coalesce(F.col("_bin"), F.lit(0)).cast("long").alias("prefix"),
            (F.col("rest") - F.coalesce(F.col("_from"), F.lit(0))).alias("rest"),
        ]
        if level == LEVELS - 1:
            nearer = F.col("rest") - F.col("_from") >= F.col("_to") - F.col("rest")
            found.append(F.coalesce(F.col("_bin") + nearer.cast("long"), F.lit(0)).cast("long").alias("below"))
        plan = materialise(at.select("source", "source_size", "target", "passes", *found), f"mix-level{level}")
    return plan.select("source", "source_size", "target", "passes", "below")


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; the text is read once."""
    narrow = materialise(_measured(docs), "mix-rows")
    plan = thresholds(narrow).withColumnRenamed("source", "_s")
    times = F.col("passes") + (F.col("h") < F.col("below")).cast("long")
    return narrow.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    narrow = materialise(_measured(docs), "mix-rows")
    plan = thresholds(narrow).select(F.col("source").alias("_s"), F.col("passes").alias("_passes"), F.col("below").alias("_below"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_of"), doc_hash(F.col("doc_id"), F.col("text")).alias("_h"))
    times = F.col("_passes") + (F.col("_h") < F.col("_below")).cast("long")
    taken = rows.join(plan, F.col("_of").eqNullSafe(F.col("_s"))).withColumn("_times", times).where("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed to 150% of its words at weights 3, 1, 2."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
