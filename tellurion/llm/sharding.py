"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Every row gets a global number 0..n-1; a Feistel network with cycle walking
permutes the numbers; ``shard = p % shards`` and ``slot = p // shards``.  The
shuffle is reproducible from the seed and n alone, shard sizes differ by one row
at most (law ``rows``), and slots are gapless.

Defined results: null text has size 8 and CRC 0; null keys and repeated rows are
numbered like any other (identical rows are interchangeable); an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.sources.scratch import materialise

SHARDS = 24
SEED = 20240611
ROUNDS = 6
#: Rows to a numbering bucket, and the most buckets; both bound one sort.
BUCKET_ROWS = 512
MAX_BUCKETS = 1 << 16
#: Steps of cycle walking that are laid out in the expression (see ``permute``).
WALKS = 64
_M = 2147483647


def round_constants(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three positive 31-bit constants for each round, from a linear congruence."""
    out, x = [], seed % _M
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % _M
            row.append(x + 1)
        out.append(tuple(row))
    return out


def feistel_sides(n: int) -> tuple[int, int]:
    """The smallest a x b grid with a = ceil(sqrt n) that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _step(x: Column, n: int, seed: int) -> Column:
    """One pass of the network: the rounds are folded, so that each reads the halves once."""
    a, b = feistel_sides(n)
    long = lambda v: F.lit(v).cast("long")
    rounds = F.array(*[
        F.struct(long(k1).alias("k1"), long(k2).alias("k2"), long(k3).alias("k3"), F.lit(i % 2 == 0).alias("even"))
        for i, (k1, k2, k3) in enumerate(round_constants(seed))
    ])

    def one(acc, k):
        src = F.when(k["even"], acc["right"]).otherwise(acc["left"])
        mixed = ((src + k["k2"]) * k["k1"]) % _M * ((src + k["k3"]) % _M) % _M
        return F.struct(
            F.when(k["even"], (acc["left"] + mixed) % long(a)).otherwise(acc["left"]).alias("left"),
            F.when(k["even"], acc["right"]).otherwise((acc["right"] + mixed) % long(b)).alias("right"),
        )

    start = F.struct((x % long(a)).alias("left"), ((x - x % long(a)) / long(a)).cast("long").alias("right"))
    return F.aggregate(rounds, start, one, lambda acc: acc["left"] + acc["right"] * long(a))


def permute_py(x: int, n: int, seed: int = SEED) -> int:
    """The same permutation on one Python integer, for looking up a row's place."""
    a, b = feistel_sides(n)
    while True:
        left, right = x % a, x // a
        for i, (k1, k2, k3) in enumerate(round_constants(seed)):
            if i % 2 == 0:
                left = (left + ((right + k2) * k1) % _M * ((right + k3) % _M) % _M) % a
            else:
                right = (right + ((left + k2) * k1) % _M * ((left + k3) % _M) % _M) % b
        x = left + right * a
        if x < n:
            return x


def permute(row_no: Column, n: int, seed: int = SEED) -> Column:
    """Permute 0..n-1.

    The grid has fewer than a = ceil(sqrt n) numbers outside the range, so a walk
    of ``WALKS`` steps is enough for certain up to 4,000 rows; beyond, a walk of
    length k needs k hits on a set with a share under 1/sqrt(n), so 64 steps fail
    with odds below 1e-115.  A number that is still outside then raises an error.
    """
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        -row_no - 1,  # negative: not permuted yet
        lambda acc, _: F.when((acc >= 0) & (acc < n), acc).otherwise(_step(F.when(acc < 0, -acc - 1).otherwise(acc), n, seed)),
    )
    walked = F.aggregate(F.array(walked), F.lit(-1).cast("long"), lambda acc, x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return walked


def number_rows(narrow: DataFrame, keys: list[str], row_col: str = "row_no") -> tuple[DataFrame, int]:
    """Give the rows of ``narrow`` the numbers 0..n-1, in order of a hash bucket and then the keys.

    Identical rows are first counted (combined before the shuffle), so a row that
    makes up a third of the table is one row of the numbering; windows hold one
    bucket of about ``BUCKET_ROWS`` distinct rows.
    """
    n = narrow.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    counted = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", hashed.cast("int"))
    per = narrow.select(hashed.cast("int").alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_in"))
    starts = per.select("_b", (F.sum("_in").over(Window.orderBy("_b")) - F.col("_in")).alias("_start"))
    order = Window.partitionBy("_b").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    placed = counted.withColumn("_end", F.sum("_n").over(order)).join(F.broadcast(starts), "_b")  # at most MAX_BUCKETS rows
    first = F.col("_start") + F.col("_end") - F.col("_n")
    return placed.select(*keys, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(row_col)), n


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The text is read once; only 28 bytes a row are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialise(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")),
        "shard-rows",
    )
    numbered, n = number_rows(narrow, ["doc_id", "size", "text_crc32"])
    p = permute(F.col("row_no"), max(n, 1), seed)
    placed = numbered.select("doc_id", "size", "text_crc32", p.alias("p"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 24 shards under the law ``rows``."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
