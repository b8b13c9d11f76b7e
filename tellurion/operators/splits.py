"""Whole groups to splits with exact numbers of rows, and what leaks between splits.

The groups of a source come in the order of a hash of seed, source and group.  A split
takes, in that order, every group that fits what it still lacks; what it leaves is
offered to the next split.  As a split's choice depends on earlier groups only, all
splits are filled in one pass: the state is one number a split.  Sources are sorted
streams of narrow rows (one a group), so a source of any size needs no memory beyond
that state; the rows themselves are never gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def group_order(seed: int, source: Column, group: Column) -> Column:
    """The hash by which a source's groups are taken."""
    return F.sha2(F.encode(F.concat(F.lit(f"{seed}|"), source.cast("string"), F.lit("|"), group.cast("string")), "UTF-8"), 256)


def exact_splits(groups: DataFrame, targets: DataFrame, seed: int, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """``groups`` (source, grp, n) with split: the one that takes the group, NULL if none has room.

    ``targets`` has source and one column of rows for each split.  Groups of sources
    without targets, NULL groups and NULL targets (a split that takes nothing) get no
    split; groups must be told apart by (source, grp).
    """
    wanted = targets.select(F.col("source").alias("_s"), F.array(*[F.coalesce(F.col(n).cast("long"), F.lit(0)) for n in names]).alias("_want"))
    d = groups.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_h", group_order(seed, F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("grp")))
    d = d.repartition("source").sortWithinPartitions("source", "_h", "grp")
    columns, schema = groups.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)

    def fill(batches):
        source, left = object(), []
        for b in batches:
            taken = []
            for s, g, n, want in zip(*(b.column(c).to_pylist() for c in ("source", "grp", "n", "_want"))):
                if s != source:
                    source, left = s, list(want or [])
                place = next((i for i, room in enumerate(left) if n <= room), None) if g is not None and n else None
                if place is not None:
                    left[place] -= n
                taken.append(None if place is None else names[place])
            kept = b.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(taken, pa.string())], names=[*kept.schema.names, "split"])

    return d.mapInArrow(fill, f"{schema}, split string")


def split_report(assigned: DataFrame, targets: DataFrame, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """source, split, target, rows, groups, short (target less rows) and exact, for every split of every source; a NULL split has what no split took."""
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.coalesce(F.col(n).cast("long"), F.lit(0)).alias("target")) for n in names], F.struct(F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("target"))))
    want = targets.select("source", lines.alias("_l")).select("source", "_l.*")
    got = assigned.groupBy(F.col("source").alias("_s"), F.col("split").alias("_p")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))
    d = want.join(got, F.col("source").eqNullSafe(F.col("_s")) & F.col("split").eqNullSafe(F.col("_p")), "left").drop("_s", "_p").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "groups")})
    return d.withColumn("short", F.col("target") - F.col("rows")).withColumn("exact", F.col("short") == 0)


def leakage_report(rows: DataFrame, split: str, group: str, keys: list[str]) -> DataFrame:
    """One row: rows checked, groups in more than one split, and for each of ``keys`` the repeats of values (NULL and empty ones don't count) and the values in more than one split."""
    spread = lambda c: rows.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("splits"))
    out = rows.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(F.col(split).isNull()).alias("unassigned"))
    out = out.crossJoin(F.broadcast(spread(group).agg(F.count_if(F.col("splits") > 1).alias("leaking_groups"))))  # one row by one row
    for k in keys:
        out = out.crossJoin(F.broadcast(spread(k).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"repeated_{k}"), F.count_if(F.col("splits") > 1).alias(f"leaking_{k}"))))
    return out.withColumn("leaks", F.col("leaking_groups") > 0)
