"""Hard negatives of anchors, by partial products along principal axes.

Components become integers, floor(256 * x), and a score is the integer inner product.
An anchor's positives are the best rows of its label; for each of them the best rows
of other labels are taken whose score is at most the positive's and at least
``SHARE`` of it.

Search.  The orthogonal axes are those of the second moments of all rows, largest
first (a rotation leaves products as they are).  A block of anchors is sent to all
tasks; a task adds up the products of the leading components, stage by stage, and
bounds the rest by the product of the residual norms plus the slack that rounding and
the axes' own error can make.  Pairs whose bounds can't reach the threshold at hand,
the last of the best found so far or the positive's share, are discarded; survivors
are verified by integer products.  A task hands on its best few of each anchor.
Anchors go in blocks of some ``ANCHORS``, by a hash of the row, one block after the
other, so a task's memory doesn't grow with their number.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do those whose integer norm is over 2**27 (100 times a
score would not fit a long); shorter vectors count as filled with zeros; null ids come
after all others among equal scores; rows that repeat an id are rows of their own,
equal scores and ids are ordered by row number; fewer rows than asked for: all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.sources.scratch import fresh_path, materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in hundredths of the positive's: from, to.
SHARE = (80, 100)
ANCHORS = 2048
#: Rows of a task that are compared at once: few at first, while there are no thresholds.
FIRST, MOST = 128, 1024
#: Pairs that are looked at together component by component.
PAIRS = 1 << 16
STAGES = (0.25, 0.5, 1.0)
NORM = 1 << 54
_KEYS = "a long, score long, unknown boolean, id long, rid long"


# ---- rows ------------------------------------------------------------------------


def integer_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label, rid (a row number), q (little-endian 32-bit integers) of the rows that take part; a written table."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    narrow = rows.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.monotonically_increasing_id().alias("rid"), v.cast("array<double>").alias("x"))
    width = narrow.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches):
        for b in batches:
            x = b.column("x")
            lengths = np.diff(x.offsets.to_numpy())
            q = np.zeros((len(x), width))
            q[np.arange(width) < lengths[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
            q = np.floor(q * SCALE)
            fits = np.einsum("ij,ij->i", q, q) <= NORM
            whole = np.ascontiguousarray(q[fits].astype("<i4"))
            part = b.select(["vec_id", "label", "rid"]).filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "label", "rid", "q"])

    return materialise(narrow.mapInArrow(run, "vec_id long, label long, rid long, q binary"), "integer-rows")


def matrix(column: pa.Array | list[bytes]) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else [bytes(x) for x in column]
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1) if rows and rows[0] else np.zeros((len(rows), 1), "<i4")


def principal_axes(rows: DataFrame) -> np.ndarray:
    """Orthogonal axes as columns, those with the largest second moment over all rows first."""

    def run(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("q")).astype(np.float64)
                total = total + x.T @ x
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x) for x in table.column("v").to_pylist())
        return pa.table({"i": table.column("i")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    moments = rows.select("q").mapInArrow(run, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()  # one row a component
    if not moments:
        return np.eye(1)
    m = np.array([np.frombuffer(r.v) for r in sorted(moments, key=lambda r: r.i)])
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


# ---- the search in a task ----------------------------------------------------------


class Block:
    """A block of anchors, rotated, and what bounds need."""

    def __init__(self, q: np.ndarray, axes: np.ndarray):
        d = len(axes)
        self.q, self.axes = q, axes
        self.ends = sorted({max(1, round(d * s)) for s in STAGES})
        #: Relative to the product of the norms: the axes' departure from orthogonality, and d-term sums of products in double precision.
        self.slack = float(np.abs(axes.T @ axes - np.eye(d)).sum(axis=0).max()) + 32 * d**1.5 * 2.0**-53
        self.y, self.rest = self.rotate(q)

    def rotate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated rows, and their norms: whole, and behind each stage."""
        y = q.astype(np.float64) @ self.axes
        return y, np.stack([np.linalg.norm(y[:, e:], axis=1) for e in (0, *self.ends)])

    def survivors(self, q, y, rest, rows, cols, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the pairs of ``rows`` and ``cols`` whose score can be in [low, high] of the anchor."""
        slack = self.slack * np.outer(rest[0][rows], self.rest[0][cols])
        end = self.ends[0]
        part = y[rows, :end] @ self.y[cols, :end].T
        reach = np.outer(rest[1][rows], self.rest[1][cols]) + slack
        at = np.nonzero((part + reach >= low[cols]) & (part - reach <= high[cols]))
        out = [(np.empty(0, np.int64),) * 3]
        for s in range(0, len(at[0]), PAIRS):
            x, z = at[0][s : s + PAIRS], at[1][s : s + PAIRS]
            i, j, p, sl = rows[x], cols[z], part[x, z], slack[x, z]
            for k in range(1, len(self.ends)):
                a, b = self.ends[k - 1 : k + 1]
                p = p + np.einsum("ij,ij->i", y[i, a:b], self.y[j, a:b])
                reach = rest[k + 1][i] * self.rest[k + 1][j] + sl
                keep = (p + reach >= low[j]) & (p - reach <= high[j])
                i, j, p, sl = i[keep], j[keep], p[keep], sl[keep]
            out.append((i, j, np.einsum("ij,ij->i", q[i].astype(np.int64), self.q[j].astype(np.int64))))
        return tuple(np.concatenate(c) for c in zip(*out))


class Best:
    """The first ``most`` of each key by score (falling), id (null last) and row."""

    def __init__(self, keys: int, most: int):
        self.most, self.last = most, np.full(keys, -np.inf)
        self.rows = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)]

    def add(self, key, score, unknown, ids, rid) -> None:
        rows = [np.concatenate(c) for c in zip(self.rows, (key, score, unknown, ids, rid))]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        k = rows[0][order]
        edge = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
        rank = np.arange(len(k)) - np.maximum.accumulate(np.where(edge, np.arange(len(k)), 0))
        order, rank = order[rank < self.most], rank[rank < self.most]
        self.rows = [c[order] for c in rows]
        full = order[rank == self.most - 1]
        self.last[rows[0][full]] = rows[1][full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in self.rows], names=["a", "score", "unknown", "id", "rid"])


def slices(batches):
    """(vec_id, unknown, label, rid, q) of few rows, then more; of equal rows of a label the first ones, as no other can be among the first of an anchor."""
    size, most = FIRST, max(POSITIVES + 1, NEGATIVES)
    for b in batches:
        s = 0
        while s < b.num_rows:
            p = b.slice(s, size)
            s, size = s + size, min(2 * size, MOST)
            unknown = p.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            ids, labels, rid = (p.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "rid"))
            q = matrix(p.column("q"))
            _, same = np.unique(np.column_stack((q, labels.view("<i4").reshape(-1, 2))), axis=0, return_inverse=True)
            same = same.ravel()
            order = np.lexsort((rid, ids, unknown, same))
            edge = np.concatenate(([True], same[order][1:] != same[order][:-1]))
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))
            at = np.sort(order[rank < most])
            yield ids[at], unknown[at], labels[at], rid[at], q[at]


def find_positives(block: Block, labels: np.ndarray, rids: np.ndarray):
    """The best rows of each anchor's label in a task's rows; anchors in order of label."""

    def run(batches):
        best, high = Best(len(labels), POSITIVES), np.full(len(labels), np.inf)
        for ids, unknown, lab, rid, q in slices(batches):
            y, rest = block.rotate(q)
            for v in np.unique(lab).tolist():
                rows, cols = np.flatnonzero(lab == v), np.arange(np.searchsorted(labels, v), np.searchsorted(labels, v, "right"))
                if len(cols):
                    i, j, score = block.survivors(q, y, rest, rows, cols, best.last, high)
                    other = rid[i] != rids[j]
                    i, j, score = i[other], j[other], score[other]
                    best.add(j, score, unknown[i], ids[i], rid[i])
        yield best.batch()

    return run


def find_negatives(block: Block, labels: np.ndarray, scores: np.ndarray, valid: np.ndarray):
    """The best rows of other labels for each anchor and positive (``scores``: anchors x positives; key: anchor * positives + place)."""

    def run(batches):
        count = scores.shape[1]
        best = Best(scores.size, NEGATIVES)
        margin = np.abs(scores) * 1e-12 + 1
        floor = np.where(valid, scores * (SHARE[0] / 100) - margin, np.inf)
        high = np.where(valid, scores * (SHARE[1] / 100) + margin, -np.inf).max(axis=1, initial=-np.inf)
        for ids, unknown, lab, rid, q in slices(batches):
            y, rest = block.rotate(q)
            low = np.maximum(floor, best.last.reshape(scores.shape)).min(axis=1, initial=np.inf)
            i, j, score = block.survivors(q, y, rest, np.arange(len(q)), np.arange(len(labels)), low, high)
            other = lab[i] != labels[j]
            i, j, score = i[other], j[other], score[other]
            for k in range(count):
                p = scores[j, k]
                fits = valid[j, k] & (SHARE[0] * p <= 100 * score) & (100 * score <= SHARE[1] * p)
                at = i[fits]
                best.add(j[fits] * count + k, score[fits], unknown[at], ids[at], rid[at])
        yield best.batch()

    return run


# ---- the whole -----------------------------------------------------------------------


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each key over all tasks, with their rank."""
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), "unknown", "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, embedding) that ``anchors`` chooses, against all."""
    spark = rows.sparkSession
    whole = integer_rows(rows)
    axes = principal_axes(whole)
    chosen = whole.where(anchors)
    blocks = -(-chosen.count() // ANCHORS)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    chosen = materialise(chosen.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")), "anchors")
    path = fresh_path(spark, "hard-negatives")
    for n in range(blocks):
        held = sorted(chosen.where(F.col("block") == n).collect(), key=lambda r: (r.label, r.rid))  # some ANCHORS rows
        if not held:
            continue
        labels, rids = (np.array([r[c] for r in held], np.int64) for c in ("label", "rid"))
        block = Block(matrix([r.q for r in held]), axes)
        positives = _first(whole.mapInArrow(find_positives(block, labels, rids), _KEYS), POSITIVES).collect()  # POSITIVES rows an anchor
        scores, valid = np.zeros((len(held), POSITIVES), np.int64), np.zeros((len(held), POSITIVES), bool)
        pairs = []
        for r in positives:
            scores[r.a, r["rank"] - 1], valid[r.a, r["rank"] - 1] = r.score, True
            pairs.append((r.a * POSITIVES + r["rank"] - 1, held[r.a].vec_id, None if r.unknown else r.id, r.score))
        found = _first(whole.mapInArrow(find_negatives(block, labels, scores, valid), _KEYS), NEGATIVES)
        names = F.broadcast(spark.createDataFrame(pairs, "a long, anchor_id long, positive_id long, positive_score long"))  # POSITIVES rows an anchor of the block
        out = found.join(names, "a").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("unknown"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every hundredth row of ``embeddings`` as anchor against all rows, the labels of every seventh moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = e.label AS same, e.rid, e.vec_id, list_inner_product(a.q, e.q)::BIGINT AS score
      FROM e AS a JOIN e ON a.rid <> e.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid)::INT AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 80 * p.score AND 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
