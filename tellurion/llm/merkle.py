"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups.

A row's leaf is the SHA-256 of its framed fields, computed by Spark where the text
lies; only digests and keys move on.  Leaves ascend by key inside their group; every
two consecutive nodes become their parent (the last one alone, if their number is
odd) until one is left, the group's subroot.  Subroots in order of the group, null
first, give the root in the same way.

Reduction.  Rows are sorted by range and numbered inside their group.  A block of
``2**k`` consecutive positions is reduced in one task to one digest and the lower part
of its rows' proofs.  ``k`` grows with the table so that at most 2 * ``MOST_TOP`` digests
of blocks of larger groups are left: that top tree the driver builds.  The paths from
a block to the subroot are broadcast (their number has the same bound), executors
append them and fold each row.  The tree over the subroots is reduced in the same way.

Defined results: a null field is framed as ``-``, so it differs from an empty one; a
null group is a group of its own, before all others; null keys come first, rows with
equal keys are ordered by their leaves, and equal rows are interchangeable; an empty
table gives an empty result; columns that aren't fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.sources.scratch import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Least binary logarithm of a block, and the number of full blocks that it grows to keep.
LEAST_BLOCK = 10
MOST_TOP = 1 << 16
#: Rows to a range of the sort.
RANGE_ROWS = 1 << 20


def framed(value: Column) -> Column:
    """Byte count, colon and value, or ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]), 256))


def parent(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def climb(nodes: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """All levels below the top and the top: ``levels`` steps, or as many as it takes to leave one node."""
    out = []
    while len(nodes) > 1 if levels is None else len(out) < levels:
        out.append(nodes)
        nodes = [parent(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return out, nodes[0]


def siblings(levels: list[list[str]], at: int) -> tuple[int, bytes]:
    """Of the node at place ``at`` of the lowest level: the levels (as bits) that have a sibling, and the siblings."""
    has, path = 0, []
    for i, nodes in enumerate(levels):
        other = at >> i ^ 1
        if other < len(nodes):
            has |= 1 << i
            path.append(nodes[other])
    return has, bytes.fromhex("".join(path))


def fold(node: str, at: int, depth: int, has: int, path: bytes) -> str:
    """The node ``depth`` levels above, from a node, its place and its siblings."""
    used = 0
    for i in range(depth):
        pair = [node]
        if has >> i & 1:
            pair.insert(0 if at >> i & 1 else 1, path[used : used + 32].hex())
            used += 32
        node = parent(pair)
    return node


# ---- positions -----------------------------------------------------------------


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` (a written table) with _t, the dense number of its group (a string without nulls), and _p, its place there; and their number.

    A range of the sort holds runs of groups.  Only its first run can go on from the
    range before, so one summary a range is all that the driver needs.
    """
    spark = rows.sparkSession
    n = rows.count()
    ranges = max(-(-n // RANGE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)), 1)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def runs(batches):
        part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group)
            new = np.concatenate(([g[0].as_py() != last], pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)))
            number = run + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            place = np.arange(len(new)) - start + np.where(number == run, at, 0)
            run, at, last = int(number[-1]), int(place[-1]) + 1, g[-1].as_py()
            more = [pa.array(np.full(len(new), part, np.int32)), pa.array(number.astype(np.int64)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_part", "_run", "_at"])

    numbered = materialise(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(runs, f"{schema}, _part int, _run long, _at long"), "merkle-order")
    each = numbered.groupBy("_part", "_run").agg(F.first(group).alias("g"), F.count(F.lit(1)).alias("n"))
    ends = each.groupBy("_part").agg(F.count(F.lit(1)).alias("runs"), F.min_by(F.struct("g", "n"), "_run").alias("first"), F.max_by(F.struct("g", "n"), "_run").alias("last"))
    starts, tree, held, last = [(-1, 0, 0)], -1, 0, None  # one row a range; the first line only gives a type to an empty table
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = r.first.g == last
        base, carry = tree + (not goes_on), held if goes_on else 0
        starts.append((r["_part"], base, carry))
        tree, last = base + r.runs - 1, r["last"].g
        held = r["last"].n + (carry if r.runs == 1 else 0)
    begin = spark.createDataFrame(starts, "_part int, _base long, _carry long")
    placed = numbered.join(F.broadcast(begin), "_part")
    return placed.select(*rows.columns, (F.col("_base") + F.col("_run")).alias("_t"), (F.col("_at") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)).alias("_p")), n


# ---- reduction -----------------------------------------------------------------

_LOW = "_has long, _depth int, _path binary, _top string, _m long"
_HIGH = "_t long, _b long, _has2 long, _depth2 int, _path2 binary, _top2 string"


def reduce_blocks(nodes: DataFrame, k: int) -> DataFrame:
    """``nodes`` (_t, _p, _d and others) with the lower part of each proof and the block's digest."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        m, b = table.num_rows, table.column("_b")[0].as_py()
        levels, top = climb([d.hex() for d in table.column("_d").to_pylist()], k if b or m == 1 << k else None)
        proofs = [siblings(levels, i) for i in range(m)]
        low = [pa.array([h for h, _ in proofs], pa.int64()), pa.array([len(levels)] * m, pa.int32()), pa.array([p for _, p in proofs], pa.binary()), pa.array([top] * m), pa.array([m] * m, pa.int64())]
        for name, column in zip(("_has", "_depth", "_path", "_top", "_m"), low):
            table = table.append_column(name, column)
        return table

    return nodes.withColumn("_b", F.shiftright("_p", k)).groupBy("_t", "_b").applyInArrow(reduce, f"{schema}, _b long, {_LOW}")


def reduce_trees(nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` (at most ``n``) with both parts of each proof and _top, the digest of its whole tree."""
    spark = nodes.sparkSession
    k = max(LEAST_BLOCK, (max(n, 1) // MOST_TOP).bit_length())
    blocks = materialise(reduce_blocks(nodes, k), "merkle-blocks")
    # Full blocks, and last blocks of trees that have a full one: at most two for each 2**k nodes.
    tops = blocks.where(F.col("_p") == F.shiftleft("_b", k)).where(f"_b > 0 or _m = {1 << k}").select("_t", "_b", "_top").collect()
    trees: dict[int, dict[int, str]] = {}
    for r in tops:
        trees.setdefault(r["_t"], {})[r["_b"]] = r["_top"]
    suffixes = []
    for t, by_block in trees.items():
        levels, top = climb([by_block[b] for b in range(len(by_block))], None)
        for b in range(len(by_block)):
            has, path = siblings(levels, b)
            suffixes.append((t, b, has, len(levels), path, top))
    whole = blocks.join(F.broadcast(spark.createDataFrame(suffixes, _HIGH)), ["_t", "_b"], "left")
    return whole.withColumns({"_has2": F.coalesce("_has2", F.lit(0)), "_depth2": F.coalesce("_depth2", F.lit(0)), "_path2": F.coalesce("_path2", F.lit(b"")), "_top": F.coalesce("_top2", "_top")}).drop("_top2", "_m")


_STEPS = ("_p", "_depth", "_has", "_path", "_b", "_depth2", "_has2", "_path2")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof and place of every row of ``docs``, and _other, the leaf of its changed version (null where it is not changed).

    ``proof`` is an array of (place, depth, has, path): the siblings from the
    leaf up, in four stretches (block, group, block of groups, all groups).
    """
    value = {f: F.col(f) for f in fields}
    own = leaf([value[f] for f in fields])
    other = F.when(where, leaf([(changed or {}).get(f, value[f]) for f in fields])) if where is not None else F.lit(None).cast("binary")
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("")).alias("_g"), own.alias("_d"), other.alias("_other"), F.monotonically_increasing_id().alias("_rid"))
    placed, n = positions(materialise(narrow, "merkle-leaves"), "_g", ["_key", "_d", "_rid"])
    rows = reduce_trees(placed.drop("_rid", "_g"), n)
    subroots = rows.where("_p = 0").select(F.lit(0).cast("long").alias("_t"), F.col("_t").alias("_p"), F.unhex("_top").alias("_d"))
    above = reduce_trees(subroots, n).select(F.col("_p").alias("_t"), F.col("_top").alias("_root"), *[F.col(c).alias(f"_up{c}") for c in _STEPS])
    stretch = lambda at, depth, has, path: F.struct(F.col(at).alias("place"), F.col(depth).alias("depth"), F.col(has).alias("has"), F.col(path).alias("path"))
    proof = F.array(*[stretch(*[f"{up}{c}" for c in _STEPS[i : i + 4]]) for up in ("", "_up") for i in (0, 4)])
    return rows.join(above, "_t").select(F.col("_key").alias(key), F.lower(F.hex("_d")).alias("leaf"), F.lower(F.hex("_other")).alias("_other"), F.col("_top").alias("subroot"), F.col("_root").alias("root"), proof.alias("proof"))


def folded(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with folded_root, the root that ``leaf_col`` and the proof give, and proof_sha256, the digest of the siblings."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for b in batches:
            ends, digests = [], []
            for node, proof in zip(b.column(leaf_col).to_pylist(), b.column("proof").to_pylist()):
                for s in proof:
                    node = fold(node, s["place"], s["depth"], s["has"], s["path"])
                ends.append(node)
                digests.append(parent([s["path"].hex() for s in proof]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.string()), pa.array(digests, pa.string())], names=[*b.schema.names, "folded_root", "proof_sha256"])

    return rows.mapInArrow(run, f"{schema}, folded_root string, proof_sha256 string")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, each row checked again after every seventh (by CRC-32 of its id) was tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = manifest(docs, changed={"n_chars": F.col("n_chars") + 1}, where=hit)
    checked = folded(rows.withColumn("_now", F.coalesce("_other", "leaf")), "_now")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FRAMED = " || ".join(f"coalesce(strlen({{{f}}}::VARCHAR)::VARCHAR || ':' || {{{f}}}::VARCHAR, '-')" for f in FIELDS)
_LEAF, _OTHER = (f"sha256({_FRAMED.format(**{f: f for f in FIELDS} | {'n_chars': n})})" for n in ("n_chars", "(n_chars + 1)"))

ORACLE = f"""
WITH RECURSIVE
f AS (SELECT row_number() OVER () AS rid, doc_id, lang, {_LEAF} AS leaf, {_OTHER} AS other, n_chars IS NOT NULL
        AND xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT)), 4294967295) % 7 = 0 AS hit FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS p, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM f),
low AS (SELECT t, 0 AS l, p, leaf AS d FROM a
        UNION ALL SELECT t, l + 1, p // 2, sha256(string_agg(d, '' ORDER BY p)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM low) WHERE n > 1 GROUP BY t, l, p // 2),
sub AS (SELECT t, max(l) AS depth, arg_max(d, l) AS subroot FROM low GROUP BY t),
high AS (SELECT 0 AS l, t AS p, subroot AS d FROM sub
         UNION ALL SELECT l + 1, p // 2, sha256(string_agg(d, '' ORDER BY p)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY l, p // 2),
top AS (SELECT max(l) AS depth, arg_max(d, l) AS root FROM high),
steps AS (
  SELECT rid, i AS l, (x.p >> i) % 2 AS side, low.d
  FROM (SELECT rid, t, p, unnest(range(depth)) AS i FROM a JOIN sub USING (t)) x LEFT JOIN low ON low.t = x.t AND low.l = i AND low.p = xor(x.p >> i, 1)
  UNION ALL
  SELECT rid, 100 + i, (x.t >> i) % 2, high.d
  FROM (SELECT rid, t, unnest(range(depth)) AS i FROM a, top) x LEFT JOIN high ON high.l = i AND high.p = xor(x.t >> i, 1)),
s AS (SELECT rid, string_agg(d, '' ORDER BY l) AS path, list(CASE WHEN d IS NULL THEN '-' WHEN side = 1 THEN 'L' || d ELSE 'R' || d END ORDER BY l) AS moves FROM steps GROUP BY rid),
e AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(path, '')) AS proof_sha256,
             list_reduce(list_prepend(CASE WHEN hit THEN other ELSE leaf END, coalesce(moves, [])),
                         lambda n, m: sha256(CASE m[1] WHEN 'L' THEN m[2:] || n WHEN 'R' THEN n || m[2:] ELSE n END)) AS folded_root
      FROM a JOIN sub USING (t) CROSS JOIN top LEFT JOIN s USING (rid))
SELECT *, folded_root = root AS verified FROM e
"""
