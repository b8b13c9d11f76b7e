"""The Merkle manifest against a plain tree, with blocks and ranges so small that every level is used."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tellurion.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and the siblings of every leaf."""
    rows, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(rows) > 1:
        for i, p in enumerate(at):
            if (p ^ 1) < len(rows):
                proofs[i].append(rows[p ^ 1])
        rows = [h(*rows[i : i + 2]) for i in range(0, len(rows), 2)]
        at = [p // 2 for p in at]
    return rows[0], proofs


def plain_leaf(r, add=0):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(frame(r[0]), frame(r[3]), frame(r[2]), frame(None if r[4] is None else r[4] + add), frame(r[1]))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    out, subroots, held = Counter(), [], []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        top, proofs = plain_tree([plain_leaf(r) for r in own])
        subroots.append(top)
        held.append((own, proofs, top))
    root, ups = plain_tree(subroots)
    for (own, proofs, top), up in zip(held, ups):
        for r, proof in zip(own, proofs):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out[(r[0], plain_leaf(r), top, root, h(*proof, *up), not hit)] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 64, 333])
def test_manifest_equals_plain_tree(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEAST_BLOCK", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rng = random.Random(n)
    langs = [None, "", "a", "é", "zz", *[f"l{i}" for i in range(n // 20)]]
    rows = [(rng.choice([None, 5, *range(3 * n)]), rng.choice([None, "", "t é", "x" * 50]), "a" if rng.random() < 0.4 else rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3]), "clash", 1) for _ in range(n)]
    rows += rows[: n // 3] + [rows[0]] * (n // 4)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == brute(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_other_groups_and_keys(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    rows = merkle.folded(merkle.manifest(df, ("k", "g"), "k", "g")).collect()
    assert len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 3 and all(r.folded_root == r.root for r in rows)
