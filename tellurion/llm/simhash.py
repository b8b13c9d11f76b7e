"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are the majority bits of hashes of a text's word shingles, one word of
64 bits or several.  Two of them link at ``radius`` or fewer differing bits, and the
components of the links are the groups.

Search.  The bits are grouped into m parts, correlated bits together; part i gets a
threshold t_i >= -1 with sum(t_i) = sure - m + 1, so any pair within ``sure`` bits is
within t_i in some part (-1: the part is not probed).  The thresholds, unequal as
they come, are found by dynamic programming over estimated candidate counts, and m
is the one with the least estimate.  A part is probed by masks: for every set of at
most t_i of its bits, fingerprints meet that differ in exactly those bits of the
part; each meeting is verified on all bits.  With ``sure`` = ``radius`` every link is
found.

Two uses.  ``near_duplicates`` links 64-bit fingerprints of 4-word shingles at 4 bits,
all of them.  ``representatives`` looks for texts whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more; two such sets differ in about 15% of the bits, so
it takes ``WIDE`` words of 64 bits and lets the parts be narrow: pairs within ``sure``
bits meet for certain, a pair at 0.8 meets in one of some 36 parts with odds over
0.95, one at 0.9 with odds over 0.999.  Parts get wider with the number of texts, and
the words of a fingerprint more, so that these odds don't fall (``words_for``).
Meetings keep links of up to ``LOOSE`` of the first 512 bits.  Those of at most
``CLOSE`` bits (a similarity near 0.9) hold; where longer ones would join groups that
these leave apart, the two texts' shingle sets are compared (``fingerprint_groups``).

Bounded work.  Equal fingerprints are first combined, so exact copies cost nothing.
Meetings are scanned in order of their key, block by block, and give only the links
of a spanning forest, never all pairs (of groups that a failed comparison leaves apart:
the links between them).  A meeting of more than ``BLOCK`` fingerprints
is cut into blocks, and pairs of blocks become meetings of their own on other tasks:
every pair is still compared, and the rows sent grow with the square of such a
meeting over ``BLOCK``.

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer words than a shingle are one shingle; repeated rows and ids
stay rows; the smallest doc_id leads a group, null after all others, and of rows with
that id the first; an empty table gives an empty result; other columns are ignored
by ``near_duplicates`` and kept by ``representatives``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.graph import components
from tellurion.sources.scratch import materialise

SHINGLE = 4
RADIUS = 4
WIDE_SHINGLE = 5
WIDE = 8
LOOSE = 92
CLOSE = 45
STEP = 6
SIMILARITY = 0.8
#: Share of bits in which two texts at that similarity differ, and the least odds that they meet.
DIFFER = 0.15
ODDS = 0.95
BLOCK = 4096
SMALL = 48
MOST_BROADCAST = 4_000_000
MOST_HOT = 65_536
_SPACES = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's shingles in order, repeats included; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """The majority vote of a text's shingles as ``words`` words of 64 bits; 0 without words.

    The first word votes on the shingles' XXH64, the others on mixes of it.
    """
    h = shingle_hashes(text, shingle)
    if not len(h):
        return np.zeros(words, np.uint64)
    if words > 1:
        with np.errstate(over="ignore"):
            h = np.stack([h, *(_mix(h + np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)) for i in range(1, words))], axis=1)
    return votes(np.ascontiguousarray(h.reshape(-1, words)))


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows: counts of byte values give counts of bits."""
    n, columns = len(hashes), hashes.view(np.uint8)
    if n < 64:
        counts = np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        width = columns.shape[1]
        cells = np.zeros(width * 256, np.int64)
        for s in range(0, n, 4096):
            cells += np.bincount((columns[s : s + 4096] + np.arange(width) * 256).ravel(), minlength=width * 256)
        counts = (cells.reshape(width, 256) @ _BYTE_BITS).ravel()
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def _fps(column) -> np.ndarray:
    """The fingerprints of an Arrow column of binaries, one row of 64-bit words each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1) if rows else np.empty((0, 1), np.uint64)


def _binary(fps: np.ndarray) -> pa.Array:
    """Rows of words as an Arrow column of binaries."""
    n, width = fps.shape
    data = pa.py_buffer(np.ascontiguousarray(fps).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width * 8).astype(np.int32)), data])


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """The ``keep`` columns of ``docs`` and fp, the fingerprint (binary, little endian)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _binary(np.array(fps, np.uint64).reshape(len(fps), words))], names=[*keep, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, fp binary")


# ---- parts and thresholds -------------------------------------------------


def bit_statistics(fps: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of bits is set together; over all of them."""
    bits = 64 * words

    def run(batches):
        total, both = 0, np.zeros((bits, bits))
        for b in batches:
            x = _fps(b.column("fp"))
            m = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").astype(np.float32)
            total += len(x)
            both += m.T @ m
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits, dtype=np.int32)), pa.array(np.full(bits, total, np.int64)), pa.array([r.tobytes() for r in both], pa.binary())], names=["i", "n", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x.as_py()) for x in table.column("v"))
        return pa.table({"i": table.column("i")[:1], "n": [sum(table.column("n").to_pylist())], "v": [v.tobytes()]}, schema=table.schema)

    rows = fps.select("fp").mapInArrow(run, "i int, n long, v binary").groupBy("i").applyInArrow(add, "i int, n long, v binary").collect()  # one row a bit
    both = np.zeros((bits, bits))
    for r in rows:
        both[r.i] = np.frombuffer(r.v)
    return (rows[0].n if rows else 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of nearly equal number, correlated bits together: each group grows by the bit with the largest sum of absolute correlations to it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = np.ones(len(p), bool), []
    for g in range(parts):
        size = int(free.sum()) // (parts - g)
        first = int(np.where(free, corr[:, free].sum(axis=1), -1).argmax())
        group, ties = [first], corr[first].copy()
        free[first] = False
        while len(group) < size:
            best = int(np.where(free, ties, -1).argmax())
            group.append(best)
            free[best] = False
            ties += corr[best]
        out.append(sorted(group))
    return out


def _mask(bits, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    for b in bits:
        out[b // 64] |= np.uint64(1 << b % 64)
    return out


def equal_pairs(fps: DataFrame, groupings: dict[int, list[list[int]]], words: int) -> dict[tuple[int, int], float]:
    """For each part of each grouping, the pairs of fingerprints that agree on it; counted over all of them."""
    masks = [(m, i, _mask(bits, words)) for m, parts in groupings.items() for i, bits in enumerate(parts)]

    def run(batches):
        for b in batches:
            x = _fps(b.column("fp"))
            for number, (_, _, mask) in enumerate(masks):
                key, n = np.unique(_hash(x & mask), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["part", "key", "n"])

    counts = fps.select("fp").mapInArrow(run, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").cast("double").alias("n"))
    rows = counts.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()  # one row a part
    return {masks[r.part][:2]: r.pairs for r in rows}


def estimated_candidates(equal: float, n: int, p: np.ndarray, bits: list[int], upto: int) -> list[float]:
    """Pairs within 0..upto bits on a part: the distance of two fingerprints taken as a sum of independent bits, scaled so that distance 0 has the pairs counted."""
    dist = np.zeros(upto + 1)
    dist[0] = 1.0
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - q) + np.concatenate(([0], dist[:-1])) * q
    dist = dist * (n * (n - 1) / 2)
    scale = max(1.0, equal / max(dist[0], 1e-9)) if equal else 1.0
    rest = np.minimum(dist * np.concatenate(([1.0], np.full(upto, min(scale, 64.0)))), n * (n - 1) / 2)
    rest[0] = equal
    return np.cumsum(rest).tolist()


def probes(width: int, t: int) -> int:
    out, term = 0, 1
    for k in range(t + 1):
        out += term
        term = term * (width - k) // (k + 1)
    return out


#: Estimated cost of one probe row against one verification (sorting and moving a row against one XOR and popcount).
PROBE_COST = 60.0


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least total cost; costs[i][t] is the cost of t >= 0, -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                c = cost + (row[t] if t >= 0 else 0.0)
                if total + t not in nxt or c < nxt[total + t][0]:
                    nxt[total + t] = (c, [*chosen, t])
        best = nxt
    return best[budget]


def part_width(n: int) -> int:
    """Bits of a part that lets some 1,024 of ``n`` unlike fingerprints agree on it (14 to 30)."""
    return min(30, max(14, int(n).bit_length() - 10))


def words_for(n: int, odds: float = ODDS) -> int:
    """Words of 64 bits that give parts enough for a pair at the similarity sought to agree on one with these odds: wider parts, as ``n`` grows, come with more of them."""
    agree = (1 - DIFFER) ** part_width(n)
    parts = math.log(1 - odds) / math.log1p(-agree)
    return max(WIDE, math.ceil(parts * part_width(n) / 64))


def part_counts(n: int, sure: int, words: int) -> list[int]:
    """Numbers of parts to choose from: for one word those that ``sure`` allows, for several the one that ``part_width`` gives."""
    if words == 1:
        return list(range(2, sure + 2))
    return [64 * words // part_width(n)]


def plan_parts(fps: DataFrame, sure: int | None = RADIUS, words: int = 1) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed; ``sure`` None: as many bits as parts with threshold 0 give."""
    n, both = bit_statistics(fps, words)
    ones = np.diag(both)
    groupings = {m: group_bits(n, both, m) for m in part_counts(n, sure or 0, words)}
    equal = equal_pairs(fps, groupings, words)
    best = None
    for m, parts in groupings.items():
        costs, budget = [], 0 if sure is None else sure - m + 1
        for i, bits in enumerate(parts):
            upto = min(2, budget + m - 1) if words == 1 else 1
            pairs = estimated_candidates(equal.get((m, i), 0.0), n, ones / max(n, 1), bits, upto)
            costs.append([probes(len(bits), t) * n * PROBE_COST + pairs[t] for t in range(upto + 1)])
        cost, chosen = allocate(costs, budget)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return best[1]


# ---- meetings ----------------------------------------------------------------


def masks_of(parts: list[tuple[list[int], int]], words: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits of the part, bits that must differ) for every probe."""
    return [(_mask(bits, words), _mask(flip, words)) for bits, t in parts for k in range(t + 1) for flip in itertools.combinations(bits, k)]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(x: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of words; a single word is taken as it is."""
    out = x[:, 0]
    for i in range(1, x.shape[1]):
        with np.errstate(over="ignore"):
            out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ x[:, i]
    return out


def _keys(x: np.ndarray, number: int, part: np.ndarray, flip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the meeting, and the side: rows that differ in exactly the flipped bits share a key and are on opposite sides."""
    own = x & flip
    other = own ^ flip
    where = int(np.flatnonzero(flip)[0]) if flip.any() else 0
    high = own[:, where] > other[:, where]
    low = np.where(high[:, None], other, own)
    with np.errstate(over="ignore"):
        return _mix(_mix(_hash(x & (part & ~flip) | low)) + np.uint64(number)), high


def meetings(fps: DataFrame, masks: list[tuple[np.ndarray, np.ndarray]], hot: np.ndarray | None, only_hot: bool, numbered: bool = False) -> DataFrame:
    """key, side, fp for every probe; ``numbered``: with the probe's number as a word behind.  A key that is in ``hot`` (sorted) is left to ``only_hot``."""

    def run(batches):
        for b in batches:
            x = _fps(b.column("fp"))
            for number, (part, flip) in enumerate(masks):
                key, side = _keys(x, number, part, flip)
                rows = x
                if hot is not None:
                    at = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
                    is_hot = hot[at] == key if len(hot) else np.zeros(len(key), bool)
                    take = is_hot if only_hot else ~is_hot
                    key, side, rows = key[take], side[take], x[take]
                if len(rows):
                    rows = np.column_stack((rows, np.full(len(rows), number, np.uint64))) if numbered else rows
                    kind = side.astype(np.int8) if flip.any() else np.full(len(rows), 2, np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), _binary(rows)], names=["key", "side", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, side byte, fp binary")


def meeting_sizes(fps: DataFrame, masks: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """key, n of every meeting; only keys are moved."""

    def run(batches):
        for b in batches:
            x = _fps(b.column("fp"))
            for number, (part, flip) in enumerate(masks):
                key, n = np.unique(_keys(x, number, part, flip)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return fps.select("fp").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words, of the first ``WIDE``; a and b broadcast against each other."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for i in range(1, min(WIDE, a.shape[-1])):
        d += np.bitwise_count(a[..., i] ^ b[..., i])
    return d


def _links(left: np.ndarray, right: np.ndarray, radius: int, same: bool, cell: int = 1 << 18, parent: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places of links between two arrays (``same``: one array with itself) that join what any link joins: a forest.

    Rows of ``left`` are taken in slices; a slice is compared with the rows of
    ``right`` that are not yet joined to all of it.  ``parent`` holds what is joined and
    is changed.
    """
    off = 0 if same else len(left)
    if parent is None:
        parent = np.arange(len(left) if same else len(left) + len(right))

    def roots():
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent[:] = up

    out, step, s = [], max(1, min(64, cell // max(1, len(right)))), 0
    while s < len(left):
        at = np.arange(s, min(len(left), s + step))
        s += step
        of = roots()
        mine = of[at]
        others = np.flatnonzero(of[off:] != mine[0]) if (mine == mine[0]).all() else np.arange(len(right))
        if not len(others):
            continue
        rows, cols = np.nonzero(_distance(left[at, None], right[None, others]) <= radius)
        a, b = at[rows], others[cols] + off
        while len(a):  # drop the pairs that are joined already, then join one of each group that is left
            of = roots()
            apart = of[a] != of[b]
            a, b = a[apart], b[apart]
            low, high = np.minimum(of[a], of[b]), np.maximum(of[a], of[b])
            high, first = np.unique(high, return_index=True)
            parent[high] = low[first]
            out += zip(a[first].tolist(), (b[first] - off).tolist())
    return out


def _small_links(key, side, fp, radius):
    """Places of links inside the meetings of sorted rows: rows at distance d of each other in order, for d = 1, 2, ... up to the largest meeting."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n, d = len(key), 1
    live = np.arange(n - 1)
    while len(live):
        live = live[live + d < n]
        live = live[key[live] == key[live + d]]
        near = (_distance(fp[live], fp[live + d]) <= radius) & ((side[live] == 2) | (side[live] != side[live + d]))
        us.append(live[near])
        vs.append(live[near] + d)
        d += 1
    return np.concatenate(us), np.concatenate(vs)


def _meetings_of(work, words: int):
    """Over rows sorted by key: what ``work`` (key, side, fp) yields of whole meetings."""

    def run(batches):
        key, side, fp = np.empty(0, np.int64), np.empty(0, np.int8), np.empty((0, words), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate((key, b.column("key").to_numpy(zero_copy_only=False)))
            side = np.concatenate((side, b.column("side").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, _fps(b.column("fp"))))
            done = np.searchsorted(key, key[-1])  # the last meeting may go on in the next batch
            if done:
                yield from work(key[:done], side[:done], fp[:done])
                key, side, fp = key[done:], side[done:], fp[done:]
        if len(key):
            yield from work(key, side, fp)

    return run


def _verify(radius: int, words: int, close: int | None = None):
    """The links of every meeting: all of a small one, of a larger one a forest of those within ``close``, and of longer ones between its trees, shorter ones first."""

    def work(key, side, fp):
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        starts, sizes = edge[:-1], np.diff(edge)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        u, v = _small_links(key[at], side[at], fp[at], radius)
        us, vs = [at[u]], [at[v]]
        for s, k in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            place, sd = np.arange(s, s + k), side[s : s + k]
            same = sd[0] == 2
            left, right = (place, place) if same else (place[sd == 0], place[sd == 1])
            if len(left) and len(right):
                parent = np.arange(len(left) if same else len(left) + len(right))
                steps = [radius] if close is None else range(close, radius + STEP, STEP)
                pairs = [x for r in steps for x in _links(fp[left], fp[right], min(r, radius), bool(same), parent=parent)]
                us.append(left[[a for a, _ in pairs]] if pairs else place[:0])
                vs.append(right[[b for _, b in pairs]] if pairs else place[:0])
        u, v = np.concatenate(us), np.concatenate(vs)
        both = np.unique(np.concatenate((fp[u], fp[v]), axis=1), axis=0)
        apart = (both[:, :words] != both[:, words:]).any(axis=1)
        u, v = both[apart, :words], both[apart, words:]
        yield pa.RecordBatch.from_arrays([_binary(u), _binary(v), pa.array(_distance(u, v).astype(np.int32))], names=["u", "v", "bits"])

    return _meetings_of(work, words)


def _across(radius: int, words: int, masks: list[tuple[np.ndarray, np.ndarray]], cell: int = 1 << 18):
    """All links of every meeting between fingerprints of different groups, by number, each in the first meeting that its ends share.

    Three words behind a fingerprint's own are its number, its group's, and the probe's.
    """

    def work(key, side, fp):
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            step = max(1, cell // (e - s))
            for at in range(s, e, step) if (fp[s:e, words + 1] != fp[s, words + 1]).any() else ():
                left, right = fp[at : min(at + step, e), None], fp[None, at:e]
                near = (_distance(left[..., :words], right[..., :words]) <= radius) & (left[..., words + 1] != right[..., words + 1])
                sides = side[at : min(at + step, e), None]
                near &= ((sides == 2) | (sides != side[None, at:e])) & (np.arange(len(left))[:, None] < np.arange(e - at))
                i, j = (at + x for x in np.nonzero(near))
                first, differ = np.full(len(i), len(masks)), fp[i, :words] ^ fp[j, :words]
                for number, (part, flip) in reversed(list(enumerate(masks))):
                    first[((differ & part[:words]) == flip[:words]).all(axis=1)] = number
                i, j = i[first == fp[i, words + 2]], j[first == fp[i, words + 2]]
                swap = fp[i, words] > fp[j, words]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                columns = [fp[i, words], fp[j, words], fp[i, words + 1], fp[j, words + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["u", "v", "a", "b"])

    return _meetings_of(work, words + 3)


def links(fps: DataFrame, masks: list[tuple[np.ndarray, np.ndarray]], find, block: int = BLOCK, schema: str = "u binary, v binary, bits int", numbered: bool = False) -> DataFrame:
    """What ``find`` (see ``_verify``, ``_across``) gives of the meetings of ``fps`` (distinct)."""
    scan = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(find, schema)
    many = 0
    if fps.count() > block:
        sizes = materialise(meeting_sizes(fps, masks).where(F.col("n") > block), "hot-meetings")
        many = sizes.count()
    if not many:
        return scan(meetings(fps, masks, None, False, numbered))
    if many <= MOST_HOT:  # tasks look them up
        hot = np.sort(np.array([r.key for r in sizes.select("key").collect()], np.int64).view(np.uint64))
        out, large = scan(meetings(fps, masks, hot, False, numbered)), meetings(fps, masks, hot, True, numbered).join(F.broadcast(sizes), "key")
    else:
        every = meetings(fps, masks, None, False, numbered)
        out, large = scan(every.join(sizes, "key", "left_anti")), every.join(sizes, "key")

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, side, fp, n = b.column("key").to_numpy(zero_copy_only=False), b.column("side").to_numpy(zero_copy_only=False), _fps(b.column("fp")), b.column("n").to_numpy(zero_copy_only=False)
            number = _mix(_hash(fp) + np.uint64(7))
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                at = order[s:e]
                k, cuts = int(key[at[0]]), -(-int(n[at[0]]) // block)
                own = (number[at] % np.uint64(cuts)).astype(np.int64)
                for other in range(cuts):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    cell = _mix(np.full(len(own), k, np.int64).view(np.uint64) + (low * cuts + high + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(side[at]), _binary(fp[at])], names=["key", "side", "fp"])

    return out.unionByName(scan(large.mapInArrow(spread, "key long, side byte, fp binary")))


# ---- groups -------------------------------------------------------------------


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK, words: int = 1, close: int | None = None, alike=None) -> DataFrame:
    """fp, lead for every fingerprint of ``rows`` (columns doc_id, fp and a row number rid; a written table).

    lead is the first row of the group in order of doc_id (null last) and row number.
    Nodes of the graph are named by their first row in that order, so the least name
    that the star rounds reach is the lead, and no group is gathered for it.

    Links of more than ``close`` bits between groups of the others hold only if
    ``alike``, given (u, v, a, b; row numbers and groups), keeps them.  Larger meetings
    give only a forest of them; where one of these fails, the two groups may still be
    joined by another, so the fingerprints of groups with a failure meet once more and
    every link between different groups is given to ``alike``.  Two groups of a meeting
    that a forest joins over links that hold are one, so no link is left out.
    """
    name = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
    distinct = materialise(rows.groupBy("fp").agg(F.min(name).alias("node")), "distinct")
    # names of the links' ends; unknown ids are 0 in a name, as equality wants values
    node = F.struct(F.col("node.unknown").alias("unknown"), F.coalesce("node.doc_id", F.lit(0).cast(rows.schema["doc_id"].dataType)).alias("doc_id"), F.col("node.rid").alias("rid"))
    names = distinct.select("fp", node.alias("node"))
    masks = masks_of(plan_parts(distinct, radius if words == 1 else None, words), words)

    def named(found: DataFrame) -> DataFrame:
        found = found.distinct().join(names.select(F.col("fp").alias("u"), F.col("node").alias("_u")), "u").join(names.select(F.col("fp").alias("v"), F.col("node").alias("_v")), "v")
        return materialise(found.select(F.col("_u").alias("u"), F.col("_v").alias("v"), "bits"), "links")

    edges = named(links(distinct, masks, _verify(radius, words, close), block))
    linked = components(edges if close is None else edges.where(F.col("bits") <= close))
    lead = names.join(linked, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("lead"))
    if close is None:
        return lead.select("fp", "lead")

    def joined(lead: DataFrame, held: DataFrame) -> DataFrame:
        roots = components(held.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnsRenamed({"node": "lead", "root": "_root"})
        return materialise(lead.join(roots, "lead", "left").select("fp", "node", F.coalesce("_root", "lead").alias("lead"), F.col("lead").alias("was")), "groups")

    lead = materialise(lead, "groups")
    at = lambda end, group: lead.select(F.col("node").alias(end), F.col("lead").alias(group))
    far = edges.where(F.col("bits") > close).join(at("u", "a"), "u").join(at("v", "b"), "v").where("a != b")
    far = materialise(far.select(F.least("u.rid", "v.rid").alias("u"), F.greatest("u.rid", "v.rid").alias("v"), "a", "b").dropDuplicates(["u", "v"]), "far")
    held = materialise(alike(far), "alike")
    lead = joined(lead, held)
    now = lead.select(F.col("was").alias("a"), F.col("lead").alias("now")).distinct()
    failed = far.join(held, ["u", "v"], "left_anti")
    failed = failed.join(now, "a").withColumnRenamed("now", "x").join(now.withColumnRenamed("a", "b"), "b").where("x != now")
    open_ = materialise(failed.select(F.explode(F.array("x", "now")).alias("lead")).distinct(), "open")
    if open_.isEmpty():
        return lead.select("fp", "lead")
    again = lead.join(open_, "lead", "left_semi").select(F.concat("fp", _little_endian(F.col("node.rid")), _little_endian(F.col("lead.rid"))).alias("fp"))
    wider = [tuple(np.append(m, np.zeros(2, np.uint64)) for m in mask) for mask in masks]
    more = links(materialise(again, "again"), wider, _across(radius, words, masks), block, "u long, v long, a long, b long", True).distinct()
    more = materialise(more.join(far, ["u", "v"], "left_anti"), "far")
    held = materialise(alike(more), "alike")
    leads = lead.select("lead").distinct()
    side = lambda c: leads.select(F.col("lead.rid").alias(c), F.col("lead").alias(f"_{c}"))
    held = held.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return joined(lead, held).select("fp", "lead")


def _little_endian(x: Column) -> Column:
    """The eight bytes of a long, least first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)]))


def by_number(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to a written table of row numbers by its only column: where they lie while there are at most ``MOST_BROADCAST`` numbers, by a shuffle beyond."""
    few = numbers.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(numbers) if few else numbers.hint("shuffle_hash"), numbers.columns, how)


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs`` (u, v, ...) whose texts in ``texts`` (rid, text) have shingle sets of at least that Jaccard similarity; a shingle is told by 32 bits of its hash."""
    wanted = materialise(pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct(), "wanted")

    def cut(batches):
        for b in batches:
            sets = [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(sets, pa.binary())], names=["rid", "set"])

    sets = materialise(by_number(texts, wanted, "left_semi").select("rid", "text").mapInArrow(cut, "rid long, set binary"), "sets")
    both = pairs.join(sets.withColumnsRenamed({"rid": "u", "set": "_x"}), "u").join(sets.withColumnsRenamed({"rid": "v", "set": "_y"}), "v")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("_x"), b.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield b.filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, both.schema).drop("_x", "_y")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group) for every row of ``docs``."""
    rows = materialise(fingerprints(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "doc_id", "rid"), "fingerprints")
    of = fingerprint_groups(rows, radius, block)
    return rows.join(of, "fp").select(
        "doc_id", F.lower(_swapped("fp")).alias("fingerprint"),
        F.when(~F.col("lead.unknown"), F.col("lead.doc_id")).alias("component_id"))


def _swapped(fp: str):
    """Hex digits of eight bytes in reverse order."""
    return F.concat(*[F.substring(F.hex(fp), 2 * i + 1, 2) for i in range(7, -1, -1)])


def representatives(docs: DataFrame, radius: int = LOOSE, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each group of texts alike in 5-word shingles (0.8 or more), one with the smallest doc_id (nulls last).

    Fingerprints are moved, and shingle sets of the texts that are compared; texts stay
    where they lie while at most ``MOST_BROADCAST`` of them are compared or go.
    """
    columns = docs.columns
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")), "rows")
    texts = numbered.select(F.col("_rid").alias("rid"), F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    words = words_for(numbered.count())
    rows = materialise(fingerprints(texts, "rid", "doc_id", shingle=WIDE_SHINGLE, words=words), "fingerprints")
    of = fingerprint_groups(rows, radius, block, words, CLOSE, lambda pairs: similar_pairs(pairs, texts.select("rid", "text")))
    gone = materialise(rows.join(of, "fp").where(F.col("rid") != F.col("lead.rid")).select(F.col("rid").alias("_rid")), "gone")
    kept = by_number(numbered, gone, "left_anti")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
