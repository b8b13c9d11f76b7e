import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tellurion.llm import simhash
from tellurion.operators.graph import components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """doc_id -> smallest doc_id reachable over links of 4 or fewer bits."""
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \t\n\x0b\x85é　Zz"), max_size=120))
def test_fingerprint(text):
    assert int(simhash.fingerprint(text)[0]) == brute_fp(text)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_groups(rows)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in rows.items()}


def cluster_frame(spark, n=700, seed=3):
    """Distinct fingerprints around a few centres, some chains, some random."""
    rng = random.Random(seed)
    out = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(n // 4):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    x = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        out.add(x)
    while len(out) < n:
        out.add(rng.getrandbits(64))
    return sorted(out)


def test_links_keep_every_group_whatever_the_block(spark, monkeypatch):
    fps = cluster_frame(spark)
    want = brute_groups(dict(enumerate(fps)))
    df = spark.createDataFrame([(bytearray(x.to_bytes(8, "little")),) for x in fps], "fp binary").repartition(4)
    place = {x.to_bytes(8, "little"): i for i, x in enumerate(fps)}
    for block, most in ((20, 65536), (20, 1), (4096, 65536)):
        monkeypatch.setattr(simhash, "MOST_HOT", most)
        linked = {bytes(r.node): bytes(r.root) for r in components(simhash.links(df, simhash.masks_of(simhash.plan_parts(df)), simhash._verify(4, 1), block)).collect()}
        groups = {}
        for f, i in place.items():
            groups.setdefault(linked.get(f, f), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_thresholds_are_enough():
    rng = np.random.default_rng(1)
    costs = rng.random((4, 3)).tolist()
    cost, chosen = simhash.allocate(costs, 1)
    assert sum(chosen) == 1 and min(chosen) >= -1
    assert cost == sum(costs[i][t] for i, t in enumerate(chosen) if t >= 0)


def test_edges_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, " \n", "y"), (None, "a b", "z"), (5, "a b", "z"), (6, "a " * 9000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [g[0] for g in got] == [0, 1, 2, 2, 5, 6]
    assert {g[2] for g in got if g[1] == "0" * 16} == {1}
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]
    assert simhash.representatives(docs.where("false")).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.representatives(one).collect()) == ["a b", "c d"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 90)}, 300: 200, 250: 200}


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def edited(rng, words, share):
    """A copy with words replaced, one in a place, so that about ``share`` of the 5-word shingles stay in common (Jaccard)."""
    out = list(words)
    changes = round(len(words) * (1 - share) / (1 + share) / 5)
    for i in range(changes):
        out[(2 * i + 1) * len(words) // (2 * max(1, changes))] = f"x{rng.getrandbits(40)}"
    return out


def test_similar_texts_link_and_others_do_not(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(150, 600))
        share = (0.95, 0.9, 0.86, 0.5, 0.3)[i % 5]
        a, b = " ".join(words), " ".join(edited(rng, words, share))
        rows += [(2 * i, a), (2 * i + 1, b)]
        x, y = shingle_set(a), shingle_set(b)
        pairs.append((2 * i, len(x & y) / len(x | y)))
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d in kept for d, _ in pairs)
    alike = [d + 1 not in kept for d, j in pairs if j >= 0.8]
    unlike = [d + 1 not in kept for d, j in pairs if j < 0.8]
    assert len(alike) > 60 and sum(alike) >= 0.95 * len(alike) and len(unlike) > 40 and not any(unlike)


def test_representatives_against_all_pairs(spark):
    """Documents of the smallest table: which go, against Jaccard similarity over all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    by, parent = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    common = {}
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[(b, a)] = common.get((b, a), 0) + 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    empty = [d for d, s in sets.items() if not s]
    want = {d for d in sets if root(d) == d} - set(empty[1:])
    got = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert len(got - want) <= 0.05 * (len(sets) - len(want)) and len(want - got) <= 0.002 * len(want)


def apart(rng, fp, bits):
    out = fp.copy()
    for b in rng.choice(512, bits, replace=False):
        out[b // 64] ^= np.uint64(1 << int(b) % 64)
    return out


def test_sure_links_of_large_meetings():
    """A link within CLOSE is given whatever looser ones there are, in meetings of any size."""
    rng = np.random.default_rng(2)
    for others in (3, 37, 57, 500):
        a = rng.integers(0, 2**63, 8).astype(np.uint64)
        b = apart(rng, a, 35)
        c = apart(rng, np.where(np.arange(8) < 4, a, b), 70)
        rows = np.concatenate(([c, a, b], rng.integers(0, 2**63, (others, 8)).astype(np.uint64)))
        got = next(simhash._verify(simhash.LOOSE, 8, simhash.CLOSE)(iter([simhash.pa.RecordBatch.from_arrays([simhash.pa.array(np.zeros(len(rows), np.int64)), simhash.pa.array(np.full(len(rows), 2, np.int8)), simhash._binary(rows)], names=["key", "side", "fp"])])))
        assert any({bytes(u), bytes(v)} == {a.tobytes(), b.tobytes()} for u, v in zip(got.column("u").to_pylist(), got.column("v").to_pylist()))
        assert len(got.column("u")) >= 2


def test_boilerplate_families(spark):
    """100 pages share most of their words (a similarity of some 0.7); subgroups of them are near copies (0.8 to 0.98)."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    common, rows = rng.choices(vocabulary, k=420), []
    for g in range(20):
        own = rng.choices(vocabulary, k=80)
        for i in range(5):
            rows.append((len(rows), " ".join(edited(rng, common + own, (1.0, 0.97, 0.9, 0.86, 0.84)[i]))))
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent = [parent[j] if x == parent[i] else x for x in parent]
    want = {min(i for i in range(len(rows)) if parent[i] == p) for p in set(parent)}
    assert 15 <= len(want) <= 30
    got = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got ^ want) <= 1


def test_odds_do_not_fall_with_size():
    for n in (10, 10**6, 17 * 10**6, 3 * 10**8, 5 * 10**9):
        words = simhash.words_for(n)
        (parts,) = simhash.part_counts(n, 0, words)
        assert 1 - (1 - (1 - simhash.DIFFER) ** simhash.part_width(n)) ** parts >= 0.945
    assert simhash.words_for(10**6) == simhash.WIDE
