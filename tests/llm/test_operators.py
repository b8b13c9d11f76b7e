"""Operators against brute-force versions, the library, round trips and held-out data."""

import gzip
import hashlib
import io
import math
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tellurion.llm import decontam, licenses, lm, mixing, quality, sharding, tokens, toxicity, warc
from tellurion.sources.scratch import fresh_path

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 400), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_permutation_is_one_to_one(n, seed):
    assert sorted(sharding.permute_py(i, n, seed) for i in range(n)) == list(range(n))


def test_shards_are_even_gapless_and_computable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign_shards(docs.unionByName(docs.limit(7))).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, k in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in rows)
    numbered, n = sharding.number_rows(docs.select("doc_id"), ["doc_id"])
    got = numbered.withColumn("p", sharding.permute(numbered.row_no, n)).collect()
    assert all(r.p == sharding.permute_py(r.row_no, n) for r in got)


def test_mix_targets_by_resharing(spark):
    sizes = {"a": 100, "b": 900, "c": 50, "d": 10, None: 40}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 2 * sizes[s]]
        if not over:
            want |= {s: weights[s] * level for s in open_}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    assert got == pytest.approx(want)


def test_mix_comes_near_targets_and_documents_follow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        s = by.setdefault((r.target, r.source_size), [0, 0])
        s[0] += r.taken
        s[1] = max(s[1], r["size"])
    assert all(abs(taken - target) <= largest for (target, _), (taken, largest) in by.items())
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r["size"] for r in rows if r["size"])


def brute_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)})


def test_repeated_words(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b"], n)) for n in (0, 7, 8, 9, 40, 300)] + ["x y z " * 50, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(df).collect()}
    assert got == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}
    assert quality.keep(df).columns == df.columns


def test_clean_prose_is_kept_and_junk_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    r = quality.judge(docs).groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in r}
    assert n[(1, True)] > 0.8 * (n[(1, True)] + n.get((1, False), 0))
    assert n.get((0, True), 0) < 0.5 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_license_rules(spark):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        2: "x y\nReleased under the MIT License.\nz", 3: "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", 4: "a driving licence is needed", 5: "nothing"}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in texts] == ["MIT", "MIT", "Apache-2.0,CC-BY-NC-4.0", "", ""]
    assert got[1].sentence_ids == "mitgrant,mitnotice" and got[4].n_unknown == 1


@given(st.text(alphabet=st.sampled_from("aZé1 \t\n'’s.,<|>endoftx\x85　\x1cΣİ́"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_counts_are_the_librarys(text):
    counter = tokens._counter(tokens.vocabulary_path())
    for t in (text, text.replace("x", "<|endoftext|>")):
        assert counter.count([t]) == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids)]


def test_cache_is_reused(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "cache")
    first = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.where("doc_id % 2 = 0"), path).collect()}
    size = spark.read.parquet(path).count()
    both = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()}
    assert first.items() <= both.items() and len(both) == 200
    assert spark.read.parquet(path).count() == docs.select(tokens._digest(docs.text)).distinct().count() > size
    library = tokens._counter(tokens.vocabulary_path()).tokenizer
    assert both == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_archives_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "a"), max_archive=30_000)
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) > 1
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a"), with_payload=True).collect()}
    want = {r.page_id: r for r in pages.collect()}
    assert {k: bytes(r.payload).decode() for k, r in got.items()} == {k: r.html for k, r in want.items()}
    assert all(r.url == want[k].url for k, r in got.items())
    one = next((tmp_path / "a").glob("*.warc.gz")).read_bytes()
    raw = list(warc.members(io.BytesIO(one).read))
    assert b"".join(raw) == gzip.decompress(one)
    with pytest.raises(ValueError):
        warc.parse(raw[0].replace(b"<html", b"<hxml", 1))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(one[:-9]).read))


def test_shared_payloads_are_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 1500), (9, "u", "a" * 1500), (5, "u", "a" * 1500), (2, "u", "b"), (3, "u", "b")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "b"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    d = hashlib.sha1(b"a" * 1500).hexdigest()
    assert got[9] == ("response", None, 1500, d) and got[1] == ("revisit", 9, 1500, d) == got[5]
    assert got[2][0] == got[3][0] == "response"


def test_toxic_sentences_are_learnt_from_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts, y = toxicity.training_sample(docs, labels, {1: 300, 0: 900})
    weights = toxicity.train(texts, y)
    got = toxicity.score(docs.where("lang = 'en'"), weights).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit / max(1, sum(r.predicted for r in got)) > 0.9 and hit / sum(r.toxic for r in got) > 0.6
    one = spark.createDataFrame([(1, "The ther and. You idiot moron of and. Then that.")], "doc_id long, text string")
    assert [r.sentence.strip() for r in toxicity.offending_sentences(one, weights).collect()] == ["You idiot moron of and."]


def brute_hits(text, items):
    words, hit, own = decontam.words_of(text), set(), set()
    for item, t in items:
        iw = decontam.words_of(t)
        k = min(10, len(iw))
        for i in range(len(iw) - k + 1 if iw else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == iw[i : i + k]:
                    hit.update(range(j, j + k))
                    own.add(item)
    return hit, own


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=3))
@settings(max_examples=80, deadline=None)
def test_automaton_matches_brute_force(words, items):
    items = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    numbers, machine = decontam.build(items)
    spans, own = decontam.find(words, numbers, machine)
    hit, want = brute_hits(" ".join(words), items)
    assert {i for a, b in spans for i in range(a, b)} == hit and own == want


def test_blocks_and_offsets(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontam.contamination(docs, bench).orderBy("doc_id").collect()
    assert decontam.contamination(docs, bench, max_bytes=3000).orderBy("doc_id").collect() == whole
    bad = {r.doc_id for r in whole if r.contaminated}
    assert bad and {r.doc_id for r in decontam.contaminated_passages(docs, bench).select("doc_id").collect()} == bad
    assert decontam.clean_documents(docs, bench).count() == 200 - len(bad)
    text = "Ünd, THE  cat; sat"
    assert [text[a:b] for a, b in decontam.offsets(text, [(1, 3)])] == ["THE  cat"]


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = np.zeros(lm.VOCAB)
    counts[:50] = rng.integers(1, 90, 50)
    counts[lm.END] = 20
    leaf = lm.leaves(counts, np.arange(lm.VOCAB) % 3 > 0)
    return counts, leaf, lm.fresh_weights(counts, leaf), rng


def test_untrained_model_is_the_unigram_distribution():
    counts, leaf, w, _ = small_model()
    x = np.full((1, 1), 7)
    p = np.exp([lm.log_probability(w, x, np.array([[leaf[i]]]))[0, 0] for i in range(60)])
    assert p == pytest.approx((counts[:60] + 0.5) / (counts + 0.5).sum(), rel=1e-3)


def test_model_is_a_distribution_and_gradient_is_right():
    counts, leaf, w, rng = small_model()
    for name in ("t1", "t2", "t3"):
        w[name] += rng.normal(0, 0.3, w[name].shape).astype(np.float32)
    ids, y, valid = rng.integers(0, 50, (2, 6)), leaf[rng.integers(0, 50, (2, 6))], np.ones((2, 6), bool)
    h, _ = lm.hidden(w, ids[:1, :1])
    every = np.arange(lm.FAN**3)
    total = np.exp(sum(t.log_p() for t in lm.levels(w, np.repeat(h, len(every), 0), every)).astype(float)).sum()
    assert total == pytest.approx(1, abs=1e-3)
    loss, grad = lm.gradient(w, ids, y, valid)
    assert loss == pytest.approx(-lm.log_probability(w, ids, y).mean(), rel=1e-5)
    for name, (rows, g) in grad.items():
        dense = np.zeros_like(w[name])
        dense[slice(None) if rows is None else rows] = g
        at = np.unravel_index(np.abs(dense).argmax(), dense.shape)
        e = 1e-2
        w[name][at] += e
        up = lm.gradient(w, ids, y, valid)[0]
        w[name][at] -= 2 * e
        down = lm.gradient(w, ids, y, valid)[0]
        w[name][at] += e
        assert (up - down) / (2 * e) == pytest.approx(float(dense[at]), rel=0.05, abs=1e-4)
    # causal: a later id changes nothing before it
    x2 = ids.copy()
    x2[:, 4] = (x2[:, 4] + 1) % 50
    assert np.allclose(lm.log_probability(w, x2, y)[:, :4], lm.log_probability(w, ids, y)[:, :4], atol=1e-6)


def test_padded_nodes_and_scored_places_change_no_result(monkeypatch):
    counts, leaf, w, rng = small_model()
    for name in ("t1", "t2", "t3"):
        w[name] += rng.normal(0, 0.3, w[name].shape).astype(np.float32)
    ids = np.minimum(rng.zipf(1.2, (40, lm.LENGTH)), 3000) % 500
    y, valid = leaf[np.roll(ids, -1, axis=1)], rng.random(ids.shape) < 0.9
    loss, grad = lm.gradient(w, ids, y, valid)
    logs = lm.log_probability(w, ids, y)
    f = rng.normal(0, 1, (5, 40, 4 * lm.WIDTH)).astype(np.float32)
    assert np.allclose(lm.attend(f, 12)[1], lm.attend(f)[1][:, 12:], atol=1e-6)  # a window asks only for what it scores
    starts = np.array([0, 2, 40, 75, 1200])
    score = lm.score_streams(ids.ravel(), starts, w, leaf)
    assert np.allclose(lm.score_streams(ids.ravel(), starts, w, leaf, lm.products(w), step=3, block=100), score, rtol=1e-5)
    assert score == pytest.approx([naive_log10(w, leaf, ids.ravel()[a:e]) for a, e in zip(starts[:-1], starts[1:])], rel=1e-4)
    monkeypatch.setattr(lm, "PADDED", (0,))  # each node has a product of its own
    one, alone = lm.gradient(w, ids, y, valid)
    assert loss == pytest.approx(one, rel=1e-6) and np.allclose(lm.log_probability(w, ids, y), logs, atol=1e-5)
    for name, (rows, g) in grad.items():
        assert rows is None or np.array_equal(rows, alone[name][0])
        assert np.allclose(g, alone[name][1], atol=1e-6)


def naive_log10(w, leaf, ids):
    """One text's log10 probability, an id at a time, in float64: window, softmax attention, three softmaxes."""
    w = {k: v.astype(float) for k, v in w.items()}
    soft = lambda o: np.exp(o - o.max()) / np.exp(o - o.max()).sum()
    total = 0.0
    for t in range(len(ids) - 1):
        first = 0 if t < lm.LENGTH else lm.STRIDE * -(-(t + 1 - lm.LENGTH) // lm.STRIDE)
        context = ids[first : t + 1]
        e = w["emb"][context] + w["pos"][: len(context)]
        q, k, v = np.split(e @ w["qkv"], 3, axis=1)
        h = soft(k @ q[-1] / math.sqrt(lm.WIDTH)) @ v
        u = np.tanh(np.concatenate((h, e[-1], [1])) @ w["hid"])
        one, low, at = np.append(u, 1), np.append(u @ w["low"], 1), int(leaf[ids[t + 1]])
        fan = lm.FAN
        total += math.log10(soft(one @ w["t1"][0])[at // fan**2] * soft(one @ w["t2"][at // fan**2])[at // fan % fan] * soft(low @ w["t3"][at // fan])[at % fan])
    return total


def test_scores_are_those_of_a_naive_evaluation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = lm.vocabulary_path("piece_bpe_32k.model")
    _, w, leaf = lm.learn(docs.where(~lm.held_out(docs.doc_id)), path)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    rows = [(None, None), *((r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(20).collect())]
    for doc, text in rows:
        _, _, ids, _ = lm.streams([text], lm._piecer(path))
        if doc is None:
            assert len(ids) == 2 and naive_log10(w, leaf, ids) < 0
        else:
            assert got[doc] == pytest.approx(naive_log10(w, leaf, ids), rel=1e-4)


def test_training_helps_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = lm.vocabulary_path("piece_bpe_32k.model")
    _, w, leaf = lm.learn(docs.where(~lm.held_out(docs.doc_id)), path)
    piecer = lm._piecer(path)
    text = [r.text for r in docs.where(lm.held_out(docs.doc_id)).collect()]
    _, _, ids, starts = lm.streams(text, piecer)
    counts = np.bincount(lm.streams([r.text for r in docs.where(~lm.held_out(docs.doc_id)).collect()], piecer)[2], minlength=lm.VOCAB)
    assert lm.score_streams(ids, starts, w, leaf).sum() > 0.85 * lm.score_streams(ids, starts, lm.fresh_weights(counts, leaf), leaf).sum()


def test_weights_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = lm.vocabulary_path("piece_bpe_32k.model")
    one, two = lm.learn(docs.coalesce(1), path)[1], lm.learn(docs.repartition(5, "text"), path)[1]
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_trainers_are_averaged(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(lm, "PER_TRAINER", 18)  # over 64 trainers: the sums take two levels
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.undo()
    one = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert got.keys() == one.keys() and all(math.isfinite(x) and x < 0 for x in got.values())


def test_frequent_is_exact(spark):
    rng = np.random.default_rng(3)
    for counts in ([7] * 500, rng.integers(1, 30, 500).tolist(), (10 ** rng.uniform(0, 9, 500)).astype(int).tolist(), [200_000 + i % 3 for i in range(500)]):
        df = spark.createDataFrame(list(enumerate(counts)), "key long, n long")
        for most in (5, 50, 499, 500, 900):
            got = sorted((r.n for r in lm.frequent(df, most).collect()), reverse=True)
            assert got == sorted(counts, reverse=True)[:most]


def test_windows_score_each_id_once():
    starts = np.array([0, 2, 40, 75, 300])
    first, text, new = lm.spans(starts)
    seen = Counter()
    for a, t, k in zip(first, text, new):
        for p in range(k, lm.LENGTH):
            if a + p < starts[t + 1] - 1:
                seen[a + p] += 1
    inputs = [i for s, e in zip(starts[:-1], starts[1:]) for i in range(s, e - 1)]
    assert dict(seen) == {i: 1 for i in inputs}


def test_base_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    texts = {r.doc_id: [w.decode() for w in lm.words_of(r.text)] for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, ws in texts.items() if not out[d] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for d, ws in texts.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0


def test_rare_words_get_their_counts_by_a_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r for r in lm.score(docs).collect()}
    cut = {r.doc_id: r for r in lm.score(docs, top_words=50).collect()}
    assert all(cut[d].n_known == r.n_known and cut[d].base_score == pytest.approx(r.base_score, rel=1e-9) for d, r in whole.items())


def test_memory_is_bounded_without_a_change(monkeypatch):
    piecer = lm.Pieces(lm.vocabulary_path("piece_bpe_32k.model"))
    texts = ["some words and " + "b" * 5000, None, "other words"]
    first = lm.streams(texts, piecer)
    assert not piecer.full
    monkeypatch.setattr(lm, "MEMO_BYTES", 1000)
    assert piecer.full
    piecer.clear()
    assert len(piecer) == 1 and all(np.array_equal(a, b) for a, b in zip(lm.streams(texts, piecer), first))


def test_model_learns_from_every_window(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20 * i))) for i in range(12)], "doc_id long, text string")
    piecer = lm.Pieces(lm.vocabulary_path("piece_bpe_32k.model"))
    facts = lm.gather(docs, lm.vocabulary_path("piece_bpe_32k.model")).where("kind = 2").collect()
    got = sorted(len(r.ids) // 2 - 1 for r in facts)
    _, _, _, starts = lm.streams([r.text for r in docs.orderBy("doc_id").collect()], piecer)
    assert got == sorted(min(lm.LENGTH, n - i) for n in (np.diff(starts) - 1).tolist() for i in range(0, n, lm.LENGTH))


def test_blocks_keep_repeated_and_null_ids_apart(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r.text for r in bench.where("text is not null").orderBy("item_id").limit(6).collect()]
    rows = [(7, texts[0]), (7, "and " + texts[1]), (7, "nothing here"), (None, texts[2]), (None, "so " + texts[3]), (2**60 + 1, texts[4]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = order(decontam.contamination(docs, bench))
    assert len(whole) == len(rows) and order(decontam.contamination(docs, bench, max_bytes=3000)) == whole
    passages = order(decontam.contaminated_passages(docs, bench))
    assert passages and order(decontam.contaminated_passages(docs, bench, max_bytes=3000)) == passages


def test_items_without_id_hit_as_in_sql(spark):
    import duckdb
    from tellurion.llm import oracles

    items = [(None, "one two three"), ("a", "four five"), ("b", "one two three"), (None, "lone words")]
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five"), (3, "the lone words"), (4, "none")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        con.register(f"{name}_", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    assert got == sorted(con.execute(oracles.DECONTAMINATION).fetchall())
    assert [r[2:4] for r in got] == [(3, 1), (2, 1), (2, 0), (0, 0)]


def test_notices_with_a_break_inside(spark):
    gpl = (
        "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation{} either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    notices = {"GPL-3.0-or-later": gpl.format(":", ",", 3), "GPL-2.0-or-later": gpl.format(";", ",", 2), "MPL-2.0": mpl}
    rows = [(name, cut) for name, text in notices.items() for cut in (text, textwrap.fill(text, 70))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.licenses for r in got] == [r.doc_id for r in got] and len(got) == len(rows)


def test_license_places(spark):
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without\n"
             "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the\n"
             "Software is furnished to do so, subject to the following conditions:\n\n")
    notice = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [
        (1, "Licensed under CC BY-NC 4.0\nand then some prose that goes on\n\n" + grant + notice, "ccbync4ref,mitgrant,mitnotice", "MIT,CC-BY-NC-4.0", 0),
        (2, "Licensed under the MIT License (MIT).", "mitref", "MIT", 0),
        (3, "This is free and unencumbered software released into the PUBLIC\nDomain.", "unlicense", "Unlicense", 0),
        (4, "No Warranty is given.", "", "", 1),
        (5, grant + "Some other permission.\n\n" + notice, "mitgrant,mitnotice", "", 1),
        (6, None, "", "", 0), (7, "", "", "", 0), (8, " \n\n ", "", "", 0)]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.sentence_ids, r.licenses, r.n_unknown) for r in got] == [(r[0], *r[2:]) for r in rows]


def test_archives_that_are_missing_or_short(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<html>{i} " + "z" * 500) for i in range(200)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "c"), max_archive=3000)
    files = sorted((tmp_path / "c").glob("*.warc.gz"))
    (tmp_path / "c" / "left-behind.warc.gz").write_bytes(files[0].read_bytes())  # of an attempt that no manifest names
    assert warc.read_archives(spark, str(tmp_path / "c")).count() == 200
    data = files[0].read_bytes()
    first = next(warc.members(io.BytesIO(data).read))
    files[0].write_bytes(warc.member(first))
    with pytest.raises(Exception, match="records"):
        warc.read_archives(spark, str(tmp_path / "c")).collect()
    files[0].unlink()
    with pytest.raises(ValueError, match="missing"):
        warc.read_archives(spark, str(tmp_path / "c"))


def foreign(kind, block, *more):
    return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "warc-date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html>body</html>"
    body = b"<html>body</html>"
    sha = hashlib.sha1(body).hexdigest()
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://x/", "Content-Type: application/http; msgtype=request"),
        foreign("response", http, "WARC-Target-URI: http://x/", "Content-Type: application/http;\r\n msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", "WARC-Block-Digest: md5:" + hashlib.md5(http).hexdigest(), "X-Other: blake3:zz"),
        foreign("resource", b"r" * 70000, "WARC-Block-Digest: crc:77"),
        foreign("revisit", b"", "WARC-Refers-To: <urn:uuid:3>"),
    ]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    rows = warc.read_archives(spark, str(tmp_path / "d"), with_payload=True).collect()
    assert [(r.record_type, r.page_id, r.url) for r in rows] == [("warcinfo", None, None), ("request", None, "http://x/"), ("response", None, "http://x/"), ("resource", None, None), ("revisit", None, None)]
    assert (bytes(rows[2].payload), rows[2].payload_digest, rows[2].payload_bytes) == (body, sha, len(body)) and rows[3].payload_bytes == 70000 and rows[4].payload_bytes is None
    for bad in (records[2].replace(b"body", b"bodx"), records[3][:-5], b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)
