"""Packed token ids: exact round trips, and whole texts through the library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tellurion.llm import packed
from tellurion.sources.scratch import fresh_path


@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=3000), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values, share):
    ids = np.array(values, np.uint32)
    blocks = packed.pack(ids, share)
    assert len(blocks) == -(-len(ids) // packed.BLOCK)
    assert np.array_equal(packed.unpack(blocks)[: len(ids)] if blocks else ids, ids)


def test_width_is_the_percentile_and_the_rest_exceptions():
    ids = np.full(packed.BLOCK, 7, np.uint32)
    ids[:900] += np.arange(900, dtype=np.uint32) % 16
    ids[1000:] = 2**31
    low, width, n, _ = packed._HEAD.unpack_from(packed.pack(ids, 0.9)[0])
    assert (low, width, n) == (7, 4, 24)


def test_file_ranges_and_damage(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 50000, rng.integers(0, 4000), dtype=np.uint32)) for i in range(60)]
    uri = f"file://{tmp_path}/a.pfor"
    w = packed.Writer(uri)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    every, r = np.concatenate([x for _, x in docs]), packed.Reader(uri)
    for a, b in [(0, 0), (0, 1), (1023, 1025), (5000, 90000), (0, len(every))]:
        assert np.array_equal(r.read(a, b), every[a:b])
    assert [(d, n) for d, _, n, _ in r.documents()] == [(d, len(x)) for d, x in docs]
    data = bytearray((tmp_path / "a.pfor").read_bytes())
    for at in (40, len(data) - 100):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "b.pfor").write_bytes(bad)
        with pytest.raises(ValueError):
            list(packed.Reader(f"file://{tmp_path}/b.pfor").documents())


ODD = [(9, None), (3, ""), (3, "a <|endoftext|> ﬁ ÀÉ́ 　x"), (None, "q" * 5000 + " w" * 30000), (None, "zz"), (-4, "\x85a b\x1cc"), (3, ""), (2**40, "naïve don't it's 1234 ΑΣ ΑΣ. \x00")]


def test_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 4096)
    monkeypatch.setattr(packed, "LEAST_BYTES", 1 << 13)
    from tokenizers import Tokenizer

    rows = ODD + [(random.Random(i).randrange(1000), f"text {i} of Many " * (i % 90)) for i in range(300)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string").repartition(4)
    folder = fresh_path(spark, "ids")
    packed.write_ids(docs, folder)
    got = sorted(packed.read_ids(spark, folder, True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is None, d or 0))
    t, at, texts = Tokenizer.from_file(packed.vocabulary_path()), 0, {}
    for d, x in rows:
        texts.setdefault(d, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in got:
        assert r.start == at and bytes(r.ids) in texts[r.doc_id] and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        texts[r.doc_id].remove(bytes(r.ids))
        at += r.n_tokens


@pytest.mark.parametrize("memo", [3, 10**6])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_equal_whole_texts(name, memo):
    from tokenizers import Tokenizer

    path = packed.vocabulary_path(name)
    t, w, rng = Tokenizer.from_file(path), packed.WordIds(path, memo), random.Random(8)
    marks = ["don't", "it's,", "a.b", "WORD.", "End!?)", "x1y", "1234", "ΑΣ", "é", "e\u0301", "\u0301x", "ß", "STRASSE", "ÀÉÎÕÜ,", "ñandú", "Ærøå", "×÷", "a×b", "ÿŸ", "\u00aa\u00ba\u00b5", "İ", "\x01", "a\x01b", "\u3000", "x\u3000y", "<|endoftext|>", "a<|startoftext|>b", "'", "'s", "s'", '"q"', "ﬁ", "\x1c", "\x85", "日本語", "😀", ".", "...", "),", "\ufffd"]
    texts = [None, "", " \n"] + [rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choice(marks) + rng.choice(["", "", rng.choice(marks)]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for s in range(0, len(texts), 50):
        got = w.encode(texts[s : s + 50], 2)
        assert [np.frombuffer(x, w.kind).tolist() for x in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts[s : s + 50]]


def test_query_on_all_documents(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(packed.vocabulary_path())
    at, want = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in packed.op11_packed_ids(spark, sf).collect()} == want
