import corpus_pipeline
from tellurion.llm import decontam, mixing, quality, sharding
from tests.llm.test_simhash import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.judge(docs).where("kept").collect()}
    sets, root = {d: shingle_set(t) for d, t in kept.items()}, {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    left = {d for d in kept if root[d] == d}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    numbers, machine = decontam.build(items)
    left = {d for d in left if not decontam.find(decontam.words_of(kept[d]), numbers, machine)[0]}
    clean = docs.where(docs.doc_id.isin(list(left)))
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(clean).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {d: n for d, n in times.items() if n}
    shards = sharding.SHARDS
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % shards, i // shards) for i in range(len(got)))


def test_odd_and_empty_tables(spark, tmp_path):
    prose = "the cat and the dog went to the house in the wood and it was a good day for all of them there"
    rows = [
        (1, prose, "en", "a", 1, 7, "x"), (1, prose, "en", "a", 1, 7, "x"), (None, prose, "en", None, 1, None, "y"), (4, None, "en", "a", 0, 1, None), (5, "", None, "b", 0, 1, "z"), (6, " \n", "en", "b", 2, 1, "z"),
        (1, prose.replace("cat", "hen").replace("dog", "cow").replace("wood", "town").replace("good", "bad"), "en", "c", 1, 7, "x"), (8, " ".join(f"the word{i} of" for i in range(20000)), "en", "b", 1, 1, "q")]
    d = str(tmp_path / "odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, passes long, _row string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "no such words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        if name == "simhash near-dedup":
            assert sorted((r.doc_id, len(r.text)) for r in docs.collect()) == sorted([(1, len(prose)), (1, len(rows[6][1])), (8, len(rows[7][1]))])
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} <= {1, 8} and len({(r.shard, r.slot) for r in got}) == len(got)
    e = str(tmp_path / "empty")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{e}/{t}.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0
