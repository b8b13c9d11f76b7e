"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Texts are lower-cased (A-Z) and cut into words; an item's windows of ten
consecutive words are the patterns (an item of fewer words is one pattern).  The
automaton works on word numbers instead of letters, so it is as large as ten times
the windows and never matches inside a word.  A document is scanned once; matches
give word positions, and word positions map back to the original text's offsets,
since lower-casing A-Z moves nothing.

The items are a stated test set; their text is read to the driver behind a checked
bound (``max_bytes``) and sent to the executors.  A larger set is worked off in
blocks of that size whose hits are united by a written row number, so no item is
dropped and rows with the same or no doc_id stay apart.

Defined results: null and empty texts have no words and no hits; items without
words have no windows; repeated documents are scanned each; repeated item ids
count once; windows of items without an id are hits, but no id is listed or counted
for them; an empty table on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.sources.scratch import materialise

WINDOW = 10
MAX_BYTES = 32 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


def build(items: list[tuple[str | None, str | None]]) -> tuple[dict[str, int], ahocorasick.Automaton | None]:
    """Word numbers (from 1) and the automaton; a pattern's value is (length, item ids)."""
    numbers: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        size = min(WINDOW, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            own = owners.setdefault(tuple(ids[i : i + size]), set())
            if item is not None:
                own.add(item)
    if not owners:
        return numbers, None
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, own in owners.items():
        machine.add_word(key, (len(key), tuple(sorted(own))))
    machine.make_automaton()
    return numbers, machine


def find(words: list[str], numbers: dict[str, int], machine) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged half-open word spans that lie in matches, and the items matched."""
    ids = tuple(map(numbers.get, words, [0] * len(words)))
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if machine is None or not any(ids):
        return spans, items
    for end, (size, own) in machine.iter(ids):
        start = end - size + 1
        items.update(own)
        while spans and start <= spans[-1][1]:
            start = min(start, spans.pop()[0])
        spans.append((start, end + 1))
    return spans, items


_built: dict[str, tuple] = {}


def _scanner(items, tag: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _built:  # one automaton for a Python worker
            _built.clear()
            _built[tag] = build(items.value)
        numbers, machine = _built[tag]
        for batch in batches:
            n_words, hits, owners = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                spans, own = find(words, numbers, machine)
                n_words.append(len(words))
                hits.append([{"start": a, "stop": b} for a, b in spans])
                owners.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(hits, SPANS), pa.array(owners, pa.list_(pa.string()))],
                names=[*keep, "n_words", "spans", "items"])

    return run


def _blocks(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most ``max_bytes`` of text (or one item)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"))
    total = rows.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    n = int(total // max(1, max_bytes // 2)) + 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (with ``text``), and n_words, spans, items."""
    blocks = _blocks(benchmark, max_bytes)
    first, second = next(blocks), next(blocks, None)

    def hits(rows, block, cols):
        shared, tag = docs.sparkSession.sparkContext.broadcast(block), hashlib.sha256(repr(block).encode()).hexdigest()
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*cols).schema)
        return shared, rows.select(*dict.fromkeys([*cols, "text"])).mapInArrow(_scanner(shared, tag, cols), fields + SCHEMA)

    if second is None:
        return hits(docs, first, keep)[1]
    rows, parts = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), *dict.fromkeys([*keep, "text"])), "leak-rows"), []
    for block in chain([first, second], blocks):  # one block in memory at a time
        shared, found = hits(rows, block, ["_row"])
        parts.append(materialise(found.where(F.size("spans") > 0) if parts else found, "leak-block"))
        shared.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    united = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = F.aggregate(
        "s", F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))))
    united = united.select("_row", "n_words", merged.alias("spans"), "items")
    return rows.select("_row", *keep).join(united, "_row").drop("_row")


def contamination(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    out = scan(docs, benchmark, ["doc_id"], max_bytes)
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as character offsets of the original text."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, start, stop, passage for every hit stretch, in characters of the original text."""

    def run(batches):
        for b in batches:
            at, starts, stops, passages = [], [], [], []
            for i, (text, spans) in enumerate(zip(b.column("text").to_pylist(), b.column("spans").to_pylist())):
                for x, y in offsets(text, [(s["start"], s["stop"]) for s in spans]):
                    at.append(i)
                    starts.append(x)
                    stops.append(y)
                    passages.append(text[x:y])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(passages, pa.string())],
                names=["doc_id", "start", "stop", "passage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = scan(docs, benchmark, ["doc_id", "text"], max_bytes).where(F.size("spans") > 0)
    return found.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, start int, stop int, passage string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns; one block of items after the other, what is left written between them."""
    columns, blocks = docs.columns, _blocks(benchmark, max_bytes)
    items = next(blocks)
    while items is not None:
        shared, tag = docs.sparkSession.sparkContext.broadcast(items), hashlib.sha256(repr(items).encode()).hexdigest()

        def run(batches, shared=shared, tag=tag):
            if tag not in _built:
                _built.clear()
                _built[tag] = build(shared.value)
            numbers, machine = _built[tag]
            for batch in batches:
                keep = [not find(words_of(t), numbers, machine)[0] for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        items = next(blocks, None)
        if items is not None:
            docs = materialise(docs, "clean-block")
            shared.unpersist()
    return docs.select(*columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against every item of ``benchmark``."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
