"""Token counts with a digest cache.

A text's content digest is the SHA-256 of its normalised form (runs of ASCII
white space made one space, ends trimmed: the tokenizer drops white space itself,
so equal digests have equal counts); the version digest is the SHA-256 of the
vocabulary file.  Texts are joined to the cache on both digests.  Only distinct
digests that the cache lacks are encoded, once each, and appended to it.

Encoding.  The tokenizer's normaliser and splitter never look across white space,
so a text's count is the sum over its white-space separated words (tests hold this
against whole-text encoding); a worker keeps the counts of words it has met, up to
``MEMO`` words of at most ``LONGEST`` bytes, and gives the library only words it hasn't.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside texts are handled as the library does by default; repeated rows and ids
stay rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.sources.scratch import fresh_path, materialise

LIMIT = 2048
MEMO = 600_000
LONGEST = 64
CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_SPACES = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounter:
    """Token counts of texts, with a bounded memory of words."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, int] = {}
        self.size = memo

    def count(self, texts: list[str | None]) -> list[int]:
        split = [t.encode("utf-8", "replace").translate(_SPACES).split() if t else [] for t in texts]
        memo = self.memo
        new = list({w for words in split for w in words if w not in memo})
        lengths = [len(e.ids) for s in range(0, len(new), 4096) for e in self.tokenizer.encode_batch_fast([w.decode() for w in new[s : s + 4096]], add_special_tokens=False)]
        met = dict(zip(new, lengths))
        if len(memo) + len(met) <= self.size and max(map(len, new), default=0) <= LONGEST:
            memo.update(met)
            return [sum(map(memo.__getitem__, words)) for words in split]
        for w in new[: max(0, self.size - len(memo))]:
            if len(w) <= LONGEST:
                memo[w] = met[w]
        both = lambda w: met[w] if w in met else memo[w]
        return [sum(map(both, words)) for words in split]


_counters: dict[str, WordCounter] = {}


def _counter(path: str) -> WordCounter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = WordCounter(path)
    return _counters[path]


def _digest(text):
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens for every row of ``texts`` (digest, text)."""

    def run(batches):
        counter = _counter(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(np.array(counter.count(part.column("text").to_pylist()), np.int64))], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, cache_path: str, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; the cache at ``cache_path`` (made if missing) gains what it lacked.

    The text is scanned for the digests and, for one document of each missing
    digest, once more to be encoded; only those texts are moved.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    version = version_digest(path)
    rows = materialise(
        docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), _digest(F.col("text")).alias("digest")),
        "token-rows")
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    wanted = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    missing = wanted.join(stored(), "digest", "left_anti").withColumnRenamed("digest", "_digest").hint("shuffle_hash")
    digested = docs.select("doc_id", _digest(F.col("text")).alias("digest"), "text")
    texts = digested.join(missing, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    encode_misses(texts, path).dropDuplicates(["digest"]).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    return rows.join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``; the cache starts empty, so every distinct text is encoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, fresh_path(spark, "token-cache"))
