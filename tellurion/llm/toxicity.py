"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its words' features (the word and its beginnings of four to eight letters, hashed);
a document's is the noisy-or of its sentences, 1 - prod(1 - p).  Only documents
are labelled; the gradient of the document's likelihood reaches the sentences
through the noisy-or, so the trained scorer also tells which sentences offend.

Training takes a bounded sample (``PER_CLASS``) of the labelled documents outside
the held-out third, the first of each class by a hash of the id; everything else
runs over all documents and whole texts.  Ids, sources, languages and labels are
not inputs of a score.

Defined results: null, empty and blank texts have no sentences and score 0; rows
without a known label are scored like any other; repeated rows stay rows; several
labels of one id count as toxic if any is; without a toxic and a clean training
document every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_CLASS = {1: 2000, 0: 4000}
BUCKETS = 1 << 18
MIN_DOCS = 4
STEPS = 120
RATE = 0.15
DECAY = 1e-5
BIAS = -6.0
CUT = 0.7
#: Texts that an id may give to the sample.
PER_ID = 4
MEMO = 400_000
LONGEST = 64
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = ".,!?;:\"'()[]{}%$*&#|<>-_"


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    parts = ["=" + word] + [word[:k] for k in range(4, 9) if len(word) >= k]
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


def sentence_words(text: str | None) -> list[list[str]]:
    """The sentences of a text that have words, as stripped lower-case words."""
    out = []
    for m in SENTENCE.findall(text.lower()) if text else []:
        words = [w for w in (x.strip(_EDGE) for x in m.split()) if w]
        if words:
            out.append(words)
    return out


def train(texts: list[str | None], labels: list[int], steps: int = STEPS) -> np.ndarray:
    """Feature weights, the bias last; zeros with a bias of -inf if a class is missing."""
    if len(set(labels)) < 2:
        return np.concatenate((np.zeros(BUCKETS), [-np.inf]))
    index: dict[str, int] = {}
    words, sentence_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for sentence in sentence_words(text):
            words += [index.setdefault(w, len(index)) for w in sentence]
            sentence_of += [len(doc_of)] * len(sentence)
            doc_of.append(d)
    words, sentence_of, doc_of = np.array(words, np.int32), np.array(sentence_of, np.int32), np.array(doc_of, np.int32)
    feats = [features(w) for w in index]
    owner = np.repeat(np.arange(len(feats), dtype=np.int32), [len(f) for f in feats])
    flat = np.fromiter((x for f in feats for x in f), np.int32)
    doc_words = np.unique(doc_of[sentence_of].astype(np.int64) * len(index) + words)
    in_docs = np.bincount(flat, weights=np.bincount(doc_words % len(index), minlength=len(index))[owner], minlength=BUCKETS)
    known = in_docs[flat] >= MIN_DOCS
    used, flat = np.unique(flat[known], return_inverse=True)
    owner = owner[known]
    y = np.array(labels, float)
    w, bias = np.zeros(len(used)), BIAS
    m = v = np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        per_word = np.bincount(owner, weights=w[flat], minlength=len(index))
        z = np.bincount(sentence_of, weights=per_word[words], minlength=len(doc_of)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_q = np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=len(y))
        q = np.exp(np.minimum(log_q, -1e-9))
        back = np.where(y == 1, -q / (1 - q), 1.0)[doc_of] * p
        g_word = np.bincount(words, weights=back[sentence_of], minlength=len(index))
        g = np.concatenate((np.bincount(flat, weights=g_word[owner], minlength=len(used)), [back.sum()])) / len(y)
        g[:-1] += DECAY
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = np.maximum(w - step[:-1], 0.0), bias - step[-1]  # evidence only adds: neutral words don't thin an offence out
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w, bias
    return out


class Scorer:
    """Sentence and document scores from trained weights, with a bounded memory of words."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.bias, self.memo = weights[:-1], weights[-1], {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            got = float(self.weights[features(s)].sum()) if (s := w.strip(_EDGE)) else 0.0
            if len(self.memo) < MEMO and len(w) <= LONGEST:
                self.memo[w] = got
        return got

    def sentences(self, text: str | None) -> np.ndarray:
        """Log odds of the sentences, in order."""
        return np.array([sum(map(self.word, w)) for m in SENTENCE.findall(text.lower() if text else "") if (w := m.split())]) + self.bias

    def document(self, text: str | None) -> float:
        if not text or not np.isfinite(self.bias):
            return 0.0
        z = [sum(map(self.word, words)) for m in SENTENCE.findall(text.lower()) if (words := m.split())]
        if not z:
            return 0.0
        return float(-np.expm1(-np.logaddexp(0, np.array(z) + self.bias).sum()))


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> tuple[list, list]:
    """Texts and labels, at most ``per_class`` ids of each label, first by hash of the id, and ``PER_ID`` texts of an id, first by hash of the text."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = texts.withColumn("_k", place).where(F.col("_k") <= PER_ID).select("doc_id", "text", "y").collect()  # at most PER_ID for each of per_class
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return [r.text for r in rows], [r.y for r in rows]


_scorers: dict[str, Scorer] = {}


def _scorer(shared, tag: str) -> Scorer:
    if tag not in _scorers:
        _scorers.clear()
        _scorers[tag] = Scorer(shared.value)
    return _scorers[tag]


def _share(spark, weights: np.ndarray):
    return spark.sparkContext.broadcast(weights), xxhash.xxh64_hexdigest(weights.tobytes())


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared, tag = _share(docs.sparkSession, weights)

    def run(batches):
        s = _scorer(shared, tag)
        for b in batches:
            got = np.array([s.document(t) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, weights: np.ndarray, cut: float = 0.5) -> DataFrame:
    """doc_id, start, stop, sentence, score of every sentence that scores at least ``cut``."""
    shared, tag = _share(docs.sparkSession, weights)

    def run(batches):
        s = _scorer(shared, tag)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for m in SENTENCE.finditer(text or ""):
                    words = m.group().lower().split()
                    z = sum(map(s.word, words)) + s.bias
                    p = float(1 / (1 + np.exp(-np.clip(z, -500, 500)))) if words else 0.0
                    if p >= cut:
                        out.append((doc, m.start(), m.end(), m.group(), p))
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, stop int, sentence string, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from ``labels`` outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, labels = training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, train(texts, labels))
