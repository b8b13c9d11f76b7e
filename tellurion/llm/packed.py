"""Token ids of documents in files of patched frame-of-reference blocks.

Format.  Ids run through a file document after document, each with its end id.  A
block holds ``BLOCK`` of them: its minimum, a width in bits, and the differences to the
minimum packed at that width, least bit first.  The width is the one that ``SHARE`` of
the block's differences fit; the high bits of the others follow as a list of
exceptions (places, then values).  The last block is filled with its minimum.  After
the blocks come their starts and CRC-32s, the documents (id, end, and whether the id
is known), and a footer of fixed size.  Any range of ids is read through the starts.

    magic | blocks | starts u64 x (blocks + 1) | crc u32 x blocks
          | ids i64 x docs | ends u64 x docs | known u8 x docs | footer

Writing.  Documents are sorted by ranges of (doc_id, row number); each range encodes
its texts and streams one file in pieces of ``PIECE`` ids.  The manifest is a Parquet table that Spark commits: one
row a file, first key, numbers of documents and ids.  Files that it doesn't name (of
attempts that failed) are never read.  Reading checks every block's CRC-32 and each
file's numbers against the manifest.

Encoding.  This tokenizer never looks across white space, so a worker keeps the ids of
words it has met (bounded) and gives the library the others; tests hold this against
whole texts.  A vocabulary of another kind gets whole texts.

Defined results: null and empty texts have the end id only; null doc_ids come after
all others; repeated ids are ordered by row number; doc_id is a long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm.files import fresh_name, qualified, system_of
from tellurion.llm.tokens import LONGEST, vocabulary_path
from tellurion.sources.scratch import fresh_path

BLOCK = 1024
SHARE = 0.9
PIECE = 1 << 20
END = 2
MEMO = 400_000
#: Bytes of text and documents to a file, and the least bytes that are worth a task of their own.
FILE_BYTES, FILE_DOCS = 1 << 28, 1 << 20
LEAST_BYTES = 1 << 21
MAGIC = b"TLIDS\x00\x00\x01"
_HEAD = struct.Struct("<IBxHI")
_FOOT = struct.Struct("<QQQQII8s")
#: The splitter and the suffix of vocabularies whose words don't depend on each other (fixed values), and what may close a plain word.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
CLOSING = b'.,;:!?)"'
BETWEEN = "\x01"
_SPACES = bytes(32 if 9 <= i <= 13 else i for i in range(256))


# ---- blocks --------------------------------------------------------------------


def pack(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """The blocks of ``ids`` (unsigned 32-bit)."""
    if not len(ids):
        return []
    fill = -len(ids) % BLOCK
    rows = np.concatenate((ids, np.full(fill, ids[-(len(ids) % BLOCK or BLOCK) :].min(), np.uint32))).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    gaps = rows - low[:, None]
    bits = np.frexp(gaps.astype(np.float64))[1].astype(np.uint8)
    place = max(0, min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1))
    width = np.partition(bits, place, axis=1)[:, place]
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        flat = np.unpackbits(gaps[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=w)
        for i, line in zip(at.tolist(), np.packbits(flat.reshape(len(at), -1), axis=1, bitorder="little")):
            packed[i] = line.tobytes()
    over = bits > width[:, None]
    rest = gaps >> np.minimum(width, 31)[:, None].astype(np.uint32)
    out = []
    for i, body in enumerate(packed):
        where = np.flatnonzero(over[i])
        out.append(_HEAD.pack(int(low[i]), int(width[i]), len(where), len(body)) + body + where.astype("<u2").tobytes() + rest[i][where].astype("<u4").tobytes())
    return out


def unpack(blocks: list[bytes]) -> np.ndarray:
    """The ids of whole blocks."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    width = np.array([h[1] for h in heads])
    out = np.zeros((len(blocks), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        body = np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + heads[i][3]] for i in at), np.uint8).reshape(len(at), -1)
        flat = np.zeros((len(at), BLOCK, 32), np.uint8)
        flat[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        out[at] = np.packbits(flat, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i, (low, w, n, size) in enumerate(heads):
        if n:
            at = _HEAD.size + size
            where, rest = np.frombuffer(blocks[i], "<u2", n, at), np.frombuffer(blocks[i], "<u4", n, at + 2 * n)
            out[i, where] |= rest << np.uint32(w)
        out[i] += np.uint32(low)
    return out.ravel()


# ---- files ---------------------------------------------------------------------


class Writer:
    """A file that grows by documents; holds one piece of ids and the indexes."""

    def __init__(self, uri: str):
        system, path = system_of(uri)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.held, self.pending, self.n = len(MAGIC), [], 0, 0
        self.starts, self.sums, self.ids, self.ends = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.pending += len(ids)
        self.n += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.n)
        if self.pending >= PIECE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for s in range(0, whole, PIECE):
            for b in pack(ids[s : min(s + PIECE, whole)]):
                self.starts.append(self.at)
                self.sums.append(zlib.crc32(b))
                self.out.write(b)
                self.at += len(b)
        self.held, self.pending = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = np.array([*self.starts, self.at], "<u8").tobytes() + np.array(self.sums, "<u4").tobytes()
        index += np.array([0 if d is None else d for d in self.ids], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes() + bytes(d is not None for d in self.ids)
        self.out.write(index)
        self.out.write(_FOOT.pack(self.n, len(self.ids), len(self.starts), self.at, BLOCK, zlib.crc32(index), MAGIC))
        self.out.close()


class Reader:
    """A file opened for any range of ids; damage raises ``ValueError``."""

    def __init__(self, uri: str):
        system, path = system_of(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        if size < len(MAGIC) + _FOOT.size:
            raise ValueError(f"{uri} is too short")
        self.n_ids, self.n_docs, blocks, at, block, crc, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        index = self.file.read_at(size - _FOOT.size - at, at) if magic == MAGIC and block == BLOCK and at < size else b""
        if not index or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} has no sound index")
        parts, at = [], 0
        for kind, n in (("<u8", blocks + 1), ("<u4", blocks), ("<i8", self.n_docs), ("<u8", self.n_docs), ("u1", self.n_docs)):
            parts.append(np.frombuffer(index, kind, n, at))
            at += parts[-1].nbytes
        self.starts, self.sums, self.ids, self.ends, self.known = parts

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        a = int(self.starts[first])
        data = self.file.read_at(int(self.starts[last]) - a, a)
        cuts = (self.starts[first : last + 1] - np.uint64(a)).tolist()
        blocks = [data[x:y] for x, y in zip(cuts, cuts[1:])]
        if any(zlib.crc32(b) != c for b, c in zip(blocks, self.sums[first:last].tolist())):
            raise ValueError("a block is damaged")
        return unpack(blocks)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, list[np.ndarray]]]:
        """doc_id, start, number of ids, and the ids in pieces, of each document in order."""
        begin, piece, base = 0, np.empty(0, np.uint32), 0
        for doc, end, known in zip(self.ids.tolist(), self.ends.tolist(), self.known.tolist()):
            at, parts = begin, []
            while at < end:
                if at >= base + len(piece):
                    base = at // BLOCK * BLOCK
                    piece = self.read(base, min(base + PIECE, self.n_ids))
                upto = min(end, base + len(piece))
                parts.append(piece[at - base : upto - base])
                at = upto
            yield doc if known else None, begin, end - begin, parts
            begin = end


# ---- tables --------------------------------------------------------------------


#: Classes of bytes: 1 ASCII letter, 2 first byte of another Latin-1 letter (3: its second byte), 4 closing sign, 8 space, 0 others.
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123)]], _CLASS[0xC3], _CLASS[[*CLOSING]], _CLASS[32] = 1, 2, 4, 8
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def is_plain(words: list[bytes]) -> np.ndarray:
    """Whether each word (not empty, without spaces) is a run of Latin-1 letters, and closing signs or none behind it."""
    if not words:
        return np.empty(0, bool)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    kind = _CLASS[data]
    before = np.concatenate(([8], kind[:-1]))
    kind = np.where((before == 2) & _SECOND[data], 3, kind)
    before = np.concatenate(([8], kind[:-1]))
    bad = (kind == 0) | (before == 2) & (kind != 3) | (before == 4) & (kind != 4) & (kind != 8) | (before == 8) & (kind == 4)
    ends = np.flatnonzero(kind == 8)
    return np.add.reduceat(bad, np.concatenate(([0], ends[:-1] + 1)), dtype=np.int64) == 0


class WordIds:
    """Ids of texts, with a bounded memory of words that were met twice.

    Whole texts go to the library, unless the vocabulary splits at white space and at
    ends of letter runs, as ``SPLITS`` says; then words do.  Words of Latin-1 letters and
    closing punctuation are the same before and behind its normaliser and splitter but
    for their case, so the library's merges without these steps give their ids, for
    many words in one call; the end-of-word suffix tells where each ends.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer, self.memo, self.size, self.met = Tokenizer.from_file(path), Memo(), memo, np.zeros(1 << 23, bool)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pieces = [p.get("pattern", {}).get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = pieces[:1] == [SPLITS] and rules["model"].get("end_of_word_suffix") == SUFFIX and [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if self.by_words:
            self.merges = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation", "behavior": "Contiguous"}, *rules["pre_tokenizer"]["pretokenizers"][1:]]}, "post_processor": None, "added_tokens": []}))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(SUFFIX)]] = True
            self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _plain(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words that ``is_plain`` tells, with their ids."""
        for s in range(0, len(words), 1 << 16):
            part = words[s : s + (1 << 16)]
            line = b" ".join(part)
            marked = np.fromiter((w[-1] in CLOSING for w in part), np.int64, len(part))
            ids = np.array(self.merges.encode_batch_fast([line.decode().lower()], add_special_tokens=False)[0].ids, self.kind)
            data, pieces = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            cuts = pieces[np.cumsum(1 + marked) - 1].tolist()
            yield from zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)])

    def _others(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any words; a character of its own stands between those that don't hold it."""
        single = [w for w in words if len(self.between) != 1 or BETWEEN.encode() in w]
        out = {w: self._bytes(e.ids) for w, e in zip(single, self.tokenizer.encode_batch_fast([w.decode() for w in single], add_special_tokens=False))}
        words = [w for w in words if w not in out]
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join([w.decode() for w in part])], add_special_tokens=False)[0].ids, self.kind)
            data, cuts = ids.tobytes(), np.flatnonzero(ids == self.between[0])
            stops = [*(cuts * ids.itemsize).tolist(), len(data)]
            out.update(zip(part, (data[a:b] for a, b in zip([0, *((cuts + 1) * ids.itemsize).tolist()], stops))))
        return out

    def _look(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words; those that were looked for before go to the memory while it has room."""
        plain = is_plain(words)
        out = dict(self._plain([w for w, p in zip(words, plain) if p]))
        out.update(self._others([w for w, p in zip(words, plain) if not p]))
        at = np.fromiter(map(hash, words), np.int64, len(words)) & len(self.met) - 1
        again = self.met[at]
        self.met[at] = True
        room = self.size - len(self.memo)
        self.memo.update((w, out[w]) for w in [words[i] for i in np.flatnonzero(again).tolist()][: max(0, room)] if len(w) <= LONGEST)
        return out

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and the end id, as ``kind`` says."""
        last = self._bytes([end])
        if not self.by_words:
            return [self._bytes(e.ids) + last for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        words, new = self.memo.__getitem__, self.memo.new
        parts = [list(map(words, t.encode("utf-8", "replace").translate(_SPACES).split())) if t else [] for t in texts]
        for w, ids in self._look(list(new)).items():
            new[w] += ids
        out = [b"".join(p) + last for p in parts]
        new.clear()
        return out


class Memo(dict):
    """Ids by word; a word that is missing gets a place in ``new`` that is filled later."""

    def __init__(self):
        super().__init__()
        self.new: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        at = self.new.get(word)
        if at is None:
            at = self.new[word] = bytearray()
        return at


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordIds(path)
    return _encoders[path]


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write the ids of all ``docs`` (doc_id, text) to files and a manifest below ``folder``, in ascending order of doc_id."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    root = qualified(spark, folder)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    at_once = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.bytes // LEAST_BYTES))
    ranges = max(1, at_once, -(-total.bytes // FILE_BYTES), -(-total.docs // FILE_DOCS))

    def run(batches):
        out, uri, first, encoder = None, "", None, _encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                keys = part.column("doc_id").to_pylist(), part.column("rid").to_pylist()
                for doc, rid, ids in zip(*keys, encoder.encode(part.column("text").to_pylist(), end)):
                    if out is None:
                        uri, first = f"{root}/{fresh_name('ids', '.pfor')}", (doc, rid)
                        out = Writer(uri)
                    out.add(doc, np.frombuffer(ids, encoder.kind).astype(np.uint32))
        if out is not None:
            out.close()
            row = {"first_id": pa.array([first[0]], pa.int64()), "first_rid": pa.array([first[1]], pa.int64()), "uri": pa.array([uri]), "n_ids": pa.array([out.n], pa.int64()), "n_docs": pa.array([len(out.ids)], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    keys = [F.col("doc_id").asc_nulls_last(), F.col("rid").asc()]
    files = narrow.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(run, MANIFEST)
    files.write.parquet(f"{root}/manifest")


MANIFEST = "first_id long, first_rid long, uri string, n_ids long, n_docs long"


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every document below ``folder``; start counts the ids of all documents before it."""
    files, start = [], 0
    order = [F.col("first_id").asc_nulls_last(), F.col("first_rid").asc()]
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(*order).collect():  # one row a file
        files.append((r.uri, start, r.n_ids, r.n_docs))
        start += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches):
        for b in batches:
            for uri, base, n_ids, n_docs in zip(*(b.column(c).to_pylist() for c in ("uri", "base", "n_ids", "n_docs"))):
                file = Reader(uri)
                if (file.n_ids, file.n_docs) != (n_ids, n_docs):
                    raise ValueError(f"{uri} is not what the manifest says")
                rows, held = [[], [], [], [], []], 0
                for doc, at, n, parts in file.documents():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(memoryview(np.ascontiguousarray(p)).cast("B"), crc)
                    for column, v in zip(rows, (doc, base + at, n, crc, b"".join(p.tobytes() for p in parts) if with_ids else None)):
                        column.append(v)
                    held += n
                    if held >= PIECE or len(rows[0]) >= 4096:
                        yield _batch(rows, with_ids)
                        rows, held = [[], [], [], [], []], 0
                yield _batch(rows, with_ids)

    table = spark.createDataFrame(files, "uri string, base long, n_ids long, n_docs long")
    return table.repartition(max(1, len(files)), "uri").mapInArrow(run, schema)


def _batch(rows: list[list], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in rows[:4]] + ([pa.array(rows[4], pa.binary())] if with_ids else [])
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])


def op11_packed_ids(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written to files and read back."""
    folder = fresh_path(spark, "packed-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, folder)
