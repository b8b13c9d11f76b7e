"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Tokens.  A text's words are cut into subword ids by a public BPE model, word by
word; one end id opens and closes the text.

Model.  Ids and places are embedded; one head of causal masked attention over a
window of ``LENGTH`` ids and the id's own embedding make a hidden vector, from which
a tree of softmaxes gives the distribution over all ids: ``FAN`` branches from the
root, ``FAN`` from each of those, ``FAN`` ids below each of these.  Every level has
weights of its own for the hidden vector.  Counts of ids only order the tree's
leaves and initialise its biases; the untrained model is the unigram distribution.

Corpus statistics cover every training document: word counts, id counts, and every
window as a training example.  Windows go to trainers by a hash of the document's
id, the window's place and its content, and each trainer takes its windows in the
order of that hash, so the weights do not depend on tasks, files or cores.  The
trainers' weights are averaged ``ROUNDS`` times over disjoint windows; a corpus of
more than ``PER_TRAINER`` windows has more trainers.

Scoring.  Windows overlap by ``LENGTH - STRIDE`` ids; each id is scored once, in
the first window that reaches it, by batches of masked attention.  The base score
looks words up in the ``TOP_WORDS`` most frequent ones; all others get their counts
by a join.

Defined results: null and empty texts consist of the end alone; documents without
an id are training documents; repeated rows stay rows; a corpus without training
documents has counts of zero and the untrained model; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.sources.scratch import materialise
from tellurion.llm.tokens import vocabulary_path

LENGTH = 48
STRIDE = 36
WIDTH = 16
LOW = 8
FAN = 32
ROUNDS = 2
BATCH = 128
RATE = 0.06
PER_TRAINER = 1 << 16
CHUNK = 1 << 14
TOP_WORDS = 1 << 19
MEMO = 400_000
MEMO_BYTES = 64 << 20
VOCAB = 32000
UNK, END = 0, 2
#: The end of a text as a word: no word holds a space.
END_WORD = b" "
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; white space is the six ASCII characters."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


class Codes(dict):
    """Numbers for words: one that isn't there gets the next number and is noted in ``new``."""

    def __init__(self, *a):
        super().__init__(*a)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Pieces:
    """Numbers for words, and by number the subword ids and the XXH64 of the word.

    ``full`` tells that the memory is over its bound of words or bytes; the owner
    then calls ``clear``.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.clear()

    def clear(self) -> None:
        self.codes = Codes({END_WORD: 0})
        self.flat, self.n_flat = np.full(1 << 16, END, np.int32), 1
        self.starts, self.hashes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.starts[1] = 1
        self.hashes[0] = xxhash.xxh64_intdigest(END_WORD)
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def full(self) -> bool:
        return len(self.codes) > MEMO or self.bytes > MEMO_BYTES

    def settle(self) -> None:
        """Cut the words that were numbered since the last time."""
        new, self.codes.new = self.codes.new, []
        n = len(self.codes) - len(new)
        for s in range(0, len(new), 4096):
            part = new[s : s + 4096]
            parts = [ids or [UNK] for ids in self.tokenizer.encode([w.decode() for w in part], num_threads=1)]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.fromiter(chain.from_iterable(parts), np.int32, int(lengths.sum()))
            self.bytes += sum(map(len, part)) + 4 * len(ids)
            while self.n_flat + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
            while n + len(part) + 1 > len(self.starts):
                self.starts, self.hashes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.hashes))
            self.flat[self.n_flat : self.n_flat + len(ids)] = ids
            self.starts[n + 1 : n + len(part) + 1] = self.n_flat + np.cumsum(lengths)
            self.hashes[n : n + len(part)] = [xxhash.xxh64_intdigest(w) for w in part]
            self.n_flat += len(ids)
            n += len(part)


_pieces: dict[str, Pieces] = {}


def _piecer(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def streams(texts, piecer: Pieces):
    """Word numbers of all texts, each closed by the end's number 0; the texts' sizes in words; all ids in one array, each text's begun and closed by the end id; the texts' starts in it."""
    split = [words_of(t) for t in texts]
    for words in split:
        words.append(END_WORD)
    size = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(piecer.codes.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
    piecer.settle()
    first = piecer.starts[codes]
    lengths = piecer.starts[codes + 1] - first
    ends = np.cumsum(lengths)
    ids = piecer.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)]
    last = ends[np.cumsum(size) - 1] if len(size) else np.zeros(0, np.int64)
    before = np.concatenate(([0], last[:-1])).astype(np.int64)
    starts = np.concatenate((before + np.arange(len(size)), last[-1:] + len(size))) if len(size) else np.zeros(1, np.int64)
    return codes, size, np.insert(ids, before, END), starts


# ---- corpus statistics -----------------------------------------------------


def gather(docs: DataFrame, path: str) -> DataFrame:
    """kind, key, n, ids: word counts (0), id counts (1) and training windows (2; the key is the window's hash) of the training documents, by task."""

    def run(batches):
        piecer = _piecer(path)
        piecer.clear()
        counts, seen_ids = np.zeros(0, np.int64), np.zeros(VOCAB, np.int64)

        def rows(kind, key, n, ids=None):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n), pa.array(ids or [None] * len(key), pa.binary())], names=["kind", "key", "n", "ids"])

        def word_rows():
            seen = np.flatnonzero(counts)
            return rows(0, piecer.hashes[seen].view(np.int64), counts[seen])

        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                codes, _, ids, starts = streams(part.column("text").to_pylist(), piecer)
                n = np.bincount(codes, minlength=len(piecer))
                n[: len(counts)] += counts
                counts = n
                seen_ids += np.bincount(ids, minlength=VOCAB)
                seen_ids[END] -= len(starts) - 1  # the opening ones are not predicted
                keys, windows, small = [], [], ids.astype(np.uint16)
                for seed, a, e in zip(part.column("seed").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    for i in range(0, max(1, e - 1 - a), LENGTH):
                        window = small[a + i : min(e, a + i + LENGTH + 1)].tobytes()
                        keys.append(xxhash.xxh64_intdigest(window, seed * 1_000_003 + i))
                        windows.append(window)
                yield rows(2, np.array(keys, np.uint64).view(np.int64), np.ones(len(keys), np.int64), windows)
                if piecer.full:
                    yield word_rows()
                    piecer.clear()
                    counts = np.zeros(0, np.int64)
        yield word_rows()
        yield rows(1, np.flatnonzero(seen_ids), seen_ids[seen_ids > 0])

    seed = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(0)).cast("long")
    return docs.select(seed.alias("seed"), "text").mapInArrow(run, "kind byte, key long, n long, ids binary")


def _boundary(rows: DataFrame, place, most: int, low: int, high: int) -> tuple[int, int]:
    """The place at which the ``most`` rows with the least ``place`` (low <= place < high) end, and how many rows lie before it.

    A histogram of 4096 bins is refined inside the bin that the end falls into.
    """
    before = 0
    while high - low > 1:
        step = -(-(high - low) // 4096)
        inside = rows.where((place >= low) & (place < high))
        hist = sorted(inside.groupBy(F.floor((place - F.lit(low)) / F.lit(step)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k")).collect())
        for b, k in hist:
            if before + k > most:
                low, high = low + b * step, min(high, low + (b + 1) * step)
                break
            before += k
        else:
            return high, before
    return low, before


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Exactly the ``most`` rows of ``counts`` (key, n; distinct keys) with the largest n, the lesser hash of the key first on ties; all rows if there aren't more.

    Nothing is sorted: thresholds come from histograms, and only the boundary bin is refined.
    """
    total, top = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    if total <= most:
        return counts
    rank = F.lit(int(top)) - F.col("n")
    edge, before = _boundary(counts, rank, most, 0, int(top) + 1)
    tie = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    cut, _ = _boundary(counts.where(rank == edge), tie, most - before, 0, 1 << 40)
    return counts.where((rank < edge) | ((rank == edge) & (tie < cut)))


# ---- the network -----------------------------------------------------------------


def leaves(counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Leaf of each id: ids that begin a word first, then the others, by falling count."""
    order = np.lexsort((np.arange(len(counts)), -counts, ~begins))
    leaf = np.empty(len(counts), np.int64)
    leaf[order] = np.arange(len(counts))
    return leaf


def fresh_weights(counts: np.ndarray, leaf: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random vectors; the biases (last rows of t1, t2, t3) give the unigram distribution."""
    rng = np.random.default_rng(seed)
    normal = lambda sd, *s: rng.normal(0, sd, s).astype(np.float32)
    mass = np.zeros(FAN**3)
    mass[leaf] = counts + 0.5
    w = {
        "emb": normal(0.3, VOCAB, WIDTH), "pos": normal(0.1, LENGTH, WIDTH), "qkv": normal(0.2, WIDTH, 3 * WIDTH),
        "hid": normal(0.15, 2 * WIDTH + 1, WIDTH), "low": normal(0.2, WIDTH, LOW),
        "t1": np.zeros((1, WIDTH + 1, FAN), np.float32), "t2": np.zeros((FAN, WIDTH + 1, FAN), np.float32), "t3": np.zeros((FAN * FAN, LOW + 1, FAN), np.float32)}
    for name, level in (("t1", mass.reshape(1, FAN, -1)), ("t2", mass.reshape(FAN, FAN, -1)), ("t3", mass.reshape(FAN * FAN, FAN, 1))):
        m = level.sum(axis=2)
        w[name][:, -1] = np.log(np.maximum(m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30), 1e-13))
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    out = np.ones((*x.shape[:-1], x.shape[-1] + 1), np.float32)
    out[..., :-1] = x
    return out


_MASK = np.tril(np.ones((LENGTH, LENGTH), np.float32))
_SCALE = np.float32(WIDTH**-0.5)
_ONES = np.ones(FAN, np.float32)
#: Nodes with up to so many rows are padded and multiplied together; others have a product each.
PADDED = (4, 16)


def joint(w) -> np.ndarray:
    """The products that the embeddings go through, side by side: queries (scaled), keys, values, and their own share of the hidden vector."""
    out = np.concatenate((w["qkv"], w["hid"][WIDTH : 2 * WIDTH]), axis=1)
    out[:, :WIDTH] *= _SCALE
    return out


def attend(f: np.ndarray, new: int = 0):
    """Attention from the places ``new`` and on of windows f (windows, n, products), in two parts, as the former half sees only places up to its own end.

    Parts (from, to, weights, their sums), and the mean values (windows, n - new, WIDTH).
    """
    b, n = f.shape[:2]
    q, k, v = f[..., :WIDTH], f[..., WIDTH : 2 * WIDTH], f[..., 2 * WIDTH : 3 * WIDTH]
    middle = (new + n + 1) // 2
    parts, h = [], np.empty((b, n - new, WIDTH), np.float32)
    for lo, hi in ((new, middle), (middle, n)):
        if lo < hi:
            a = np.matmul(q[:, lo:hi], k[:, :hi].transpose(0, 2, 1))
            np.clip(a, -30, 60, out=a)
            np.exp(a, out=a)
            a *= _MASK[lo:hi, :hi]
            total = (a @ np.ones(hi, np.float32))[..., None]
            np.divide(np.matmul(a, v[:, :hi]), total, out=h[:, lo - new : hi - new])
            parts.append((lo, hi, a, total))
    return parts, h


def hidden(w, x):
    """Hidden vectors of every place of windows x (windows, n), and what the gradient needs."""
    b, n = x.shape
    e = w["emb"].take(x.ravel(), axis=0).reshape(b, n, WIDTH)
    e += w["pos"][:n]
    f = (e.reshape(-1, WIDTH) @ joint(w)).reshape(b, n, 4 * WIDTH)
    parts, h = attend(f)
    u = h.reshape(-1, WIDTH) @ w["hid"][:WIDTH]
    u += f.reshape(-1, 4 * WIDTH)[:, 3 * WIDTH :]
    u += w["hid"][2 * WIDTH]
    return np.tanh(u, out=u), (e, f, parts, h)


class Level:
    """One level of the tree for targets that sit at ``child`` below ``node``; rows are in order of the node. ``log_p`` puts them in the places ``order``."""

    def __init__(self, vectors: np.ndarray, node: np.ndarray, child: np.ndarray, w: np.ndarray, order: np.ndarray):
        self.vectors, self.child, self.w, self.order = vectors, child, w, order
        edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True]))) if len(node) else np.zeros(1, np.int64)
        self.nodes, first, many = node[edge[:-1]], edge[:-1], np.diff(edge)
        alone = np.flatnonzero(many > PADDED[-1])
        self.alone = list(zip(alone.tolist(), first[alone].tolist(), edge[1:][alone].tolist(), self.nodes[alone].tolist()))
        self.padded, least = [], 0
        for most in PADDED:
            some = np.flatnonzero((many > least) & (many <= most))
            if len(some):
                inside = np.arange(most) < many[some, None]
                rows = np.where(inside, first[some, None] + np.arange(most), 0)
                self.padded.append((some, rows, inside, rows[inside], vectors.take(rows, axis=0), w.take(self.nodes[some], axis=0)))
            least = most
        o = np.empty((len(node), FAN), np.float32)
        for _, a, e, k in self.alone:
            np.matmul(vectors[a:e], w[k], out=o[a:e])
        for _, _, inside, rows, v, m in self.padded:
            o[rows] = np.matmul(v, m)[inside]
        np.clip(o, -30, 60, out=o)  # below, products would be too small for fast arithmetic
        np.exp(o, out=o)
        self.o, self.sums = o, o @ _ONES

    def in_order(self) -> np.ndarray:
        """Logs of the targets' probabilities, in order of the node."""
        return np.log(np.maximum(self.o.ravel()[np.arange(0, len(self.o) * FAN, FAN) + self.child] / self.sums, 1e-30))

    def log_p(self) -> np.ndarray:
        out = np.empty(len(self.o), np.float32)
        out[self.order] = self.in_order()
        return out

    def back(self, ok: np.ndarray):
        """Gradients of the vectors and of the touched nodes, for rows weighted by ``ok``; rows are in order of the node."""
        d = self.o * (ok / self.sums)[:, None]
        d.ravel()[np.arange(0, len(d) * FAN, FAN) + self.child] -= ok
        dv, dw = np.empty_like(self.vectors), np.empty((len(self.nodes), *self.w.shape[1:]), np.float32)
        for i, a, e, k in self.alone:
            np.matmul(d[a:e], self.w[k].T, out=dv[a:e])
            np.matmul(self.vectors[a:e].T, d[a:e], out=dw[i])
        for some, at, inside, rows, v, m in self.padded:
            some_d = d.take(at, axis=0)
            some_d *= inside[..., None]
            dv[rows] = np.matmul(some_d, m.transpose(0, 2, 1))[inside]
            dw[some] = np.matmul(v.transpose(0, 2, 1), some_d)
        return dv[:, :-1], dw


def levels(w, h: np.ndarray, leaf: np.ndarray) -> tuple[Level, Level, Level]:
    """The three choices that lead to the targets' leaves; one order of the rows, that of the leaves, serves all."""
    order = np.argsort(leaf.astype(np.uint16), kind="stable")
    leaf, one = leaf[order], _with_one(h.take(order, axis=0))
    low = _with_one(one[:, :-1] @ w["low"])
    return (
        Level(one, np.zeros(len(leaf), np.int64), leaf // (FAN * FAN), w["t1"], order),
        Level(one, leaf // (FAN * FAN), leaf // FAN % FAN, w["t2"], order),
        Level(low, leaf // FAN, leaf % FAN, w["t3"], order))


def log_probability(w, x: np.ndarray, y_leaf: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target, in the shape of x."""
    h, _ = hidden(w, x)
    return sum(t.log_p() for t in levels(w, h, y_leaf.ravel())).reshape(x.shape)


def gradient(w, x: np.ndarray, y_leaf: np.ndarray, valid: np.ndarray):
    """Mean loss over the valid targets and its gradient: by name the touched rows (None: all) and their gradient."""
    b, n = x.shape
    u, (e, f, parts, h) = hidden(w, x)
    t1, t2, t3 = levels(w, u, y_leaf.ravel())
    order, sorted_u = t1.order, t1.vectors[:, :-1]
    ok = valid.ravel()[order].astype(np.float32) / max(1, valid.sum())
    loss = -float(((t1.in_order() + t2.in_order() + t3.in_order()) * ok).sum())
    d1, g1 = t1.back(ok)
    d2, g2 = t2.back(ok)
    d3, g3 = t3.back(ok)
    du = d3 @ w["low"].T
    du += d1
    du += d2
    du *= 1 - sorted_u * sorted_u
    df = np.zeros((b, n, 4 * WIDTH), np.float32)  # gradients of the products
    df.reshape(-1, 4 * WIDTH)[order, 3 * WIDTH :] = du
    du = np.ascontiguousarray(df[..., 3 * WIDTH :]).reshape(-1, WIDTH)
    dh = (du @ w["hid"][:WIDTH].T).reshape(b, n, WIDTH)
    v = _with_one(f[..., 2 * WIDTH : 3 * WIDTH])
    for lo, hi, a, total in reversed(parts):
        g = np.empty((b, hi - lo, WIDTH + 1), np.float32)  # the last column meets the ones of v
        np.divide(dh[:, lo:hi], total, out=g[..., :WIDTH])
        np.einsum("bnd,bnd->bn", g[..., :WIDTH], h[:, lo:hi], out=g[..., WIDTH])
        np.negative(g[..., WIDTH], out=g[..., WIDTH])
        df[:, :hi, 2 * WIDTH : 3 * WIDTH] += np.matmul(a.transpose(0, 2, 1), g[..., :WIDTH])
        a *= np.matmul(g, v[:, :hi].transpose(0, 2, 1))
        df[:, lo:hi, :WIDTH] = np.matmul(a, f[:, :hi, WIDTH : 2 * WIDTH])
        df[:, :hi, WIDTH : 2 * WIDTH] += np.matmul(a.transpose(0, 2, 1), f[:, lo:hi, :WIDTH])
    df = df.reshape(-1, 4 * WIDTH)
    de = df @ joint(w).T
    dw = e.reshape(-1, WIDTH).T @ df
    dw[:, :WIDTH] *= _SCALE
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    rows = x.ravel()[order]
    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    dpos = np.zeros_like(w["pos"])
    dpos[:n] = de.reshape(b, n, WIDTH).sum(axis=0)
    dhid = np.concatenate((h.reshape(-1, WIDTH).T @ du, dw[:, 3 * WIDTH :], du.sum(axis=0, keepdims=True)))
    return loss, {
        "emb": (rows[edge], np.add.reduceat(de.take(order, axis=0), edge, axis=0)), "pos": (None, dpos), "qkv": (None, dw[:, : 3 * WIDTH]),
        "hid": (None, dhid), "low": (None, sorted_u.T @ d3), "t1": (None, g1), "t2": (t2.nodes, g2), "t3": (t3.nodes, g3)}


class Adagrad:
    """Steps scaled by the root of each weight's summed squares; rows that a batch doesn't touch stay."""

    def __init__(self, w):
        self.sums = {k: np.full_like(x, 1e-9) for k, x in w.items()}

    def step(self, w, gradients):
        for name, (rows, g) in gradients.items():
            at = slice(None) if rows is None else rows
            s = self.sums[name][at] + g * g
            self.sums[name][at] = s
            w[name][at] -= np.float32(RATE) * g / np.sqrt(s)


def pack(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of up to LENGTH + 1 ids as a padded matrix and the number of targets of each."""
    n = np.array([len(w) // 2 - 1 for w in windows])
    m = np.full((len(windows), LENGTH + 1), END, np.int32)
    m[np.arange(LENGTH + 1) <= n[:, None]] = np.frombuffer(b"".join(windows), np.uint16)
    return m, n


def train_on(w, windows: list[bytes], leaf: np.ndarray, steps: Adagrad) -> float:
    m, n = pack(windows)
    longest = int(n.max())
    loss, g = gradient(w, m[:, :longest], leaf[m[:, 1 : longest + 1]], np.arange(longest)[None] < n[:, None])
    steps.step(w, g)
    return loss


def flat(w) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def unflat(v: np.ndarray, like) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = v[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def _add_up(parts: DataFrame, trainers: int) -> DataFrame:
    """One row a chunk: n, v summed over the trainers in their order, 64 at a time."""

    def one(table: pa.Table) -> pa.Table:
        v = np.zeros(CHUNK)
        table = table.sort_by("trainer")
        for part in table.column("v"):
            v += np.frombuffer(part.as_py(), np.float64)
        columns = {"trainer": [table.column("trainer")[0].as_py() // 64], "chunk": table.column("chunk")[:1], "n": [sum(table.column("n").to_pylist())], "v": [v.tobytes()]}
        return pa.table(columns, schema=table.schema)

    while trainers:
        parts = parts.groupBy(F.floor(F.col("trainer") / 64), "chunk").applyInArrow(lambda table: one(table), parts.schema)
        trainers //= 64
    return parts


def train(windows: DataFrame, w: dict[str, np.ndarray], leaf: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after ROUNDS of averaging over the trainers; ``windows`` has key, ids."""
    spark, like = windows.sparkSession, {k: np.empty(x.shape) for k, x in w.items()}
    trainers = -(-windows.count() // PER_TRAINER)
    if not trainers:
        return w
    size = sum(x.size for x in w.values())
    numbered = windows.select((F.shiftrightunsigned("key", 32) % F.lit(trainers)).cast("int").alias("trainer"), F.pmod("key", F.lit(ROUNDS)).alias("round"), "key", "ids")
    for r in range(ROUNDS):
        given = spark.sparkContext.broadcast((flat(w), leaf))

        def run(batches, given=given, like=like):
            start, of = given.value
            trainer, held, seen = None, [], 0

            def result():
                v = np.zeros(-(-size // CHUNK) * CHUNK)
                v[:size] = flat(own).astype(np.float64) * seen
                chunks = [c.tobytes() for c in v.reshape(-1, CHUNK)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(chunks), trainer, np.int32)), pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array(np.full(len(chunks), seen, np.int64)), pa.array(chunks, pa.binary())],
                    names=["trainer", "chunk", "n", "v"])

            for b in batches:
                numbers, ids = b.column("trainer").to_numpy(), b.column("ids").to_pylist()
                edges = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True]))).tolist() if len(numbers) else []
                for a, e in zip(edges[:-1], edges[1:]):
                    if numbers[a] != trainer:
                        if trainer is not None:
                            if held:
                                train_on(own, held, of, steps)
                            yield result()
                        trainer, held, seen, own = int(numbers[a]), [], 0, unflat(start, like)
                        steps = Adagrad(own)
                    held += ids[a:e]
                    seen += e - a
                    while len(held) >= BATCH:
                        train_on(own, held[:BATCH], of, steps)
                        held = held[BATCH:]
            if trainer is not None:
                if held:
                    train_on(own, held, of, steps)
                yield result()

        mine = numbered.where(F.col("round") == r).select("trainer", "key", "ids").repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "key", "ids")
        parts = mine.select("trainer", "ids").mapInArrow(run, "trainer int, chunk int, n long, v binary")
        parts = _add_up(parts, trainers)
        rows = parts.orderBy("chunk").toArrow()
        if rows.num_rows:
            v = np.concatenate([np.frombuffer(x.as_py(), np.float64) / n.as_py() for x, n in zip(rows.column("v"), rows.column("n"))])
            w = unflat(v[:size], like)
        given.unpersist()
    return w


# ---- scoring -------------------------------------------------------------------------


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts at ``starts`` (ids begun and closed by the end id): first input of each window, its text, and the place in the window from which targets are new."""
    n = np.diff(starts) - 1  # inputs, as many as targets
    many = 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE))
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return starts[text] + number * STRIDE, text, np.where(number == 0, 0, LENGTH - STRIDE)


def products(w) -> tuple[np.ndarray, np.ndarray]:
    """What each id and each place adds to the products of ``joint``, for weights that stay."""
    places = w["pos"] @ joint(w)
    places[:, 3 * WIDTH :] += w["hid"][2 * WIDTH]
    return w["emb"] @ joint(w), places


def score_streams(ids: np.ndarray, starts: np.ndarray, w, leaf: np.ndarray, made=None, step: int = 64, block: int = 1 << 13) -> np.ndarray:
    """log10 probability of each text's ids: every id once, over batches of masked windows of like length; ``made`` are the ``products`` of w.

    Only the places that a window scores ask for attention. The tree is gone through in
    the order of the leaves, ``block`` targets at a time.
    """
    of_id, of_place = made or products(w)
    first, text, new = spans(starts)
    many = np.minimum(starts[text + 1] - 1 - first, LENGTH)  # inputs of each window
    order = np.lexsort((-many, new))
    scored = int((many - new).sum())
    u, target, owner, done = np.empty((scored, WIDTH), np.float32), np.empty(scored, np.int64), np.empty(scored, np.int64), 0
    edges = [0, int(np.count_nonzero(new == 0)), len(order)]
    for s in chain.from_iterable(range(a, e, step) for a, e in zip(edges[:-1], edges[1:])):
        chosen = order[s : min(s + step, edges[1] if s < edges[1] else edges[2])]
        n, k = int(many[chosen[0]]), int(new[chosen[0]])
        at = np.minimum(first[chosen, None] + np.arange(n), len(ids) - 2)
        f = of_id.take(ids[at].ravel(), axis=0).reshape(len(chosen), n, 4 * WIDTH)
        f += of_place[:n]
        _, h = attend(f, k)
        z = (h.reshape(-1, WIDTH) @ w["hid"][:WIDTH]).reshape(h.shape)
        z += f[:, k:, 3 * WIDTH :]
        valid = np.arange(k, n) < many[chosen, None]
        size = int(np.count_nonzero(valid))
        u[done : done + size] = z[valid]
        target[done : done + size] = leaf[ids[at[:, k:][valid] + 1]]
        owner[done : done + size] = np.repeat(text[chosen], many[chosen] - k)
        done += size
    np.tanh(u, out=u)
    out, by_leaf = np.zeros(len(starts) - 1), np.argsort(target.astype(np.uint16), kind="stable")
    for s in range(0, scored, block):
        rows = by_leaf[s : s + block]
        logs = sum(t.log_p() for t in levels(w, u.take(rows, axis=0), target[rows]))
        out += np.bincount(owner[rows], weights=logs, minlength=len(out))
    return out / np.log(10)


# ---- the operator ------------------------------------------------------------------


def learn(docs: DataFrame, path: str):
    """From training documents: word counts (a written table of key, n), the weights, and the leaf of each id."""
    facts = materialise(gather(docs, path), "lm-facts")
    fact = lambda k: facts.where(F.col("kind") == k)
    words = materialise(fact(0).groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    counts = np.zeros(VOCAB)
    for key, n in fact(1).groupBy("key").agg(F.sum("n")).collect():  # at most VOCAB rows
        counts[key] = n
    tokenizer = _piecer(path).tokenizer
    begins = np.array([tokenizer.id_to_piece(i).startswith("\u2581") for i in range(VOCAB)])
    leaf = leaves(counts, begins)
    return words, train(fact(2).select("key", "ids"), fresh_weights(counts, leaf), leaf), leaf


def score(docs: DataFrame, vocabulary: str | None = None, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark, path = docs.sparkSession, vocabulary or vocabulary_path("piece_bpe_32k.model")
    words, weights, leaf = learn(docs.where(~held_out(F.col("doc_id"))), path)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(words, top_words).select("key", "n").toArrow()  # at most top_words rows
    assert top.num_rows <= top_words
    whole = top.num_rows == distinct  # then a word that isn't among them doesn't occur
    keys, counts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    denominator = total + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast((weights, leaf, keys[order], np.log10((counts[order] + 0.5) / denominator)))
    unseen = float(np.log10(0.5 / denominator))

    def run(batches):
        piecer = _piecer(path)
        piecer.clear()
        w, leaf, keys, logs = shared.value
        made = products(w)
        word_log, done = np.zeros(0), 0
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                codes, size, ids, starts = streams(part.column("text").to_pylist(), piecer)
                fresh = piecer.hashes[done : len(piecer)]
                at = np.minimum(np.searchsorted(keys, fresh), max(len(keys) - 1, 0))
                word_log = np.concatenate((word_log, np.where(keys[at] == fresh, logs[at], np.nan) if len(keys) else np.full(len(fresh), np.nan)))
                log, done = word_log[codes], len(piecer)
                found = ~np.isnan(log)
                owner = np.repeat(np.arange(len(size)), size)
                base = np.bincount(owner, weights=np.where(found, log, unseen if whole else 0.0), minlength=len(size))
                known = np.bincount(owner, weights=found, minlength=len(size)).astype(np.int64)
                rare = ~found & (not whole)
                cuts = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=len(size))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(piecer.hashes[codes[rare]].view(np.int64)))
                if piecer.full:
                    piecer.clear()
                    word_log, done = np.zeros(0), 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(known), pa.array(base), pa.array(score_streams(ids, starts, w, leaf, made)), lists],
                    names=["doc_id", "n_tokens", "known", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, score double, rare array<long>")
    more_known, more_base = F.lit(0), F.lit(0.0)
    if not whole:
        scored = materialise(scored.withColumn("rid", F.monotonically_increasing_id()), "lm-scored")
        rare = scored.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").agg(F.count(F.lit(1)).alias("times"))
        log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(denominator)))
        more = rare.join(words, "key", "left").groupBy("rid").agg(F.sum(F.col("times") * log).alias("more_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known"))
        scored = scored.join(more, "rid", "left")
        more_known, more_base = F.coalesce("more_known", F.lit(0)), F.coalesce("more_base", F.lit(0.0))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + more_known).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + more_base).alias("base_score"), "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from the four fifths that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
