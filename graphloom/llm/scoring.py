"""Document scores by masked pseudo-likelihood.

Every token of a text is predicted from SIDE tokens on either side, itself hidden, by a small window
network; the sum of the logarithms of these conditional probabilities scores the document. Tokens
are words. The network's output is a softmax in two steps, both of which see the context: the class,
then the word within it. The KNOWN most frequent words of the whole corpus stand in classes of
SLOTS words each; all other words are one class more, whose slots are hashed groups, and a word
takes of its group the share that its own count in the whole corpus has.

The network is joined by a memory of the corpus. For every context (a word before and a word after) it
knows how often each word stood between them anywhere; where others have the context, too, the
probability is a mean of the network's and the memory's, by how often. A token's own occurrence is left
out of what it is judged by.

What is gathered grows with the corpus: the count of every distinct word, of every context and of every
word in it, and the tokens of every text, each of which is trained on once. Texts go to
shards of about SHARD positions, and shards to ROUNDS rounds; each shard trains from common weights
by Adagrad in numpy, and the weights of a round are averaged in groups of FAN. Counts are exchanged
between buckets of about BUCKET bytes of text and parts of the hash space, packed, each distinct key
once a bucket; so no task or driver holds more than a shard, a bucket, a part, or one set of weights
per step. Results are the same for the same rows up to the order of sums, however they are laid out.

Keys are hashes, of which as many bits are kept as make it rarer than 1 in 2**SPARE that any other key
of the corpus has those of a given one (up to 64 bits, which do for 2**(64 - SPARE) words). Known words
are told apart by their number within a context, others by some 24 bits of their hash.

Defined results: null counts as empty; a text without words has no tokens, log-likelihood 0 and a
null mean; a very long text is a bucket of its own with what falls there; repeated rows get equal
scores; among equally frequent words those with the smaller hash are known; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.session import cut, release

from .buffers import hashed_words, mix, raw, slices

SIDE = 2
#: Classes of known words; one more holds the rare groups, which makes 64.
CLASSES, SLOTS = 63, 64
KNOWN = CLASSES * SLOTS
RARE = SLOTS
#: Of the hidden units, the last one is constant, so that weights out of it are biases.
EMBED, HIDDEN = 8, 16
SHARD = 1_000_000
ROUNDS = 2
FAN = 64
STEP, BATCH = 0.1, 8192
PAD = KNOWN + RARE  # stands for the places beyond a text's ends
#: A memory of n other occurrences weighs n / (n + DOUBT).
DOUBT = 2.0
BUCKET = 8 << 20
PART = 16 << 20
#: Bits of a key beyond those that count the corpus's words.
SPARE = 20
#: Bits that tell the words of a context apart.
CODE = 24
MOST_TASKS = 100_000
#: Words are first cut to those in the upper of this many steps of counts per doubling.
STEPS = 16


class Vocabulary:
    """Token numbers of word hashes, and how often each token occurs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, mass: np.ndarray):
        """hashes and counts of the known words, most frequent first; mass: occurrences in each rare group."""
        order = np.argsort(hashes)
        self.sorted, self.rank, self.mass = hashes[order], order.astype(np.int16), mass
        self.counts = np.concatenate([counts, np.zeros(KNOWN - len(counts)), mass])
        # Where the hashes with each upper 16 bits begin, and the most that share them; the last hash is repeated for these.
        upper = (self.sorted >> np.uint64(48)).astype(np.int64)
        self.start = np.searchsorted(upper, np.arange(1 << 16)).astype(np.int32)
        self.most = int(np.bincount(upper, minlength=1).max())
        self.sorted, self.rank = (np.concatenate([x, np.repeat(x[-1:], self.most)]) for x in (self.sorted, self.rank))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        out = (KNOWN + (h % np.uint64(RARE))).astype(np.int16)
        at = self.start[h >> np.uint64(48)]
        for j in range(self.most):
            hit = np.flatnonzero(self.sorted[at + j] == h)
            out[hit] = self.rank[at[hit] + j]
        return out


def places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of tokens: known words go round the classes by rank, so that each has about the same mass."""
    t = tokens.astype(np.int64)
    known = t < KNOWN
    return np.where(known, t % CLASSES, CLASSES), np.where(known, t // CLASSES, t - KNOWN)


def _contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens around each position: SIDE before and SIDE after, PAD beyond its row."""
    n = len(tokens)
    row_start = np.repeat(first[:-1], np.diff(first))
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    out = np.full((2 * SIDE, n), PAD, np.int16)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        ok = (at + d >= row_start) & (at + d < row_end)
        out[j, ok] = tokens[at[ok] + d]
    return out


def _grouped(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The places ordered by class, and each class that occurs with its stretch of them."""
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


class Network:
    def __init__(self, seed: int = 11, counts: np.ndarray | None = None):
        """With counts of the tokens, it begins by giving each token about its share of the corpus."""
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.e = f(PAD + 1, EMBED, scale=0.3)
        self.w = f(2 * SIDE, EMBED, HIDDEN - 1, scale=(2 * SIDE * EMBED) ** -0.5)
        self.b = np.zeros(HIDDEN - 1, np.float32)
        self.o = f(HIDDEN, CLASSES + 1, scale=0.1 * HIDDEN**-0.5)
        self.v = f(CLASSES + 1, HIDDEN, SLOTS, scale=0.1 * HIDDEN**-0.5)
        self.o[-1], self.v[:, -1] = 0, 0
        if counts is not None:
            share = np.zeros((CLASSES + 1, SLOTS))
            share[places(np.arange(KNOWN + RARE))] = counts + 0.1
            self.v[:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
            self.o[-1] = np.log(share.sum(axis=1) / share.sum())

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.o, self.v]

    def to_bytes(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32).tobytes()

    @staticmethod
    def from_bytes(blob: bytes) -> Network:
        net, flat, at = Network(), np.frombuffer(blob, np.float32), 0
        for p in net.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return net

    def log_probabilities(self, tokens: np.ndarray, around: np.ndarray, chunk: int = 16384) -> np.ndarray:
        """log P(each token, or its rare group | the tokens around it)."""
        tables = [self.e @ self.w[j] for j in range(2 * SIDE)]
        kinds, slots_ = places(tokens)
        within = _within(self.o), _within(self.v)
        out = np.empty(len(tokens), np.float32)
        for a in range(0, len(tokens), chunk):
            kind, slot = kinds[a : a + chunk], slots_[a : a + chunk]
            order, groups = _grouped(kind)
            # In the order of the classes, so that a class is a stretch of rows.
            near = around[:, a : a + chunk][:, order]
            h = np.ones((len(order), HIDDEN), np.float32)
            x = np.take(tables[0], near[0], axis=0) + self.b
            for j in range(1, 2 * SIDE):
                x += np.take(tables[j], near[j], axis=0)
            np.tanh(x, out=h[:, :-1])
            z = np.empty((len(h), SLOTS), np.float32)
            for c, i, j in groups:
                np.matmul(h[i:j], self.v[c], out=z[i:j])
            out[a + order] = _log_softmax_at(h @ self.o, kind[order], within[0]) + _log_softmax_at(z, slot[order], within[1])
        return out

    def fit(self, tokens: np.ndarray, around: np.ndarray) -> None:
        """One pass of Adagrad over the windows, in their order."""
        seen = [np.full(p.shape, 1e-2, np.float32) for p in self.parts()]
        kinds, slots_ = places(tokens)
        for a in range(0, len(tokens), BATCH):
            order, groups = _grouped(kinds[a : a + BATCH])
            kind, slot = kinds[a : a + BATCH][order], slots_[a : a + BATCH][order]
            ids = around[:, a : a + BATCH].T[order]
            n = len(kind)
            x = np.take(self.e, ids, axis=0).reshape(n, -1)
            w = self.w.reshape(-1, HIDDEN - 1)
            h = np.ones((n, HIDDEN), np.float32)
            t = np.tanh(x @ w + self.b, out=h[:, :-1])
            p = _pull(h @ self.o, kind, _within(self.o))
            dh = p @ self.o[:-1].T
            z = np.empty((n, SLOTS), np.float32)
            for c, i, j in groups:
                np.matmul(h[i:j], self.v[c], out=z[i:j])
            q = _pull(z, slot, _within(self.v))
            gv = np.zeros_like(self.v)
            for c, i, j in groups:
                dh[i:j] += q[i:j] @ self.v[c, :-1].T
                np.matmul(h[i:j].T, q[i:j], out=gv[c])
            dh *= 1 - t * t
            flat = ids.ravel()
            by = np.argsort(flat, kind="stable")
            flat = flat[by]
            starts = np.flatnonzero(np.concatenate([np.ones(1, bool), flat[1:] != flat[:-1]]))
            rows = flat[starts]
            ge = np.add.reduceat((dh @ w.T).reshape(-1, EMBED)[by], starts, axis=0)
            grads = (None, (x.T @ dh).reshape(self.w.shape), np.ones(n, np.float32) @ dh, h.T @ p, gv)
            for part, s, g in list(zip(self.parts(), seen, grads))[1:]:
                s += g * g
                part -= STEP * g / np.sqrt(s)
            seen[0][rows] += ge * ge
            self.e[rows] -= STEP * ge / np.sqrt(seen[0][rows])


#: Scores beyond this are cut, so that their exponentials and the sums of them are finite.
MOST = 60.0


def _within(weights: np.ndarray) -> bool:
    """Whether no score can reach MOST by these weights, as the hidden units lie from -1 to 1."""
    return bool(np.abs(weights).sum(axis=-2).max() < MOST)


def _sums(z: np.ndarray, within: bool) -> np.ndarray:
    """The exponentials of z, in place, and each row's sum."""
    if not within:
        np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], np.float32)


def _log_softmax_at(z: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    hit = np.minimum(z[np.arange(len(at)), at], MOST)
    return hit - np.log(_sums(z, within))


def _pull(z: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """The gradient of the mean over the rows of -log softmax, in place."""
    n = len(at)
    z *= (np.float32(1 / n) / _sums(z, within))[:, None]
    z[np.arange(n), at] -= np.float32(1 / n)
    return z


# ---------------------------------------------------------------- vocabulary


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (its hash) and n over all documents, counted within batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(hashed_words(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, int]:
    """The vocabulary, from all documents, and the corpus's number of words."""
    counts = cut(word_counts(docs, text).withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    # Counts by steps first (at most 64 * STEPS rows), so that only the words near the top are sorted.
    steps = sorted(((r["step"], r["m"]) for r in counts.groupBy("step").agg(F.count("*").alias("m")).collect()), reverse=True)
    least, many = None, 0
    for step, m in steps:
        least, many = step, many + m
        if many >= KNOWN:
            break
    top = counts.where(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(KNOWN).collect() if steps else []
    known = np.array([r["word"] for r in top], np.int64)
    groups = counts.groupBy(F.col("word").bitwiseAND(F.lit(RARE - 1)).alias("g")).agg(F.sum("n").alias("n")).collect()  # RARE rows
    mass = np.zeros(RARE)
    for r in groups:
        mass[r["g"]] = r["n"]
    total = int(mass.sum())
    for r in top:
        mass[r["word"] & (RARE - 1)] -= r["n"]
    return Vocabulary(known.view(np.uint64), np.array([r["n"] for r in top], np.float64), mass), total


# ---------------------------------------------------------------- training


def training_tokens(docs: DataFrame, words: Vocabulary, shards: int, text: str = "text") -> DataFrame:
    """shard, key, tokens: the packed tokens of each text that has any."""
    model = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, key, blobs = [], [], []
            data, bounds = raw(batch.column(0))
            for a, b in slices(bounds):
                h, first = hashed_words(batch.column(0).slice(a, b - a))
                tokens = model.value.tokens(h)
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place.astype(np.uint64)), dtype=np.uint64)])
                digest = mix(sums[first[1:]] - sums[first[:-1]])
                for i in np.flatnonzero(np.diff(first)):
                    shard.append(int(digest[i] % np.uint64(shards)))
                    key.append(int(digest[i].view(np.int64)))
                    blobs.append(tokens[first[i] : first[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(key, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "key", "tokens"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "shard int, key long, tokens binary")


def _mean(states: DataFrame, shards: int) -> bytes | None:
    """The mean of all shards' weights, weighted by their positions, in groups of FAN."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += list(zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("weights").to_pylist()))
        total, n = None, 0
        for _, m, blob in sorted(rows, key=lambda r: r[0]):
            w = np.frombuffer(blob, np.float32).astype(np.float64) * m
            total, n = w if total is None else total + w, n + m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["shard", "n", "weights"])

    while True:
        states = states.withColumn("up", F.floor(F.col("shard") / FAN).cast("int")).groupBy("up").applyInArrow(merge, "shard int, n long, weights binary")
        shards = -(-shards // FAN)
        if shards <= 1:
            break
    got = states.select("weights").collect()  # one set of weights
    return bytes(got[0][0]) if got else None


def _fitter(blob: bytes):
    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += list(zip(batch.column("key").to_pylist(), batch.column("tokens").to_pylist()))
        rows.sort()
        shard = key[0].as_py()
        tokens = np.frombuffer(b"".join(b for _, b in rows), np.int16)
        first = np.cumsum([0, *(len(b) // 2 for _, b in rows)])
        order = np.random.default_rng(shard).permutation(len(tokens))
        net = Network.from_bytes(blob)
        net.fit(tokens[order], _contexts(tokens, first)[:, order])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([net.to_bytes()], pa.binary())], names=["shard", "n", "weights"])

    return fit


def train(docs: DataFrame, words: Vocabulary, total: int, text: str = "text") -> Network:
    """The network after ROUNDS rounds, each over its own share of the shards, so that every position is trained on once."""
    shards = ROUNDS * max(1, -(-total // (ROUNDS * SHARD)))
    texts = cut(training_tokens(docs, words, shards, text))
    net = Network(counts=words.counts)
    for turn in range(ROUNDS):
        mine = texts.where(F.col("shard") % ROUNDS == turn).withColumn("shard", F.floor(F.col("shard") / ROUNDS).cast("int"))
        fitted = mine.groupBy("shard").applyInArrow(_fitter(net.to_bytes()), "shard int, n long, weights binary")
        mean = _mean(fitted, shards // ROUNDS)
        net = net if mean is None else Network.from_bytes(mean)
    return net


# ---------------------------------------------------------------- counts, and scores

_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def key_bits(total: int) -> int:
    """Bits of a key for a corpus of so many words."""
    return min(64, max(1, total).bit_length() + SPARE)


def rare_keys(h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Count keys of the rare words among h."""
    return mix(h[tokens >= KNOWN] ^ _WORD)


def memory_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that have a context, which are all but the first and the last of a row, and its count keys."""
    inner = np.ones(len(h), bool)
    inner[first[:-1][first[:-1] < len(h)]] = False
    inner[first[1:][np.diff(first) > 0] - 1] = False
    at = np.flatnonzero(inner)
    return at, mix(mix(h[at - 1]) + _PAIR * h[at + 1]) if len(at) else np.zeros(0, np.uint64)


def codes(h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What tells words apart within a context: the number of a known one, else from KNOWN on by the hash."""
    rare = np.uint64(KNOWN) + h % np.uint64((1 << CODE) - KNOWN)
    return np.where(tokens >= KNOWN, rare, tokens.astype(np.uint64))


class Entries:
    """The distinct pairs of a key and a code of a table's texts, ascending: those of contexts, and of rare words with code 0."""

    def __init__(self, h: np.ndarray, first: np.ndarray, tokens: np.ndarray, bits: int):
        self.inner, context = memory_keys(h, first)
        self.rare = np.flatnonzero(tokens >= KNOWN)
        keys = np.concatenate([context, rare_keys(h, tokens)]) >> np.uint64(64 - bits)
        code = np.concatenate([codes(h[self.inner], tokens[self.inner]), np.zeros(len(self.rare), np.uint64)])
        self.keys, self.codes, self.n, at = _distinct(keys, code)
        #: The entry of each inner position, and of each rare one.
        self.of_inner, self.of_rare = at[: len(self.inner)], at[len(self.inner) :]


def _order(values: np.ndarray) -> np.ndarray:
    """The places of values in ascending order. Sorting the values' upper bits with the places below them is much faster than argsort, which is left only what these bits don't decide."""
    if not len(values):
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << len(values).bit_length()) - 1)
    both = values << np.uint64(64 - max(1, int(values.max()).bit_length()))
    both &= ~mask
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    both &= mask
    order = both.view(np.int64)
    got = values[order]
    return order[np.argsort(got, kind="stable")] if (got[1:] < got[:-1]).any() else order


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending, how often each stands, and which of them is at each place."""
    order = _order(values)
    ascending = values[order]
    start = _starts(ascending)
    new = np.zeros(len(values), np.int64)
    new[start[1:]] = 1
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new)
    return ascending[start], np.diff(start, append=len(values)), at


def _distinct(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in ascending order, how often each stands, and the pair of each place."""
    known, _, of_key = _unique(keys)
    pairs, n, at = _unique(of_key.view(np.uint64) << np.uint64(CODE) | code)
    return known[(pairs >> np.uint64(CODE)).astype(np.int64)], pairs & np.uint64((1 << CODE) - 1), n, at


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of the same number of whole numbers, in as many byte planes as the largest needs, compressed."""
    widths, planes = [], []
    for c in columns:
        c = c.astype(np.uint64)
        widths.append((int(c.max()).bit_length() + 7) // 8)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T).tobytes())
    return np.array([len(columns[0]), *widths], np.int64).tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, *widths = np.frombuffer(blob, np.int64, 1 + columns).tolist()
    planes = np.frombuffer(pa.decompress(blob[8 * (1 + columns) :], n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for w in widths:
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = planes[at : at + n * w].reshape(w, n).T
        out.append(c.view(np.uint64).ravel())
        at += n * w
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.zeros(1, np.uint64))


def _starts(ascending: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1]]))


def _pieces(entries: Entries, bits: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """What goes to each part: its range of the entries, and how often each stands."""
    part = (((entries.keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    start = _starts(part)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(part)]):
        yield int(part[a]), _pack(_steps(entries.keys[a:b]), entries.codes[a:b], entries.n[a:b])


def _totals(blobs: list[bytes]) -> Iterator[bytes]:
    """For every piece of a part, in its order: how often each entry's key stands in the corpus, and the entry."""
    pieces = [_unpack(b, 3) for b in blobs]
    ends = np.cumsum([0, *(len(p[0]) for p in pieces)]).tolist()
    keys, code, n = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in pieces]), *(np.concatenate([p[i] for p in pieces]) for i in (1, 2))
    del pieces
    known, code, _, at = _distinct(keys, code)
    del keys
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, n.astype(np.int64))
    start = _starts(known)
    of_key = np.repeat(np.add.reduceat(total, start), np.diff([*start.tolist(), len(known)]))
    for a, b in zip(ends, ends[1:]):
        yield _pack(of_key[at[a:b]], total[at[a:b]])


def likelihood(column: pa.Array, words: Vocabulary, net: Network, bits: int, told: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and summed conditional log-probability of every text; told: the totals of its entries, by part."""
    h, first = hashed_words(column)
    tokens = words.tokens(h)
    entries = Entries(h, first, tokens, bits)
    empty = [np.zeros(0, np.uint64)] * 2
    of_key, of_entry = (np.concatenate(x).astype(np.int64) for x in zip(empty, *(_unpack(b, 2) for b in told)))
    if len(of_entry) != len(entries.n):
        raise ValueError(f"{len(of_entry)} totals for {len(entries.n)} entries")
    value = net.log_probabilities(tokens, _contexts(tokens, first)).astype(np.float64)
    mine = of_entry[entries.of_rare]
    value[entries.rare] += np.log(mine / np.maximum(words.mass[tokens[entries.rare].astype(np.int64) - KNOWN], mine))
    others = of_key[entries.of_inner] - 1
    some = others > 0
    at, others, same = entries.inner[some], others[some], of_entry[entries.of_inner[some]] - 1
    weight = others / (others + DOUBT)
    value[at] = np.log((1 - weight) * np.exp(value[at]) + weight * same / others)
    sums = np.concatenate([np.zeros(1), np.cumsum(value, dtype=np.float64)])
    return np.diff(first), sums[first[1:]] - sums[first[:-1]]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, log_likelihood (0 without words) and mean_log_likelihood (null without words)."""
    words, total = vocabulary(docs, text)
    net = train(docs, words, total, text)
    release(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((words, net))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))), F.lit(0))).first()[0]
    bits, buckets, parts = key_bits(total), max(1, -(-volume // BUCKET)), max(1, -(-volume // PART))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int")).repartition(min(buckets, MOST_TASKS), "bucket")

    def send(key, table):
        h, first = hashed_words(table.column("text"))
        out = list(_pieces(Entries(h, first, model.value[0].tokens(h), bits), bits, parts))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "part", "counts"])

    def add_up(key, table):
        out = list(_totals([b.as_py() for b in table.column("counts")]))
        return pa.table([table.column("bucket"), table.column("part"), pa.array(out, pa.binary())], names=["bucket", "part", "counts"])

    def finish(table, told):
        vocabulary_, network = model.value
        # Parts are ranges of the keys, so in their order the entries are ascending as a whole.
        counts = sorted(zip(told.column("part").to_pylist(), told.column("counts").to_pylist()))
        number, value = likelihood(table.column("text"), vocabulary_, network, bits, [x for _, x in counts])
        return pa.table([table.column("id"), pa.array(number, pa.int64()), pa.array(np.round(value, 4), pa.float64())], names=["id", "n_tokens", "log_likelihood"])

    sent = rows.groupBy("bucket").applyInArrow(send, "bucket int, part int, counts binary")
    told = sent.groupBy("part").applyInArrow(add_up, "bucket int, part int, counts binary")
    out = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(finish, "id long, n_tokens long, log_likelihood double")
    return out.select(F.col("id").alias(key), "n_tokens", "log_likelihood").withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
