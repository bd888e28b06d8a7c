"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of WINDOW words, one every STRIDE words, to its end. A word
enters by a hashed embedding of the whole word and the mean of hashed embeddings of its character
trigrams, so unseen forms of a known stem still count. Two recurrent passes meet in an attention
pool and a logit; a document's score is its largest window logit, calibrated to a probability.

Training uses a bounded sample of labelled documents outside the held-out fold: at most POSITIVES
toxic and NEGATIVES other ones, the first by a hash of doc_id. As labels mark documents, not
windows, training starts from the windows whose words and trigrams are the most telling by document
frequency. Scores see the text only.

Defined results: null counts as empty; a text without words gets the score of no evidence, 0;
repeated rows get equal scores; without a labelled row of each class outside the held-out fold all
scores are 0; a text of any length is scored in full; of equal windows the first counts, which changes
no score; rows of one doc_id share their label; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import LOWER, mix, raw, slices, span_hashes, word_spans

WINDOW, STRIDE = 16, 10
WORD_ROWS, WORD_DIM = 8192, 8
GRAM_ROWS, GRAM_DIM = 4096, 16
HIDDEN = 8
POSITIVES, NEGATIVES = 1500, 2500
EPOCHS, RATE, BATCH = 6, 0.02, 64
#: Words in fewer training documents share one embedding.
MIN_DOCUMENTS = 4
THRESHOLD = 0.3

_STRIP = np.zeros(256, bool)
_STRIP[[c for c in range(128) if not chr(c).isalnum()]] = True


class Words:
    """The distinct words of some texts: hashed word row and trigram rows; and where they stand."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        data = LOWER[data]
        spans, firsts, n = [], [np.zeros(1, np.int64)], 0
        for a, b in slices(bounds):
            lo = bounds[a]
            part = data[lo : bounds[b]]
            s, e, first = word_spans(part, bounds[a : b + 1] - lo)
            # Marks around a word are no part of it.
            for _ in range(3):
                inner = (e - s) > 1
                s = s + (inner & _STRIP[part[s]]) if len(s) else s
                inner = (e - s) > 1
                e = e - (inner & _STRIP[part[e - 1]]) if len(e) else e
            spans.append((s + lo, e + lo, span_hashes(part, s, e, 1)))
            firsts.append(first[1:] + n)
            n += len(s)
        self.first = np.concatenate(firsts)
        none = np.zeros(0, np.int64)
        s, e, h = (np.concatenate(x) for x in zip(*spans)) if spans else (none, none, none.view(np.uint64))
        _, at, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[at] % np.uint64(WORD_ROWS)).astype(np.int64)
        s, e = s[at], e[at]
        size = e - s
        self.start = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(self.start, size) + np.repeat(s, size)
        c = data[place].astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
        left, right = np.roll(c, 1), np.roll(c, -1)
        left[self.start], right[self.start + size - 1] = 1, 2
        self.gram = (mix(left << np.uint64(16) | c << np.uint64(8) | right) % np.uint64(GRAM_ROWS)).astype(np.int64)
        self.size = size

    def grams_mean(self, table: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.gram], self.start, axis=0) / self.size[:, None].astype(table.dtype)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and row of every window; a row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE) + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][row] + k * STRIDE, np.minimum(WINDOW, n[row] - k * STRIDE), row


def _grid(index: np.ndarray, start: np.ndarray, size: np.ndarray, empty: int) -> np.ndarray:
    """Distinct-word numbers of windows, one line each; empty past a window's end."""
    t = np.arange(WINDOW)
    at = np.minimum(start[:, None] + t, max(len(index) - 1, 0))
    return np.where(t < size[:, None], index[at], empty)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        x, h = WORD_DIM + GRAM_DIM, HIDDEN
        self.p = {"word": f(WORD_ROWS, WORD_DIM, scale=0.1), "gram": f(GRAM_ROWS, GRAM_DIM, scale=0.3), "attend": f(2 * h, scale=0.3), "out": f(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(x, 3 * h, scale=x**-0.5), f"b{d}": np.zeros(3 * h, np.float32), f"h{d}": f(h, 3 * h, scale=h**-0.5)}
        self.known = np.ones(WORD_ROWS, bool)
        self.a, self.b = 1.0, 0.0  # calibration

    def row(self, words: Words) -> np.ndarray:
        """Embedding row of each distinct word; 0 for words too rare to learn."""
        return np.where(self.known[words.word], words.word, 0)

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][self.row(words)], words.grams_mean(self.p["gram"])], axis=1).astype(np.float32)

    def _pass(self, px: np.ndarray, grid: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States at every step; px has each distinct word's projection, and a line of zeros."""
        H, u = HIDDEN, self.p[f"h{d}"]
        h = np.zeros((len(grid), H), np.float32)
        states, saved = [None] * WINDOW, []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, q = px[grid[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * H] + q[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, 2 * H :] + r * q[:, 2 * H :])
            new = n + z * (h - n)
            m = None
            if mask is not None:
                m = mask[:, t, None]
                new = np.where(m, new, h)
            if keep:
                saved.append((t, h, z, r, n, q[:, 2 * H :], m))
            h = states[t] = new
        return np.stack(states, axis=1), saved

    def forward(self, x: np.ndarray, grid: np.ndarray, keep: bool = False):
        """Window logits. x: inputs of the distinct words; a grid cell of len(x) is empty."""
        mask = grid < len(x)
        if not keep and mask.all():
            mask = None
        parts = []
        for d in "fb":
            px = np.concatenate([x @ self.p[f"x{d}"] + self.p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            parts.append(self._pass(px, grid, mask, d, keep))
        states = np.concatenate([parts[0][0], parts[1][0]], axis=2)
        weight = states @ self.p["attend"]
        if mask is not None:
            weight = np.where(mask, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pool = np.einsum("bt,bth->bh", weight, states)
        logit = pool @ self.p["out"] + self.p["bias"][0]
        return (logit, states, weight, pool, parts, mask) if keep else logit

    def gradient(self, words: Words, grid: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(words)
        logit, states, weight, pool, parts, mask = self.forward(x, grid, keep=True)
        H, g = HIDDEN, {}
        dl = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["out"], g["bias"] = pool.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["out"]
        dw = np.einsum("bh,bth->bt", dpool, states)
        dscore = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("bt,bth->h", dscore, states)
        dstates = weight[:, :, None] * dpool[:, None, :] + dscore[:, :, None] * self.p["attend"]
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for k, d in enumerate("fb"):
            u, own = self.p[f"h{d}"], dstates[:, :, k * H : (k + 1) * H]
            gx, gu = np.zeros((len(x) + 1, 3 * H), np.float32), np.zeros_like(u)
            dh = np.zeros((len(grid), H), np.float32)
            for t, h, z, r, n, qn, m in reversed(parts[k][1]):
                dnew = dh + own[:, t]
                live = np.where(m, dnew, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * qn * r * (1 - r)
                dq = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, grid[:, t], np.concatenate([dz, dr, dn], axis=1))
                gu += h.T @ dq
                dh = np.where(m, live * z, dnew) + dq @ u.T
            gx = gx[:-1]
            g[f"h{d}"], g[f"x{d}"], g[f"b{d}"] = gu, x.T @ gx, gx.sum(axis=0)
            dx[:-1] += gx @ self.p[f"x{d}"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], self.row(words), dx[:-1, :WORD_DIM])
        g["gram"] = np.zeros_like(self.p["gram"])
        np.add.at(g["gram"], words.gram, np.repeat(dx[:-1, WORD_DIM:] / words.size[:, None].astype(np.float32), words.size, axis=0))
        return g

    def largest(self, data: np.ndarray, bounds: np.ndarray, batch: int = 4096) -> np.ndarray:
        """The largest window logit of each row; minus infinity without words."""
        words = Words(data, bounds)
        start, size, row = windows_of(words.first)
        out = np.full(len(bounds) - 1, -np.inf, np.float32)
        x = self.inputs(words)
        whole = np.argsort(size != WINDOW, kind="stable")  # windows that are full need no mask
        start, size, row = start[whole], size[whole], row[whole]
        for a in range(0, len(start), batch):
            s = slice(a, a + batch)
            np.maximum.at(out, row[s], self.forward(x, _grid(words.index, start[s], size[s], len(x))))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        data, bounds = raw(column)
        parts = [self.largest(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in slices(bounds)]
        top = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        return np.where(np.isfinite(top), _sigmoid(self.a * np.where(np.isfinite(top), top, 0) + self.b), 0.0)


def _telling(words: Words, toxic: np.ndarray) -> np.ndarray:
    """How telling each distinct word is: the log odds of its own or its trigrams' document frequency."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pos, neg = max(1, toxic.sum()), max(1, (~toxic).sum())

    def odds(counts: np.ndarray) -> np.ndarray:
        return np.log((counts[1] + 0.5) / (pos + 1)) - np.log((counts[0] + 0.5) / (neg + 1))

    n = len(words.word)
    by_word, by_gram = np.zeros((2, n), np.int32), np.zeros((2, GRAM_ROWS), np.int32)
    for a in range(0, len(toxic), 100):  # some documents at a time bound the space
        lo, hi = words.first[a], words.first[min(a + 100, len(toxic))]
        seen = np.unique(row[lo:hi] * n + words.index[lo:hi])
        r, c = seen // n, seen % n
        np.add.at(by_word, (toxic[r].astype(int), c), 1)
        size = words.size[c]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.start[c], size)
        seen = np.unique(np.repeat(r, size) * GRAM_ROWS + words.gram[at])
        np.add.at(by_gram, (toxic[seen // GRAM_ROWS].astype(int), seen % GRAM_ROWS), 1)
    by_word, by_gram = odds(by_word), odds(by_gram)
    best = np.maximum.reduceat(by_gram[words.gram], words.start) if n else by_word
    return np.maximum(np.maximum(by_word, best), 0)


def train(texts: list[str | None], toxic: list[bool], seed: int = 5) -> Network | None:
    """A network fitted to labelled texts; None without texts of both classes."""
    label = np.array(toxic, bool)
    if not label.any() or label.all():
        return None
    r = np.random.default_rng(seed)
    data, bounds = raw(pa.array(texts, pa.large_string()))
    words = Words(data, bounds)
    start, size, row = windows_of(words.first)
    weight = _telling(words, label)[words.index]
    total = np.concatenate([np.zeros(1), np.cumsum(weight)])
    value = total[start + size] - total[start] + r.random(len(start)) * 1e-3
    # The two most telling windows of each document, and another one of the others.
    order = np.lexsort((-value, row))
    rank = np.arange(len(order)) - np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row[order], minlength=len(label)))])[:-1][row[order]]
    spare = ~label[row[order]] & (r.random(len(order)) < 1.0 / np.maximum(1, np.bincount(row, minlength=len(label)))[row[order]])
    everyone = order[(rank < 2) | spare]
    net = Network(seed)
    pairs = np.unique(np.repeat(np.arange(len(label)), np.diff(words.first)) * WORD_ROWS + words.word[words.index])
    net.known = np.bincount(pairs % WORD_ROWS, minlength=WORD_ROWS) >= MIN_DOCUMENTS
    net.known[0] = True
    fit = r.random(len(label)) < 0.75  # the rest calibrates
    if not label[fit].any() or not label[~fit].any():
        fit[:] = True
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    chosen = everyone[fit[row[everyone]]]
    epochs = EPOCHS * max(1, 4000 // max(1, len(chosen)))
    for _ in range(min(epochs, 40)):
        r.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            pick = chosen[a : a + BATCH]
            grid = _grid(words.index, start[pick], size[pick], -1)
            used, inverse = np.unique(grid, return_inverse=True)
            inverse = inverse.reshape(grid.shape)
            if used[0] == -1:
                used, inverse = used[1:], np.where(inverse == 0, len(used) - 1, inverse - 1)
            g = net.gradient(_Some(words, used), inverse, label[row[pick]].astype(np.float32))
            step += 1
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                net.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    top = np.concatenate([net.largest(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in slices(bounds)]).astype(np.float64)
    ok = np.isfinite(top) & (~fit if not fit.all() else fit)
    x, y = top[ok], label[ok]
    v, m = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):  # calibration: damped Newton steps on the log-likelihood
        p = _sigmoid(m @ v)
        hess = (m * (p * (1 - p))[:, None]).T @ m + 0.05 * np.eye(2)
        v -= np.clip(np.linalg.solve(hess, m.T @ (p - y) + 0.05 * v), -1, 1)
    a, b = v
    net.a, net.b = max(float(a), 0.05), float(b)
    return net


class _Some:
    """Some of the distinct words."""

    def __init__(self, words: Words, used: np.ndarray):
        self.word, self.size = words.word[used], words.size[used]
        self.start = np.cumsum(self.size) - self.size
        at = np.arange(int(self.size.sum())) - np.repeat(self.start, self.size) + np.repeat(words.start[used], self.size)
        self.gram = words.gram[at]

    grams_mean = Words.grams_mean


def fold(key) -> object:
    return F.crc32(key.cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple[str | None, bool]]:
    """Texts and labels of the bounded sample; a doc_id with several label rows is toxic if one says so."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.coalesce(fold(F.col("doc_id")), F.lit(2)) != 2)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(positives).unionAll(known.where("toxic = 0").orderBy(*order).limit(negatives))
    # At most positives + negatives rows of two numbers.
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(*order, "text").collect()
    return [(r["text"], bool(r["toxic"])) for r in {r["doc_id"]: r for r in got}.values()]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sample = training_rows(docs, labels)
    net = train([t for t, _ in sample], [y for _, y in sample])
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.scores(batch.column(1)) if model.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
