"""Substring dedup: passages of WIDTH words that an earlier document already has are removed.

Fixed-block anchors: every document is cut into non-overlapping blocks of BLOCK = 7 words, the
largest for which any run of 13 words holds a whole block. The blocks are the index; every rolling
window of 7 words probes it. Where a probe meets a block of another document, the hit is extended
to the windows of 13 words around it, and only these are compared in full, by a 64-bit and a 32-bit hash.
Of equal windows, those outside the document with the least doc_id are repeats; their union gives
the maximal repeats, and the words they cover go.

Documents lie in buckets of about BUCKET bytes, by a hash of the row. A bucket sends each distinct
probe once, packed, to the part of the hash space it belongs to, and gets back those that other
buckets share; so a passage that a third of all documents have costs one entry per bucket, and no
task holds more than its bucket or its part. Then the same for the windows that hits were extended
to, with the least doc_id of each. The documents' shuffle into buckets is shared by all passes.

Defined results: null or empty texts have no words; texts under 13 words lose none; a text longer than
a bucket is a bucket of its own with what falls there; rows without a doc_id count as after all
others and never cause removals; rows with equal doc_id (repeated rows, too) don't remove each
other's words; windows are judged on the input; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import hashed_words, pack_sorted, plain_words, unpack_sorted, window_hashes, windows

WIDTH = 13
BLOCK = 7
BUCKET = 8 << 20
PART = 24 << 20
MOST_TASKS = 100_000
_LAST = np.iinfo(np.int64).max


def _span(words: np.ndarray, first: np.ndarray, width: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, row = windows(first, width)
    return window_hashes(words, width, which)[start], start, row


def _pack_windows(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> bytes:
    """Windows, ascending by first hash: both hashes (the second's upper half) and an id."""
    known, index = np.unique(ids, return_inverse=True)
    wide = len(known) > 65536
    head = np.array([len(h1), len(known), wide], np.int64).tobytes()
    return head + known.tobytes() + pack_sorted(h1) + (h2 >> np.uint64(32)).astype(np.uint32).tobytes() + index.astype(np.uint32 if wide else np.uint16).tobytes()


def _unpack_windows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k, wide = np.frombuffer(blob, np.int64, 3)
    at = 24 + 8 * k
    known = np.frombuffer(blob, np.int64, k, 24)
    h1 = unpack_sorted(blob[at : at + 8 * n], np.uint64)
    h2 = np.frombuffer(blob, np.uint32, n, at + 8 * n)
    return h1, h2, known[np.frombuffer(blob, np.uint32 if wide else np.uint16, n, at + 12 * n)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _stretches(part: np.ndarray) -> list[tuple[int, int, int]]:
    """The parts that ascending part numbers name, with their rows; parts without any cost nothing."""
    start = _runs(part)
    return list(zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(part)]))


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a bucket, words before each row, and each row's id (rows without one come last)."""
    words, first = hashed_words(table.column("text"))
    ids = table.column("id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int64)
    return words, first, np.asarray(ids, np.int64)


def _probes(table: pa.Table, parts: int) -> list[tuple]:
    """Rows (part, blocks, others): a bucket's distinct probes by part, those that are blocks of it first."""
    words, first, _ = _words(table)
    h, start, row = _span(words, first, BLOCK, 0)
    block = (start - first[row]) % BLOCK == 0
    # One bit less of the hash makes room for the mark, so one sort does both.
    code = np.unique((h & ~np.uint64(1)) | block.astype(np.uint64))
    marked = (code & np.uint64(1)).astype(bool)
    plain = np.concatenate([code[:-1] & ~np.uint64(1) != code[1:] & ~np.uint64(1), np.ones(1, bool)]) if len(code) else marked
    code, marked = code[plain], marked[plain]  # of a window that is a block and a probe, the block
    part = _part(code, parts)
    low = (code & np.uint64(0xFFFFFFFE)).astype(np.uint32)
    out = []
    for p, a, b in _stretches(part):
        m = marked[a:b]
        out.append((p, pack_sorted(np.sort(low[a:b][m])), pack_sorted(np.sort(low[a:b][~m]))))
    return out


def _shared_probes(table: pa.Table) -> list[tuple[int, bytes]]:
    """Rows (bucket, hits): which of its probes a bucket shares with another, one of them as a block."""
    values, buckets = [], table.column("bucket").to_pylist()
    for mark, name in ((1, "blocks"), (0, "others")):
        for i, blob in enumerate(table.column(name)):
            v = unpack_sorted(blob.as_py()).astype(np.uint64)
            values.append(v << np.uint64(32) | np.uint64(i << 1 | mark))
    v = np.concatenate(values) if values else np.zeros(0, np.uint64)
    v.sort()
    key = v >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(v)))
    any_block = np.logical_or.reduceat((v & np.uint64(1)).astype(bool), start) if len(v) else np.zeros(0, bool)
    hit = v[np.repeat((size > 1) & any_block, size)]
    index = (hit & np.uint64(0xFFFFFFFF)) >> np.uint64(1)
    order = np.argsort(index, kind="stable")
    index, low = index[order], (hit[order] >> np.uint64(32)).astype(np.uint32)
    cut = np.searchsorted(index, np.arange(len(buckets) + 1, dtype=np.uint64))
    return [(b, pack_sorted(low[cut[i] : cut[i + 1]])) for i, b in enumerate(buckets) if cut[i] < cut[i + 1]]


def _in_several_rows(h: np.ndarray, row: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Marks windows whose hash also stands in another row, one of them as a block."""
    out = np.zeros(len(h), bool)
    if not len(h):
        return out
    order = np.argsort(h, kind="stable")
    key, r = h[order], row[order]
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    several = (r[start] != r[start + size - 1]) & np.logical_or.reduceat(block[order], start)  # rows ascend within a run
    out[order] = np.repeat(several, size)
    return out


def _extended(table: pa.Table, hits: pa.Table, parts: int) -> list[tuple]:
    """Rows (part, windows): the windows of WIDTH words around a bucket's hits, with their least id."""
    words, first, ids = _words(table)
    h, start, row = _span(words, first, BLOCK, 0)
    shared = _in_several_rows(h, row, (start - first[row]) % BLOCK == 0)
    known = [np.uint64(p.as_py() << 32) | unpack_sorted(b.as_py()).astype(np.uint64) for p, b in zip(hits.column("part"), hits.column("hits"))]
    if known:
        known = np.sort(np.concatenate(known))
        mine = _part(h & ~np.uint64(1), parts) << np.uint64(32) | (h & np.uint64(0xFFFFFFFE))
        at = np.searchsorted(known, mine)
        at[at == len(known)] = 0
        # The mark's bit was spent, so both of its values are looked up as zero.
        shared |= known[at] == mine
    # A window of WIDTH words stays if any of the probes in it is shared.
    probe = np.zeros(len(words) + 1, np.int64)
    probe[start] = shared
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(probe)])
    wide, wrow = windows(first, WIDTH)
    near = before[wide + WIDTH - BLOCK + 1] > before[wide]
    wide, wrow = wide[near], wrow[near]
    h1, h2 = window_hashes(words, WIDTH, 1)[wide], window_hashes(words, WIDTH, 0)[wide] >> np.uint64(32)
    order = np.lexsort((ids[wrow], h2, h1))
    h1, h2, least = h1[order], h2[order], ids[wrow][order]
    start = _runs(h1, h2)
    h1, h2, least = h1[start], h2[start] << np.uint64(32), least[start]
    return [(p, _pack_windows(h1[a:b], h2[a:b], least[a:b])) for p, a, b in _stretches(_part(h1, parts))]


def _earlier(table: pa.Table) -> list[tuple[int, bytes]]:
    """Rows (bucket, windows): a bucket's windows that stand in another bucket under a smaller id, with the least."""
    buckets = table.column("bucket").to_pylist()
    blobs = [_unpack_windows(b.as_py()) for b in table.column("windows")]
    if not blobs:
        return []
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b[0]) for b in blobs])
    h1, h2, ids = (np.concatenate(x) for x in zip(*blobs))
    order = np.lexsort((ids, h2, h1))
    h1, h2, ids, owner = h1[order], h2[order], ids[order], owner[order]
    start = _runs(h1, h2)
    least = np.repeat(ids[start], np.diff(np.append(start, len(h1))))
    tell = np.flatnonzero(least < ids)
    tell = tell[np.argsort(owner[tell], kind="stable")]  # first hashes still ascend for each owner
    h1, h2, least = h1[tell], h2[tell].astype(np.uint64) << np.uint64(32), least[tell]
    cut = np.searchsorted(owner[tell], np.arange(len(buckets) + 1))
    return [(b, _pack_windows(h1[x:y], h2[x:y], least[x:y])) for b, x, y in zip(buckets, cut[:-1], cut[1:]) if x < y]


def _covered(table: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For every word of a bucket whether a repeat covers it; words before each row."""
    words, first, ids = _words(table)
    wide, row = windows(first, WIDTH)
    h1, h2 = window_hashes(words, WIDTH, 1)[wide], (window_hashes(words, WIDTH, 0)[wide] >> np.uint64(32)).astype(np.uint32)
    own = ids[row]
    least = own.copy()
    if len(h1):
        order = np.lexsort((own, h2, h1))
        start = _runs(h1[order], h2[order])
        least[order] = np.repeat(own[order][start], np.diff(np.append(start, len(order))))
    known = [_unpack_windows(b.as_py()) for b in told.column("windows")]
    if known and len(h1):
        k1, k2, kid = (np.concatenate(x) for x in zip(*known))
        order = np.lexsort((k2, k1))
        k1, k2, kid = k1[order], k2[order], kid[order]
        at = np.searchsorted(k1, h1)
        while True:  # more than one step only where one first hash stands with several second ones
            i = np.minimum(at, len(k1) - 1)
            same = (k1[i] == h1) & (at < len(k1))
            if not same.any():
                break
            found = same & (k2[i] == h2)
            least[found] = np.minimum(least[found], kid[i[found]])
            at = np.where(same & ~found, at + 1, len(k1))
    repeat = wide[least < own]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, repeat, 1)
    np.add.at(change, repeat + WIDTH, -1)
    return np.cumsum(change)[:-1] > 0, first


def _kept_texts(table: pa.Table, covered: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each row's words that are not covered, joined by one blank."""
    out: list[bytes] = []
    for a, b, data, s, e, local in plain_words(table.column("text"), lower=False):
        blob = data.tobytes()
        base = first[a]
        for i in range(b - a):
            lo, hi = local[i], local[i + 1]
            if lo == hi:
                out.append(b"")
                continue
            gone = covered[base + lo : base + hi]
            if not gone.any():
                out.append(blob[s[lo] : e[hi - 1]])
            else:
                stay = np.flatnonzero(~gone) + lo
                # Runs of kept words are copied whole.
                runs = np.split(stay, np.flatnonzero(np.diff(stay) > 1) + 1) if len(stay) else []
                out.append(b" ".join(blob[s[r[0]] : e[r[-1]]] for r in runs))
    return out


def _plan(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents by bucket, and what each bucket is told of others."""
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    buckets, parts = max(1, -(-volume // BUCKET)), max(1, -(-volume // PART))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))
    # A task per bucket or so; with the number given, adaptive execution doesn't pack many into one.
    rows = rows.repartition(min(buckets, MOST_TASKS), "bucket")

    def of_bucket(f, names, *more):
        def run(key, table):
            out = f(table, *more)
            cols = list(zip(*out)) if out else [[] for _ in range(len(names) + 1)]
            b = key[0].as_py()
            arrays = [pa.array([b] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]]
            return pa.table(arrays, names=["bucket", "part", *names])

        return run

    def of_part(f, name):
        def run(key, table):
            out = f(table)
            p = key[0].as_py()
            return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([p] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "part", name])

        return run

    def extend(key, table, hits):
        out = _extended(table, hits, parts)
        b = key[0].as_py()
        return pa.table([pa.array([b] * len(out), pa.int32()), pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "part", "windows"])

    probes = rows.groupBy("bucket").applyInArrow(of_bucket(_probes, ["blocks", "others"], parts), "bucket int, part int, blocks binary, others binary")
    hits = probes.groupBy("part").applyInArrow(of_part(_shared_probes, "hits"), "bucket int, part int, hits binary")
    wide = rows.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(extend, "bucket int, part int, windows binary")
    return rows, wide.groupBy("part").applyInArrow(of_part(_earlier, "windows"), "bucket int, part int, windows binary")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """key, n_words, n_removed and kept (the words left, joined by one blank), or kept_sha256 with digest."""
    rows, told = _plan(docs, key, text)
    last = "kept_sha256" if digest else "kept"

    def finish(table, told):
        covered, first = _covered(table, told)
        texts = _kept_texts(table, covered, first)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(covered)])
        kept = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode("utf-8", "replace") for t in texts]
        return pa.table([table.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", last])

    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(finish, f"`{key}` long, n_words long, n_removed long, {last} string")
