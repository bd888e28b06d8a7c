"""Near-duplicate groups by SimHash, with a byte-position inverted index and count filtering.

A fingerprint has 64 bits in 8 bytes. Fingerprints that differ in at most DISTANCE = 4 bits differ
in at most 4 bytes, so they share at least 4 bytes by position: the guaranteed minimum. The index
lists fingerprints under the bytes of three positions. Twenty triples of positions are enough for
any four positions to hold one of them (the positions fall into groups of 3, 3 and 2; a triple is a
whole group, or two of a group and one of the next), so a pair with four shared bytes meets in at
least one list. Lists of more than REFINE members are split by each fourth position, whose byte the
pair must also share. Each pair that meets has its shared bytes tallied; with fewer than 4 it is
dropped, else its bits are compared.

Equal fingerprints are one class from the start. A task emits, for each fingerprint, one link to the
least one that its own links reach, never all pairs; classes are then joined by connected
components over the links.

Defined results: null or empty texts have fingerprint 0, which links like any other; texts of fewer
words than a shingle have one shingle, all their words; a very long text is hashed in slices; ties
(a bit set in exactly half of the shingles) give bit 0; repeated rows share a component; rows
without a doc_id are linked, but never name a component (null if all its rows have none); an empty
table gives an empty result; extra columns, whatever their names, are carried but not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import min_label
from graphloom.plans.session import cut

from .buffers import LOWER, hashed_words, mix, plain_words, raw, slices

SHINGLE = 4
SEED = 42
DISTANCE = 4
REFINE = 256
#: Lists that a fourth byte leaves longer than this are split by pigeonhole over smaller pieces.
DENSE = 4096
#: Index entries that a task links at a time, and any list that is longer.
STREAM = 1 << 20


def _triples() -> list[tuple[int, int, int]]:
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [g for g in groups if len(g) == 3]
    for i, g in enumerate(groups):
        out += [(a, b, c) for a, b in combinations(g, 2) for c in groups[(i + 1) % 3]]
    return out


TRIPLES = _triples()


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b, data, s, e, first in plain_words(column, lower=True):
        view = memoryview(data)
        count = first[1:] - first[:-1]
        n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
        if not n.sum():
            continue
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first[:-1], n)
        last = np.minimum(at + shingle, np.repeat(first[1:], n)) - 1
        h = np.array([digest(view[x:y], SEED) for x, y in zip(s[at].tolist(), e[last].tolist())], np.uint64)
        some = np.flatnonzero(n)
        starts = begin[some]
        # Whole rows of shingles at a time, so the bits take bounded space.
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 65536)))
            end = int(starts[hi]) if hi < len(some) else len(h)
            bits = np.unpackbits(h[starts[lo] : end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts[lo:hi] - starts[lo], axis=0, dtype=np.int64)
            more = 2 * ones > n[some[lo:hi], None]
            out[a + some[lo:hi]] = np.packbits(more, axis=1, bitorder="little").view(np.uint64)[:, 0]
            lo = hi
    return out


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, txt (a hash of the text) and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["key", "txt", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_hash(F.col(f"`{text}`")).alias("txt"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, txt long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _met(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among fingerprints that stand in the same list; lists of more than most are left out."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    left, right = [], []
    new = np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(keys)))
    end = np.repeat(starts + size, size)
    at = np.flatnonzero(np.repeat((size > 1) & (size <= most), size))
    for k in range(1, int(size[size <= most].max(initial=0))):
        at = at[at + k < end[at]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + k]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        ok = (shared >= 8 - DISTANCE) & (x != 0)
        ok[ok] = np.bitwise_count(x[ok]) <= DISTANCE
        left.append(fps[at[ok]])
        right.append(fps[at[ok] + k])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links of a long list, by pigeonhole over its 16 four-bit pieces.

    Fingerprints within DISTANCE = 4 bits differ in 4 pieces at most; so of 5 disjoint groups of
    pieces (of 3 or 4) one is equal in both, and only fingerprints that agree in a group are compared.
    """
    fps = np.unique(fps)
    left, right = [], []
    groups = np.array_split(np.arange(16), 5)
    for g in groups:
        mask = np.uint64(sum(0xF << 4 * int(p) for p in g))
        l, r = _met(fps & mask, fps, len(fps))
        left.append(l)
        right.append(r)
    return np.concatenate(left), np.concatenate(right)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each linked fingerprint but the least of its links' component, that least one."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def links_in(key: np.ndarray, triple: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the index lists of one task, as a forest."""
    lists = key.astype(np.uint64) << np.uint64(8) | triple.astype(np.uint64)
    left, right = _met(lists, fps, REFINE)
    found = [(left, right)]
    _, inverse, size = np.unique(lists, return_inverse=True, return_counts=True)
    big = np.flatnonzero(size[inverse] > REFINE)
    if len(big):
        by = fps[big].view(np.uint8).reshape(-1, 8)
        for position in range(8):
            rows = np.flatnonzero([position not in TRIPLES[t] for t in triple[big]])
            if len(rows):
                finer = inverse[big][rows].astype(np.uint64) << np.uint64(8) | by[rows, position].astype(np.uint64)
                _, at, m = np.unique(finer, return_inverse=True, return_counts=True)
                some = m[at] <= DENSE
                found.append(_met(finer[some], fps[big][rows][some], DENSE))
                for dense in np.flatnonzero(m > DENSE):
                    found.append(_ball(fps[big][rows][at == dense]))
    return _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def links(classes: DataFrame) -> DataFrame:
    """src and dst: links between distinct fingerprints fp that have the components of all links."""
    masks = [sum(0xFF << 8 * p for p in t) for t in TRIPLES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
    index = classes.select("fp", F.explode(entries).alias("e")).select("fp", "e.t", "e.k")
    # As many parts as the session has; every list lies in one of them.
    index = index.repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists come in order, so whole lists are linked as they pass; only the last one is held back.
        held: list[np.ndarray] = []
        rows = 0

        def linked(table: np.ndarray) -> pa.RecordBatch:
            triple = table[1].astype(np.int32)
            a, b = links_in(_packed(table[2].view(np.uint64), triple), triple, table[0].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()]))
            rows += batch.num_rows
            if rows < STREAM:
                continue
            table = np.concatenate(held, axis=1)
            last = np.flatnonzero((table[1] != table[1, -1]) | (table[2] != table[2, -1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield linked(table[:, :end])
            held, rows = [table[:, end:]], table.shape[1] - end
        if held and rows:
            yield linked(np.concatenate(held, axis=1))

    return index.mapInArrow(run, "src long, dst long")


def _packed(masked: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """The three bytes of a masked fingerprint, side by side."""
    by = masked.view(np.uint8).reshape(-1, 8)
    cols = np.array(TRIPLES)[triple]
    rows = np.arange(len(by))
    return by[rows, cols[:, 0]].astype(np.uint64) | by[rows, cols[:, 1]].astype(np.uint64) << np.uint64(8) | by[rows, cols[:, 2]].astype(np.uint64) << np.uint64(16)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Two tables: key, txt and fp of every row; fp, root and component_id (the least key that links reach) of every fingerprint."""
    fps = cut(with_fingerprints(docs, key, text, shingle))  # three numbers a row
    classes = fps.groupBy("fp").agg(F.min("key").alias("least"))
    labels = min_label(links(classes)).withColumnsRenamed({"id": "fp", "label": "root"})
    full = classes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return fps, full.join(full.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp and component_id of every row."""
    fps, named = groups(docs, key, text, shingle)
    return fps.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies

#: Words of a shingle, and the similarity of shingle sets from which texts are near copies.
NEAR_SHINGLE = 5
NEAR_PLACES = 64
#: Of 64 bytes, texts of similarity 0.8 share 51 in the mean, give or take 3; texts of 0.6 or less 38.
NEAR_SHARED = 48
#: The index: twelve keys of five bytes side by side. A pair of similarity 0.8 misses all with
#: probability (1 - 0.8^5)^12 = 0.9 %, one of 0.9 with 1 in 100,000.
NEAR_BANDS, NEAR_WIDTH = 12, 5


def sketches_of(column: pa.Array) -> list[bytes | None]:
    """NEAR_PLACES bytes of every text, each from the least of all its shingles under a hash of the place; none without words."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, NEAR_PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out: list[bytes | None] = []
    data, bounds = raw(column)
    for a, b in slices(bounds):
        part = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer((bounds[a : b + 1] - bounds[a]).tobytes()), pa.py_buffer(LOWER[data[bounds[a] : bounds[b]]].tobytes()))
        words, first = hashed_words(part)
        count = np.diff(first)
        # A text of fewer words is one shingle: padded by zeros, as a run that goes on behind its end.
        n = np.where(count > 0, np.maximum(count - NEAR_SHINGLE + 1, 1), 0)
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first[:-1], n)
        end = np.repeat(first[1:], n)
        padded = np.concatenate([words, np.zeros(NEAR_SHINGLE, np.uint64)])
        h = np.zeros(len(at), np.uint64)
        for k in range(NEAR_SHINGLE):
            h = mix(h + np.where(at + k < end, padded[at + k], np.uint64(k + 1)))
        some = np.flatnonzero(n)
        sketch = np.zeros((len(some), NEAR_PLACES), np.uint8)
        if len(some):
            for p in range(NEAR_PLACES):
                least = np.minimum.reduceat(h * odd[p] ^ (h >> np.uint64(29)), begin[some])
                sketch[:, p] = mix(least) & np.uint64(0xFF)
        rows: list[bytes | None] = [None] * (b - a)
        for i, r in zip(some.tolist(), sketch):
            rows[i] = r.tobytes()
        out += rows
    return out


def _alike(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, as a forest, between nodes that stand in a list together and share NEAR_SHARED positional bytes."""
    order = np.argsort(key, kind="stable")
    key, node, sketch = key[order], node[order], sketch[order]
    new = np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(key)))
    end = np.repeat(starts + size, size)
    left, right = [], []
    at = np.flatnonzero(np.repeat(size > 1, size))
    for k in range(1, int(size.max(initial=0))):
        at = at[at + k < end[at]]
        for lo in range(0, len(at), 1 << 16):  # bounded space
            i = at[lo : lo + (1 << 16)]
            shared = (sketch[i] == sketch[i + k]).sum(axis=1)
            ok = (shared >= NEAR_SHARED) & (node[i] != node[i + k])
            left.append(node[i[ok]])
            right.append(node[i[ok] + k])
    none = np.zeros(0, np.uint64)
    return _forest(np.concatenate([none, *left]), np.concatenate([none, *right]))


def near_links(sketched: DataFrame) -> DataFrame:
    """src and dst: links between fingerprints (fp) of texts whose sketches (sketch) are alike."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(NEAR_BANDS - 1)))
    index = sketched.select("fp", "sketch", bands.alias("band"))
    index = index.select("fp", "sketch", F.xxhash64(F.substring("sketch", F.col("band") * NEAR_WIDTH + 1, F.lit(NEAR_WIDTH)), "band").alias("key"))
    index = index.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists come in order; whole ones are linked as they pass, the last one is held back.
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def linked(key, node, sketch) -> pa.RecordBatch:
            a, b = _alike(key, node.view(np.uint64), sketch)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, NEAR_PLACES)
            held.append((batch.column(2).to_numpy(), batch.column(0).to_numpy(), sketch))
            rows += batch.num_rows
            if rows < STREAM // 4:
                continue
            table = tuple(np.concatenate(x) for x in zip(*held))
            cut_ = int(np.searchsorted(table[0], table[0][-1]))
            if cut_:
                yield linked(*(x[:cut_] for x in table))
            held, rows = [tuple(x[cut_:] for x in table)], len(table[0]) - cut_
        if rows:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return index.mapInArrow(run, "src long, dst long")


def _with_sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, txt, fp and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array(sketches_of(batch.column(2)), pa.binary())], names=["key", "txt", "fp", "sketch"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_hash(F.col(f"`{text}`")).alias("txt"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "key long, txt long, fp long, sketch binary")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, whatever its key: the least by key (nulls last), then by the text's hash; columns as in docs.

    Texts are linked as in report, by fingerprints within DISTANCE bits, and also if their sets of
    five-word shingles are alike to about 0.8 or more. 64 bits can't tell the latter (such pairs
    differ in up to 13 of them), so it is read from 64 positional bytes, each the least shingle under
    its own hash, by the same means: an index over bytes by position, and a tally of shared bytes per
    pair that meets.

    Of rows equal in key and text one stays. Rows of one key with unlike texts are in groups of
    their own, and each group keeps its row.
    """
    rows_ = cut(_with_sketches(docs, key, text))
    texts = rows_.groupBy("txt").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    edges = links(texts.select("fp").distinct()).unionAll(near_links(texts.where("sketch is not null")))
    labels = min_label(edges).withColumnsRenamed({"id": "fp", "label": "root"})
    named = rows_.select("key", "txt", "fp").join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "txt")).alias("first"))
    keep = first.select("first.key", "first.txt")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("key"), text_hash(F.col(f"`{text}`")).alias("txt"))
    kept = rows.alias("r").join(keep.alias("k"), F.col("r.key").eqNullSafe(F.col("k.key")) & (F.col("r.txt") == F.col("k.txt")), "left_semi")
    return kept.dropDuplicates(["key", "txt"]).select("row.*")
