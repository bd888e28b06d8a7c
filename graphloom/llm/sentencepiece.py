"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The model file is parsed here; only its vocabulary is used. A text is encoded with one
Aho-Corasick pass that gives the longest piece starting at every position, then greedy
longest-first with backtracking: a piece may follow another only if merging the two pieces'
characters again, by score, ends in exactly these two; positions from which no completion exists
are kept in a bitfield, so no position is tried twice. The result is the one that merging the
whole text by score gives, as each adjacent pair is a fixed point of the merges.

Defined results: null text counts as empty; an empty text has no pieces (with an end id: only
that); a character outside the vocabulary becomes its UTF-8 byte pieces, or the unknown id if the
model has none. Very long texts are encoded segment by segment in linear space; repeated rows get
equal ids; ties between merges of equal score go to the leftmost; an empty table gives an empty
result; extra columns, whatever their names, are carried but not read.
"""

import heapq
import re
import string
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex

SPACE = "▁"
LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and raw value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """Vocabulary, encoder and decoder of a merge-type model with an identity normaliser."""

    def __init__(self, data: bytes, cache_entries: int = 200_000):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.add_dummy_prefix = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a merge-type (BPE) model")
            elif number == 3:
                norm = dict(_fields(value))
                self.add_dummy_prefix = bool(norm.get(3, 1))
                if norm.get(1, b"identity") != b"identity" or norm.get(4, 1):
                    raise ValueError("only identity normalisation that keeps blanks is supported")
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER, UNUSED)}
        self.score = {p: self.scores[i] for p, i in self.id.items()}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.end = next((i for i, p in enumerate(self.pieces) if p == "</s>"), None)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.plain = {i for i, k in enumerate(self.kinds) if k in (NORMAL, USER, UNUSED)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        # Characters of longer pieces that are no pieces themselves still take part in merges; they
        # get symbol numbers after the vocabulary's.
        self.symbols = list(self.pieces)
        self.single = {c for p in self.id for c in p}
        self.symbol = dict(self.id)
        for c in sorted(self.single - set(self.id)):
            self.symbol[c] = len(self.symbols)
            self.symbols.append(c)
        self.whole = len(self.symbols) == len(self.pieces)
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.reach = [len(p) - 1 for p in self.symbols]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.symbol.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        # A run of blank marks starts a segment, as no piece has a mark after another character.
        self.by_segment = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        # Blank runs are merged after all else only if their pieces have the lowest scores.
        runs = [s for p, s in self.score.items() if set(p) == {SPACE} and len(p) > 1]
        rest = [s for p, s in self.score.items() if set(p) != {SPACE} and len(p) > 1]
        mixed = any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id)
        self.runs_last = self.by_segment and not mixed and (not runs or max(runs) < min(rest, default=0.0))
        within = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        lone = "".join(c for c in "\n\r\t" if all(c not in p for p in self.id if len(p) > 1))
        out = f"[^{SPACE}{lone}]" if lone else f"[^{SPACE}]"
        # A segment also ends between a Latin letter and a mark that no piece has after a letter.
        marks = set(string.punctuation) - {x[1] for x in within if re.match(LATIN, x[0])}
        q, alone = re.escape("".join(sorted(marks))), "|".join(map(re.escape, lone))
        body = rf"{SPACE}*(?:{out}*?{LATIN}(?=[{q}])|{out}+)|{SPACE}+" if q else f"{SPACE}*{out}+|{SPACE}+"
        self.splitter = re.compile(f"{body}|{alone}" if alone else body)
        self._pair: dict[int, bool] = {}
        self._prefix: dict[int, int] = {}
        self._alone: dict[int, bool] = {}
        self._young: dict[str, tuple[str, int, str]] = {}
        self._old: dict[str, tuple[str, int, str]] = {}
        self._entries = cache_entries

    def merge(self, text: str) -> list[str]:
        """The symbols left when the best-scored adjacent pair is merged until none is a piece."""
        n = len(text)
        parts: list[str] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' characters again ends in exactly these two."""
        if len(self._pair) > 400_000:
            self._pair.clear()
        x, y = self.symbols[a], self.symbols[b]
        known = self._pair[a * len(self.symbols) + b] = self.merge(x + y) == [x, y]
        return known

    def _stands(self, a: int) -> bool:
        known = self._alone.get(a)
        if known is None:
            known = self._alone[a] = self.merge(self.symbols[a]) == [self.symbols[a]]
        return known

    def _shorter(self, a: int) -> int:
        """The longest piece that is a proper prefix; -1 if there is none."""
        if a not in self._prefix:
            p = self.symbols[a]
            self._prefix[a] = next((self.symbol[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.symbol), -1)
        return self._prefix[a]

    def backtrack(self, text: str) -> list[int]:
        """The ids of text, whose blanks are marks; characters that no piece has stand alone."""
        longest = [-1] * len(text)
        reach = self.reach
        for end, v in self.automaton.iter(text):
            longest[end - reach[v]] = v  # ends ascend, so the last one is the longest
        if -1 not in longest:
            out = self._tile(text, longest)
            if self.whole or max(out) < len(self.pieces):
                return out
            return [i for v in out for i in ([v] if v < len(self.pieces) else self._bytes(self.symbols[v]))]
        out = []
        for known, part in groupby(text, key=self.single.__contains__):
            out += self.backtrack("".join(part)) if known else [i for c in part for i in self._bytes(c)]
        return out

    def _bytes(self, character: str) -> list[int]:
        return [self.byte[b] for b in character.encode("utf-8")] if self.byte else [self.unknown]

    def _tile(self, text: str, longest: list[int]) -> list[int]:
        n, at, out = len(text), 0, []
        failed: bytearray | None = None
        pairs, reach, width = self._pair, self.reach, len(self.symbols)
        piece, last = longest[0], -1
        while True:
            end = at + reach[piece] + 1
            if failed is None or not failed[end]:
                if last < 0:
                    fits = self._stands(piece)
                else:
                    fits = pairs.get(last * width + piece)
                    if fits is None:
                        fits = self._fits(last, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = self._shorter(piece)
            if piece >= 0:
                continue
            if not out:
                return [self.symbol[p] for p in self.merge(text)]  # no tiling; not met while pieces stand
            if failed is None:
                failed = bytearray(n + 1)
            failed[at] = 1
            piece = out.pop()
            at -= reach[piece] + 1
            last = out[-1] if out else -1

    def _run(self, marks: int) -> list[int]:
        """The ids of a run of marks alone; their pieces may tie, so they are merged, leftmost first."""
        return [i for p in self.merge(SPACE * marks) for i in ([self.id[p]] if p in self.id else self._bytes(p))]

    def _ids(self, segment: str) -> list[int]:
        if not segment.startswith(SPACE * 2) or not self.runs_last:
            return self.backtrack(segment)
        marks = len(segment) - len(segment.lstrip(SPACE))
        if marks == len(segment):
            return self._run(marks)
        rest = self.backtrack(segment[marks - 1 :])
        if rest[0] == self.id.get(SPACE):
            return self._run(marks) + rest[1:]
        return self._run(marks - 1) + rest

    def segments(self, text: str) -> list[str]:
        """Parts of the normalised text that no piece crosses."""
        if not text:
            return []
        marked = (SPACE if self.add_dummy_prefix else "") + text.replace(" ", SPACE)
        return self.splitter.findall(marked) if self.by_segment else [marked]

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of text, without an end id."""
        return [int(i) for s in self.segments(text or "") for i in self._cached(s)[0].split(" ")]

    def _cached(self, segment: str) -> tuple[str, int, str]:
        """Ids as decimal text, their number, and the segment's surface. Two generations bound the cache."""
        found = self._young.get(segment)
        if found is None:
            found = self._old.get(segment)
            if found is None:
                ids = self._ids(segment)
                # Vocabulary pieces that tile a segment spell it; byte pieces are put together again.
                surface = segment if self.plain.issuperset(ids) else self._surface(ids)
                found = (" ".join([self.decimal[i] for i in ids]), len(ids), surface)
            if len(segment) <= 64:
                if len(self._young) >= self._entries:
                    self._old, self._young = self._young, {}
                self._young[segment] = found
        return found

    def _surface(self, ids: list[int]) -> str:
        """What ids stand for, blanks as marks."""
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids])
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()

        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            flush()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become blanks, the leading one goes, byte runs become characters."""
        shown = [i for i in ids if self.kinds[i] != CONTROL]
        text = self._surface(ids).replace(SPACE, " ")
        if self.add_dummy_prefix and shown and self.pieces[shown[0]].startswith(SPACE) and self.kinds[shown[0]] != BYTE:
            return text[1:]
        return text

    def found(self, text: str | None, end: bool = True) -> tuple[str, int, str]:
        """The ids as decimal text, their number, and the text that they decode to."""
        young = self._young
        segments = self.segments(text or "")
        shards = [young.get(s) for s in segments]
        if None in shards:
            shards = [x or self._cached(s) for x, s in zip(shards, segments)]
        ids = [s[0] for s in shards]
        n = sum([s[1] for s in shards])
        if end:
            ids.append(self.decimal[self.end])
            n += 1
        decoded = "".join([s[2] for s in shards]).replace(SPACE, " ")
        if shards and self.add_dummy_prefix:
            decoded = decoded[1:]  # the first piece holds the prefix that was added
        return " ".join(ids), n, decoded

    def digest(self, text: str | None, end: bool = True) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of what they decode to."""
        ids, n, decoded = self.found(text, end)
        return n, sha256_hex(ids), sha256_hex(decoded)


_models: dict[str, PieceModel] = {}


def _load(key: str, data: bytes) -> PieceModel:
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text: str = "text", end: bool = True, ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with an array column of ids; every other column stays as it is.

    With decoded, a column of that name gets the SHA-256 of the text that the ids decode to. A
    column of either name that docs already has is replaced. The model file is of fixed size and
    is read once, on the driver.
    """
    blob = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(column: pa.Array) -> pa.Array:
        model = _load(model_path, blob.value)
        parts, counts, hashes = [], [], []
        for a in range(0, len(column), 500):
            shown = [model.found(t, end) for t in column.slice(a, 500).to_pylist()]
            parts.append(np.fromstring(" ".join(x for x, _, _ in shown if x), np.int32, sep=" ") if any(n for _, n, _ in shown) else np.zeros(0, np.int32))
            counts += [n for _, n, _ in shown]
            hashes += [sha256_hex(x) for _, _, x in shown] if decoded else [None] * len(shown)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(hashes, pa.string())], names=["ids", "decoded"])

    made = F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(F.col(f"`{text}`"))
    # The columns of docs go into one struct, so that no name of theirs can clash.
    done = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), made.alias("made"))
    new = {ids: F.col("made.ids"), **({decoded: F.col("made.decoded")} if decoded else {})}
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    return done.select(*kept, *[c.alias(n) for n, c in new.items()])


def decode(docs: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with the text that a column of id arrays stands for; null ids give an empty text."""
    blob = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(model_path, blob.value)
        for s in batches:
            yield s.map(lambda x: "" if x is None else model.decode([int(i) for i in x])).astype(object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document (end id included)."""
    blob = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(model_path, blob.value)
        for batch in batches:
            rows = [model.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
