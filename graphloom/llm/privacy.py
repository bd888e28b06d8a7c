"""Personal data: base patterns, and spans that a semi-Markov conditional random field adds.

Base spans come from fixed patterns (email, ip, card, phone). The field then reads each stretch of
text around digits, at-signs or bracketed "at" as tokens, scores every candidate segment of at most
MAX_TOKENS tokens by features of the whole span (its shape, digits, check digit, neighbours and the
words before it), and a dynamic program over segment ends chooses boundaries and kinds together.
Its weights are trained here, by maximum conditional likelihood, on generated stretches: base forms,
written-out forms that the patterns miss, and look-alikes (dates, versions, prices, hexadecimal
tokens, order numbers, numbers of a card's length that fail the check digit). Spans of the field that
touch no base span are added. A long stretch is read by windows of tokens that overlap, so space is
bounded whatever its length.

Defined results: null counts as empty; an empty text has no spans; positions are code points, end
exclusive; repeated rows get equal spans; of equally good segmentations the one with fewer spans
counts; a text of any length is read whole, in time in proportion to it; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs from the start of a run of digits find the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[(] ?(?i:at) ?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_a-zA-Z]+|.", re.S)
_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_SPELT = re.compile(r"[\w.%+-]+ ?(?:[\[(] ?at ?[\])]|@| at ) ?[\w-]+(?: ?(?:[\[(] ?dot ?[\])]|\.| dot ) ?[\w-]+)+", re.I)
_QUAD = re.compile(r"(\d{1,3})(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?)(\d{1,3})(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?)(\d{1,3})(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?)(\d{1,3})", re.I)
_DIAL = re.compile(r"(?:\+|00)?\d{0,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}")
_FOURS = re.compile(r"\d{4}([ ./-]?)\d{4}\1\d{4}\1\d{4}")
_DATE = re.compile(r"\d{1,4}([./-])\d{1,2}\1\d{1,4}")
_CUES = (
    re.compile(r"(?:e-?mail|mail|contact|write)\W{0,3}$", re.I),
    re.compile(r"(?:\bip|host|server|address)\W{0,3}$", re.I),
    re.compile(r"(?:card|visa|credit|carte|tarjeta|karte)\W{0,3}$", re.I),
    re.compile(r"(?:phone|tel|call|mobile|fax)\W{0,3}$", re.I),
)
N_FEATURES = 27


def _features(text: str, a: int, b: int, tokens: int) -> list[float]:
    s = text[a:b]
    d = _digits(s)
    n = len(d)
    q = _QUAD.fullmatch(s)
    before, after = text[a - 1 : a], text[b : b + 1]
    cue = text[max(0, a - 16) : a]
    letters = any(c.isalpha() for c in s)
    return [
        1.0, tokens / MAX_TOKENS, n == 0, 0 < n < 7, 7 <= n <= 8, 9 <= n <= 12, n in (13, 14, 15), n == 16, 17 <= n <= 19, n > 19,
        13 <= n <= 19 and not letters and luhn(d), bool(_EMAIL.fullmatch(s)), bool(_SPELT.fullmatch(s)), bool(q) and all(int(x) <= 255 for x in q.groups()), bool(q),
        s[0] == "+", s[0] == "(", bool(_DIAL.fullmatch(s)), bool(_FOURS.fullmatch(s)), bool(_DATE.fullmatch(s)), letters,
        before.isalnum() or before in ("+", "@", "$", "#"), after.isalnum() or after in ("@", "%") or (after in (".", "-", "/") and text[b + 1 : b + 2].isalnum()),
        *[bool(c.search(cue)) for c in _CUES],
    ]


def _lattice(text: str, lo: int, hi: int, edges: list[int] | None = None) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Token bounds of a stretch, its candidate segments as token ranges, and their features."""
    edges = edges or [m.start() for m in _TOKEN.finditer(text, lo, hi)] + [hi]
    n = len(edges) - 1
    segments, rows = [], []
    for i in range(n):
        c = text[edges[i]]
        if not (c.isalnum() or c in "+(_"):
            continue
        some = False
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            last = text[edges[j - 1] : edges[j]]
            some = some or "0" <= last[0] <= "9" or last == "@" or last.lower() == "at"
            if not some or not (last[0].isalnum() or last in ")"):
                continue
            if edges[j] - edges[i] < 7:
                continue
            segments.append((i, j))
            rows.append(_features(text, edges[i], edges[j], j - i))
    return edges, segments, np.array(rows, np.float64).reshape(len(rows), N_FEATURES)


def _decode(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, end token, kind); tokens outside segments score 0."""
    best = np.zeros(n + 1)
    back: list[tuple[int, int] | None] = [None] * (n + 1)
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segments):
        ending.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            kind = int(scores[k].argmax())
            value = best[segments[k][0]] + scores[k, kind]
            if value > best[j]:
                best[j], back[j] = value, (k, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            out.append((*segments[k], kind))
            j = segments[k][0]
    return out[::-1]


def _gradient(n: int, segments, features: np.ndarray, weights: np.ndarray, truth: set[tuple[int, int, int]]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the true segments and its gradient, by forward and backward sums over segment ends."""
    scores = features @ weights
    total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        ending[j].append(k)
        starting[i].append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[k][0]] + total[k] for k in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(total[k] + behind[segments[k][1]] for k in starting[i])])
    value, grad = -ahead[n], np.zeros_like(weights)
    if len(segments):
        i, j = np.array(segments).T
        p = np.exp(ahead[i] + behind[j] - ahead[n])[:, None] * np.exp(scores)
        grad -= features.T @ p
    for k, (i, j) in enumerate(segments):
        for kind in range(len(KINDS)):
            if (i, j, kind) in truth:
                value += scores[k, kind]
                grad[:, kind] += features[k]
    return value, grad


def _sample(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated stretch of text and the spans of personal data in it."""
    word = lambda: "".join(r.choice("etaoinsrhldcumfpgwybvk") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        n = r.choice((13, 14, 15, 16, 16, 16, 16, 16, 19))
        d = num(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, n, 4)) if n == 16 else d

    def entity() -> tuple[int, str]:
        kind = r.randrange(4)
        if kind == 0:
            name, host, top = word() + r.choice(("", ".", "_", "")) + r.choice((word(), num(2))), word() + r.choice(("", num(1))), r.choice(("com", "org", "net", "example.com", "de", "fr"))
            at = r.choice(("@", "@", " (at) ", " [at] ", "(at)", "[at]", " @ "))
            dot = "." if "@" in at or r.random() < 0.3 else r.choice((" (dot) ", " [dot] ", "[dot]", "(dot)"))
            return 0, name + at + host + dot + top.replace(".", dot)
        if kind == 1:
            dot = r.choice((".", ".", ".", "[.]", "(.)", " . ", "[dot]"))
            return 1, dot.join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return 2, card()
        sep = r.choice((" ", "-", "."))
        forms = (f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), "+" + num(2) + sep + num(3) + sep + num(3) + sep + num(3), "00" + num(2) + sep + num(3) + sep + num(4))
        return 3, r.choice(forms)

    def unlucky(n: int) -> str:
        """A number of a card's length that fails the check digit: an order or a serial number."""
        d = num(n - 1)
        d += r.choice([c for c in "0123456789" if not luhn(d + c)])
        sep = r.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, n, 4)) if n == 16 else d

    def other() -> str:
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        return r.choice((
            f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
            f"${num(3)}.{num(2)}", unlucky(16), unlucky(r.choice((13, 14, 15, 16, 19))), f"{num(2)}%", hexa(40), f'token = "{hexa(32)}"', f"#{num(6)}", f"no. {num(8)}", f"ISBN {num(3)}-{num(1)}-{num(4)}", num(4), num(5), f"{r.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", num(24), f"@{word()}", f"{word()}@{word()}", f"{num(2)}:{num(2)}:{num(2)}", word() + num(3), f"{num(3)} {word()} {num(2)}",
        ))

    cue = ("email", "mail:", "ip", "host", "card", "visa", "phone", "tel.", "call", "", "", "", "", "", "", "", "")
    text, spans = word() + " ", []
    for _ in range(r.randint(1, 3)):
        if r.random() < 0.5:
            text += other()
        else:
            kind, s = entity()
            text += (c + " ") if (c := r.choice(cue)) else ""
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        text += r.choice((" ", " ", ". ", ", ", " " + word() + " "))
    return text + word(), spans


@lru_cache(1)
def trained(samples: int = 500, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights by feature and kind, from generated stretches; bounded work, the same every time."""
    r = random.Random(seed)
    data = []
    for _ in range(samples):
        text, spans = _sample(r)
        edges, segments, features = _lattice(text, 0, len(text))
        place = {e: i for i, e in enumerate(edges)}
        truth = {(place[a], place[b], k) for k, a, b in spans if a in place and b in place}
        data.append((len(edges) - 1, segments, features, truth))
    weights, seen = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-6)
    for _ in range(epochs):
        r.shuffle(data)
        for at in range(0, len(data), 10):
            grad = -0.02 * weights
            for n, segments, features, truth in data[at : at + 10]:
                grad += _gradient(n, segments, features, weights, truth)[1]
            seen += grad * grad
            weights += 0.5 * grad / np.sqrt(seen)
    return weights


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of text that the field reads."""
    at = 0
    while m := _HINT.search(text, at):
        # From the start of the word, or of a bounded part of it.
        lo = m.start()
        while lo > at and m.start() - lo < 64 and not text[lo - 1].isspace():
            lo -= 1
        if text[m.start()] in "([" and lo == m.start() and lo > at:
            lo -= 1  # the word before a bracketed "at" that stands apart
            while lo > at and m.start() - lo < 64 and not text[lo - 1].isspace():
                lo -= 1
        end = m.end()
        while True:
            w = _WORD_AFTER.match(text, end)
            if w is None or w.end() == end:
                break
            end = w.end()
        yield lo, end
        at = max(end, m.end())


_WORD_AFTER = re.compile(r"\S{1,200}|[ \t](?=\S{0,64}[0-9@])|[ \t](?=[\[(] ?(?:at|dot) ?[\])])|(?<=[\])])[ \t](?=[A-Za-z])|(?<=\.)[ \t](?=[0-9])|[ \t](?=\. [0-9])", re.I)


#: Tokens of a stretch whose lattice is held at a time. A window is decoded with MARGIN tokens more, and
#: only what starts before its end and is not cut by the margin counts; the next begins where that ended.
WINDOW, MARGIN = 2048, 256


def _windows(text: str, lo: int, hi: int) -> Iterator[list[int]]:
    """Token starts, by windows of a stretch; a closing bound ends each. The caller sends where the next begins."""
    while lo < hi:
        edges = []
        for m in _TOKEN.finditer(text, lo, hi):
            edges.append(m.start())
            if len(edges) > WINDOW + MARGIN:
                break
        else:
            edges.append(hi)
        lo = yield edges


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span, in time and space proportional to the text and its stretches' windows."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    # Base spans of different kinds may overlap; reach[i] is the furthest end of the first i + 1.
    reach = list(accumulate((b for _, b in taken), max))
    out = []
    for lo, hi in stretches(text):
        windows = _windows(text, lo, hi)
        edges = next(windows, None)
        while edges is not None:
            end, whole = edges[-1], edges[-1] == hi
            _, segments, features = _lattice(text, edges[0], end, edges)
            limit = end if whole else edges[WINDOW]
            after = limit
            for i, j, kind in _decode(len(edges) - 1, segments, features @ weights) if segments else ():
                a, b = edges[i], edges[j]
                if a >= limit:
                    break
                after = max(after, b)
                at = bisect_left(starts, b)
                if at == 0 or reach[at - 1] <= a:
                    out.append((kind, a, b))
            if whole:
                break
            try:
                edges = windows.send(after)
            except StopIteration:
                break
    return out


def spans_of(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, weights)


def _form(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans: array of kind, start, end and whether a base pattern found it; one row per row."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, more = spans_of(t, weights)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": x} for (k, a, b), x in sorted([*((s, True) for s in base), *((s, False) for s in more)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "spans"])

    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans (all of them) and n_added."""
    weights = trained()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [[], [], [], []]
            hashes, spans, added = [], [], []
            for t in batch.column(1).to_pylist():
                base, more = spans_of(t, weights)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                hashes.append(hashlib.sha256(_form(base).encode()).hexdigest())
                spans.append(_form(sorted(base + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
