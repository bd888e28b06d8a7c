"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import lines, mixing, privacy, scoring, sentencepiece, simhash, substrings, syncmers, toxicity
from graphloom.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("etaoinsrhldcum") for _ in range(r.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [prose(r, r.randint(5, 120)) for _ in range(30)]
    long = prose(r, 6000)
    out = [None, "", " \t\n ", "one", "The quick", *base, base[0], base[0], base[1] + " tail", base[2].replace(" ", "  ", 3), "\n".join(base[:4]), long]
    out += [base[3] + "\n" + base[5] + "\n" + base[3], "a b c d e " * 30, "é漢😀 " + base[7]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[8], "en", "s1", 3), (None, None, None, None, None)]
    # A clashing extra column must neither break nor change anything.
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("host", F.lit("y")).withColumn("size", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect() if r["doc_id"] is not None}


def test_sentencepiece_matches_library(texts):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=model_path())
    model = sentencepiece.PieceModel(sentencepiece.read_model(model_path()))
    r = random.Random(2)
    odd = ["".join(r.choice("aabcdetlhnoi  ▁.,\n\t0123é😀ß漢字()'\"-<>/²") for _ in range(r.randrange(60))) for _ in range(1500)]
    odd += [" " * n + "x" + " " * n for n in range(40)]
    for t in [*odd, *(t or "" for t in texts)]:
        ids = sp.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == sp.decode(ids), t


def test_sentencepiece_query(docs, empty):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=model_path())
    got = by_id(sentencepiece.digests(docs, model_path()), "n_tokens", "ids_sha256", "decoded_sha256")
    for r in docs.where("doc_id is not null").collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    back = sentencepiece.decode(sentencepiece.encode(docs, model_path(), end=False), model_path())
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert sentencepiece.digests(empty, model_path()).count() == 0


def test_quality_features(docs, empty):
    got = by_id(lines.quality_report(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in docs.where("doc_id is not null").collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)} if len(w) < 2000 else set()
        ln = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ln) - len(set(ln)), len(cover))
        assert got[r["doc_id"]] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert lines.quality_report(empty).count() == 0 and lines.apply_quality(empty).columns == empty.columns


def test_line_rules(spark, empty):
    r = random.Random(1)
    menu = "Home | About | Contact us today please"
    rows = [(i, menu + "\n" + prose(r, 30), "en", "big", 0) for i in range(20)] + [(100 + i, menu + "\n" + prose(r, 30), "en", None, 0) for i in range(2)]
    rows += [(200 + i, "HOME  |  About | contact us today please\nx", "en", "big", 0) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = by_id(lines.line_dedup(df, counts=True), "n_dropped", "text")
    assert all(out[i][0] == 1 and not out[i][1].startswith("Home") for i in range(20))
    assert out[100][0] == 0 and out[200][1] == "x"
    report = by_id(lines.quality_report(df), "kept", "n_removed_lines")
    assert all(report[i] == (True, 1) for i in range(20)) and report[200][0] is False
    kept = by_id(lines.apply_quality(df), "text", "n_chars")
    assert set(kept) == {*range(20), 100, 101} and kept[0][1] == len(kept[0][0])
    assert lines.line_dedup(empty).columns == empty.columns and lines.line_dedup(empty).count() == 0


def test_lines_rare_at_a_large_host_go(spark):
    r = random.Random(6)
    rows = [(i, ("All rights reserved.\n" if i % 50 == 0 else "Seen twice.\n" if i in (1, 2) else "") + prose(r, 30), "en", "large", 0) for i in range(400)]
    out = by_id(lines.line_dedup(spark.createDataFrame(rows, SCHEMA), counts=True), "n_dropped", "text")
    assert all(out[i] == ((1, t.split("\n")[1]) if i % 50 == 0 else (0, t)) for i, t, *_ in rows)


def test_quality_limit_does_not_grow_with_the_host(spark):
    r = random.Random(8)
    rows = [(i, ("All rights reserved.\n" if i % 30 == 0 else "Seen ten times.\n" if i % 40 == 1 else "") + prose(r, 30), "en", "large", 0) for i in range(400)]
    report = by_id(lines.quality_report(spark.createDataFrame(rows, SCHEMA)), "kept", "n_removed_lines", "n_left_words")
    assert all(report[i] == (True, int(i % 30 == 0), len(t.split()) - 3 * (i % 30 == 0)) for i, t, *_ in rows)


def simhash_by_hand(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(sh))


def test_simhash_components(docs, empty):
    rows = docs.collect()
    fps = [simhash_by_hand(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {x: min((r["doc_id"] for r, y in zip(rows, label) if y == x and r["doc_id"] is not None), default=None) for x in set(label)}
    want = sorted((str(r["doc_id"]), format(f, "016x"), least[x]) for r, f, x in zip(rows, fps, label))
    assert sorted((str(r[0]), r[1], r[2]) for r in simhash.report(docs).collect()) == want
    assert simhash.near_dedup(docs).count() <= len(set(label))
    assert simhash.report(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_simhash_index_loses_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    f = np.unique(np.concatenate([base, *[np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 4, replace=False).astype(np.uint64)) for _ in range(400)]) for b in base]]))
    key, triple, fps = [], [], []
    for t, where in enumerate(simhash.TRIPLES):
        m = np.uint64(sum(0xFF << 8 * p for p in where))
        key.append(simhash._packed(f & m, np.full(len(f), t)))
        triple.append(np.full(len(f), t))
        fps.append(f)
    left, right = simhash.links_in(np.concatenate(key), np.concatenate(triple), np.concatenate(fps))
    assert len(left) == len(f) - 4 and len(set(right.tolist())) == 4


@pytest.mark.parametrize("bucket", [8 << 20, 3000])
def test_substrings(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    monkeypatch.setattr(substrings, "PART", 2 * bucket)
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    least = {}
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - 12):
                x = tuple(w[i : i + 13])
                least[x] = min(least.get(x, d), d)
    got = by_id(substrings.deduplicate(docs), "n_words", "n_removed", "kept")
    for d, w in rows:
        if d is None:
            continue
        gone = {i + k for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for k in range(13)}
        assert got[d] == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert substrings.deduplicate(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix_report(docs).collect())
    per = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        per.setdefault(r["host"], [r["source_size"], r["target"], 0])[2] += r["taken"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(p[1] for p in per.values()) - 1.5 * total) < 1e-6 * total
    assert all(p[1] <= 2 * p[0] + 1e-9 and abs(p[2] - p[1]) <= mixing.BLOCK for p in per.values())
    assert mixing.mix_report(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    for n in (1, 2, 30, 97, 1000):
        step = mixing.golden_step(n)
        assert sorted(k * step % n for k in range(n)) == list(range(n))


def test_schedule_is_even(spark):
    per = spark.createDataFrame([("a", 10, 300, 0), ("b", 10, 100, 300), ("c", 5, 200, 400)], "host string, blocks long, draws long, first long")
    rows = sorted((r["slot"], r["host"], r["turn"], r["block"]) for r in mixing.schedule(per).collect())
    assert [r[0] for r in rows] == list(range(600))
    seen = {}
    for slot, host, turn, block in rows:
        assert turn == seen.get(host, 0) and block == turn % {"a": 10, "b": 10, "c": 5}[host]
        seen[host] = turn + 1
        assert all(abs(seen.get(h, 0) - (slot + 1) * d / 600) < 4 for h, d in (("a", 300), ("b", 100), ("c", 200)))


def test_fingerprints(docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = by_id(syncmers.fingerprint_report(rows), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    ids = sorted(text)
    same = {}
    for i, d in enumerate(ids):
        t, nxt = text[d], text[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        assert got[d][:2] == (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
        assert same.setdefault(t, got[d][2]) == got[d][2]
        assert 0 <= got[d][4] <= 1 and 0 <= got[d][5] <= 1
        if len(t) > 300:
            assert got[d][4] > 0.3
    assert syncmers.fingerprint_report(empty).count() == 0


def test_base_spans_by_plain_patterns():
    r = random.Random(8)
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for _ in range(4000):
        t = "".join(r.choice("0123456789.@+- ()ab%é") for _ in range(r.randint(0, 50)))
        want = []
        for k, p in enumerate(pats):
            for m in re.finditer(p, t):
                d = re.sub(r"\D", "", m.group())
                if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                    continue
                if (k == 2 and not (13 <= len(d) <= 19 and privacy.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                    continue
                want.append((k, m.start(), m.end()))
        assert privacy.base_spans(t) == want, t


def test_field_finds_held_out_spans(docs, empty):
    w = privacy.trained()
    r = random.Random(123)
    hit = true = said = 0
    for _ in range(200):
        t, spans = privacy._sample(r)
        edges, segments, features = privacy._lattice(t, 0, len(t))
        got = {(k, edges[i], edges[j]) for i, j, k in privacy._decode(len(edges) - 1, segments, features @ w)}
        hit, true, said = hit + len(got & set(spans)), true + len(spans), said + len(got)
    assert hit / true > 0.93 and hit / said > 0.85
    assert "phone" in [privacy.KINDS[k] for k, _, _ in privacy.added_spans("please call (555) 123-4567 today", [], w)]
    assert privacy.report(docs).count() == docs.count() and privacy.report(empty).count() == 0


def test_field_marginals_by_enumeration():
    text = "call 555-1234567 or x"
    edges, segments, features = privacy._lattice(text, 0, len(text))
    w = np.random.default_rng(0).standard_normal((privacy.N_FEATURES, 4)) * 0.3
    n, scores = len(edges) - 1, features @ w

    def tilings(at):
        if at == n:
            yield 0.0, ()
            return
        yield from tilings(at + 1)
        for k, (i, j) in enumerate(segments):
            if i == at:
                for kind in range(4):
                    for v, rest in tilings(j):
                        yield v + scores[k, kind], ((i, j, kind), *rest)

    every = list(tilings(0))
    best = max(every, key=lambda x: x[0])
    assert tuple(privacy._decode(n, segments, scores)) == best[1]
    value, _ = privacy._gradient(n, segments, features, w, set(best[1]))
    assert abs(value - (best[0] - np.logaddexp.reduce([v for v, _ in every]))) < 1e-9


def test_toxicity_learns(spark, empty):
    r = random.Random(6)
    bad = ["zorgface", "grumblik", "snarfole"]
    texts, y = [], []
    for i in range(500):
        w = prose(r, r.randint(10, 150)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "."]))
        texts.append(" ".join(w))
        y.append(toxic)
    net = toxicity.train(texts[:380], y[:380])
    s, truth = net.scores(pa.array(texts[380:])), np.array(y[380:])
    assert s[truth].mean() > s[~truth].mean() + 0.4
    assert ((s >= toxicity.THRESHOLD) == truth).mean() > 0.9
    odd = net.scores(pa.array([None, "", "  ", "a" * 50_000]))
    assert list(odd[:3]) == [0.0, 0.0, 0.0] and 0 <= odd[3] <= 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.report(empty, none).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "s", 1)], SCHEMA)
    assert toxicity.report(one, none).collect()[0]["score"] == 0.0


def test_toxicity_gradient():
    words = toxicity.Words(*toxicity.raw(pa.array(["hello there world foo", "a bc def ghi jk"])))
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, size, _ = toxicity.windows_of(words.first)
    grid, y = toxicity._grid(words.index, start, size, len(words.word)), np.array([1.0, 0.0])
    g = net.gradient(words, grid, y.astype(np.float32))

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(words), grid))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k in g:
        a = net.p[k]
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        old = a[at]
        a[at] = old + 1e-3
        up = loss()
        a[at] = old - 1e-3
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4 + 0.01 * abs(g[k][at])


def test_scoring(spark, docs, empty):
    got = scoring.score(docs)
    rows = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert rows[0]["n_tokens"] == 0 and rows[0]["log_likelihood"] == 0 and rows[0]["mean_log_likelihood"] is None
    assert rows[5]["log_likelihood"] < 0 and rows[5]["n_tokens"] == len(WORD.findall(docs.where("doc_id = 5").first()["text"]))
    assert scoring.score(empty).count() == 0
    again = {r["doc_id"]: r["log_likelihood"] for r in scoring.score(docs.repartition(3)).collect() if r["doc_id"] is not None}
    assert all(abs(again[d] - rows[d]["log_likelihood"]) < 0.01 for d in again)


def test_every_position_trains_once(spark, monkeypatch):
    texts = ["a b c d e f g", "x", None, " ", "a b c d e f g", "b a " * 40]
    fitted = []
    mean = scoring._mean
    monkeypatch.setattr(scoring, "_mean", lambda states, shards: (fitted.append(sum(r["n"] for r in states.select("n").collect())), mean(states, shards))[1])
    scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(fitted) == scoring.ROUNDS and sum(fitted) == sum(len((t or "").split()) for t in texts)


def test_network_learns_context():
    r = np.random.default_rng(1)
    tokens = np.tile(np.arange(6, dtype=np.int16), 40000)
    first = np.arange(0, len(tokens) + 1, 6 * 20)
    around = scoring._contexts(tokens, first)
    net = scoring.Network()
    before = net.log_probabilities(tokens, around).mean()
    order = r.permutation(len(tokens))
    net.fit(tokens[order], around[:, order])
    assert before < -6 and net.log_probabilities(tokens, around).mean() > -0.5


def test_network_gives_probabilities_over_all_tokens():
    net = scoring.Network(3)
    around = np.array([[3], [scoring.PAD], [4050], [7]], np.int16)
    every = np.arange(scoring.KNOWN + scoring.RARE, dtype=np.int16)
    p = np.exp(net.log_probabilities(every, np.repeat(around, len(every), axis=1)).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-4


def test_scores_by_hand(spark, monkeypatch):
    """The sum over a small corpus, with the network's output taken as given and all counts made anew."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    # More words than the network knows, so that some are rare.
    many = [f"m{i}" for i in range(5000) for _ in range(1 + i % 3)]
    r.shuffle(many)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(many[i : i + 400]) for i in range(0, len(many), 400)]
    texts += [texts[0], texts[1], " ".join(f"odd{i}" for i in range(50)), " ".join(f"odd{i}" for i in range(50)), "", None]
    monkeypatch.setattr(scoring, "BUCKET", 20000)
    monkeypatch.setattr(scoring, "PART", 30000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nets = []
    train = scoring.train
    monkeypatch.setattr(scoring, "train", lambda *a: nets.append((a[1], train(*a))) or nets[-1][1])
    got = by_id(scoring.score(df), "n_tokens", "log_likelihood")
    vocab, net = nets[0]
    split = [(t or "").split() for t in texts]
    count, around_count, triple = {}, {}, {}
    for w in split:
        for i, x in enumerate(w):
            count[x] = count.get(x, 0) + 1
            if 0 < i < len(w) - 1:
                around_count[w[i - 1], w[i + 1]] = around_count.get((w[i - 1], w[i + 1]), 0) + 1
                triple[w[i - 1], x, w[i + 1]] = triple.get((w[i - 1], x, w[i + 1]), 0) + 1
    hashed = lambda w: scoring.hashed_words(pa.array([" ".join(w)]))[0]
    mass = {}
    for x, n in count.items():
        t = int(vocab.tokens(hashed([x]))[0])
        mass[t] = mass.get(t, 0) + n
    remembered = rare = 0
    for d, w in enumerate(split):
        if not w:
            assert got[d] == (0, 0.0)
            continue
        h = hashed(w)
        tokens = vocab.tokens(h)
        value = net.log_probabilities(tokens, scoring._contexts(tokens, np.array([0, len(w)]))).astype(float)
        chosen = set(scoring.memory_keys(h, np.array([0, len(w)]))[0].tolist())
        total = 0.0
        for i, x in enumerate(w):
            v = value[i]
            if tokens[i] >= scoring.KNOWN:
                v += np.log(count[x] / mass[int(tokens[i])])
            if i in chosen and (n := around_count[w[i - 1], w[i + 1]] - 1) > 0:
                a = n / (n + scoring.DOUBT)
                v = np.log((1 - a) * np.exp(v) + a * (triple[w[i - 1], x, w[i + 1]] - 1) / n)
                remembered += 1
            total += v
            rare += int(tokens[i] >= scoring.KNOWN)
        assert got[d][0] == len(w) and abs(got[d][1] - total) < 0.01 + 1e-5 * abs(total), (d, got[d], total)
    assert remembered > 10 and rare > 100


def test_every_context_is_remembered(spark, monkeypatch):
    """Each inner position is judged by all other occurrences of its context, none of which is left out."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(12)}" for _ in range(r.randint(1, 30))) for _ in range(80)]
    monkeypatch.setattr(scoring, "BUCKET", 500)
    monkeypatch.setattr(scoring, "PART", 700)
    nets, train = [], scoring.train
    monkeypatch.setattr(scoring, "train", lambda *a: nets.append((a[1], train(*a))) or nets[-1][1])
    got = by_id(scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)), "log_likelihood")
    context, triple = {}, {}
    for w in map(str.split, texts):
        for x, y, z in zip(w, w[1:], w[2:]):
            context[x, z] = context.get((x, z), 0) + 1
            triple[x, y, z] = triple.get((x, y, z), 0) + 1
    for d, w in enumerate(map(str.split, texts)):
        tokens = nets[0][0].tokens(scoring.hashed_words(pa.array([texts[d]]))[0])
        value = nets[0][1].log_probabilities(tokens, scoring._contexts(tokens, np.array([0, len(w)]))).astype(float)
        for i, (x, y, z) in enumerate(zip(w, w[1:], w[2:]), 1):
            if n := context[x, z] - 1:
                a = n / (n + scoring.DOUBT)
                value[i] = np.log((1 - a) * np.exp(value[i]) + a * (triple[x, y, z] - 1) / n)
        assert abs(got[d][0] - value.sum()) < 0.01, (d, got[d], value.sum())


@pytest.mark.parametrize("bits", [30, 64])
def test_counts_come_back_to_every_bucket(bits):
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**64, 300, np.uint64) >> np.uint64(64 - bits)
    sent, told, tables = {}, {b: [] for b in range(4)}, []
    for b in range(4):
        entries = scoring.Entries(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int16), bits)
        tables.append((keys[r.integers(0, 300, 500)], r.choice(np.array([0, 7, 5000, (1 << scoring.CODE) - 1], np.uint64), 500)))
        entries.keys, entries.codes, entries.n, at = scoring._distinct(*tables[b])
        assert (entries.keys[at] == tables[b][0]).all() and (entries.codes[at] == tables[b][1]).all()
        for part, blob in scoring._pieces(entries, bits, 5):
            sent.setdefault(part, []).append((b, blob))
        tables[b] = (entries, *tables[b])
    assert sorted(sent) == list(range(5))
    for part in sorted(sent):
        for (b, _), blob in zip(sent[part], scoring._totals([x for _, x in sent[part]]), strict=True):
            told[b].append(scoring._unpack(blob, 2))
    every, code = (np.concatenate([t[i] for t in tables]) for i in (1, 2))
    for b in range(4):
        of_key, of_entry = (np.concatenate(x) for x in zip(*told[b]))
        for k, c, m, n in zip(tables[b][0].keys, tables[b][0].codes, of_key, of_entry, strict=True):
            assert m == (every == k).sum() and n == ((every == k) & (code == c)).sum()


CLASHES = ["key", "row", "doc", "txt", "fp", "root", "host", "size", "at", "copy", "now", "whole", "rest", "first", "_row", "_k", "_t", "_c", "_h", "_n", "_q", "_m", "_key", "_fp", "_root", "_encoded", "_host", "_txt", "_number", "_clean", "_src", "gone", "block", "bucket", "part", "source_size", "target", "taken"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Clashing ids, no ids, no texts, repeated rows, and every internal name as a column."""
    r = random.Random(21)
    rows = [(i % 5 if i % 3 else None, prose(r, 30 + i), None if i % 4 == 0 else f"s{i % 2}", i) for i in range(15)]
    rows += [rows[0], rows[1], (1, None, None, 90), (None, "", "s1", 91), (None, None, None, 92)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)]).cache()


def test_near_dedup_keeps_a_row_of_every_group(awkward):
    out = simhash.near_dedup(awkward)
    assert out.columns == awkward.columns
    rows = awkward.collect()
    texts = sorted({r["text"] or "" for r in rows})
    assert sorted(r["text"] or "" for r in out.collect()) == texts  # unlike texts, so each is a group
    assert set(map(tuple, out.collect())) <= set(map(tuple, rows))


def test_near_dedup_links_what_is_alike(spark):
    """Of texts whose five-word sets are alike to 0.85 or more one stays; those below 0.6 all stay."""
    r = random.Random(77)
    rows, groups = [], {}
    for g in range(12):
        base = [prose(r, 1) + str(i) for i in range(300)]
        for k in range(4):
            w = list(base)
            for place in r.sample(range(20, 280), 2 if g < 8 else 60):
                w[place] = f"new{g}x{k}x{place}"
            groups[len(rows)] = g if g < 8 else (g, k)
            rows.append((len(rows), " ".join(w)))

    def alike(a, b):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(296)} for t in (a, b))
        return len(a & b) / len(a | b)

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            assert (alike(a, b) > 0.85) == (groups[i] == groups[j]) and not 0.6 < alike(a, b) < 0.85
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(first.values())


def test_mix_takes_every_row_with_its_own_text(awkward):
    out = mixing.apply_mix(awkward)
    assert out.columns == awkward.columns
    want, got = {}, {}
    for r in awkward.collect():
        want.setdefault(r["tag"], [r["doc_id"], r["source"], (r["text"] or "").split(), 0])[3] += 1
    for r in out.collect():
        key, source, words, _ = want[r["tag"]]
        mine = r["text"].split()
        assert (r["doc_id"], r["source"]) == (key, source) and mine == words[: len(mine)]
        got[r["tag"]] = got.get(r["tag"], 0) + len(mine)
    rep = mixing.mix_report(awkward)
    assert sum(got.values()) == sum(r["taken"] for r in rep.collect())
    assert all(n <= 2 * len(want[t][2]) * want[t][3] for t, n in got.items())
    assert all(lines.apply_quality(awkward).columns == awkward.columns == f.columns for f in (lines.line_dedup(awkward),))
    assert lines.line_dedup(awkward).count() == awkward.count()


def test_reports_count_every_row(awkward):
    """No row is lost or doubled where ids clash or are missing."""
    n = awkward.count()
    for report in (simhash.report, substrings.deduplicate, syncmers.fingerprint_report, privacy.report, scoring.score, mixing.mix_report, lines.quality_report):
        assert report(awkward).count() == n, report
    texts = sorted((r["text"] or "").split() for r in awkward.collect())
    assert sorted(r["n_words"] for r in substrings.deduplicate(awkward).collect()) == sorted(map(len, texts))
    assert sentencepiece.digests(awkward, model_path()).count() == n


def test_field_on_long_texts():
    import time

    w = privacy.trained()
    mixed = lambda n: " ".join(f"mail a{i}@b{i}.com or call (555) 123-{i % 9000 + 1000}," for i in range(n))
    took = []
    for n in (500, 4000):
        text = mixed(n)
        began = time.time()
        base, more = privacy.spans_of(text, w)
        took.append(time.time() - began)
        spans = sorted((a, b) for _, a, b in base + more)
        assert len(base) == n and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert took[1] < 20 * took[0] + 1
    numbers = "5551234567 " * 3000
    found = privacy.added_spans(numbers, [], w)
    assert all(text_ok for text_ok in (numbers[a:b].strip() for _, a, b in found))


def test_a_number_that_fails_the_check_digit_is_no_card():
    w = privacy.trained()
    r = random.Random(31)
    said = 0
    for _ in range(200):
        d = "".join(r.choice("0123456789") for _ in range(15))
        d += next(c for c in "0123456789" if not privacy.luhn(d + c))
        said += any(k == 2 for k, _, _ in privacy.added_spans(f"order {d} was sent", [], w))
    assert said < 20


def fingerprint_by_hand(words, hashes, pair):
    """Slots to (anchor, first place), from hashes of words and a hash of two numbers."""
    k, s = syncmers.K, syncmers.S
    out = {}
    for i in range(len(words) - k + 1):
        runs = [pair(hashes[j], hashes[j + 1]) for j in range(i, i + k - s + 1)]
        if runs[1] < runs[0] and runs[1] < runs[2]:
            continue
        h = pair(runs[0], runs[2]) & ~0xFFFFFF
        slot = (h & (1 << 64) - 1) >> 58
        best = out.get(slot)
        if best is None or (h, i) < best:
            out[slot] = (h, i)
    return out


def test_fingerprints_by_hand(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    near = by_id(syncmers.fingerprint_report(docs.where("doc_id is not null").dropDuplicates(["doc_id"])), "near_edited", "near_next")
    some = [r for r in rows if len(r["text"].split()) >= syncmers.K][:12]
    prints = {}
    for r in some:
        w = WORD.findall(r["text"])
        h = [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(w)], "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").select("h").collect()]
        table = {}
        pairs = {(h[j], h[j + 1]) for j in range(len(h) - 1)}
        got = spark.createDataFrame(sorted(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
        table.update({(x["a"], x["b"]): x["h"] for x in got})
        runs = [table[h[j], h[j + 1]] for j in range(len(h) - 1)]
        more = {(runs[i], runs[i + 2]) for i in range(len(runs) - 2)}
        got = spark.createDataFrame(sorted(more), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
        table.update({(x["a"], x["b"]): x["h"] for x in got})
        prints[r["doc_id"]] = fingerprint_by_hand(w, h, lambda a, b: table[a, b])
    form = by_id(syncmers.fingerprint_report(docs.where("doc_id is not null").dropDuplicates(["doc_id"])), "fingerprint")
    for d, p in prints.items():
        want = sorted(format(h & (1 << 64) - 1 | i, "016x") for h, i in p.values())
        have = form[d][0]
        assert sorted(re.findall("[0-9a-f]{16}", have)) == want, d
    for x, y in zip(some, some[1:]):
        if rows.index(y) == rows.index(x) + 1:
            a, b = prints[x["doc_id"]], prints[y["doc_id"]]
            second = dict(b.values())
            shared = sorted(second[h] - i for h, i in a.values() if h in second)
            middle = shared[(len(shared) - 1) // 2] if shared else 0
            want = sum(abs(o - middle) <= syncmers.DRIFT for o in shared) / len(set(a) | set(b))
            assert abs(near[x["doc_id"]][1] - want) < 1e-9


def test_toxicity_report_with_both_classes(spark):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(240):
        w = prose(r, 25).split()
        if i % 2:
            w[3:3] = ["grumblik", "snarfole", "zorgface"]
        rows.append((i, " ".join(w)))
        marks.append((i, 1, i % 2))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.report(d, m).collect()
    import zlib

    assert len(got) == 240 and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in held) > 0.8 * len(held)
    assert all(x["predicted"] == int(x["score"] >= 0.3) and 0 <= x["score"] <= 1 for x in got)


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(12)
    base = [prose(r, r.randint(40, 200)) for _ in range(24)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*base, base[0], base[1], "short one", None, base[4] + " x"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        kept.append(sorted(x["doc_id"] for x in docs.select("doc_id").collect()))
    assert kept[0] == kept[1] == [*range(26), 28]
    # 28 is 4 with a word more, so it is a near copy by its five-word sets.
    assert kept[2] == [*range(24)]
    assert kept[3] == kept[4]
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=model_path())
    want = sorted((x["doc_id"], sp.encode(x["text"], add_eos=True)) for x in spark.read.parquet(f"{tmp_path}/3").collect())
    assert sorted((x["doc_id"], list(x["token_ids"])) for x in docs.collect()) == want
