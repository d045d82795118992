"""Language model and toxicity classifier."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from veritrail.llm import language_model as L
from veritrail.llm import toxicity as T

DOCS = "doc_id long, text string, label string, score double, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in rows], DOCS)


def kneser_ney(train, scored, order):
    """Interpolated modified Kneser-Ney on strings, and the add-0.1 unigram."""
    split = lambda t: (t or "").encode().lower().split() + ["</s>"]
    c, grams = Counter(), {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = ["<s>", *split(t)]
        c.update(w[1:])
        for i in range(1, len(w)):
            for k in range(2, order + 1):
                if i - k + 1 >= 0 and (k == order or i - k + 1 == 0):
                    grams[k][tuple(w[i - k + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for g in grams[k]:
            grams[k - 1][g[1:]] += 1
    n, v = sum(c.values()), len(c)

    def discounts(values):
        m = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        if min(m[:3]) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = m[0] / (m[0] + 2 * m[1])
        return [0] + [min(max(k - (k + 1) * y * m[k] / m[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d = {k: discounts(x.values()) for k, x in grams.items()}
    follow = {k: defaultdict(list) for k in grams}
    for k, x in grams.items():
        for g, count in x.items():
            follow[k][g[:-1]].append(count)
    t = sum(grams[1].values())
    rest = sum(d[1][min(x, 3)] for x in grams[1].values()) / t if t else 1.0

    def p(word, before, k):
        if k == 1:
            x = grams[1][(word,)]
            return (max(x - d[1][min(x, 3)], 0) / t if t else 0) + rest / (v + 1)
        low = p(word, before, k - 1)
        context = tuple(before[-(k - 1) :])
        if len(context) < k - 1 or context not in follow[k]:
            return low
        counts, x = follow[k][context], grams[k][(*context, word)]
        return max(x - d[k][min(x, 3)], 0) / sum(counts) + sum(d[k][min(y, 3)] for y in counts) / sum(counts) * low

    out = {}
    for i, text in scored:
        w = ["<s>", *split(text)]
        s = sum(math.log10(p(w[j], w[max(0, j - order + 1) : j], order)) for j in range(1, len(w)))
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
        out[i] = (len(w) - 1, sum(c[x] > 0 for x in w[1:]), base, s)
    return n, out


@pytest.mark.parametrize(("order", "block", "limit"), [(2, 3 << 20, 0xFFFFFFFF), (2, 50, 3), (3, 3 << 20, 2), (3, 40, 0xFFFFFFFF), (4, 33, 5)])
def test_kneser_ney(spark, monkeypatch, order, block, limit):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L.HashArrays, "LIMIT", limit)
    monkeypatch.setattr(L, "bits_for", lambda rows, _: 4)
    rng = random.Random(4)
    words = ["The", "the", "of", "é", "x."] + [f"w{k}" for k in range(25)]
    train = [(k, " ".join(rng.choice(words[: 5 + rng.randrange(25)]) for _ in range(rng.randrange(40)))) for k in range(60)] + [(99, None), (98, ""), (97, " \n"), (96, "of the " * 200)]
    scored = [*train[:20], (200, "never seen the words"), (201, None), (202, "the " * 500)]
    n, want = kneser_ney([t for _, t in train], scored, order)
    model = L.train(docs(spark, train), order=order)
    assert model.tokens == n
    for r in L.score(docs(spark, scored), model).collect():
        m, known, base, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (m, known) and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, s, rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-s / m), rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(spark, order):
    """Over the known words and one unknown, after any words."""
    import numpy as np

    model = L.train(docs(spark, [(1, "a b a c a b d"), (2, "b a"), (3, "e e e f")]), order=order)
    h = lambda w: L.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), L.SPACED)[0][0]
    for context in ("a", "b", "e", "zzz", "a b", "e e", "zzz a"):
        total = 0.0
        for w in [*map(h, "abcdef"), L.END, h("unknown")]:
            row = np.array([L.START, *map(h, context.split()), w], np.uint64)
            total += 10 ** model.score(row, np.array([0, len(row)]))[0][-1]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_counts_of_any_size(tmp_path, monkeypatch):
    import numpy as np

    arrays = L.HashArrays(f"file://{tmp_path}", "x", 0, {"n": "<u4", "m": "<u4"})
    n = np.array([1, 2**32 - 2, 2**32 - 1, 2**40], np.uint64)
    arrays.write(0, np.array([3, 4, 5, 6], np.uint64), {"n": n, "m": n[::-1].copy()})
    _, got = arrays.lookup(np.array([3, 4, 5, 6, 7], np.uint64))
    assert got["n"].tolist() == [*n.tolist(), 0] and got["m"].tolist() == [*n.tolist()[::-1], 0]


def test_model_of_nothing(spark):
    model = L.train(docs(spark, []))
    (r,) = L.score(docs(spark, [(1, "a")]), model).collect()
    assert model.tokens == 0 and r.n_known == 0 and r.score == 0.0
    assert L.score(docs(spark, []), model).count() == 0


def test_held_out_rows_are_not_learned(spark, monkeypatch):
    rows = [(i, f"own{i} shared") for i in range(200)]
    with monkeypatch.context() as m:
        m.setattr(type(spark), "read", property(lambda _: type("R", (), {"parquet": lambda *_: docs(spark, rows)})()))
        got = {r.doc_id: r for r in L.op2_lm_scoring(spark, "x").collect()}
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0}
    assert held and {i for i, r in got.items() if r.held_out} == held
    assert all(r.n_known == (2 if i in held else 3) and r.train_tokens == 3 * (200 - len(held)) for i, r in got.items())


def test_toxicity_generalises(spark):
    rng = random.Random(6)
    bad = ["scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(1500):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 60))]
        y = i % 8 == 0
        if y:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(y if rng.random() > 0.02 else not y), 1))
    rows += [(5000, None), (5001, ""), (5002, "word " * 20000 + "scum"), (5003, "word " * 20000), (None, "you moron")]
    labels += [(None, 1, 1), (5003, None, 1), (4, 1, 0)]
    got = {r.doc_id: r for r in T.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(1500))
    truth = [i % 8 == 0 for i in held]
    right = sum(got[i].predicted == t for i, t in zip(held, truth, strict=True))
    assert right / len(held) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and got[5002].predicted == 1 and got[5003].predicted == 0 and got[None].predicted == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.toxicity(docs(spark, [(1, "x")]), none).collect()] == [0.5]
    assert T.toxicity(docs(spark, []), none).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "TRAIN_ROWS", 50)
    rows = [(i, "a b c" if i % 2 else "bad d") for i in range(1000)]
    model = T.train(docs(spark, rows).select("doc_id", "text"), spark.createDataFrame([(i, 1 - i % 2) for i in range(1000)], "doc_id long, label int"))
    s = {r.doc_id: r.score for r in T.score(docs(spark, rows), model).collect()}
    assert s[0] > 0.7 > 0.3 > s[1]


def scalar_ftrl(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal of the paper, a coordinate at a time on plain numbers. The coordinate None is the bias, without penalties of L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        lam = 0.0 if i is None else l1
        if abs(z[i]) <= lam:
            return 0.0
        return -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in [*x, None]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_ftrl_by_the_paper(monkeypatch):
    import numpy as np

    monkeypatch.setattr(T, "L1", 0.7)
    rng = random.Random(8)
    rows = [(sorted(rng.sample(range(40), rng.randrange(0, 9))), int(rng.random() < 0.4)) for _ in range(120)]
    model = T.Ftrl(40)
    for _ in range(3):
        for x, y in rows:
            model.learn(np.array([*x, 40]), y)
    want = scalar_ftrl(rows, 3, T.ALPHA, T.BETA, 0.7, T.L2)
    got = model.weights(np.arange(41))
    assert all(math.isclose(got[40 if i is None else i], w, rel_tol=1e-9, abs_tol=1e-12) for i, w in want.items())
    assert sum(w == 0 for w in got) >= 3 and len(want) == 41


def test_scores_by_brute_force(spark):
    """The whole operator on strings' feature numbers: learned in its order of rows, scored on sets."""
    import numpy as np

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "bad", "so", "Very", "é"]) for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(3, "bad bad again"), (None, "bad so")]
    labels = [(i, int("bad" in t), 0) for i, t in rows if i is not None]
    got = T.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), carry="text").collect()

    def features(t):
        w = t.lower().split()
        grams = [(x,) for x in w] + [(a, 1, b) for a, b in zip(w, w[1:], strict=False)] + [(a, 2, b) for a, b in zip(w, w[2:], strict=False)]
        return set(grams)

    learned = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    order = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in range(80)], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}

    def numbers(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return sorted(set(T.features(raw, np.array([0, len(raw)]))[0].tolist()))

    label = {i: y for i, y, _ in labels}
    for i, y, _ in labels:
        label[i] = max(label[i], y)
    learned.sort(key=lambda r: (order[r[0]], r[0], numbers(r[1])))
    weights = scalar_ftrl([(features(t), label[i]) for i, t in learned], T.EPOCHS, T.ALPHA, T.BETA, T.L1, T.L2)
    for r in got:
        s = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in [*features(r.text), None])))
        assert math.isclose(r.score, s, rel_tol=1e-9), r
    assert any(w for f, w in weights.items() if f is not None)
