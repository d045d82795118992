"""Near duplicates, repeated lines and benchmark passages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from veritrail import store
from veritrail.store import scratch
from veritrail.llm import decontamination, line_dedup, near_dedup, shared

DOCS = "doc_id long, text string, bucket string, n_hit long, shingles string"  # names that operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", -1, "y") for i, t in rows], DOCS)


def components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " \n ", "one two", "One  TWO", "one two three", "same text of six words here"] + ["same text of six words here"] * 5
    for edits in (0, 2, 6, 12):
        texts += family(rng, 25, 60, edits)
    chain = [f"c{k}" for k in range(100)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 40, 4)]  # a chain: only neighbours are alike
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows) - 50
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LED", 4)
    monkeypatch.setattr(store, "MOST_BROADCAST", -1)
    again = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert again == {i: c for i, (_, c) in want.items()}


def test_cells_meet_every_pair_of_components_once(spark, monkeypatch):
    """Of a bucket with a large component and some small ones, with blocks of a few classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    component = [0] * 20 + [1] * 5 + [2] * 4 + [3]
    regs = np.zeros(near_dedup.REGISTERS, np.uint16).tobytes()
    classes = spark.createDataFrame([(k, 10, bytearray(regs)) for k in range(30)], "rep long, n long, registers binary")
    bands = spark.createDataFrame([(7, 0, k) for k in range(30)] + [(8, 0, k) for k in range(9)], "bucket long, band byte, rep long")
    labels = spark.createDataFrame(list(enumerate(component)), "rep long, component long")
    got = near_dedup._suspects(bands, labels, classes, 0.75, scratch(spark, "t"), 30).collect()
    assert {r.bucket for r in got} == {7} and {r.rep for r in got} == set(range(30))
    together = {(min(a.rep, b.rep), max(a.rep, b.rep)) for a in got for b in got if a.cell == b.cell and a.component != b.component}
    assert together == {(a, b) for a in range(30) for b in range(a + 1, 30) if component[a] != component[b]}
    assert max(Counter(r.cell for r in got).values()) <= 14


def test_pairs_of_ranges():
    low, high = np.array([1, 2, 5, 3, 5]), np.array([5, 5, 5, 5, 5])
    want = [(x, y) for x in range(5) for y in range(low[x], high[x])]
    for most in (1, 2, 100):
        assert [(int(a), int(b)) for x, y in near_dedup._pairs(low, high, most) for a, b in zip(x, y, strict=True)] == want


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    got = sorted(near_dedup.near_duplicates(docs(spark, rows)).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 3, True), (3, 3, True), (4, 4, True), (None, None, True), (None, None, True)]


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (3, b), (8, a), (9, a + " more"), (1, c), (1, d), (2, c), (4, d + " more"), (6, None), (6, a), (7, "alone in this text")]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs(spark, rows)).select("doc_id", "component_id", "kept").collect())
    root = {5: 3, 3: 3, 8: 3, 9: 3, 6: 3, 1: 1, 2: 1, 4: 1, 7: 7}
    assert got == sorted((i, root[i], root[i] == i) for i, _ in rows)


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    for share in (0.5, 0.75, 0.9):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, len(a) - k, dtype=np.uint64)]))
        true = k / (len(a) + len(b) - k)
        r = near_dedup.registers([a, b])
        est = near_dedup.joint_similarity(r[:1], r[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - true) < 0.12
    whole, parts = near_dedup.registers([np.unique(np.concatenate([a, b]))]), near_dedup.registers([a, b])
    assert (whole[0] == parts.max(0)).all()  # mergeable


LINE = "this line is surely longer than forty code points"


def lines_of(rows, least=40, most=5):
    key = lambda x: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x).encode().lower()
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n") if len(x.strip(" \t\n\x0b\f\r")) >= least}:
            held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(held.get(key(x), [])) >= most and i != max(held[key(x)]))]
        out[i] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


def test_lines(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, LINE.upper() + "\nshort\n" + LINE), (4, " " + LINE + "\t\nend"), (5, LINE), (6, "é" * 40), (7, LINE + "\n" + LINE), (8, f"x\n{LINE}\r\ny")]
    rows += [(10 + k, "\n".join(rng.choice([LINE + " two", "é" * 41, "É" * 41, f"{rng.random()} is a line of its own and long enough", "tiny"]) for _ in range(6))) for k in range(60)]
    want = lines_of(rows)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 30


def test_no_lines(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    rows = [(None, LINE)] * 4 + [(5, LINE)] * 2
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == [("5", 0), ("5", 0)] + [("None", 1)] * 4


def test_lines_of_repeated_ids(spark):
    two = [(7, LINE)] * 5 + [(8, LINE)]  # two documents hold the line
    five = [(k, LINE + " !") for k in (1, 2, 3, 4, 9, 9)]
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, two + five)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1)] + [(7, 0)] * 5 + [(8, 0), (9, 0), (9, 0)]


def test_digests_that_share_64_bits(tmp_path):
    arrays = shared.HashArrays(f"file://{tmp_path}", "x", 0, {"b": "<u8", "keeper": "<i8"})
    keys = np.array([3, 5, 5, 5, 9], np.uint64)
    arrays.write(0, keys, {"b": np.array([1, 1, 2, 3, 1]), "keeper": np.array([10, 11, 12, 13, 14])})
    found, values = arrays.find(np.array([3, 5, 5, 5, 9, 10], np.uint64), {"b": np.array([1, 3, 4, 1, 2, 1], np.uint64)})
    assert found.tolist() == [True, True, False, True, False, False] and values["keeper"].tolist() == [10, 13, 0, 11, 0, 0]


def test_segments_merged_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MERGED", 20)
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice([LINE + f" {j}" for j in range(40)]) for _ in range(8)) + f"\n{k} is in this line of its own and nowhere else") for k in range(120)]
    want = lines_of(rows)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows).repartition(7)).collect()}
    assert got == want


def test_twice_seen_filter(tmp_path):
    f = line_dedup.TwiceSeen(f"file://{tmp_path}", 16)
    hashes = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    once, twice = {}, {}
    for part in (hashes[:1200], hashes[1000:], np.repeat(hashes[:5], 2)):
        for s, a, b in f.partials(part):
            once.setdefault(s, []).append(a)
            twice.setdefault(s, []).append(b)
    for s in once:
        f.write(s, [f.seen(once[s][:1], twice[s][:1]), f.seen(once[s][1:], twice[s][1:])])
    seen = f.may_hold(hashes)
    assert seen[1000:1200].all() and seen[:5].all() and seen.mean() < 0.5


def passages(doc_rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in doc_rows:
        w, hit, held = split(t), set(), set()
        for item, text in items:
            v = split(text)
            k = min(len(v), window)
            for s in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        held.add(str(item))
        out[i] = (len(w), len(hit), sorted(held))
    return out


def test_passages(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "é", "x1"] + [f"r{k}" for k in range(30)])
    items = [(10, " ".join(word() for _ in range(25))), (2, "Just three, WORDS"), (3, ""), (4, None), (5, "the the the the the the the the the the the the"), (None, "no id"), (7, "solo"), (11, " ".join(word() for _ in range(10)))]
    rows = [(0, None), (1, ""), (2, "...just three-words here"), (3, "the " * 30), (4, "THE " * 9), (5, "a solo b"), (6, items[0][1].upper()), (7, "x " + " ".join(items[0][1].split()[5:16]) + " y"), (8, " ".join(items[0][1].split()[5:14])), (9, items[7][1] + " " + items[7][1])]
    rows += [(20 + k, " ".join(word() for _ in range(40)) + " " + (" ".join(items[0][1].split()[k : k + 12]) if k % 2 else "")) for k in range(12)]
    want = passages(rows, [x for x in items if x[0] is not None])
    got = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == want
    assert sum(bool(x[2]) for x in want.values()) >= 8


def test_repeated_items(spark):
    first, second = [f"a{k}" for k in range(14)], [f"b{k}" for k in range(14)]
    both = " ".join(first[:12] + second[:12])
    items = [(1, " ".join(first)), (1, " ".join(first)), (2, " ".join(second)), (2, both), (2, "solo word"), (3, "solo word")]
    rows = [(0, "x " + " ".join(first[2:13]) + " y"), (1, " ".join(second)), (2, both), (3, "solo word solo"), (4, " ".join(first[:9]))]
    got = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = passages(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == want
    assert [want[k][2] for k in range(5)] == [["1", "2"], ["2"], ["1", "2"], ["2", "3"], []]


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs(spark, [(1, "a b"), (None, "a b")]), empty).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)] * 2
    assert decontamination.decontaminate(docs(spark, []), empty).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta gamma beta alpha"), (4, "alpha beta gamma"), (5, "alpha " + "z " * 20 + "beta gamma delta")]
    found = decontamination.Matches(decontamination.Index(docs(spark, rows)), items)
    assert sorted(r.doc_id for r in found.near(2).collect()) == [1, 2] and sorted(r.doc_id for r in found.near(0).collect()) == [1]
    assert [(r.doc_id, r.pos, r.length) for r in found.phrases().collect()] == [(1, 0, 4)]


def near_windows(doc_rows, items, slop, window):
    """Windows with an assignment of their words to different document words near their places, by trying all."""

    def fits(need, word, used):
        if not need:
            return True
        (j, t), *rest = need
        return any(word.get(p) == t and p not in used and fits(rest, word, used | {p}) for p in range(j - slop, j + slop + 1))

    index = Counter(x for _, t in doc_rows for x in t.split())
    out = set()
    for item, text in items:
        v = text.split()
        k = min(len(v), window)
        for s in range(len(v) - k + 1):
            own = list(enumerate(v[s : s + k], s))
            if not all(index[t] for _, t in own):
                continue
            j1, rare = min(own, key=lambda x: (index[x[1]], x[0]))
            for i, t in doc_rows:
                word = dict(enumerate(t.split()))
                if any(fits([(p - j1 + j, t) for j, t in own], word, set()) for p, x in word.items() if x == rare):
                    out.add((item, s, i))
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_takes_words_once(spark, slop):
    rng = random.Random(9)
    items = [(1, "alpha alpha"), (2, "a b a b c"), (3, "x"), (4, "a a a b"), (5, "c b a d a c")]
    rows = [(1, "alpha"), (2, "alpha alpha"), (3, "alpha z alpha"), (4, "")] + [(10 + k, " ".join(rng.choice("aabbcdx") for _ in range(rng.randrange(1, 12)))) for k in range(25)]
    found = decontamination.Matches(decontamination.Index(docs(spark, rows)), spark.createDataFrame(items, "item_id long, text string"), window=4)
    got = {(r.item_id, r.s, r.doc_id) for r in found.near(slop).collect()}
    assert got == near_windows(rows, items, slop, 4) and got


def test_an_index_serves_several_benchmarks(spark):
    text = [f"w{k}" for k in range(30)]
    index = decontamination.Index(docs(spark, [(1, " ".join(text)), (2, "w3 other w4")]))
    for first in (0, 7):
        items = spark.createDataFrame([(first, " ".join(text[first : first + 12]))], "item_id long, text string")
        assert [(r.item_id, r.doc_id, r.pos, r.length) for r in decontamination.Matches(index, items).phrases().collect()] == [(first, 1, first, 12)]


@pytest.mark.parametrize("most", [16 << 20, -1])
def test_rows_of_repeated_and_missing_ids(spark, monkeypatch, most):
    """Each row by itself, also where nothing is small enough to broadcast."""
    monkeypatch.setattr(store, "MOST_BROADCAST", most)
    v = [f"v{k}" for k in range(12)]
    rows = [(1, " ".join(v[:5])), (1, "x x x x x " + " ".join(v[5:10])), (2, " ".join(v)), (2, " ".join(v)), (2, "clean"), (None, " ".join(v[1:])), (None, "clean"), (None, None)]
    got = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame([(7, " ".join(v))], "item_id long, text string"), carry="bucket").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted([(1, 5, 0, []), (1, 10, 0, []), (2, 12, 12, ["7"]), (2, 12, 12, ["7"]), (2, 1, 0, []), (None, 11, 11, ["7"]), (None, 1, 0, []), (None, 0, 0, [])], key=str)
    assert {r.bucket for r in got} == {"x"}


@pytest.mark.parametrize("text", ["ÀB C", "", None, "İSTANBUL k", "a_b c-d"])
def test_words(spark, text):
    (row,) = docs(spark, [(1, text)]).select(decontamination.words(decontamination.F.col("text")).alias("w")).collect()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    assert row.w == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
