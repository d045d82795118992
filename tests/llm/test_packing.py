"""Packing, sharding and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritrail.llm import packing, sharding

DOCS = "doc_id long, text string, length long, shard int, salt int"  # names that operators use inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree(text):
    t = packing.Tokenizer.of(packing.default_tokenizer())
    assert list(t.ids(text)) == reference_cached().encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_fast_path_agrees(text):
    t = packing.Tokenizer.of(packing.default_tokenizer())
    assert t.fast.encode_ordinary(text) == reference_cached().encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n\t'-é中文字，。\u00a0\x1cs", max_size=60))
def test_parts_are_cut_between_tokens(text):
    t = packing.Tokenizer.of(packing.default_tokenizer())
    was, packing.PART = packing.PART, 3
    try:
        assert "".join(t.parts(text)) == text
        assert list(t.ids(text)) == reference_cached().encode(text, add_special_tokens=False).ids
    finally:
        packing.PART = was


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "a" * 3_000_000, " \n" * 1_000_000, "x" + "\t" * 1_000_000 + "y", "中" * 300_000, "ab " * 1_000_000], ids=["spaces", "lines", "letters", "mixed", "tabs", "chinese", "words"])
def test_long_texts(text):
    t = packing.Tokenizer.of(packing.default_tokenizer())
    ids = t.ids(text)
    assert reference_cached().decode([int(x) for x in ids], skip_special_tokens=False) == text
    if len(text) <= 300_000:
        assert list(ids) == reference_cached().encode(text, add_special_tokens=False).ids


_reference = []


def reference_cached():
    if not _reference:
        _reference.append(reference())
    return _reference[0]


def check_plan(counts, capacities):
    places = packing.plan(counts, capacities)
    limits = capacities.limits()
    bins = {}
    seen = {k: [] for k in counts}
    for length, rank, n, first, offset in places:
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
            seen[length].append(rank + k)
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert (np.array([at, len(own), sum(n * n for _, n in own)]) <= limits).all()
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from(["norm", "dot"]), st.none() | st.integers(1, 9), st.none() | st.integers(64 * 64, 9000))
def test_plans_keep_every_capacity(counts, rule, most, attention):
    n = check_plan(counts, packing.Capacities(64, most, attention, rule=rule))
    assert n >= -(-sum(k * v for k, v in counts.items()) // 64)


def test_plans_are_tight_and_small():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in enumerate(rng.integers(0, 2000, 1025)) if k and v}
    bins = check_plan(counts, packing.Capacities())
    large = sum(v for k, v in counts.items() if k > 512)
    assert bins <= 1.02 * max(large, sum(k * v for k, v in counts.items()) / 1024)
    many = {k: v * 10**7 for k, v in counts.items()}
    assert len(packing.plan(many, packing.Capacities())) < 20_000
    assert packing.plan({}, packing.Capacities()).shape == (0, 5)
    with pytest.raises(ValueError):
        packing.plan({10: 1}, packing.Capacities(64, attention=50))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 40)
    rng = random.Random(0)
    rows = [(0, None), (1, ""), (2, "a" * 9000), (3, "<|endoftext|> x"), (4, "word " * 5000), (5, "中文字 текст"), (6, "same"), (6, "same"), (None, "no id"), (None, "no id")]
    rows += [(10 + k, "same length") for k in range(100)] + [(200 + k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(900)))) for k in range(60)]
    got = packing.pack(docs(spark, rows)).collect()
    t = reference()
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > head else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 1024
    assert len(bins) <= 1.05 * -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_tree_is_a_best_fit():
    rng = random.Random(0)
    tree, held = sharding.Capacities(), []
    for k in range(3000):
        if rng.random() < 0.6 or not held:
            key = (rng.randrange(500), k)
            tree.add(key)
            held.append(key)
        else:
            key = held.pop(rng.randrange(len(held)))
            tree.remove(key)
        size = rng.randrange(500)
        assert tree.tightest(size) == min((x for x in held if x[0] >= size), default=None)

    def height(n):
        return 0 if n is None else 1 + max(height(n.left), height(n.right))

    assert height(tree.root) <= 1.45 * np.log2(len(held) + 2)


def best_fit(sizes, capacity):
    """Loads of shards, packed group by group."""
    left = []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        k = min(fits, key=lambda k: (left[k], k), default=None)
        if k is None:
            left.append(capacity)
            k = len(left) - 1
        left[k] -= n
    return sorted(capacity - x for x in left)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(5, 40))
def test_plan_is_best_fit_decreasing(sizes, capacity):
    counts = {n: sizes.count(n) for n in sizes}
    places, opened = sharding.plan(counts, capacity)
    held = {}
    for n, rank, number, first, each in places:
        for k in range(rank, rank + number):
            held.setdefault(first + (k - rank) // each, []).append(n)
    assert sorted(sum(x) for x in held.values()) == best_fit(sizes, capacity)
    assert sorted(held) == list(range(opened))
    assert {n: sum(p[2] for p in places if p[0] == n) for n in counts} == counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 9))
def test_even_plan(sizes, shards):
    counts = {n: sizes.count(n) for n in sizes}
    places = sharding.even_plan(counts, shards)
    loads = {}
    for n, _, number, first, each in places:
        for k in range(number):
            loads[first + k // each] = loads.get(first + k // each, 0) + n
    assert len(loads) <= shards and sum(loads.values()) == sum(sizes)


def test_shards(spark):
    rng = random.Random(0)
    texts = ["copy " * 40] * 300 + [None, None, "", ""] + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(2000))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x"), (None, "x")]
    got = sharding.shard_documents(docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    shard_of, sizes, slots = {}, {}, {}
    for r in got:
        text = by_id[r.doc_id]
        raw = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert shard_of.setdefault(text, r.shard) == r.shard
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.02 * sum(sizes.values()) / 8
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0


def test_capacity_mode(spark):
    rows = spark.range(200_000).selectExpr("concat('g', id % 100000) AS grp", "5L AS size", "id AS shard", "id AS rank")
    got = sharding.assign(rows, "grp", "size", capacity=100)
    per = got.groupBy("shard").agg({"size": "sum", "grp": "count"}).collect()
    assert len(per) == 10_000 and {r["sum(size)"] for r in per} == {100} and {r["count(grp)"] for r in per} == {20}
    assert got.groupBy("grp").agg({"shard": "min", "*": "count"}).count() == 100_000 == got.select("grp", "shard").distinct().count()
    assert got.select("rank").distinct().count() == 200_000


def test_groups_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 7)
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(300)}", rng.randrange(1, 40)) for _ in range(900)] + [("hot", 1)] * 3000 + [(None, 2)] * 50 + [("none", None), ("zero", 0), ("big", 5000)]
    got = sharding.assign(spark.createDataFrame(rows, "g string, n long"), "g", "n", capacity=400).collect()
    assert sorted(((r.g, r.n) for r in got), key=str) == sorted(rows, key=str)
    sizes, shard_of = {}, {}
    for r in got:
        sizes[r.g] = sizes.get(r.g, 0) + (r.n or 0)
        assert shard_of.setdefault(r.g, r.shard) == r.shard
    own = {g: n for g, n in sizes.items() if n > 400}
    assert set(own) == {"hot", "big"} and all([shard_of[x] for x in sizes if sizes[x]].count(shard_of[g]) == 1 for g in own)
    held = {}
    for g, n in sizes.items():
        if 0 < n <= 400:
            held.setdefault(shard_of[g], []).append(n)
    assert sorted(sum(x) for x in held.values()) == best_fit([n for n in sizes.values() if 0 < n <= 400], 400)
    assert sharding.assign(spark.createDataFrame([], "g string, n long"), "g", "n", capacity=400).count() == 0
