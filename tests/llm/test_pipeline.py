"""The pipeline against its stages in plain Python."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from test_models import scalar_ftrl
from test_packing import reference
from test_pairs import components, lines_of, passages

import corpus_pipeline as P
from veritrail.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n):
    """Rows of all kinds, labels and a benchmark."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(f"p{k}" for k in range(30))
    shared = "This line stands in many of the documents, word for word."
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 80))]
        if i % 7 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Scum", "moron!", "trash"])
        text = " ".join(w)
        if i % 6 == 0:
            text += "\n" + shared + "\nend"
        if i % 11 == 3:
            k = rng.randrange(18)
            text += " " + " ".join(passage.split()[k : k + 12])
        rows.append((i, text))
    rows += [(1000 + i, rows[i][1] if i % 2 else rows[i][1] + " more") for i in range(8, 40)]
    rows += [(2000, None), (2001, ""), (None, "you trash moron scum " * 3), (None, "fine words"), (None, None), (None, "x " + passage), (30, passage), (30, rows[30][1]), (31, "scum trash moron scum"), (2002, "word " * 3000)]
    labels = [(i, 1, int(bool(re.search("scum|moron|trash", t or "", re.I)))) for i, t in rows if i is not None and i < 1000]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], labels, [(1, passage), (2, "only these three"), (3, None)]


def scores(spark, rows, labels):
    """Of each row's text, by the classifier's features and a plain update."""

    def numbers(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return sorted(set(T.features(raw, np.array([0, len(raw)]))[0].tolist()))

    label = {}
    for i, _, y in labels:
        label[i] = max(label.get(i, 0), y)
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in label], "i long").selectExpr("i", "xxhash64(i) AS h").collect()}
    learned = [(order[i], i, numbers(t), label[i]) for i, t, *_ in rows if i in label and zlib.crc32(str(i).encode()) % 3 != 1]
    weights = scalar_ftrl([(x, y) for _, _, x, y in sorted(learned)], T.EPOCHS, T.ALPHA, T.BETA, T.L1, T.L2)
    return [1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in [*numbers(t), None]))) for _, t, *_ in rows]


def brute_force(spark, rows, labels, items):
    rows = [r for r, s in zip(rows, scores(spark, rows, labels), strict=True) if s < T.THRESHOLD]
    named = [(k if r[0] is None else r[0], r[1]) for k, r in zip(range(-len(rows), 0), rows, strict=True)]  # rows without id: a negative one each
    out = []
    for r, (i, t) in zip(rows, named, strict=True):
        text, _, dropped = lines_of([*(x for x in named if x[0] != i), (i, t)])[i]
        out.append((r[0], text, *r[2:4], len(text)) if dropped else r)
    rows = out
    ids = {}
    for i, t, *_ in rows:
        if i is not None:
            ids.setdefault(i, []).append(t)
    several = {i: x for i, x in ids.items() if len(x) > 1}
    # rows of one id are linked: give each a number of its own and join their components
    flat = [(10 * i + k, t) for i, x in ids.items() for k, t in enumerate(x)]
    root = {n: c for n, (_, c) in components(flat).items()}
    changed = True
    while changed:
        changed = False
        for i in several:
            own = {root[10 * i + k] for k in range(len(several[i]))}
            if len(own) > 1:
                changed, least = True, min(own)
                root = {n: least if c in own else c for n, c in root.items()}
    kept = {i for i in ids if min(n // 10 for n, c in root.items() if c == root[10 * i]) == i}
    rows = [r for r in rows if r[0] is None or r[0] in kept]
    rows = [r for r in rows if not passages([(0, r[1])], [x for x in items if x[1]])[0][1]]
    t, out = reference(), []
    for i, text, *_ in rows:
        tokens = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(tokens) % 1024 or 1024
        cuts = [0, *range(head, len(tokens) + 1, 1024)] if len(tokens) > head else [0, len(tokens)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def written(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_by_brute_force(spark, tmp_path):
    rows, labels, items = corpus(1, 260)
    got = P.run(spark, written(spark, tmp_path / "t", rows, labels, items)).collect()
    want = brute_force(spark, rows, labels, items)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert 100 < len({r.doc_id for r in got}) < 240 and sum(r.doc_id is None for r in got) == 2
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 1024


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:4]:
        docs = P.stored(stage(spark, docs, sf), "s")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
        assert docs.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", None, 0)]])
def test_stages_of_little(spark, tmp_path, rows):
    at = written(spark, tmp_path / "t", rows, [], [])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:4]:
        docs = P.stored(stage(spark, docs, at), "s")
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str)
    assert sorted(((r.doc_id, r.length) for r in P.run(spark, at).collect()), key=str) == sorted(((r[0], 1) for r in rows), key=str)
