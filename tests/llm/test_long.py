"""Texts of megabytes, beside ordinary ones, through the operators on words and lines."""

from __future__ import annotations

import random

import pytest

from veritrail.llm import decontamination, language_model, line_dedup, near_dedup, toxicity

WORDS = 250_000
LINE = "this line is surely longer than forty code points"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(WORDS))
    passage = " ".join(f"p{k}" for k in range(12))
    return [(1, long + " " + passage), (2, long + " " + passage + " more"), (3, "short " + passage), (4, "\n".join([LINE] * 30_000)), (5, LINE), (6, "x" * 2_000_000), (7, LINE), (8, LINE), (9, LINE), (10, " " * 2_000_000)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pos long")


def test_passages(spark, rows):
    items = spark.createDataFrame([(7, " ".join(f"p{k}" for k in range(12)))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.decontaminate(docs(spark, rows), items).collect()}
    assert got[1] == (WORDS + 12, 12) and got[2] == (WORDS + 13, 12) and got[3] == (13, 12) and got[4] == (30_000 * 9, 0) and got[6] == (1, 0) and got[10] == (0, 0)


def test_near_copies(spark, rows):
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 5, 8: 5, 9: 5, 10: 10}


def test_lines(spark, rows):
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[4] == (30_000, 30_000) and got[5] == (1, 1) and got[9] == (1, 0) and got[6] == (1, 0)


def test_scores(spark, rows):
    model = language_model.train(docs(spark, rows), order=3)
    got = {r.doc_id: r for r in language_model.score(docs(spark, rows), model).collect()}
    assert got[1].n_tokens == WORDS + 13 and got[6].n_tokens == 2 and got[10].n_tokens == 1 and got[1].n_known == WORDS + 13 and got[1].score > got[1].base_score
    labels = spark.createDataFrame([(k, int(k == 3)) for k in range(1, 11)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs(spark, rows), labels).collect())
