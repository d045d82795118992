"""Media, WARC and chat: round trips."""

from __future__ import annotations

import base64
import cmath
import hashlib
import io
import json
import math
import random
import wave
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.llm import chat, media, warc
from veritrail.llm.shared import scratch, write_file

TEXTS = [None, "", "a", "x" * 576, "x" * 577, "é" * 2000, "long " * 60000, "a"]


def test_media(spark):
    docs = spark.createDataFrame([(i, t, b"m", "f") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary, feature string")
    stored = media.with_media(docs)
    raw = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in media.media_features(stored).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        want = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        with wave.open(io.BytesIO(raw[i])) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == want
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(raw[i]), hashlib.sha256(raw[i]).hexdigest())
    assert got[0].feature == got[1].feature and got[2].feature == got[7].feature != got[3].feature
    assert media.media_features(media.with_media(docs.limit(0))).count() == 0


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (1, 1), (2, 5)])
def test_resampling(monkeypatch, up, down):
    monkeypatch.setattr(media, "UP", up)
    monkeypatch.setattr(media, "DOWN", down)
    media.low_pass.cache_clear()
    x = np.random.default_rng(0).normal(size=997)
    full = np.zeros(len(x) * up)
    full[::up] = x
    want = np.convolve(full, media.low_pass())[media.TAPS * up :][: len(full)][::down]
    got = media.resample(x)
    media.low_pass.cache_clear()
    assert len(got) == len(want) and np.allclose(got, want)


def test_pieces_of_long_media(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 30000, dtype=np.uint8).tobytes()
    whole = media.features(raw)
    monkeypatch.setattr(media, "PIECE", 4096)
    again = media.features(raw)
    assert np.allclose(whole[0], again[0]) and whole[1] == again[1]


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_last_byte_counts(m):
    text = ("some words of text " * 200)[: 576 * m - 1]
    one, two = (media.features(media.padded(text + x)) for x in "az")
    assert media.feature_text(*one) != media.feature_text(*two)
    assert all(b <= 1000 * 576 * m / media.RATE for _, b in one[1])


def test_segments():
    e = np.array([0, 0, 5, 2.05, 2, 2.05, 0, 0, 9, 0])  # mean 2.01: on above 2.21, off below 1.81
    assert media.segments(e) == [(2, 5), (8, 8)]
    assert media.segments(np.ones(4)) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.5, 0.95, 1.0, 1.05, 2.0, 9.0]), min_size=1, max_size=30))
def test_segments_step_by_step(energy):
    mean, on, runs = sum(energy) / len(energy), False, []
    for k, x in enumerate(energy):
        if x > media.HIGH * mean:
            on = True
        elif x < media.LOW * mean:
            on = False
        if on:
            runs = [*runs[:-1], (runs[-1][0], k)] if runs and runs[-1][1] == k - 1 else [*runs, (k, k)]
    assert media.segments(np.array(energy)) == runs


def test_log_mel_by_definition():
    """Frames by a direct Fourier sum and mel triangles by their corners."""
    x = np.random.default_rng(5).normal(size=700)
    mel, energy = media.log_mel(x)
    assert len(mel) == 6
    rate, n = media.RATE * media.UP / media.DOWN, media.WINDOW
    mels = lambda f: 2595 * math.log10(1 + f / 700)
    corner = [700 * (10 ** (mels(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    for t in (0, 3, 5):
        frame = [x[t * media.HOP + k] if t * media.HOP + k < len(x) else 0.0 for k in range(n)]
        inside = min(n, len(x) - t * media.HOP)
        assert math.isclose(energy[t], sum(v * v for v in frame) / inside)
        windowed = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / n)) for k, v in enumerate(frame)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * b * k / n) for k, v in enumerate(windowed))) ** 2 for b in range(n // 2 + 1)]
        for m in (0, 7, 31):
            total = 0.0
            for b, p in enumerate(power):
                f, (lo, mid, hi) = b * rate / n, corner[m : m + 3]
                total += p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
            assert abs(mel[t, m] - math.log10(max(total, media.FLOOR))) < 2e-3


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "abc " * 9000), (2, None)], "doc_id long, text string")
    table = media.feature_table(media.with_media(docs))
    rows = table.orderBy("doc_id", "k").collect()
    assert all(len(r.log_mel) == media.ROWS * media.MELS for r in rows) and [r.k for r in rows if r.doc_id == 1] == list(range(len(rows) - 1))
    assert all(r.start_ms < r.end_ms and all(r.start_ms <= s.start_ms < s.end_ms <= r.end_ms for s in r.spans) for r in rows)
    arrow = media.to_arrow(pa.Table.from_pandas(table.toPandas()))
    assert arrow["log_mel"].combine_chunks().to_numpy_ndarray().shape == (len(rows), media.ROWS, media.MELS)


def test_stored_media(spark, monkeypatch):
    uris = []
    monkeypatch.setattr(media, "scratch", lambda s, label: uris.append(scratch(s, label)) or uris[-1])
    texts = [*TEXTS, "loud \x01\x02 \x7f and ~~~~ quiet " * 3000]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = media.media_features(media.with_media(docs)).collect()
    want = [media.feature_text(*media.features(media.padded(t))) for t in texts]
    assert sorted(r.feature for r in got) == sorted(want)
    assert spark.read.parquet(f"{uris[0]}/media").count() == len(texts)
    names = sorted({r.tensor_file for r in got})
    tables = [pa.ipc.open_stream(media.open_file(x)).read_all() for x in names]
    assert {t.schema.field("log_mel").type for t in tables} == {pa.fixed_shape_tensor(pa.float32(), (media.ROWS, media.MELS))}
    assert sum(sum(t["frames"].to_pylist()) for t in tables) == sum(len(media.features(media.padded(t))[0]) for t in texts)


def test_warc(spark):
    rng = random.Random(0)
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 5000, "x" * 300000, "\x1f\x8b\x08 in text WARC/1.1\r\n\r\n"] + ["".join(chr(rng.randrange(32, 2000)) for _ in range(rng.randrange(3000))) for _ in range(60)]
    rows = [(i * 3 % 71, f"http://x/{i}\r\nX: y", h, "k", "d") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, digest string")
    files = warc.archive_pages(pages.repartition(3), scratch(spark, "warc"))
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
    for split in (1 << 20, 997):
        got = {r.record_id: r for r in warc.resolved(warc.read(spark, files, split)).collect()}
        assert len(got) == len(rows)
        for i, _, h, *_ in rows:
            b, r = (h or "").encode(), got[f"urn:page:{i}"]
            assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
            k = best[h or ""]
            assert (r.record_type, r.refers_to) == (("response", None) if k == i else ("revisit", f"urn:page:{k}"))
    listed = warc.archives(spark, files.first().file.rsplit("/", 1)[0])
    assert listed.count() == files.count()


def test_warc_edge_rows(spark):
    pages = spark.createDataFrame([(None, None, "same"), (5, None, "same"), (5, None, "same"), (4, "u", "same")], "page_id long, url string, html string")
    got = sorted((r.record_id, r.record_type, r.refers_to) for r in warc.read(spark, warc.archive_pages(pages, scratch(spark, "w"))).collect())
    assert got == [("urn:page:4", "revisit", "urn:page:5"), ("urn:page:5", "response", None), ("urn:page:5", "response", None), ("urn:page:none", "response", None)]
    assert warc.read(spark, warc.archive_pages(pages.limit(0), scratch(spark, "w"))).count() == 0


def test_damaged_members_are_skipped(spark, tmp_path):
    good = [warc.record("response", f"urn:page:{k}", "u", f"page {k}".encode(), "D", None) for k in range(4)]
    bad = bytearray(good[1])
    bad[40:60] = b"\0" * 20
    name = f"file://{tmp_path}/a.warc.gz"
    n = write_file(name, [good[0], bytes(bad), b"junk\x1f\x8b\x08junk", good[2], good[3][:-9]])
    files = spark.createDataFrame([(name, n)], "file string, bytes long")
    for split in (1 << 20, 50):
        assert sorted(r.record_id for r in warc.read(spark, files, split).collect()) == ["urn:page:0", "urn:page:2"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<|\\im_endstar>\n ax", max_size=40), st.text(alphabet="<|\\\nuser", max_size=10))
def test_escapes(text, role):
    flat = chat.flatten([{"type": "text", "text": text[:7]}, {"type": "text", "text": text[7:]}])
    whole = chat.format_turn(role, flat.text) + chat.format_turn("assistant", flat.text)
    assert [(r, t) for r, t, _, _ in chat.parse_turns(whole)] == [(role, text), ("assistant", text)]


def test_parts():
    got = chat.flatten([{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 700, "height": 300}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "document", "ref": "c", "pages": 3}, {"type": "video", "ref": "d"}, {"text": None}])
    assert got.text == "see <\\|image|> <|image|><|audio|><|document|><|file|>"
    assert [(a["k"], a["kind"], a["ref"], a["tokens"]) for a in got.attachments] == [(0, "image", "a.png", 3 * 576), (1, "audio", "b", 38), (2, "document", "c", 2400), (3, "file", "d", 1)]
    assert got.tokens == 3 * 576 + 38 + 2400 + 1


def test_conversations(spark):
    rng = random.Random(0)
    texts = [None, "", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "é<|", "x" * 5000]
    rows = [(c, k, rng.choice(["user", "assistant", "system", None]), rng.choice(texts)) for c in range(20) for k in range(rng.randrange(1, 9))] + [(99, k, "assistant", f"t{k}") for k in range(3000)] + [(None, 0, "user", "n"), (7, None, "user", "first")]
    turns = spark.createDataFrame([(*r, 0, "f") for r in rows], "conv_id long, turn long, role string, text string, loss_start int, formatted string")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.streamed(formatted, chat.digests, chat.DIGESTS).collect()}
    whole = {r.conv_id: r for r in chat.conversations(formatted).collect()}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)
    for c, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r, w = got[c], whole[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(w.formatted) and [(a or "", b or "") for _, _, a, b in own] == [(a, b) for a, b, _, _ in chat.parse_turns(w.formatted)]
        assert "".join(chat.unescape(w.formatted[s.start : s.end]) for s in w.loss_spans) == loss
    assert chat.streamed(formatted.limit(0), chat.digests, chat.DIGESTS).count() == 0


def test_content_column(spark):
    parts = json.dumps([{"type": "text", "text": "look"}, {"type": "image", "ref": "r", "width": 10, "height": 10}])
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, content string")
    (row,) = chat.conversations(chat.format_turns(rows)).collect()
    assert row.attachments[0].ref == "r" and row.attachment_tokens == 576 and "look<|image|>" in row.formatted


PARTS = [
    ("not json", "not json", 0), ("null", "", 0), ("[null]", "", 0), ('["a", "b"]', "ab", 0), ('"a"', "a", 0), ('{"text": "x"}', "x", 0), ("7", "7", 0), ("[true, 1.5]", "true1.5", 0), ("", "", 0), (None, "", 0),
    ('{"type": "image", "width": "wide", "height": -3}', "<|image|>", 576), ('{"type": "image", "width": "700"}', "<|image|>", 3 * 576), ('{"type": "audio", "seconds": NaN}', "<|audio|>", 1),
    ('{"type": "audio", "seconds": 1e400}', "<|audio|>", 2_500_000), ('{"type": "document", "pages": [3], "ref": {"a": 1}}', "<|document|>", 800), ('{"type": ["text"], "text": 5}', "5", 0), ('{"type": "", "text": null}', "", 0),
    ('{"type": "other"}', "<|file|>", 1), ('{"type": "_attach"}', "<|file|>", 1), ('{"text": "\\ud800"}', "?", 0), ("[" * 100000, "[" * 100000, 0), ("[[1, 2]]", "[1, 2]", 0),
]


def test_odd_content(spark):
    rows = spark.createDataFrame([(k, 0, "user", c) for k, (c, _, _) in enumerate(PARTS)], "conv_id long, turn long, role string, content string")
    got = {r.conv_id: r for r in chat.format_turns(rows).collect()}
    for k, (c, text, tokens) in enumerate(PARTS):
        assert got[k].formatted == f"<|im_start|>user\n{text}<|im_end|>\n" and got[k].attachment_tokens == tokens, c


_values = st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["type", "text", "ref", "width", "height", "seconds", "pages"]), x | st.sampled_from(["text", "image", "audio", "document"]), max_size=5), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(_values)
def test_any_content_has_a_form(value):
    flat = chat.flatten(chat.parts_of(json.dumps(value)))
    whole = chat.format_turn("user", flat.text)
    assert [r for r, *_ in chat.parse_turns(whole)] == ["user"] and 0 <= flat.tokens < 2**62
    assert all(isinstance(a["ref"], str) and 0 < a["tokens"] < 2**31 for a in flat.attachments)
    whole.encode()
