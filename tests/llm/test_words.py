"""Word hashes against a split of the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.llm import words as W


def one(raw: bytes, kind) -> int:
    return int(W.hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), kind)[0][0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB é\n\t_9-ß", max_size=30), min_size=1, max_size=8), st.integers(1, 9))
def test_hashes(texts, step):
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    for kind, split in ((W.SPACED, lambda b: b.lower().split()), (W.ALNUM, lambda b: bytes(x if W.ALNUM[x] else 32 for x in b.lower()).split(b" "))):
        for a, b, data, bounds in W.batches(batch, "t", 7):
            got, at = W.hashes(data, bounds, kind, step)
            for r in range(b - a):
                want = [w for w in split((texts[a + r] or "").encode()) if w]
                assert [int(x) for x in got[at[r] : at[r + 1]]] == [one(w, kind) for w in want]


def test_grams_stay_within_rows():
    h = np.arange(1, 8, dtype=np.uint64)
    got, at = W.grams(h, np.array([0, 3, 3, 4, 7]), (0, 2))
    assert list(np.diff(at)) == [1, 0, 0, 1] and len(got) == 2 and got[0] != got[1]


def test_long_words():
    raw = b"x" * 5000 + b" y"
    got, _ = W.hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), W.SPACED, 100)
    assert len(got) == 2 and int(got[0]) == one(b"x" * 5000, W.SPACED) != one(b"x" * 4999, W.SPACED)


def test_files_are_kept_up_to_a_limit(tmp_path, monkeypatch):
    from urllib.parse import urlparse

    from veritrail.llm import shared

    for k in range(4):
        (tmp_path / f"{k}").write_bytes(bytes([k]) * 10)
    files = shared.Files(limit=25)
    assert all(files.get(f"file://{tmp_path}/{k}").tolist() == [k] * 10 for k in range(4)) and files.size == 0
    assert files.get(f"file://{tmp_path}/none") is None
    monkeypatch.setattr(shared, "urlparse", lambda x: urlparse(x)._replace(scheme="other"))
    monkeypatch.setattr(shared, "_filesystem", lambda x: (__import__("pyarrow.fs").fs.LocalFileSystem(), urlparse(x).path))
    files = shared.Files(limit=25)
    assert [files.get(f"other://{tmp_path}/{k}").tolist() for k in range(4)] == [[k] * 10 for k in range(4)]
    assert files.size == 20 and len(files.held) == 2


def test_sessions_keep_their_own_limits(spark):
    from veritrail.llm.shared import limit_batches

    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    limit_batches(other)
    assert other.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77" and other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
