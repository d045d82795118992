"""Media columns: texts' bytes as 8-bit mono PCM in WAV form, and audio features of them.

The payload is the text in UTF-8, padded with bytes 255 to a positive multiple of
576 (``FRAME``). ``store`` writes one WAV file image a row; ``payload`` reads it back
by its RIFF chunks. Features of the samples:

* polyphase resampling by ``UP``/``DOWN`` with a windowed-sinc low-pass: of each
  branch only the outputs that are kept are computed;
* log-mel energies of overlapped Hann frames;
* segments: frames become active above a high and inactive below a low threshold of
  frame energy (hysteresis), given as time spans in milliseconds.

``feature_table`` cuts the log-mel matrix into tensors of ``ROWS`` x ``MELS`` (a
fixed-shape Arrow tensor extension column for ``to_arrow``), each with its time span;
the last one is padded with the floor. ``media_features`` stores the media, reads them
back, and stores their tensors as Arrow streams with a fixed-shape tensor column, one
file after the other; its digests and features are what is read back of both. A file is
read by the task that wrote it, so nothing is shuffled. All sums run over one document in
double precision and are rounded, so equal texts give equal values. Long texts are worked
through in pieces of ``PIECE`` samples that overlap as frames need.

Null and empty texts are one frame of padding. Rows that repeat a doc_id are rows each,
a null doc_id stays null. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import open_file, scratch, stored, write_file

FRAME, PAD = 576, 255
RATE, UP, DOWN = 20_000, 2, 5  # to 8 kHz: the filter has two branches
TAPS = 16  # on each side of the centre, in input samples
WINDOW, HOP, MELS, ROWS = 256, 128, 32, 64
HIGH, LOW = 1.1, 0.9  # of the mean frame energy
FLOOR = 1e-6
PIECE = 1 << 20
#: Tensors of an Arrow batch; bytes from which on a file of tensors is closed.
BATCH, FILE_BYTES = 128, 8 << 20


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def store(samples: bytes) -> bytes:
    """A WAV file: 8-bit unsigned mono PCM. An odd number of samples gets RIFF's pad byte, which is not a sample."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples + b"\0" * (n % 2)


def payload(media: bytes) -> memoryview:
    """Samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache
def low_pass() -> np.ndarray:
    """Hann-windowed sinc at the lower of both rates' limits, of unit gain."""
    k = np.arange(-TAPS * UP, TAPS * UP + 1)
    h = np.sinc(k / max(UP, DOWN)) * (0.5 + 0.5 * np.cos(np.pi * k / (TAPS * UP + 1)))
    return h / h.sum() * UP


def resample(x: np.ndarray) -> np.ndarray:
    """By UP/DOWN. Output m is the sum over k of x[m * DOWN // UP - k] times branch (m * DOWN) % UP of the filter at k."""
    h, centre = low_pass(), TAPS * UP
    n = -(-len(x) * UP // DOWN)
    ext = np.concatenate([np.zeros(TAPS), x, np.zeros(TAPS + DOWN)])
    out = np.empty(n)
    for phase in range(UP):  # outputs phase, phase + UP, ... share a branch and stand DOWN inputs apart
        first, branch = divmod(phase * DOWN, UP)
        count = len(range(phase, n, UP))
        total = np.zeros(count)
        for k in range(-TAPS, TAPS + (branch == 0)):
            at = first - k + TAPS
            total += h[centre + branch + k * UP] * ext[at : at + count * DOWN : DOWN][:count]
        out[phase::UP] = total
    return out


@lru_cache
def mel_bank() -> np.ndarray:
    """Triangles of equal width on the mel scale."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * (RATE * UP / DOWN) / WINDOW
    up = (f[None] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - f[None]) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 mel energies (frames x MELS, 3 decimals) and frame energies of resampled signal.

    A frame starts at each hop, so the last ones reach beyond the end: silence there
    is no part of their energy.
    """
    n = len(x)
    frames = max(1, -(-n // HOP))
    x = np.pad(x, (0, (frames - 1) * HOP + WINDOW - n))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    mel, energy = np.empty((frames, MELS)), np.empty(frames)
    for a in range(0, frames, 2048):
        b = min(frames, a + 2048)
        view = np.lib.stride_tricks.sliding_window_view(x[a * HOP : (b - 1) * HOP + WINDOW], WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(view * hann, axis=1)) ** 2
        mel[a:b] = power @ mel_bank().T
        energy[a:b] = (view**2).sum(1) / np.clip(n - np.arange(a, b) * HOP, 1, WINDOW)
    return np.round(np.log10(np.maximum(mel, FLOOR)), 3), energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each active run: on above HIGH, off below LOW times the mean energy."""
    mean = energy.mean()
    mark = np.where(energy > HIGH * mean, 1, np.where(energy < LOW * mean, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def features(samples) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """log-mel matrix and active time spans in milliseconds of 8-bit samples."""
    raw = np.frombuffer(samples, np.uint8)
    parts, step = [], PIECE // DOWN * DOWN  # pieces start where an output does
    for a in range(0, len(raw), step):  # with what the filter sees on both sides
        lo, hi = max(0, a - 2 * TAPS * DOWN), min(len(raw), a + step + 2 * TAPS * DOWN)
        y = resample((raw[lo:hi].astype(np.float64) - 128) / 128)
        skip = (a - lo) * UP // DOWN
        parts.append(y[skip : skip + -(-(min(a + step, len(raw)) - a) * UP // DOWN)])
    whole = np.concatenate(parts)
    mel, energy = log_mel(whole)
    ms = 1000 * DOWN / UP / RATE
    return mel, [(a * HOP * ms, min(b * HOP + WINDOW, len(whole)) * ms) for a, b in segments(energy)]


def feature_text(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, mean log-mel energies, a checksum of all of them, and spans: number, total and longest in ms."""
    total = sum(b - a for a, b in spans)
    means = ",".join(f"{x:.2f}" for x in mel.mean(0) + 0.0)
    whole = zlib.crc32(np.round(mel * 1000).astype("<i4").tobytes())
    return f"frames={len(mel)};mel={means};crc={whole:08x};spans={len(spans)};active={total:.1f};longest={max((b - a for a, b in spans), default=0):.1f}"


def with_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of each row."""

    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_file string"


def media_features(media: DataFrame) -> DataFrame:
    """``FEATURES`` of each row, from its stored media and tensors: sizes, hashes, feature, and the file that holds its tensors."""
    uri = scratch(media.sparkSession, "media")
    held = stored(media.select("doc_id", "n_bytes", "media"), "media", uri)

    def run(it):
        names, kinds = zip(*(x.split() for x in FEATURES.split(", ")), strict=True)
        arrow = {"long": pa.int64(), "string": pa.string()}
        sink, rows = None, []

        def done():
            name = sink.close()
            found = list(read_file(name))
            columns = list(zip(*(r + (f, name) for r, f in zip(rows, found, strict=True)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in it:
            for i, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = x.as_py()
                got = payload(raw)
                sink = sink or TensorFile(f"{uri}/tensors")
                sink.add(len(rows), tensors(got))
                rows.append((i, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(raw), hashlib.sha256(raw).hexdigest()))
                if sink.size() >= FILE_BYTES:
                    yield done()
                    sink, rows = None, []
        if rows:
            yield done()

    return held.mapInArrow(run, FEATURES)


def tensors(samples) -> Iterator[tuple]:
    """k, start_ms, end_ms, frames, tensor (ROWS x MELS) and spans of each part of the features."""
    ms = 1000 * DOWN / UP / RATE
    mel, spans = features(samples)
    for k in range(0, len(mel), ROWS):
        part = np.full((ROWS, MELS), np.log10(FLOOR), np.float32)
        n = min(ROWS, len(mel) - k)
        part[:n] = mel[k : k + n]
        start, end = k * HOP * ms, min((k + n - 1) * HOP + WINDOW, -(-len(samples) * UP // DOWN)) * ms
        yield k // ROWS, start, end, n, part, [{"start_ms": max(a, start), "end_ms": min(b, end)} for a, b in spans if a < end and b > start]


def joined_spans(parts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Whole spans from what the tensors hold of them: parts of one span overlap, spans at most touch."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(parts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
TENSOR = pa.fixed_shape_tensor(pa.float32(), (ROWS, MELS))
FILE = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int32()), ("log_mel", TENSOR), ("spans", SPANS)])


class TensorFile:
    """An Arrow stream of rows' tensors, written to the shared folder when it is closed."""

    def __init__(self, folder: str):
        self.folder, self.sink, self.held = folder, pa.BufferOutputStream(), []
        self.writer = pa.ipc.new_stream(self.sink, FILE, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9)))

    def add(self, row: int, parts: Iterator[tuple]) -> None:
        for x in parts:
            self.held.append((row, *x))
            if len(self.held) >= BATCH:
                self._flush()

    def size(self) -> int:
        return self.sink.tell()

    def _flush(self) -> None:
        row, k, start, end, n, part, spans = zip(*self.held, strict=True)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(part).reshape(-1)), ROWS * MELS)
        columns = [pa.array(x, f.type) for x, f in zip((row, k, start, end, n), FILE, strict=False)]
        self.writer.write_batch(pa.RecordBatch.from_arrays([*columns, pa.ExtensionArray.from_storage(TENSOR, flat), pa.array(spans, SPANS)], schema=FILE))
        self.held = []

    def close(self) -> str:
        """The file's name. A task that is tried again writes another file."""
        if self.held:
            self._flush()
        self.writer.close()
        name = f"{self.folder}/{uuid.uuid4().hex}.arrow"
        write_file(name, [self.sink.getvalue()])
        return name


def read_file(name: str) -> Iterator[str]:
    """The feature of each row in a file, from its tensors and spans."""
    parts, spans, last = [], [], None
    with open_file(name) as src, pa.ipc.open_stream(src) as stream:
        for batch in stream:
            cube = batch["log_mel"].to_numpy_ndarray()
            for row, n, x, held in zip(batch["row"].to_pylist(), batch["frames"].to_pylist(), cube, batch["spans"].to_pylist(), strict=True):
                if row != last and parts:
                    yield feature_text(_mel(parts), joined_spans(spans))
                    parts, spans = [], []
                last = row
                parts.append(x[:n])
                spans += [(s["start_ms"], s["end_ms"]) for s in held]
    if parts:
        yield feature_text(_mel(parts), joined_spans(spans))


def _mel(parts: list[np.ndarray]) -> np.ndarray:
    return np.round(np.concatenate(parts).astype(np.float64), 3)


def feature_table(media: DataFrame) -> DataFrame:
    """Tensors of each row's media: doc_id, k, start_ms, end_ms, frames (that are not padding), log_mel (ROWS * MELS floats) and spans."""

    def run(it):
        for batch in it:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, start, end, n, part, inside in tensors(payload(x.as_py())):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "k": pa.array([k], pa.int32()), "start_ms": [start], "end_ms": [end], "frames": pa.array([n], pa.int32()), "log_mel": pa.array([part.reshape(-1)], pa.list_(pa.float32())), "spans": pa.array([inside], SPANS)})

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, k int, start_ms double, end_ms double, frames int, log_mel array<float>, spans array<struct<start_ms: double, end_ms: double>>")


def to_arrow(features: pa.Table) -> pa.Table:
    """A part of ``feature_table`` with log_mel as a fixed-shape tensor column of ROWS x MELS."""
    kind = pa.fixed_shape_tensor(pa.float32(), (ROWS, MELS))
    flat = features["log_mel"].combine_chunks()
    fixed = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), ROWS * MELS)
    return features.set_column(features.schema.get_field_index("log_mel"), "log_mel", pa.ExtensionArray.from_storage(kind, fixed))


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media_features(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("tensor_file")
