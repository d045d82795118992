"""The folder that driver and executors share, and files in it that workers map into memory.

Scratch data (tables between passes, filters, hashed models) goes below
``spark.checkpoint.dir``. Workers reach it through ``pyarrow.fs``, so any scheme
that library knows will do. A local or mounted path is mapped in place; of another one
a worker keeps the files in memory that it used last, so mount it for large models.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..store import scratch, small, stored  # noqa: F401  (operators take all of it from here)


def limit_batches(spark: SparkSession) -> None:
    """Batches that this session reads and sends to Python workers hold a few megabytes from now on, whatever the rows' length.

    The defaults fit narrow rows: 4,096 texts are read at a time, and 64 MB sent, of
    which the JVM and the worker hold several. Operators leave a session's settings
    alone: call this where the session is made, or set limits of your own, which are
    kept. The queries and the pipeline call it.
    """
    defaults = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"),
        "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
        "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
    }
    for key, (default, value) in defaults.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def tidy(run: Callable) -> Callable:
    """``run`` of a partition, after which the worker gives memory that it no longer uses back to the system: it lives on for other tasks, and allocators keep what large arrays took."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return tidied


def _filesystem(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme == "file":
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list) -> int:
    """Writes byte chunks under another name, then moves the file: a retried task replaces it whole."""
    fs, path = _filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(tmp) as out:
        for x in parts:
            out.write(x)
            n += memoryview(x).nbytes
    fs.move(tmp, path)
    return n


def open_file(uri: str):
    """Random-access input of a shared file."""
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)


class Files:
    """Bytes of shared files that this process looked at last: local ones mapped, others read into memory up to ``limit`` bytes together."""

    def __init__(self, limit: int = 256 << 20, most: int = 1 << 16):
        self.limit, self.most, self.held, self.size = limit, most, OrderedDict(), 0

    def get(self, uri: str) -> np.ndarray | None:
        """None where there is none."""
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri][0]
        fs, path = _filesystem(uri)
        found, cost = None, 0
        if fs.get_file_info(path).is_file:
            if urlparse(uri).scheme == "file":
                found = np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
            else:
                with fs.open_input_file(path) as src:
                    found = np.frombuffer(src.read(), np.uint8)
                cost = len(found)
        self.held[uri] = found, cost
        self.size += cost
        while len(self.held) > 1 and (self.size > self.limit or len(self.held) > self.most):
            self.size -= self.held.popitem(last=False)[1][1]
        return found


_files = Files()


def map_file(uri: str) -> np.ndarray | None:
    """Bytes of a shared file; None where there is none."""
    return _files.get(uri)


class HashArrays:
    """Sorted 64-bit keys and columns of values, in one file a shard; a shard holds the keys that share their top bits. Keys may repeat (see ``find``).

    A file is the keys, then each column. Lookups map the files and search
    batches of sorted keys, so memory holds pages, not tables. Columns of 32 bits hold
    any count: those from ``LIMIT`` on stand in arrays of their own.
    """

    LIMIT = 0xFFFFFFFF

    def __init__(self, uri: str, name: str, bits: int, columns: dict[str, str]):
        self.uri, self.name, self.bits, self.columns = uri, name, bits, columns

    def path(self, shard: int) -> str:
        return f"{self.uri}/{self.name}-{shard:06d}.bin"

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def write(self, shard: int, keys: np.ndarray, values: dict[str, np.ndarray]) -> int:
        """Keys sorted, all of this shard."""
        narrow = [j for j, (k, d) in enumerate(self.columns.items()) if d == "<u4" and (np.asarray(values[k]) >= self.LIMIT).any()]
        if narrow:
            names = list(self.columns)
            rows = [(i, j) for j in narrow for i in np.flatnonzero(np.asarray(values[names[j]]) >= self.LIMIT)]
            rows.sort()
            self.large().write(shard, keys[[i for i, _ in rows]], {"column": np.array([j for _, j in rows]), "value": np.array([values[names[j]][i] for i, j in rows])})
            values = {k: np.minimum(values[k], self.LIMIT) if d == "<u4" else values[k] for k, d in self.columns.items()}
        return write_file(self.path(shard), [np.ascontiguousarray(keys, "<u8")] + [np.ascontiguousarray(values[k], d) for k, d in self.columns.items()])

    def large(self) -> HashArrays:
        return HashArrays(self.uri, f"{self.name}-large", self.bits, {"column": "<u8", "value": "<u8"})

    def shard(self, shard: int) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
        raw = map_file(self.path(shard))
        if raw is None or not len(raw):
            return None
        n = len(raw) // (8 + sum(np.dtype(d).itemsize for d in self.columns.values()))
        at, values = 8 * n, {}
        for k, d in self.columns.items():
            values[k] = raw[at : at + n * np.dtype(d).itemsize].view(d)
            at += n * np.dtype(d).itemsize
        return raw[: 8 * n].view("<u8"), values

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of these sorted keys are there, and their values (0 where not)."""
        return self.find(keys, {})

    def find(self, keys: np.ndarray, same: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """``lookup`` of keys that may stand there several times: the row is meant whose columns are as in ``same``."""
        found = np.zeros(len(keys), bool)
        out = {k: np.zeros(len(keys), "<u8" if d == "<u4" else d) for k, d in self.columns.items()}
        shards = self.shard_of(keys)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b or (at := self.shard(int(shards[a]))) is None:
                continue
            there, values = at
            own, i = np.arange(a, b), np.searchsorted(there, keys[a:b])
            while len(own):  # once, and again for keys that go on with another row
                ok = i < len(there)
                ok[ok] = there[i[ok]] == keys[own[ok]]
                own, i = own[ok], i[ok]
                hit = np.ones(len(own), bool)
                for k, want in same.items():
                    hit &= values[k][i] == want[own]
                found[own[hit]] = True
                for k in out:
                    out[k][own[hit]] = values[k][i[hit]]
                own, i = own[~hit], i[~hit] + 1
        for j, (k, d) in enumerate(self.columns.items()):
            if d == "<u4" and len(at := np.flatnonzero(out[k] >= self.LIMIT)):
                out[k][at] = self.large().find(keys[at], {"column": np.full(len(at), j, np.uint64)})[1]["value"]
        return found, out


def bits_for(rows: float, a_shard: int) -> int:
    """How many top bits split so many rows into shards of about a_shard."""
    return max(0, int(np.ceil(np.log2(max(1.0, rows / a_shard)))))
