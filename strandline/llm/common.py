"""Scratch tables in the shared folder, and vectorised text kernels over Arrow buffers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the kernels work on at a time (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20


#: Scratch objects of this process whose tables are not removed, in order.
MADE: list = []


def sweep(after) -> None:
    """Removes the tables of all Scratch objects made after another, once nothing is left that reads them."""
    while MADE and MADE[-1] is not after:
        MADE.pop().keep()


class Scratch:
    """Tables written below ``spark.checkpoint.dir``: they cut lineage and outlive executors.

    The folder is read from the session. Only in local mode, where it may be unset as in tests, is one made;
    on a cluster an unset folder is an error, as a machine's own folder is not seen by the others.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names = spark, set()
        base, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
        if not base and not held.isDefined():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base or held.get()
        self.root = f"{base.rstrip('/')}/t{uuid.uuid4().hex}"
        MADE.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Removes all tables but these, which the frame that is returned still reads."""
        for name in self.names - set(names):
            self.drop(name)


def once(key, make):
    """What ``make`` returns, kept for the life of a Python worker (functions travel by value, modules do not)."""
    held = sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def release() -> None:
    """Gives freed memory back to the system: workers are kept between stages, and so is what they hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = once("libc", lambda: ctypes.CDLL(None))
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and each row's start and end; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return raw, starts, ends


def chunks(starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose text is at most ``limit`` bytes, or one row."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        yield i, min(j, n)
        i = min(j, n)


def byte_class(words: str) -> np.ndarray:
    """Table of the bytes that words are made of."""
    table = np.ones(256, bool)
    if words == "space":  # [^\x20\x09-\x0D]
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], over lower-cased text
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


class WordHasher:
    """Hashes of the words of many texts at once: a polynomial over bytes, A-Z read as a-z."""

    BASE = 0x9E6C63D0876A3F35

    def __init__(self, words: str) -> None:
        self.table = byte_class(words)
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = odd_constants(256, 11)[lower]
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + 1)
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(self.size, b, np.uint64)]) for b in (self.BASE, inverse))

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(hash, first byte, end byte) of each word, and the number of words of each row."""
        low, high = int(starts[0]), int(ends.max())
        data, starts, ends = raw[low:high], starts - low, ends - low
        if high <= low:
            empty = np.zeros(0, np.int64)
            return empty.astype(np.uint64), empty, empty, np.zeros(len(starts), np.int64)
        self._powers(len(data))
        inside = self.table[data]
        live = ends > starts
        before = np.r_[False, inside[:-1]]
        before[starts[live]] = False
        after = np.r_[inside[1:], False]
        after[ends[live] - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64)
        total = np.r_[np.uint64(0), total]
        h = mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        count = np.searchsorted(first, ends) - np.searchsorted(first, starts)
        return h, first + low, last + low, np.where(live, count, 0)
