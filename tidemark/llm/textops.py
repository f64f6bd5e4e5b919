"""Vectorised text helpers that several operators share.

Texts arrive as Arrow string arrays. Words are found and hashed on the whole UTF-8 buffer with numpy, so the
cost of a word is a few array operations, not a Python call. Word patterns here only tell ASCII bytes apart,
so a byte scan finds the same words as a code-point scan.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte classes: True where the byte belongs to a word.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

try:
    _libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    _libc.malloc_trim  # noqa: B018  other C libraries have none
except (OSError, AttributeError):
    _libc = None

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased (A-Z) bytes of all texts, and where each begins; nulls are empty."""
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _TO_LOWER[data], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of a byte class begin and end, and each text's first word (one entry more than texts)."""
    word = kind[data]
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before = np.empty_like(word)
    before[1:], before[:1] = word[:-1], False
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1], after[-1:] = word[1:], False
    after[last] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial modulo 2**64. Works in chunks of about 1 MB."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    powers, inverses = _powers(_CHUNK)
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        n = int(ends[j - 1] - base)
        if n > len(powers):  # one span longer than a chunk
            powers, inverses = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(seed + 1)) * powers[:n], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _tables:
        one = np.ones(1, np.uint64)
        made = tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, _BASE_INVERSE))
        if n != _CHUNK:
            return made
        _tables[n] = made
    return _tables[n]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and few bytes of text, so what is computed from them stays small.

    A row is never cut: a text longer than ``size`` bytes comes by itself.
    """
    for batch in batches:
        for a, b in pieces([c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)], batch.num_rows, rows, size):
            yield batch.slice(a, b - a)
        release()


def release() -> None:
    """Gives memory that is free back to the system, which numpy's and Arrow's allocators would keep in idle workers."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch that goes to Python, for the jobs that run meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def pieces(texts: list[pa.Array], n: int, rows: int = 1024, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive pieces of ``n`` rows, of at most ``rows`` rows and about ``size`` bytes of ``texts``."""
    import pyarrow.compute as pc

    ends = np.zeros(n, np.int64)
    for t in texts:
        ends += np.cumsum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < n:
        before = ends[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, before + size, "right"))), n)
        yield a, b
        a = b
