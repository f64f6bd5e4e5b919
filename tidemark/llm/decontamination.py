"""Benchmark decontamination with a broadcast set of n-grams.

The benchmark's windows (``n`` consecutive words of an item; an item of fewer words is one window) are hashed
into a table that every executor holds. Training texts are scanned once: words are found and hashed on the
byte buffer, a window is looked up only where all its words occur in the benchmark, and every hit is verified
word by word, so a hash collision can't mark anything. There is no shuffle.

The table's size is checked before it is broadcast. A benchmark beyond ``block_bytes`` of text is dealt into
blocks of that size, and the texts are scanned once for each block, with a checkpoint between scans so that
only one block is held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops

MADE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_STEP = np.uint64(0x9FB21C651E98DF25)


def _window_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` word hashes from each place of ``at`` on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _STEP + words[at + j]
    return textops.mix(out)


class Windows:
    """The windows of one block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        data, offsets = textops.utf8(pa.array([t for _, t in items], pa.large_string()))
        starts, ends, first = textops.spans(data, offsets, textops.ALNUM)
        words = textops.hashes(data, starts, ends)
        raw = data.tobytes()
        self.vocabulary = np.unique(words)
        self.lookup: dict[int, np.ndarray] = {}
        self.items: dict[bytes, set[str]] = {}
        found: dict[int, set[int]] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            size = min(n, b - a)
            if size == 0:
                continue
            at = np.arange(a, b - size + 1)
            found.setdefault(size, set()).update(_window_hash(words, at, size).tolist())
            own = [raw[i:j] for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            for i in range(len(at)):
                self.items.setdefault(b" ".join(own[i : i + size]), set()).add(item)
        for size, hashes in found.items():
            self.lookup[size] = np.array(sorted(hashes), np.uint64)

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie in a window, and the items found, by text."""
        hit, items = np.zeros(len(starts), bool), {}
        if not len(starts) or not len(self.vocabulary):
            return hit, items
        words = textops.hashes(data, starts, ends)
        near = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.concatenate([[0], np.cumsum(self.vocabulary[near] == words)])
        text_end = np.repeat(first[1:], np.diff(first))
        raw = None
        for size, table in self.lookup.items():
            at = np.arange(len(starts) - size + 1)
            at = at[(known[size:] - known[:-size] == size) & (at + size <= text_end[: len(at)])]
            if not len(at):
                continue
            h = _window_hash(words, at, size)
            at = at[table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h]
            for i in at.tolist():
                raw = raw or data.tobytes()
                got = self.items.get(b" ".join(raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)))
                if got:
                    hit[i : i + size] = True
                    items.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(got)
        return hit, items


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """A text without its runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    kept, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return (b"".join(kept) + raw[at:]).decode()


def _scanned(docs: DataFrame, shared, mode: str, held: tuple[str, str], again: bool, last: bool) -> DataFrame:
    """One scan: ``again`` starts from what an earlier block found and holds in two columns, ``last`` gives the results."""
    base = [f for f in docs.schema.fields if f.name not in held]
    state = [T.StructField(held[0], T.BinaryType()), T.StructField(held[1], T.ArrayType(T.StringType()))]
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in textops.small_batches(batches):
            texts = batch.column("text")
            data, offsets = textops.utf8(texts)
            starts, ends, first = textops.spans(data, offsets, textops.ALNUM)
            hit, items = windows.scan(data, starts, ends, first)
            rows = range(batch.num_rows)
            if again:
                for k, (mask, had) in enumerate(zip(batch.column(held[0]).to_pylist(), batch.column(held[1]).to_pylist(), strict=True)):
                    hit[first[k] : first[k + 1]] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=first[k + 1] - first[k]).astype(bool)
                    if had:
                        items.setdefault(k, set()).update(had)
            columns = [batch.column(f.name) for f in base]
            if not last:
                columns += [pa.array([np.packbits(hit[first[k] : first[k + 1]]).tobytes() for k in rows], pa.binary()), pa.array([sorted(items.get(k, ())) for k in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*base, *state)])
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            if mode == "spans" and n_hit.any():
                new = texts.to_pylist()
                for k in np.flatnonzero(n_hit).tolist():
                    a, b = first[k], first[k + 1]
                    new[k] = _without(new[k].encode(), starts[a:b] - offsets[k], ends[a:b] - offsets[k], hit[a:b])
                columns[[f.name for f in base].index("text")] = pa.array(new, pa.string())
            columns += [
                pa.array(np.diff(first), pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(items.get(k, ())) for k in rows], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(items.get(k, ()))).encode()).hexdigest() for k in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*base, *made)])

    return docs.mapInArrow(run, T.StructType([*base, *(made if last else state)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "report", block_bytes: int = 16 << 20) -> DataFrame:
    """Finds passages of ``benchmark`` (item_id, text) in ``docs`` (with a ``text`` column).

    Adds n_words, n_hit (words inside any occurrence of a window), n_items (distinct item ids with occurring
    windows), items_sha256 (of those ids as strings, sorted and joined by commas) and contaminated. ``mode``:
    "report" returns every row as it is, "documents" only rows without a hit, "spans" every row with the runs
    of hit words cut from its text.

    A-Z count as a-z; words are runs of other characters than ASCII ones that are no letter or digit. A null
    or empty text has no words and is clean; so is an item with no words. A text of any length is scanned whole, texts are taken
    up by about a million bytes at a time. Repeated rows and item ids are
    handled as they come (items with equal ids count once; a null id reads "null"), an empty benchmark marks
    nothing, other columns stay, whatever their names, and columns named like the results are replaced.
    """
    if mode not in ("report", "documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = docs.sparkSession
    docs = docs.drop(*MADE)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // block_bytes))
    longest = max(map(len, docs.columns))
    held = tuple(f"{x}_{'_' * longest}" for x in ("words", "items"))  # no column has such a name
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        own = items.where(block == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(Windows([(r["item_id"], r["text"]) for r in own.toLocalIterator()], n))
        docs = _scanned(docs, shared, mode, held, again=k > 0, last=k == blocks - 1)
        if k < blocks - 1:
            docs = docs.checkpoint()
            shared.unpersist()
    docs = docs.withColumn("contaminated", F.col("n_hit") > 0)
    return docs.where(~F.col("contaminated")) if mode == "documents" else docs
