"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (a line with something in it) is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane, modulo a power of two. So the order of paragraphs does not matter,
and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts. The equality lanes (modulo 2**64) come from a cryptographic hash of the paragraph:
fingerprints agree there just if the multisets of paragraphs do, but for chance. The likeness lanes (modulo
2**32) are the sum of a vector of signs for each run of words within the paragraph: lane products estimate
how many runs two documents share, so likeness can be read from two fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops

EQUALITY, LIKENESS, RUN = 16, 256, 3
_STEP = np.uint64(0x9FB21C651E98DF25)


class Vector:
    """A fingerprint: vectors of paragraphs can be added to it and taken away."""

    def __init__(self, equality: np.ndarray | None = None, likeness: np.ndarray | None = None):
        self.equality = np.zeros(EQUALITY, np.uint64) if equality is None else equality
        self.likeness = np.zeros(LIKENESS, np.uint32) if likeness is None else likeness

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.equality + other.equality, self.likeness + other.likeness)

    def __sub__(self, other: Vector) -> Vector:
        return Vector(self.equality - other.equality, self.likeness - other.likeness)

    def text(self) -> str:
        return self.equality.tobytes().hex() + self.likeness.tobytes().hex()

    @staticmethod
    def parse(text: str) -> Vector:
        raw = bytes.fromhex(text)
        return Vector(np.frombuffer(raw[: 8 * EQUALITY], np.uint64), np.frombuffer(raw[8 * EQUALITY :], np.uint32))

    def like(self, other: Vector) -> float:
        """Estimated share of word runs in common, 0 to 1; 1 for equal fingerprints."""
        if np.array_equal(self.equality, other.equality):
            return 1.0
        a, b = (x.likeness.view(np.int32).astype(np.float64) for x in (self, other))
        size = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / size))) if size else 0.0


def _paragraphs(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Paragraphs of all texts, and where each text's begin (one entry more than texts)."""
    found = [[p for p in t.split("\n") if p.strip()] for t in texts]
    return [p for own in found for p in own], np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Column sums of the rows between neighbouring places of ``at``."""
    out = np.zeros((len(at) - 1, values.shape[1]), values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


def vectors(texts: list[str]) -> list[Vector]:
    """Fingerprints of whole texts."""
    paragraphs, at = _paragraphs(texts)
    sums = np.array([np.frombuffer(hashlib.shake_128(p.encode()).digest(8 * EQUALITY), np.uint64) for p in paragraphs], np.uint64).reshape(-1, EQUALITY)
    equality = _sums(sums, at)
    data, offsets = textops.utf8(pa.array(paragraphs, pa.large_string()))
    starts, ends, first = textops.spans(data, offsets, textops.SPACE_SEPARATED)
    words = textops.hashes(data, starts, ends)
    # a run of RUN words within one paragraph, or all words of a shorter one
    h, paragraph_end = np.zeros(len(words), np.uint64), np.repeat(first[1:], np.diff(first))
    place = np.arange(len(words))
    for j in range(RUN):
        inside = place + j < paragraph_end
        h[inside] = h[inside] * _STEP + words[place[inside] + j]
    short = np.repeat(np.diff(first) < RUN, np.diff(first))
    begins = np.zeros(len(words), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    own = np.flatnonzero((place + RUN <= paragraph_end) | (short & begins))
    h = h[own]
    run_at = np.searchsorted(own, first[at])
    likeness = np.zeros((len(texts), LIKENESS), np.uint32)
    step = max(1, 4_000_000 // LIKENESS)
    for a in range(0, len(h), step):  # signs of a bounded number of runs at a time
        part = h[a : a + step]
        bits = np.stack([textops.mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(LIKENESS // 64)], axis=1)
        signs = np.unpackbits(bits.view(np.uint8), axis=1)
        where = np.clip(run_at - a, 0, len(part))
        counts = np.diff(where)
        for k in np.flatnonzero(counts).tolist():
            ones = signs[where[k] : where[k + 1]].sum(axis=0, dtype=np.int64)
            likeness[k] += (2 * ones - counts[k]).astype(np.uint32)
    return [Vector(equality[k], likeness[k]) for k in range(len(texts))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` (hex) to rows with a ``text``; a null or blank text has the zero fingerprint.

    Rows keep their other columns, whatever their names; a column named like the result is replaced, repeated rows are handled
    each, a text of any length is read whole, and an empty table gives no rows.
    """
    docs = docs.drop("fingerprint")

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for a, b in textops.pieces([batch], len(batch), 256):
                out += [v.text() for v in vectors([x or "" for x in batch.slice(a, b - a).to_pylist()])]
            yield pa.array(out, pa.string())

    return docs.withColumn("fingerprint", F.arrow_udf(run, "string")("text"))


def changed(before: Vector, old: list[str], new: list[str]) -> Vector:
    """The fingerprint after some paragraphs were replaced by others, from the change alone."""
    both = vectors(["\n".join(old), "\n".join(new)])
    return before - both[0] + both[1]


def _cut(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``bucket``, of about ``n`` that hold as many rows each: they count up as doc_id goes down, and null ones come last.

    Cuts are quantiles of doc_id, so one that lies far off moves nothing; null doc_ids are cut by the hash of their text.
    """
    rows, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 and known else None
    cuts = sorted(set(cuts or ()), reverse=True)
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda values: F.array(*map(F.lit, values)).cast(T.ArrayType(docs.schema["doc_id"].dataType))
    above = lambda values: F.size(F.filter(values, lambda c: c > F.col("doc_id")))  # noqa: E731  how many cuts are larger
    coarse = above(literal(cuts[::step])) - 1
    bucket = F.when(coarse < 0, 0).otherwise(coarse * step + above(F.slice(literal(cuts), coarse * step + 1, F.lit(step))))
    parts = max(1, -(-n * (rows - known) // max(1, rows)))
    last = F.least(F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), n + last).otherwise(bucket).cast("int"))


def edit_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of each one's edited text, and their likenesses.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document, in descending doc_id; after the last comes the first. Its fingerprint is
    made from the document's by taking away the paragraphs from the cut on and adding the new ones. A null text is
    empty; one of any length is handled whole. Rows with equal doc_ids follow one another ordered by the hash of the text and
    then by the text, and are one task's; null doc_ids come last, a single row is its own next, an empty table gives no rows.
    Columns other than doc_id and text are dropped.

    Rows are dealt once, by ranges of doc_id; a bucket also gets a copy of the first rows of the bucket that
    follows, so each row's next one is at hand and no range waits for another.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _cut(docs, n).withColumn("place", F.struct("doc_id", F.bitwise_not("h").alias("h")))
    heads = dealt.groupBy("bucket").agg(F.max("place").alias("head"))  # a row a bucket
    up = Window.orderBy("bucket")
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(up), F.max("bucket").over(Window.partitionBy())))
    dealt = dealt.join(F.broadcast(heads), "bucket", "left")
    here, extra = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("b"), F.lit(True).alias("extra"))
    copies = F.when(F.col("place").eqNullSafe(F.col("head")), F.array(here, extra)).otherwise(F.array(here))
    dealt = dealt.withColumn("to", F.explode(copies)).select("doc_id", "text", "h", F.col("to.b").alias("bucket"), F.col("to.extra").alias("extra"))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "h", "text").drop("h")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(x, T.DoubleType()) for x in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in textops.small_batches(batches, 256):
            rows = waiting + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "extra")), strict=True))
            waiting = rows[-1:]
            pairs = [(r, s) for r, s in zip(rows, rows[1:], strict=False) if r[2] == s[2] and not r[3]]
            if pairs:
                yield _edited(pairs, schema)

    return dealt.mapInArrow(run, schema)


def _edited(pairs: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    cut, prefixes, old, new, sha = [], [], [], [], []
    for (_, text, *_), (_, following, *_) in pairs:
        k = len(text) // 3
        keep = text[: len(text) - k]
        edited = keep + following[:k]
        sha.append(hashlib.sha256(edited.encode("utf-8")).hexdigest())
        line = keep.rfind("\n") + 1  # paragraphs before the one that is cut stay as they are
        old.append(text[line:])
        new.append(edited[line:])
        prefixes.append(text[:line])
        cut.append(len(text))
    kept, gone, come = vectors(prefixes), vectors(old), vectors(new)
    base = [a + b for a, b in zip(kept, gone, strict=True)]
    edited = [v - g + c for v, g, c in zip(base, gone, come, strict=True)]
    last = vectors([pairs[-1][1][1]])[0]
    following = []
    for k, (_, s) in enumerate(pairs):
        same = k + 1 < len(pairs) and pairs[k + 1][0] is s
        following.append(base[k + 1] if same else last if k + 1 == len(pairs) else vectors([s[1]])[0])
    columns = [
        [r[0] for r, _ in pairs],
        cut,
        sha,
        [v.text() for v in base],
        [v.text() for v in edited],
        [v.like(e) for v, e in zip(base, edited, strict=True)],
        [v.like(f) for v, f in zip(base, following, strict=True)],
    ]
    kinds = [pa.int64() if schema["doc_id"].dataType == T.LongType() else None, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)
