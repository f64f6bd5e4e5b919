"""A quality classifier by co-training.

Two logistic models look at a document through separate views: the words, characters and layout of its text, and its
page metadata (source, language and recorded length), which are no function of what is written. Both start from the labelled rows. In each round
either model labels a pool of unlabelled rows, and the rows that it is most sure of teach the other one. The
scores of both are calibrated on labelled rows set aside, and their log odds are added to score all documents.

Fitting uses a sample of documented bounds (``labelled`` and ``pool`` rows, by hash of doc_id); its features,
of fixed width, are computed by the executors and only they reach the driver. Scoring is one map over all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops

GRAMS, LAYOUT, META = 1024, 32, 96
CONTENT = GRAMS + LAYOUT
MADE = ("quality_content", "quality_metadata", "quality_score", "quality_keep")


def content_features(texts: pa.Array) -> np.ndarray:
    """What is written, and how it is laid out."""
    return np.concatenate([gram_features(texts), layout_features(texts)], axis=1)


def gram_features(texts: pa.Array) -> np.ndarray:
    """Hashed byte 1- to 3-grams and words of each text, as the root of their shares: lengths don't matter."""
    import pyarrow.compute as pc

    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    lower, offsets = textops.utf8(texts)
    # the shape of what is written counts here, so case is kept for the grams
    raw = np.frombuffer(b"".join(x.encode() for x in whole.to_pylist()), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = np.zeros(len(texts) * GRAMS)
    third = GRAMS // 4
    code, place, end = raw.copy(), np.arange(len(raw)), np.repeat(offsets[1:], np.diff(offsets))
    for k in range(3):
        own = place + k < end  # grams that end within their text
        cell = (textops.mix(code[own] + np.uint64(k << 40)) % np.uint64(third)).astype(np.int64) + k * third
        out += np.bincount(row[own] * GRAMS + cell, minlength=len(out))
        n = max(0, len(raw) - k - 1)
        code[:n] = (code[:n] << np.uint64(8)) | raw[len(raw) - n :]
    starts, ends, first = textops.spans(lower, offsets, textops.SPACE_SEPARATED)
    words = textops.hashes(lower, starts, ends)
    word_row = np.repeat(np.arange(len(texts)), np.diff(first))
    out += np.bincount(word_row * GRAMS + 3 * third + (words % np.uint64(third)).astype(np.int64), minlength=len(out))
    out = out.reshape(len(texts), 4, third)
    return np.sqrt(out / np.maximum(1, out.sum(axis=2, keepdims=True))).reshape(len(texts), GRAMS).astype(np.float32)


def layout_features(texts: pa.Array) -> np.ndarray:
    """Shares of kinds of bytes, of upper case and of repeated lines, and lengths of words and lines."""
    n = len(texts)
    lower, offsets = textops.utf8(texts)
    out = np.zeros((n, LAYOUT), np.float32)
    size = np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    original = [x or "" for x in texts.to_pylist()]
    kinds = np.zeros(256, np.int64)  # 0 other, 1 letters and beyond ASCII, 2 digits, 3 white space, 4 signs
    kinds[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    kinds[[*range(0x30, 0x3A)]] = 2
    kinds[[0x20, *range(0x09, 0x0E)]] = 3
    kinds[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
    share = np.bincount(row * 5 + kinds[lower], minlength=5 * n).reshape(n, 5) / np.maximum(1, size)[:, None]
    starts, ends, first = textops.spans(lower, offsets, textops.SPACE_SEPARATED)
    words = np.diff(first)
    lines = [x.split("\n") for x in original]
    n_lines = np.array([len(x) for x in lines])
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    upper = np.array([sum(map(str.isupper, x)) for x in original]) / np.maximum(1, size)
    out[:, 1:6] = share
    out[:, 6] = upper
    out[:, 7] = repeated
    for k, x in enumerate((size, words, n_lines, size / np.maximum(1, words), size / n_lines)):
        out[:, 8 + k] = np.log1p(x) / 5
    out[:, 14:19] = _steps(share[:, 4], (0.02, 0.05, 0.1, 0.2, 0.4))
    out[:, 19:23] = _steps(upper, (0.05, 0.1, 0.3, 0.6))
    out[:, 23:26] = _steps(repeated, (0.05, 0.2, 0.5))
    out[:, 26:29] = _steps(share[:, 2], (0.02, 0.1, 0.3))
    return out


def _steps(x: np.ndarray, limits: tuple) -> np.ndarray:
    """Coarse steps, with which a linear model can bend."""
    return np.stack([x > t for t in limits], axis=1)


def metadata_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """Hashed source and language, and the recorded length."""
    out = np.zeros((len(sources), META), np.float32)
    for k, (s, x) in enumerate(zip(sources, langs, strict=True)):
        out[k, 32 + zlib.crc32(str(s).encode()) % 32] = 1
        out[k, 64 + zlib.crc32(str(x).encode()) % 32] = 1
    length = np.log1p(np.array([max(0, x or 0) for x in lengths], np.float64))
    out[:, 0] = length / 5
    out[:, 1:13] = _steps(length, tuple(range(2, 14)))
    out[:, 13] = [x is None for x in lengths]
    return out


class Logistic:
    """Logistic regression with L2, by Newton steps on conjugate gradients; deterministic."""

    def __init__(self, strength: float = 1.0):
        self.strength = strength

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        """``x`` has a last column of ones. Rows of weight 0 count for nothing, so a part needs no copy."""
        w = np.zeros(x.shape[1], x.dtype)
        y, weight = y.astype(x.dtype), weight.astype(x.dtype)
        ridge = np.full(len(w), self.strength, x.dtype)
        ridge[-1] = 1e-6
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - y)) + ridge * w
            h = weight * np.maximum(p * (1 - p), 1e-6)
            step, r = np.zeros_like(w), g.copy()
            d, rr = r.copy(), r @ r
            for _ in range(20):
                hd = x.T @ (h * (x @ d)) + ridge * d
                a = rr / max(d @ hd, 1e-30)
                step += a * d
                r -= a * hd
                new = r @ r
                if new < 1e-10 * (g @ g + 1e-30):
                    break
                d, rr = r + new / rr * d, new
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows without the column of ones."""
        return x @ self.w[:-1] + self.w[-1]


def _sure(odds: np.ndarray, free: np.ndarray, share: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The surest free pool rows of each class, in the classes' proportion."""
    at = np.flatnonzero(free)
    order = at[np.argsort(odds[at], kind="stable")]
    n = max(1, int(share * len(at)))
    bad = order[: max(1, round(n * (1 - rate)))]
    good = order[::-1][: max(1, round(n * rate))]
    return bad[odds[bad] < -2], good[odds[good] > 2]


class CoTrained:
    """Both models and their calibration."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, rounds: int = 3):
        """``views`` hold all rows of the sample with a last column of ones, labelled or not; ``y`` is 0, 1 or,
        where there is no label, NaN."""
        self.trivial = None
        labelled = np.flatnonzero(~np.isnan(y))
        own = y[labelled]
        if len(own) < 8 or len(set(own.tolist())) < 2:
            self.trivial = float(np.mean(own)) if len(own) else 0.5
            return
        held = labelled[3::4]  # rows come in hash order
        rate = float(own.mean())
        start = ~np.isnan(y)
        start[held] = False
        pool = np.isnan(y)
        taught = [{}, {}]
        for k in range(rounds + 1):
            models = []
            for v in range(2):
                labels, weight = np.where(start, y, 0.0), start.astype(np.float64)
                for row, label in taught[v].items():
                    labels[row], weight[row] = label, 0.5
                models.append(Logistic().fit(views[v], labels, weight))
            if k == rounds or not pool.any():
                break
            for v in range(2):
                free = pool.copy()
                free[list(taught[1 - v])] = False
                bad, good = _sure(views[v] @ models[v].w, free, 0.15, rate)
                taught[1 - v] |= dict.fromkeys(bad.tolist(), 0.0) | dict.fromkeys(good.tolist(), 1.0)
        self.models, self.prior = models, np.log(rate / (1 - rate))
        # Platt scaling of each view on the rows set aside
        ones = np.ones(len(held))
        self.scale = [Logistic(0.01).fit(np.stack([views[v][held] @ models[v].w, ones], axis=1), y[held], ones).w for v in range(2)]

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probabilities of good quality: by content, by metadata, by both."""
        if self.trivial is not None:
            return np.full((len(content), 3), self.trivial)
        a, b = (np.clip(m.odds(x.astype(np.float32)) * s[0] + s[1], -30, 30) for m, x, s in zip(self.models, (content, meta), self.scale, strict=True))
        return 1 / (1 + np.exp(-np.clip(np.stack([a, b, a + b - self.prior], axis=1), -30, 30)))


def _features(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` columns and both views of each row as bytes."""
    fields = [docs.schema[c] for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.small_batches(batches, size=1 << 19):
            c, m = _views(batch)
            columns = [batch.column(x) for x in extra]
            columns += [pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary()) for v in (c, m)]
            yield pa.RecordBatch.from_arrays(columns, names=[*extra, "content", "meta"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("content", T.BinaryType()), T.StructField("meta", T.BinaryType())]))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return content_features(batch.column("text")), metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _length(docs: DataFrame) -> Column:
    """The length on the page's record; where there is no such column, that of the text."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.length("text")).cast("long").alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 5000, pool: int = 5000, rounds: int = 3) -> CoTrained:
    """Fits on at most about ``labelled`` rows with a quality label and ``pool`` rows without one, both chosen by hash.

    ``docs`` has doc_id, text, source and lang, and n_chars unless the text's length is to stand for it; a null in any of them
    is a value of its own, a null doc_id teaches nothing. Of several labels of a doc_id the largest counts, and every row of that
    doc_id has it; texts of any length are read whole. Empty tables, and labels of one kind or fewer than eight, give a model that
    knows only their share. Other columns are ignored.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n_labels, n_docs = one.count(), docs.count()
    part = lambda most, n: place < int((1 << 30) * min(1.0, most / max(1, n)))
    chosen = one.where(part(labelled, n_labels))  # a bounded number of ids
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "source", "lang", _length(docs))
    near = rows.join(F.broadcast(chosen), "doc_id", "left")
    near = near.where(F.col("quality").isNotNull() | (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, pool / max(1, n_docs)))))
    found = _features(near.select("doc_id", "text", "source", "lang", "n_chars", "quality").withColumn("quality", F.col("quality").cast("double")), ["doc_id", "quality"])
    with textops.arrow_rows(docs.sparkSession):
        got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "content", "meta").toArrow()

    y = np.array([np.nan if x is None else float(x > 0) for x in got["quality"].to_pylist()])

    def view(name: str, width: int) -> np.ndarray:
        out = np.ones((len(y), width + 1), np.float32)
        at = 0
        for chunk in got[name].chunks:  # a batch at a time, so that there is one copy
            for x in chunk:
                out[at, :width] = np.frombuffer(x.as_buffer(), np.float16)
                at += 1
        return out

    return CoTrained((view("content", CONTENT), view("meta", META)), y, rounds)


def score(docs: DataFrame, model: CoTrained, keep_from: float = 0.5) -> DataFrame:
    """Adds quality_content, quality_metadata, quality_score (probabilities) and quality_keep (score >= keep_from).

    ``docs`` has text, source and lang, and n_chars unless the text's length is to stand for it; null ones count as a value of
    their own, a null text as an empty one, and a text of any length is read whole. Every row is scored, repeated ones and ties
    alike; other columns stay, whatever their names, columns named like the results are replaced, and an empty table gives no rows. Where the labels have fewer than two kinds, every row gets their share.
    """
    names = [c for c in docs.columns if c not in MADE]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in parts:
            out = []
            for a, b in textops.pieces([columns[0]], len(columns[0]), size=1 << 19):
                c, m = _views(pa.RecordBatch.from_arrays([x.slice(a, b - a) for x in columns], names=["text", "source", "lang", "n_chars"]))
                out.append(shared.value.scores(c.astype(np.float16), m.astype(np.float16)))
            both = np.concatenate(out) if out else np.zeros((0, 3))
            yield pa.StructArray.from_arrays([pa.array(both[:, k]) for k in range(3)], names=["c", "m", "b"])
            textops.release()

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # one column, so no name can clash
    scored = docs.select(row, F.arrow_udf(run, "c double, m double, b double")("text", "source", "lang", _length(docs)).alias("q"))
    made = [F.col(f"q.{k}").alias(name) for k, name in zip("cmb", MADE, strict=False)]
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *made, (F.col("q.b") >= keep_from).alias(MADE[3]))
