"""Language identification of mixed-language text.

Each word is scored for every language by a naive Bayes model of its character 1- to 3-grams. The word's
script, told by code-point ranges, first narrows the languages to those that were seen with that script. Then a
Viterbi pass over the words of a text, with a penalty for each switch, labels spans of one language. A
document's language is the one whose spans hold most letters.

The model is a table of n-gram counts by language over all training documents. Counts are made in each task
with numpy, added up by language and cell in one aggregation of bounded size (cells x languages), and
broadcast as a table of float32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops

CELLS = 1 << 16

#: Code-point ranges of scripts (fixed values of the Unicode blocks): first, last, script.
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x1E00, 0x1EFF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x3040, 0x309F, "kana"),
    (0x30A0, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
)
NAMES = ["other", *dict.fromkeys(s for *_, s in SCRIPTS)]

_held: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script."""
    if "letter" not in _held:
        n = 0x110000
        _held["letter"] = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        lower = np.arange(n, dtype=np.uint32)
        for i in np.flatnonzero(_held["letter"]).tolist():
            x = chr(i).lower()
            if len(x) == 1:
                lower[i] = ord(x)
        _held["lower"] = lower
        script = np.zeros(n, np.uint8)
        for a, b, name in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        _held["script"] = script
    return _held["letter"], _held["lower"], _held["script"]


class Words:
    """The words (runs of letters) of a batch of texts and their n-gram cells."""

    def __init__(self, texts: list[str | None]):
        letter, lower, script = _tables()
        texts = [t or "" for t in texts]
        code = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter[code] if len(code) else np.zeros(0, bool)
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.letters = self.ends - self.starts
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, begin)
        self.script = script[code[self.starts]] if len(self.starts) else np.zeros(0, np.uint8)
        # letters in a row with a zero around each word
        at = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(self.starts)), self.letters)
        padded = np.zeros(len(at) + len(self.starts) + 1, np.uint64)
        self.place = np.arange(len(at)) + word + 1
        padded[self.place] = lower[code[at]]
        before, here, after = padded[self.place - 1], padded[self.place], padded[self.place + 1]
        k, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
        self.cells = [
            ((here * k) >> shift).astype(np.int64),
            (((before << np.uint64(21) | here) * k + np.uint64(1 << 50)) >> shift).astype(np.int64),
            ((((before << np.uint64(21) | here) << np.uint64(21) | after) * k + np.uint64(1 << 51)) >> shift).astype(np.int64),
        ]
        self.word_at = np.concatenate([[0], np.cumsum(self.letters)]).astype(np.int64)


def fit(docs: DataFrame, most: int = 128) -> dict:
    """The model of all ``docs`` with a text and a lang: languages, log probabilities by cell, scripts by language.

    A language takes some 2 MB on the driver and in every worker, so more than ``most`` different values of lang raise an
    error: such a column holds something else. Repeated rows count each, texts of any length count whole, an empty table
    gives a model without languages; other columns are ignored.
    """
    kinds = docs.where("text IS NOT NULL AND lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).count()
    if kinds > most:
        raise ValueError(f"more than {most} different values of lang; clean the column first")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in textops.small_batches(batches, size=1 << 20):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                w = Words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                own = cells.setdefault(lang, np.zeros(3 * CELLS, np.int64))
                for k, c in enumerate(w.cells):
                    own[k * CELLS : (k + 1) * CELLS] += np.bincount(c, minlength=CELLS)
                scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))[:] += np.bincount(w.script, minlength=len(NAMES))
        for lang, own in cells.items():
            own = np.concatenate([own, scripts[lang]])
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "cell", "n"])

    seen = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, cell int, n long")
    rows = seen.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].unique().to_pylist()))
    counts = np.zeros((len(langs), 3 * CELLS + len(NAMES)))
    if langs:
        index = {x: k for k, x in enumerate(langs)}
        counts[[index[x] for x in rows["lang"].to_pylist()], rows["cell"].to_numpy()] = rows["n"].to_numpy()
    grams = counts[:, : 3 * CELLS].reshape(len(langs), 3, CELLS)
    log = np.log((grams + 0.05) / (grams.sum(axis=2, keepdims=True) + 0.05 * CELLS))
    script = counts[:, 3 * CELLS :]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.nan_to_num(script / script.sum(axis=1, keepdims=True))
    allowed = share >= 0.001
    return {"langs": langs, "log": np.ascontiguousarray(log.transpose(1, 2, 0), np.float32), "allowed": allowed}


def word_scores(w: Words, model: dict) -> np.ndarray:
    """Log scores of each word (row) for each language, none but the candidates of its script."""
    n = len(model["langs"])
    total = np.zeros((len(w.place), n), np.float32)
    for k, c in enumerate(w.cells):
        total += model["log"][k][c]
    scores = np.add.reduceat(total, w.word_at[:-1], axis=0) if len(w.starts) else np.zeros((0, n), np.float32)
    candidates = model["allowed"][:, w.script].T
    candidates[~candidates.any(axis=1)] = True  # a script that no language was seen with tells nothing
    # three n-grams a letter overlap, so a third of their sum is nearer to a word's evidence
    return np.where(candidates, scores / 3, scores.min(axis=1, keepdims=True) / 3 - 20 if n else scores).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, by text; ``first`` has each text's first word. All texts advance together."""
    n = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], first[:-1][order]
    if not len(length) or not length[0] or n < 2:
        return labels
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # texts with more than t words
    switch = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int16)
    value = np.zeros((len(length), n), np.float32)
    for t in range(int(length[0])):
        m = live[t]
        at = begin[:m] + t
        v = value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top][:, None] - penalty if t else v
        s = jump > v
        switch[at], best_before[at] = s, top
        value[:m] = np.maximum(v, jump) + scores[at]
    label = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        own = label[:m]
        labels[at] = own
        label[:m] = np.where(switch[at, own], best_before[at], own)
    return labels


def spans(text: str, model: dict, penalty: float = 4.0) -> list[tuple[int, int, str]]:
    """Labelled spans of one text: first and last code point (end exclusive) and language."""
    w = Words([text])
    labels = viterbi(word_scores(w, model), w.first, penalty)
    out: list[tuple[int, int, str]] = []
    for a, b, x in zip(w.starts.tolist(), w.ends.tolist(), labels.tolist(), strict=True):
        lang = model["langs"][x]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], b, lang)
        else:
            out.append((a, b, lang))
    return out


def identify(docs: DataFrame, model: dict, penalty: float = 4.0) -> DataFrame:
    """Adds lang_pred, score and lang_spans to rows with a ``text``.

    lang_pred is the language whose spans hold most letters (the first by name among equals), or ``und`` where
    the text is null or has no letter, or nothing was learned; score is that share of letters, 0 for ``und``.
    lang_spans lists the spans as (start, end, lang) in code points. A text of any length is labelled whole; texts are
    taken up by about a million bytes at a time. Repeated rows are labelled each, other columns stay, whatever their names, columns named like the results are replaced, and an empty table gives no rows.
    """
    made = ("lang_pred", "score", "lang_spans")
    names = [c for c in docs.columns if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])))])
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in texts:
            parts = [_identified(batch.slice(a, b - a).to_pylist(), model, penalty) for a, b in textops.pieces([batch], len(batch), 512, 1 << 20)]
            pred, score, found = (sum((p[k] for p in parts), []) for k in range(3))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, span_kind)], names=kind.names)

    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # one column, so no name can clash
    out = docs.select(whole, F.arrow_udf(run, kind)("text").alias("found"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(f"found.{c}").alias(c) for c in made])


def _identified(texts: list[str | None], model: dict, penalty: float) -> tuple[list, list, list]:
    langs = model["langs"]
    w = Words(texts)
    if not langs or not len(w.starts):
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    labels = viterbi(word_scores(w, model), w.first, penalty)
    row = np.repeat(np.arange(len(texts)), np.diff(w.first))
    letters = np.bincount(row * len(langs) + labels, weights=w.letters, minlength=len(texts) * len(langs)).reshape(len(texts), len(langs))
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    pred = [langs[k] if n else "und" for k, n in zip(top.tolist(), total.tolist(), strict=True)]
    score = [float(letters[i, k] / n) if n else 0.0 for i, (k, n) in enumerate(zip(top.tolist(), total.tolist(), strict=True))]
    # a span ends where the label or the text changes
    begin = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])]))
    end = np.concatenate([begin[1:], [len(labels)]]) - 1
    base = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    found: list[list] = [[] for _ in texts]
    for a, b, r, x in zip(w.starts[begin].tolist(), w.ends[end].tolist(), row[begin].tolist(), labels[begin].tolist(), strict=True):
        found[r].append({"start": a - int(base[r]), "end": b - int(base[r]), "lang": langs[x]})
    return pred, score, found
