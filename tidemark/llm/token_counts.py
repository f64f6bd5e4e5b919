"""Token counts by a two-tier lookup on the map side.

A text falls into pre-tokens that no merge of the vocabulary can cross: runs of the space symbol with what
follows, cut again at every line feed. Tier one is a broadcast table of the token counts of frequent
pre-tokens. Tier two encodes a miss with the library and keeps the answer in a bounded cache of the worker.
Pre-tokens are never shuffled; the plan is one scan and one projection, after the pre-tokens of a bounded sample of documents
from all partitions were counted for tier one.

Cutting is exact only where no piece of the vocabulary holds a line feed, or the space symbol after another
character; ``Cutter`` checks both (and that the model has no user-defined symbol and normalises nothing) and
else encodes whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The symbol that stands for a space in the vocabulary (fixed value of the library).
SPACE = "▁"

#: Characters of the longest pre-token that is kept.
LONG = 64


class Lengths(dict):
    """Pre-token -> number of tokens. Misses are encoded; about ``most`` bytes of them are kept, and no long ones."""

    def __init__(self, frequent: dict[str, int], encode, most: int = 64 << 20):
        super().__init__(frequent)
        self.encode, self.room, self.most = encode, most, most
        self.frequent = frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) > LONG:
            return n
        size = 150 + 4 * len(piece)  # the string, its number and their place
        if self.room < size:
            self.clear()
            self.update(self.frequent)
            self.room = self.most
        self.room -= size
        self[piece] = n
        return n


class Cutter:
    """Counts tokens of whole texts with one sentencepiece model."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None, cache: int = 64 << 20):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not self.sp.is_control(i) and not self.sp.is_byte(i)]
        whole = any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.exact = not whole and self._keeps_characters()
        self.lengths = Lengths(frequent or {}, self._encode, cache)

    def _keeps_characters(self) -> bool:
        """Encoding changes no character, and puts just one space before the text."""
        sp = self.sp
        for text in ("a", "  a  b", "ﬁ Ⅳ é", "A\tb"):
            back = b"".join(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.encode() for i, p in zip(sp.encode(text), sp.encode(text, out_type=str), strict=True))
            if back.decode() != SPACE + text.replace(" ", SPACE):
                return False
        return True

    def _encode(self, piece: str) -> list[int]:
        """``piece`` begins with the space symbol, or follows a line feed and begins with the mark \\n."""
        if piece[0] == "\n":  # the library's leading space and the line feed are a token each
            return self.sp.encode(piece)[2:]
        if not piece.strip(SPACE):  # the library gives nothing for an empty text, so a line feed stands in
            return self.sp.encode(piece[1:] + "\n")[:-1]
        return self.sp.encode(piece[1:])

    @staticmethod
    def cut(text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many line feeds stand between them."""
        text = text.replace(" ", SPACE)
        found: list[str] = []
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if k == 0:
                found += _runs(SPACE + line)
            elif line:
                found += _runs("\n" + line)
        return found, len(lines) - 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.exact:
            return len(self.sp.encode(text))
        pieces, feeds = self.cut(text)
        return sum(map(self.lengths.__getitem__, pieces)) + feeds


def _runs(line: str) -> list[str]:
    """Cuts before each run of space symbols; a line begins with one, or with the mark for a line feed."""
    if SPACE * 2 not in line and not line.startswith("\n" + SPACE):
        head, *rest = line.split(SPACE)
        return [head] * bool(head) + [SPACE + x for x in rest]
    found, run = [], ""
    head, *rest = line.split(SPACE)
    if head and head != "\n":
        found.append(head)
    for x in rest:
        run += SPACE
        if x:
            found.append(run + x)
            run = ""
    if run:
        found.append(run)
    return found


def frequent_lengths(docs: DataFrame, model: bytes, sample_docs: int, keep: int) -> dict[str, int]:
    """Tier one: counts of the ``keep`` most frequent pre-tokens of about ``sample_docs`` documents, chosen by hash.

    The sample comes from all partitions alike. It only decides what is fast: a pre-token missing here is encoded in full by
    the worker that meets it, as is any longer than LONG characters.
    """
    if not Cutter(model).exact:
        return {}
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).where("text IS NOT NULL").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in dict.fromkeys(batch.column(0).to_pylist()):  # copies count once
                seen.update(p for p in Cutter.cut(text)[0] if len(p) <= LONG)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "n"])

    top = sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(keep).collect()
    cutter = Cutter(model)
    return {r["piece"]: len(cutter._encode(r["piece"])) for r in top}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, sample_docs: int = 1000, keep: int = 50_000, cache: int = 64 << 20) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to documents with a ``text`` column.

    Whole texts are counted as the model's library gives them, with no begin or end tokens. A null text is
    empty: 0 bytes, 0 tokens; one of any length is counted whole. Rows keep their other columns (a column named like one of the results is
    replaced), repeated rows are counted each, and an empty table gives no rows. The model file is read on
    the driver and broadcast; executors need no copy.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    shared = spark.sparkContext.broadcast((model, frequent_lengths(docs, model, sample_docs, keep)))
    held = {}

    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "cutter" not in held:
            held["cutter"] = Cutter(*shared.value, cache)
        for batch in texts:
            yield pa.array([held["cutter"].count(x.as_py()) for x in batch], pa.int64())

    counted = F.arrow_udf(count, "long")
    return docs.select(
        "*",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
