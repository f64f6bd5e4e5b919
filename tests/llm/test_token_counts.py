import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import q_token_counts, token_counts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "a  b", "a \n b", "a\nb", "\na", "a\n", "▁", "a▁b", "<s> x</s><unk>", "ﬁ Ⅳ é", "a\tb\r\n c", "\x00a", "x" * 5000, "日本 語\n한국", "a\n  b   c \n\n d", "😀 \n😀"]


def test_cutting_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    cutter = token_counts.Cutter(open(PATH, "rb").read(), cache=3)
    assert cutter.exact
    for text in ODD:
        assert cutter.count(text) == len(sp.encode(text)), repr(text)


def test_query_equals_brute_force(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {r.doc_id: (len(r.text.encode()), len(sp.encode(r.text))) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = q_token_counts.op9_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    rows = [(1, None, 7), (1, None, 7), (2, "", 7), (None, "a b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH, limit=1).collect())
    assert got == [(-1, 3, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)]
    assert token_counts.count_tokens(docs.where(F.lit(False)), PATH).count() == 0
