import zlib

import numpy as np
import pytest

from tests.conftest import TESTDATA
from tidemark.llm import language_id as li
from tidemark.llm import q_language_id


def test_held_out_accuracy(spark):
    folder = f"{TESTDATA}/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = q_language_id.op10_language_id(spark, folder).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog went with that thing", "en"), ("der hund und die katze gehen nicht mit", "de"), ("кошка и собака", "ru"), ("собака", "bg"), (None, "xx"), ("lost", None)] * 3
    return li.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_mixed_text_and_scripts(model):
    assert model["langs"] == ["bg", "de", "en", "ru"]
    text = "the cat and the dog went 12 кошка и собака, der hund und die katze gehen"
    found = li.spans(text, model, penalty=2.0)
    assert [x for *_, x in found] == ["en", "ru", "de"]
    assert [text[a:b] for a, b, _ in found][1] == "кошка и собака"


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(1)
    first = np.array([0, 5, 5, 6, 11])
    scores = r.normal(size=(11, 3)).astype(np.float32)
    labels = li.viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(path, a=a, b=b):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(labels[a:b].tolist()) == pytest.approx(best, abs=1e-5)


def test_edges(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (3, "12 !!", "x"), (None, "the dog", "x"), (5, "the dog " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in li.identify(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[5].lang_pred == got[None].lang_pred == "en" and len(got[5].lang_spans) == 1
    assert li.identify(df.limit(0), model).count() == 0
    nothing = li.fit(df.limit(0).selectExpr("text", "lang_pred AS lang"))
    assert {r.lang_pred for r in li.identify(df, nothing).collect()} == {"und"}
