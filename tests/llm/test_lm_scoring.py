import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import lm_scoring as lm
from tidemark.llm import q_lm_scoring


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), None]


def base(docs, train):
    counts = Counter(t for (_, text), use in zip(docs, train, strict=True) if use for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        t = tokens(text)
        out.append((i, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("sf", "gain"), [("sf0.01", 0.015)])
def test_query_counts_and_held_out_score(spark, sf, gain):
    folder = f"{TESTDATA}/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = base(docs, [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs])
    got = sorted(q_lm_scoring.op6_lm_scoring(spark, folder).collect(), key=lambda r: repr((r.doc_id,)))
    for r, w in zip(got, sorted(want, key=lambda x: repr(x[:1])), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > (1 - gain) * sum(r.base_score for r in held)  # both negative: the model is better


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 60_000)  # several shards
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text")
    want = None
    for parts in (1, 4, 16):
        got = {r.doc_id: r.score for r in lm.lm_scores(docs.repartition(parts, "text"), F.col("doc_id") % 7 != 2).collect()}
        want = want or got
        assert got == pytest.approx(want, rel=1e-6)


def test_rare_tokens_joined_and_edges(spark):
    docs = [(1, "a b a C"), (2, None), (2, None), (3, "a zzz b b b"), (None, "é a\tnew"), (4, "x " * 3000)]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, score double")
    train = [d[0] is not None and d[0] < 4 for d in docs]
    for frequent in (1 << 19, 2):
        rows = lm.lm_scores(df, F.coalesce(F.col("doc_id") < 4, F.lit(False)), frequent).collect()
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=repr)
        for g, w in zip(got, base(docs, train), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4])
        assert all(r.score < 0 for r in rows)
    assert lm.lm_scores(df.limit(0), F.lit(True)).count() == 0
    assert {r.n_known for r in lm.lm_scores(df, F.lit(False)).collect()} == {0}


def test_tokens_are_normalised_and_training_helps():
    texts = pa.array(["the cat sat on the mat", "the dog sat on the mat"] * 400)
    t = lm.Tokens(texts)
    kinds, ids = np.unique(t.hash, return_inverse=True)
    size = np.bincount(ids, minlength=700) + 1.0
    model = lm.LogBilinear(size / size.sum())
    one, two = lm.contexts(ids, t.first)
    z = lambda m: np.stack([m.normalisers(k) for k in range(len(m.context))])
    before = model.log_prob(one, two, ids, z(model)).mean()
    trainer = lm.Trainer(model, 0.1)
    for _ in range(150):
        trainer.step(one, two, ids)
    assert model.log_prob(one, two, ids, z(model)).mean() > before + 1
    group, centres = model.clustered(size, 64)
    assert group.max() < 64 and centres.shape == (64, lm.DIM)
    small = lm.LogBilinear(model.prior, group, np.concatenate([centres.ravel(), model.flat()[model.context.size :]]))
    for m in (model, small):
        table = z(m)
        for k in (0, 3, 650):
            p = np.exp(m.log_prob(np.full(700, k), np.full(700, 1), np.arange(700), table))
            assert p.sum() == pytest.approx(1, abs=1e-3)


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", "u", "v", "w", 2.0)], "doc_id long, text string, id string, row string, p string, score double")
    (r,) = lm.lm_scores(df, F.lit(True)).collect()
    assert (r.id, r.row, r.p) == ("u", "v", "w") and r.score < 0
